"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input per word: trained vectors of the word and of its character five-grams (both hashed), and
how strongly word and five-grams are tied to the label in the training sample (a lower
confidence bound of their log odds; while fitting, taken from the other half of the sample).
The network reads windows of 32 words that overlap by half, all of them; a text's score is that
of its worst window. Texts are labelled as a whole, so fitting goes on with the worst window of
every text, found anew in every round.

Gates and candidates use x / (1 + |x|) in place of sigmoid and tanh.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.shared import ready, spans_of, utf8, with_value
from tarmac.llm.words import ALPHANUMERIC, LETTERS, mix, words

WINDOW, STRIDE = 32, 16
GRAM = 5
BITS = 18
WIDTH = 4  # of each trained vector
HIDDEN = 8
FOLDS = 5
SAMPLE = 1500  # labelled texts of each class that the network is fitted on, at most
LONGEST = 30_000  # characters of a text in that sample, at most
ROUNDS = 10
BLOCK = 1 << 20
INPUTS = 2 * WIDTH + 3


@dataclass
class Vocabulary:
    """The distinct words of a block: bucket of each, buckets of their five-grams, where a word's begin."""

    word: np.ndarray
    grams: np.ndarray
    begins: np.ndarray


def read_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, every word's entry in it, and where each row's words begin (n + 1)."""
    numbers, starts, ends, at = words(raw, offsets, ALPHANUMERIC)
    distinct, first, entry = np.unique(numbers, return_index=True, return_inverse=True)
    length = ends[first] - starts[first]
    count = np.maximum(length + 2 - GRAM + 1, 1)
    begins = np.concatenate([[0], np.cumsum(count)])
    # Letters of all distinct words, each between two marks.
    stops = np.concatenate([[0], np.cumsum(length + 2)])
    codes = np.full(stops[-1] + GRAM, 7, np.uint64)
    inside = np.ones(stops[-1], bool)
    inside[stops[:-1]] = inside[stops[1:] - 1] = False
    source = np.repeat(starts[first], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    codes[np.flatnonzero(inside)] = LETTERS[raw[source]]
    place = np.repeat(stops[:-1], count) + (np.arange(begins[-1]) - np.repeat(begins[:-1], count))
    gram = np.zeros(begins[-1], np.uint64)
    for k in range(GRAM):
        gram = mix(gram + codes[place + k])
    shift = np.uint64(64 - BITS)
    return Vocabulary((distinct >> shift).astype(np.int64), (gram >> shift).astype(np.int64), begins), entry, at


def part_of(v: Vocabulary, which: np.ndarray) -> Vocabulary:
    """The entries `which` alone."""
    count = np.diff(v.begins)[which]
    place = np.repeat(v.begins[which], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return Vocabulary(v.word[which], v.grams[place], np.concatenate([[0], np.cumsum(count)]))


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of the words of every window, and each row's number of windows."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(-(-(n - (WINDOW - STRIDE)) // STRIDE), 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return at[row] + number * STRIDE, at[row + 1], count


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    """Parameters; `ties` holds the two tables of label ties, for words and five-grams."""

    p: dict[str, np.ndarray]
    ties: tuple[np.ndarray, np.ndarray]
    base: float | None = None  # the score of every text, where there was nothing to learn from

    @staticmethod
    def start(ties: tuple[np.ndarray, np.ndarray]) -> "Network":
        rng = np.random.default_rng(11)

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        p = {
            "word": normal(1 << BITS, WIDTH, scale=0.05), "gram": normal(1 << BITS, WIDTH, scale=0.05),
            "wx": normal(INPUTS, 6 * HIDDEN, scale=0.4), "bx": np.zeros(6 * HIDDEN, np.float32),
            "uf": normal(HIDDEN, 3 * HIDDEN, scale=0.3), "ub": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.5), "b": np.zeros(1, np.float32),
        }
        return Network(p, ties)

    def inputs(self, v: Vocabulary, ties: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        by_word, by_gram = ties or self.ties
        tied = by_gram[v.grams]
        count = np.diff(v.begins).astype(np.float32)
        out = np.empty((len(v.word), INPUTS), np.float32)
        out[:, :WIDTH] = self.p["word"][v.word]
        if len(v.word):
            out[:, WIDTH : 2 * WIDTH] = np.add.reduceat(self.p["gram"][v.grams], v.begins[:-1], axis=0) / count[:, None]
            out[:, 2 * WIDTH] = by_word[v.word]
            out[:, 2 * WIDTH + 1] = np.maximum.reduceat(tied, v.begins[:-1])
            out[:, 2 * WIDTH + 2] = np.add.reduceat(tied, v.begins[:-1]) / count
        return out

    def logits(self, gates: np.ndarray, entry: np.ndarray, first: np.ndarray, end: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logit of every window; `gates` are the projected inputs of the vocabulary."""
        p, n = self.p, len(first)
        place = first + np.arange(WINDOW)[:, None]
        mask = (place < end).astype(np.float32)[:, :, None]
        which = entry[np.minimum(place, len(entry) - 1)]
        hidden = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        for side, u in enumerate((p["uf"], p["ub"])):
            own = np.ascontiguousarray(gates[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
                a, hu = own[which[t]], h @ u
                g = a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
                g /= 1 + np.abs(g)
                g *= 0.5
                g += 0.5
                c = a[:, 2 * HIDDEN :] + g[:, HIDDEN:] * hu[:, 2 * HIDDEN :]
                c /= 1 + np.abs(c)
                new = (h + g[:, :HIDDEN] * (c - h)) * mask[t]
                if trace is not None:
                    trace[side, t] = (h, g, c, hu[:, 2 * HIDDEN :])
                h = new
                hidden[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        weight = np.exp(np.clip(hidden @ p["att"], -30, 30)) * mask[:, :, 0]
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, hidden)
        if trace is not None:
            trace |= {"which": which, "mask": mask, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ p["out"] + p["b"][0]

    def gradient(self, v: Vocabulary, ties: tuple, entry: np.ndarray, first: np.ndarray, end: np.ndarray, label: np.ndarray, importance: np.ndarray) -> dict:
        """Gradients of the mean logistic loss of some windows."""
        p, trace = self.p, {}
        place = np.minimum(first[:, None] + np.arange(WINDOW), len(entry) - 1)
        own, near = np.unique(entry[place], return_inverse=True)
        v, entry = part_of(v, own), near.reshape(-1)
        end = np.arange(len(first)) * WINDOW + np.minimum(end - first, WINDOW)
        first = np.arange(len(first)) * WINDOW
        x = self.inputs(v, ties)
        gates = x @ p["wx"] + p["bx"]
        logit = self.logits(gates, entry, first, end, trace)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) * importance / len(label)).astype(np.float32)
        hidden, weight, mask, which = trace["hidden"], trace["weight"], trace["mask"], trace["which"]
        out = {"b": np.array([d.sum()], np.float32), "out": trace["pooled"].T @ d}
        dpool = d[:, None] * p["out"]
        da = np.einsum("tnh,nh->tn", hidden, dpool)
        ds = weight * (da - (weight * da).sum(axis=0))
        out["att"] = np.einsum("tn,tnh->h", ds, hidden)
        dhidden = weight[:, :, None] * dpool + ds[:, :, None] * p["att"]
        dgates = np.zeros_like(gates)
        for side, name in enumerate(("uf", "ub")):
            u, du = p[name], np.zeros_like(p[name])
            back = np.zeros((len(first), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1) if side == 0 else range(WINDOW):
                before, g, c, huc = trace[side, t]
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                dh = (dhidden[t, :, side * HIDDEN : (side + 1) * HIDDEN] + back) * mask[t]
                dc = dh * z * (1 - np.abs(c)) ** 2
                dg = np.concatenate([dh * (c - before), dc * huc], axis=1) * 0.5 * (1 - np.abs(2 * g - 1)) ** 2
                dhu = np.concatenate([dg, dc * r], axis=1)
                du += before.T @ dhu
                back = dh * (1 - z) + dhu @ u.T
                np.add.at(dgates[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN], which[t], np.concatenate([dg, dc], axis=1))
            out[name] = du
        out["wx"], out["bx"] = x.T @ dgates, dgates.sum(axis=0)
        dx = dgates @ p["wx"].T
        count = np.diff(v.begins)
        out["word"] = (v.word, dx[:, :WIDTH])
        out["gram"] = (v.grams, np.repeat(dx[:, WIDTH : 2 * WIDTH] / count[:, None], count, axis=0))
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of every row; a text without words scores 0."""
        if self.base is not None:
            return np.full(len(offsets) - 1, self.base)
        vocabulary, entry, at = read_words(raw, offsets)
        first, end, count = windows(at)
        out = np.zeros(len(count))
        if len(first):
            gates = self.inputs(vocabulary) @ self.p["wx"] + self.p["bx"]
            logit = np.concatenate([self.logits(gates, entry, first[k : k + 4096], end[k : k + 4096]) for k in range(0, len(first), 4096)])
            some = np.flatnonzero(count)
            worst = np.maximum.reduceat(logit, (np.cumsum(count) - count)[some])
            out[some] = 1 / (1 + np.exp(-np.clip(worst.astype(np.float64), -30, 30)))
        return out


def label_ties(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Per bucket the log odds of the label, drawn towards 0 by two standard errors.

    seen: how many texts of either class have each bucket; texts: how many there are of either.
    """
    good, bad = seen
    n = texts + 1
    odds = np.log((bad + 0.5) / n[1]) - np.log((good + 0.5) / n[0])
    error = 2 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return (np.sign(odds) * np.maximum(np.abs(odds) - error, 0)).astype(np.float32)


@dataclass
class _Adam:
    rate: float
    step: int = 0
    state: dict = field(default_factory=dict)

    def apply(self, p: dict, grads: dict) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for name, g in grads.items():
            m, s = self.state.setdefault(name, (np.zeros_like(p[name]), np.zeros_like(p[name])))
            if isinstance(g, tuple):  # rows of a table
                rows, place = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                np.add.at(total, place, g[1])
                m[rows] = 0.9 * m[rows] + 0.1 * total
                s[rows] = 0.999 * s[rows] + 0.001 * total**2
                p[name][rows] -= 0.2 * scale * m[rows] / (np.sqrt(s[rows]) + 1e-7)
            else:
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p[name] -= scale * m / (np.sqrt(s) + 1e-7)


def fit(texts: list[str], label: np.ndarray) -> Network:
    """A network from whole labelled texts; with fewer than two of a class, a constant score."""
    label = np.asarray(label, np.float64)
    if label.sum() < 2 or (1 - label).sum() < 2:
        return Network({}, (), float((label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.0))
    joined = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in joined])]).astype(np.int64)
    vocabulary, entry, at = read_words(np.frombuffer(b"".join(joined), np.uint8), offsets)
    first, end, count = windows(at)
    row = np.repeat(np.arange(len(texts)), count)

    def ties(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ties of words and five-grams, counted text by text."""
        by_word, by_gram = np.zeros((2, 1 << BITS)), np.zeros((2, 1 << BITS))
        for r in np.flatnonzero(chosen):
            own = part_of(vocabulary, np.unique(entry[at[r] : at[r + 1]]))
            by_word[int(label[r]), np.unique(own.word)] += 1
            by_gram[int(label[r]), np.unique(own.grams)] += 1
        texts = np.bincount(label[chosen].astype(int), minlength=2)
        return label_ties(by_word, texts), label_ties(by_gram, texts)

    half = np.zeros(len(texts), bool)
    for value in (0, 1):
        half[np.flatnonzero(label == value)[::2]] = True
    network = Network.start(ties(np.ones(len(texts), bool)))
    sides = [(half, ties(~half)), (~half, ties(half))]
    adam, rng = _Adam(0.02), np.random.default_rng(5)
    importance = np.where(label == 1, np.sqrt((1 - label.mean()) / label.mean()), 1.0)
    for turn in range(ROUNDS):
        adam.rate = 0.02 * (1 - turn / ROUNDS) + 0.002
        for chosen, tied in sides:
            mine = np.flatnonzero(chosen[row])
            x = network.inputs(vocabulary, tied)
            if turn == 0:
                strength = x[:, 2 * WIDTH] + x[:, 2 * WIDTH + 1]
                sums = np.concatenate([[0], np.cumsum(strength[entry])])
                value = sums[np.minimum(first[mine] + WINDOW, end[mine])] - sums[first[mine]]
            else:
                gates = x @ network.p["wx"] + network.p["bx"]
                value = np.concatenate([network.logits(gates, entry, first[mine[k : k + 4096]], end[mine[k : k + 4096]]) for k in range(0, len(mine), 4096)])
            order = np.lexsort((value, row[mine]))
            worst = mine[order[np.append(row[mine][order][1:] != row[mine][order][:-1], True)]]
            # Every text's worst window, and as many others of clean texts.
            clean = mine[label[row[mine]] == 0]
            todo = rng.permutation(np.concatenate([worst, rng.choice(clean, min(len(clean), len(worst)), replace=False)]))
            for part in np.array_split(todo, max(8, len(todo) // 256)):
                r = row[part]
                adam.apply(network.p, network.gradient(vocabulary, tied, entry, first[part], end[part], label[r], importance[r]))
    return network


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of at most `size` labelled texts of each class outside the held-out fold, chosen by hash.

    Texts over LONGEST are left out; of a repeated doc_id the smallest text counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for v in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * size rows
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(ids, "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [batch for batch in batches if batch.num_rows]
    texts = [x for batch in held for x in batch.column(0).to_pylist()]
    label = np.array([x for batch in held for x in batch.column(1).to_pylist()], np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, label))], pa.binary())], names=["network"])


def fitted(sample: DataFrame) -> Network:
    """A network fitted on `sample` (doc_id, text, toxic) by one task; its rows are bounded, and only parameters reach the driver."""
    ready(sample.sparkSession)
    rows = sample.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
    found = rows.mapInArrow(_fit_rows, "network binary").first()
    return pickle.loads(found.network) if found else fit([], np.zeros(0))


def _score_texts(sent):
    def work(texts: pa.Array) -> pa.Array:
        raw, offsets = utf8(texts)
        score = [np.zeros(0)]
        for a, b in spans_of(offsets, BLOCK):
            score.append(sent.value.score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        return pa.array(np.concatenate(score))

    return work


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of `docs` (with a column text), whole, as `row`, and their `score`."""
    sent = docs.sparkSession.sparkContext.broadcast(network)  # its size is fixed by BITS
    return with_value(docs, _score_texts(sent), T.DoubleType(), "score")


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text), fitted on `labels` (doc_id, toxic).

    Null and empty texts and texts without words score 0. Null labels are not used; with fewer than
    two texts of a class to learn from, every text gets the same score. Repeated rows are scored
    each; a row without doc_id is not held out; other columns are ignored; an empty table gives no
    rows.
    """
    rows = scored(docs.select("doc_id", "text"), fitted(training_sample(docs, labels, size)))
    return rows.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
