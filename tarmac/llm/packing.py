"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised where they lie; only the lengths of their pieces travel. All further
planning happens on the histogram of lengths, which has at most `capacity` entries however many
pieces there are. Per sequence, the longest length left is fixed and a subset-sum table over bit
sets finds the fullest combination of the lengths that are left; the combination is removed as
often as its lengths last, so the plan has at most as many patterns as there are lengths. A
piece finds its place from its rank among the pieces of its length; ranks come from counts per
hashed cell of the pieces, so that even one length with a third of all pieces is ranked by many
tasks.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.shared import in_batches, spans_of, stored, utf8
from tarmac.llm.words import CASED, SPACED, mix, numbered, words

CAPACITY = 4096
END = 1
CELL_ROWS = 20_000
CACHE = 400_000  # stretches that are remembered
GROUP = 512  # stretches encoded as one text
STRETCH = 1 << 20
BORDER = b"|"
_SPACE = re.compile(rb"[\x09-\x0d ]")


def _kinds() -> np.ndarray:
    """1 for ASCII letters, 2 for ASCII signs, 3 for digits, 0 for bytes that may belong to what stands beside them."""
    out = np.zeros(256, np.uint8)
    out[[c for c in range(33, 127) if c != ord("'")]] = 2
    out[48:58] = 3
    out[65:91] = out[97:123] = 1
    return out


KINDS = _kinds()


def _cuts_by_kind(tokenizer) -> bool:
    """Whether a tokenizer always parts ASCII letters, signs and single digits, and takes no notice of A-Z or a-z."""
    parts = lambda text: [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    signs = [chr(c) for c in range(33, 127) if KINDS[c] == 2]
    if tokenizer.pre_tokenizer is None or tokenizer.normalizer is None or any(len(parts(f"ab{c}cd")) != 3 for c in signs):
        return False
    letters = "".join(chr(c) for c in range(33, 127))
    return parts("ab1cd23%4") == ["ab", "1", "cd", "2", "3", "%", "4"] and tokenizer.normalizer.normalize_str(letters) == letters.lower()


class Encoder:
    """Token ids of whole texts, remembered by stretches that the tokenizer never joins.

    White space parts stretches; with a tokenizer that parts letters, signs and digits, so do the
    borders between these, and there are few different ones. Stretches are found and numbered without
    a step for each; only new ones reach the tokenizer. The memory is sorted arrays of numbers and one
    of ids; it starts anew once it holds CACHE stretches. A block with a special token's own sign in
    it is parted at white space alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_kind = _cuts_by_kind(self.tokenizer)
        self.border = self._ids([BORDER.decode()])[0]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, raw: np.ndarray, offsets: np.ndarray, whole: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, byte starts and ends of all stretches, and where each row's begin (n + 1)."""
        if not self.by_kind or any(x in whole for x in self.special):
            numbers, starts, ends, at = words(raw, offsets, SPACED, CASED)
            return mix(numbers), starts, ends, at  # apart from those without regard to case
        inside, kind = SPACED[raw], KINDS[raw]
        part = np.ones(len(raw) + 1, bool)  # before each byte, and after the last
        part[offsets] = True
        same = (kind[1:] == kind[:-1]) & (kind[1:] != 3) | (kind[1:] == 0) | (kind[:-1] == 0)
        part[1:-1] = ~(same & inside[1:] & inside[:-1])
        part[offsets] = True
        starts = np.flatnonzero(inside & part[:-1])
        ends = np.flatnonzero(inside & part[1:]) + 1
        return numbered(raw, starts, ends), starts, ends, np.searchsorted(starts, offsets)

    def learn(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        """Encode new stretches, many at a time with a border between; those that hold the border's sign, alone."""
        plain = [k for k, x in enumerate(stretches) if BORDER not in x] if len(self.border) == 1 else []
        alone = sorted(set(range(len(stretches))).difference(plain))
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        found, sizes = [], []
        for ids in self._ids([b"\n|\n".join([stretches[k] for k in g]).decode() for g in groups]):
            border = ids == self.border[0]
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(border), [len(ids)]])) - 1)
            found.append(ids[~border])
        for ids in self._ids([stretches[k].decode() for k in alone]):
            sizes.append(np.array([len(ids)]))
            found.append(ids)
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *found])
        keys = np.concatenate([self.keys, keys[plain + alone]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin (n + 1)."""
        whole = raw.tobytes()
        numbers, starts, ends, at = self._stretches(raw, offsets, whole)
        distinct, first, entry = np.unique(numbers, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        slot = np.searchsorted(self.keys, distinct)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            self.learn(distinct[new], [whole[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            slot = np.searchsorted(self.keys, distinct)
        size, begin = self.size[slot][entry], self.begin[slot][entry]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.ids[source], total[at]

    def encode_long(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one long text, worked through in stretches that end at white space."""
        out, at, whole = [np.zeros(0, "<u4")], 0, text.tobytes()
        while at < len(text):
            border = _SPACE.search(whole, at + STRETCH)
            end = border.end() if border else len(text)
            out.append(self.encode(text[at:end], np.array([0, end - at]))[0])
            at = end
        ids = np.concatenate(out)
        return ids, np.array([0, len(ids)])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(path: str, capacity: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = encoder(path)
        columns: list[list] = [[] for _ in range(5)]  # row, piece, start, length, crc
        raw, offsets = utf8(batch.column(1))
        for a, b in spans_of(offsets, STRETCH):
            part = raw[offsets[a] : offsets[b]]
            ids, begins = known.encode_long(part) if b == a + 1 else known.encode(part, offsets[a : b + 1] - offsets[a])
            ids = np.insert(ids, begins[1:], END)
            begins = begins + np.arange(b - a + 1)
            length = np.diff(begins)
            count = -(-length // capacity)
            row = np.repeat(np.arange(b - a), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            size = np.minimum(length[row] - start, capacity)
            data = memoryview(ids.astype("<u4").tobytes())
            first = 4 * (begins[row] + start)
            crc = np.array([zlib.crc32(data[x:y]) for x, y in zip(first.tolist(), (first + 4 * size).tolist())], np.int64)
            for column, values in zip(columns, (row + a, piece, start, size, crc)):
                column.append(values)
        row, piece, start, size, crc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns)
        taken = batch.column(0).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([taken, pa.array(piece.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (start, size, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return work


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    return in_batches(docs.select("doc_id", "text"), _cut(tokenizer, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(lengths: list[int], counts: Counter, room: int) -> list[int]:
    """The combination of available lengths (longest first in `lengths`) with the largest sum up to `room`.

    Bit s of a layer tells that the lengths so far can sum to s; layers are walked back to read
    the combination off. The search ends early where the room can be filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for size in lengths:
        if size > room:
            continue
        left, step = min(counts[size], room // size), 1
        while left > 0:
            step = min(step, left)
            more = (reach | reach << (size * step)) & mask
            layers.append((size, step, reach))
            reach, left, step = more, left - step, step * 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: list[int] = []
    for size, step, before in reversed(layers):
        if not before >> best & 1:
            out += [size] * step
            best -= size * step
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(copies, lengths) of every pattern of sequences that together hold all pieces."""
    counts = Counter({size: n for size, n in histogram.items() if n})
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        counts[lengths[0]] -= 1
        pattern = [lengths[0], *fullest(lengths, counts, capacity - lengths[0])]
        counts[lengths[0]] += 1
        need = Counter(pattern)
        copies = min(counts[size] // n for size, n in need.items())
        for size, n in need.items():
            counts[size] -= copies * n
        lengths = [size for size in lengths if counts[size]]
        out.append((copies, pattern))
    return out


def _places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the rank ranges: first rank, pieces per sequence, first sequence, first offset."""
    used: Counter = Counter()
    out: dict[int, list] = {}
    sequence = 0
    for copies, pattern in patterns:
        offset = 0
        for size, n in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(size, []).append((used[size], n, sequence, offset))
            used[size] += n * copies
            offset += n * size
        sequence += copies
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def _placed(sent):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            table = sent.value[int(size)]
            row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
            inside = rank[own] - row[:, 0]
            sequence[own] = row[:, 2] + inside // row[:, 1]
            offset[own] = row[:, 3] + inside % row[:, 1] * size
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    A null or empty text is the end mark alone. Repeated rows are packed each, as are rows
    without doc_id; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    total = cut.count()
    cells = max(1, math.ceil(total / CELL_ROWS))
    cut = cut.withColumn("cell", F.pmod(F.hash("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    counts = stored(cut.groupBy("length", "cell").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    sent = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))  # at most capacity * sqrt(2 * capacity) rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")
    counts = counts.select("length", "cell", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("within", within).join(counts, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    return in_batches(ranked, _placed(sent), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
