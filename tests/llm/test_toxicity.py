import random
import zlib

import numpy as np
from tests.llm.samples import clashing, documents, frame, odd

from tarmac.llm import toxicity as t

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lon mar nis pel qua".split()]
    rows, label = [], []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 300))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "grobnak" + rng.choice(plain)])
        rows.append(" ".join(words)), label.append(int(bad))
    return rows, np.array(label)


def test_learns_words_and_word_beginnings():
    texts, label = corpus()
    network = t.fit(texts[:300], label[:300])
    raw = [x.encode() for x in texts[300:]]
    score = network.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert ((score >= 0.5) == label[300:]).mean() >= 0.95


def test_gradient():
    texts, label = corpus(6)
    raw = [x.encode() for x in texts]
    v, entry, at = t.read_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rng = np.random.default_rng(0)
    ties = tuple(rng.normal(size=1 << t.BITS).astype(np.float32) for _ in range(2))
    network = t.Network.start(ties)
    first, end, count = t.windows(at)
    y = np.repeat(label, count)
    args = (v, ties, entry, first, end, y, np.ones(len(first)))

    def loss():
        z = network.logits(network.inputs(v) @ network.p["wx"] + network.p["bx"], entry, first, end).astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z))))

    grads = network.gradient(*args)
    for name in ("wx", "bx", "uf", "ub", "att", "out", "b"):
        p, step = network.p[name].reshape(-1), 1e-2
        k = int(np.argmax(np.abs(grads[name].reshape(-1))))
        old = p[k]
        p[k] = old + step
        up = loss()
        p[k] = old - step
        down = loss()
        p[k] = old
        assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[k]) < 2e-3 + 0.05 * abs(grads[name].reshape(-1)[k]), name


def test_windows_cover_every_word():
    at = np.cumsum([0, 0, 1, 16, 17, 32, 33, 48, 49, 500])
    first, end, count = t.windows(at)
    seen = {i for a, e in zip(first, end) for i in range(a, min(a + t.WINDOW, e))}
    assert seen == set(range(at[-1])) and count.tolist() == [0, 1, 1, 1, 1, 2, 2, 3, 31]


def test_held_out_labels_and_other_columns_are_never_used(spark):
    texts, label = corpus(160)
    docs = [(k, x) for k, x in enumerate(texts)]
    kept = [(k, 0, int(y)) for k, y in enumerate(label)]
    turned = [(k, 1, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, _, y in kept] + [(k, 0, None) for k in range(5)]
    one = {r.doc_id: r for r in t.toxicity(frame(spark, docs), frame(spark, kept, LABELS)).collect()}
    two = {r.doc_id: r for r in t.toxicity(clashing(spark, docs), frame(spark, turned, LABELS)).collect()}
    assert one == two
    for k, r in one.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [k for k, r in one.items() if r.held_out]
    assert np.mean([one[k].predicted == label[k] for k in held]) >= 0.9


def test_odd_rows_and_nothing_to_learn(spark):
    rows = odd(documents(spark, 20))
    none = frame(spark, [], LABELS)
    assert {r.score for r in t.toxicity(clashing(spark, rows), none).collect()} == {0.0}
    assert t.toxicity(frame(spark, []), none).collect() == []
    texts, label = corpus(60)
    network = t.fit(texts, label)
    got = sorted((tuple(r) for r in t.scored(frame(spark, rows), network).select("row.doc_id", "score").collect()), key=str)
    assert len(got) == len(rows) and dict(got)[10**6] == dict(got)[10**6 + 1] == dict(got)[10**6 + 2] == 0.0


def test_score_does_not_depend_on_the_batch():
    texts, label = corpus(80)
    network = t.fit(texts, label)
    raw = [x.encode() for x in texts]
    whole = network.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    alone = [network.score(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in raw]
    assert np.allclose(whole, alone, atol=1e-5)


def auc(score, label):
    """Chance that a text with label 1 scores higher than one with label 0; ties count half."""
    _, rank, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[rank]
    bad = label.sum()
    return (rank[label == 1].sum() - bad * (bad + 1) / 2) / (bad * (len(label) - bad))


def test_network_beats_its_own_inputs(spark):
    """On held-out texts the network ranks better than any of the label ties it is fed, in a text's worst window or over the whole text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    network = t.fitted(t.training_sample(docs, labels))
    held = docs.join(labels.where("toxic is not null"), "doc_id").where(t.held_out("doc_id")).where("length(text) > 0").orderBy("doc_id").select("text", "toxic").collect()
    raw, label = [r.text.encode() for r in held], np.array([r.toxic for r in held])
    offsets = np.cumsum([0, *map(len, raw)])
    joined = np.frombuffer(b"".join(raw), np.uint8)
    own = auc(network.score(joined, offsets), label)
    vocabulary, entry, at = t.read_words(joined, offsets)
    x = network.inputs(vocabulary)
    first, end, count = t.windows(at)
    some = count > 0
    for tie in (x[:, 2 * t.WIDTH], x[:, 2 * t.WIDTH + 1], x[:, 2 * t.WIDTH] + x[:, 2 * t.WIDTH + 1]):
        sums = np.concatenate([[0], np.cumsum(tie[entry])])
        window = sums[np.minimum(first + t.WINDOW, end)] - sums[first]
        worst = np.zeros(len(count))
        worst[some] = np.maximum.reduceat(window, (np.cumsum(count) - count)[some])
        assert own > max(auc(worst, label), auc(sums[at[1:]] - sums[at[:-1]], label))
    assert own > 0.95


def test_of_a_repeated_id_the_smallest_text_is_learnt(spark):
    docs = frame(spark, [(1, "b"), (1, "a"), (2, "c"), (3, None), (4, "x" * (t.LONGEST + 1))])
    labels = frame(spark, [(1, 0, 1), (2, 0, 0), (2, 0, 1), (3, 0, 1), (4, 0, 1)], LABELS)
    known = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5}
    got = {r.doc_id: (r.text, r.toxic) for r in t.training_sample(docs, labels).collect()}
    assert got == {i: x for i, x in {1: ("a", 1), 2: ("c", 1)}.items() if i in known}
