import math

import numpy as np
from tests.llm.samples import SF, frame

from tarmac.llm import prefix_forest as f

VECTORS = "vec_id bigint, embedding array<float>, score string"


def plain(rows, every=20, nearest=20):
    good = {}
    for i, x, *_ in rows:
        if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            good[i] = np.array(x, np.float32).astype(np.float64)
    out = {}
    for q in sorted(i for i in good if i % every == 0):
        scored = sorted((-float((good[q] * x).sum()), i) for i, x in good.items() if i != q and len(x) == len(good[q]))
        out[q] = [(i, -s) for s, i in scored[:nearest]]
    return out


def result(df):
    out = {}
    for r in sorted(f.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == {q for q, near in want.items() if near}
    hits = [len({i for i, _ in got[q]} & {i for i, _ in near}) / len(near) for q, near in want.items() if near]
    return sum(hits) / len(hits)


def test_recall_on_given_vectors(spark):
    rows = [(*r, "") for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(result(frame(spark, rows, VECTORS)), plain(rows)) >= 0.9


def test_structure_is_used(spark):
    """Clustered vectors of differing norms: found with few candidates."""
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((40, 16)) * 3
    x = (middle[rng.integers(0, 40, 2000)] + rng.standard_normal((2000, 16)) * 0.3).astype(np.float32)
    rows = [(k, v.tolist(), "") for k, v in enumerate(x)]
    assert recall(result(frame(spark, rows, VECTORS)), plain(rows)) >= 0.9


def test_more_neighbours_from_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(f, "QUERIES", 8)
    monkeypatch.setattr(f, "CHUNK", 128)
    x = np.random.default_rng(4).standard_normal((120, 8)).astype(np.float32)
    rows = [(k, v.tolist(), "") for k, v in enumerate(x)]
    got: dict[int, set[int]] = {}
    for r in f.search(frame(spark, rows, VECTORS), every=2, nearest=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain(rows, 2, 30)
    assert set(got) == set(want) and all(len(near) == 30 for near in got.values())
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * 30 * len(want)


def test_odd_and_repeated_vectors(spark):
    same = [0.5, -0.5, 0.0]
    rows = [(k, same, "") for k in range(0, 300)]
    rows += [(300, [0.5, -0.5, -0.0], ""), (1000, None, ""), (1020, [0.0, 0.0, 0.0], ""), (1040, [1.0, None, 0.0], ""), (1060, [float("nan"), 1.0, 0.0], ""), (1080, [float("inf"), 1.0, 0.0], ""), (1100, [], "")]
    rows += [(None, same, ""), (400, [1.0, 2.0], ""), (500, [1.0, 0.0, 0.0], ""), (500, [1.0, 0.0, 0.0], ""), (501, [-1.0, 0.0, 0.0], "")]
    assert result(frame(spark, rows, VECTORS)) == {q: near for q, near in plain(rows).items() if near}
    assert f.search(frame(spark, [], VECTORS)).collect() == []


def test_effort_is_the_least_that_suffices():
    totals = {1: {1: 100, 2: 40, 3: 10}, 2: {1: 90, 2: 50, 3: 8}}
    assert f.enough(totals, {1: [3, 3], 2: [3, 3]}, 0.9) == 8
    assert f.enough(totals, {1: [2, 2], 2: [2, 2]}, 0.9) == 40
    assert f.enough(totals, {1: [0, 2], 2: [2, 2]}, 0.9) == float("inf")


def test_doubles_are_scored_as_given(spark):
    rows = [(k, [1.0 + k * 1e-12, 0.5, -0.25]) for k in range(60)]
    got = f.search(frame(spark, rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    for q in (0, 20, 40):
        near = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        want = sorted((-sum(a * b for a, b in zip(rows[q][1], x)), i) for i, x in rows if i != q)[:20]
        assert [i for _, i, _ in near] == [i for _, i in want] and all(abs(s + w) < 1e-15 * 8 for (_, _, s), (w, _) in zip(near, want))


def test_no_large_side_is_sent_whatever_its_size_on_disk(spark, monkeypatch):
    """With a generous threshold and nothing small enough to be sent, tables of prefixes are sorted, and the neighbours are the same."""
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((20, 8)) * 3
    rows = [(k, v.tolist(), "") for k, v in enumerate((middle[rng.integers(0, 20, 600)] + rng.standard_normal((600, 8)) * 0.2).astype(np.float32))]
    want = result(frame(spark, rows, VECTORS))
    plans, store = {}, f.stored
    monkeypatch.setattr(f, "stored", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or store(df, label))
    monkeypatch.setattr(f, "SENT", 0, raising=False)
    monkeypatch.setattr(f, "SHALLOW", 0, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert result(frame(spark, rows, VECTORS)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plans["stands"] and "SortMergeJoin" in plans["buckets"]
    assert "BroadcastHashJoin" not in plans["queries"] and "BroadcastHashJoin" not in plans["buckets"]
