import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.samples import clashing, documents, frame, odd

from tarmac.llm import sharding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40), st.integers(2, 8))
def test_differencing_deals_every_item_once(sizes, shards):
    to = sharding.difference([(x, *([0] * (shards - 1))) for x in sizes], shards)
    sums = [0] * shards
    for x, parts in zip(sizes, to):
        assert sorted(parts) == list(range(shards))
        sums[parts[0]] += x
    assert sum(sums) == sum(sizes)
    assert max(sums) - min(sums) <= max(sizes)


def check(rows, out):
    text = {}
    for i, t in rows:
        text.setdefault(i, set()).add(t or "")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t in rows)
    home = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None
        (own,) = text[r.doc_id]
        assert r.text_crc32 == zlib.crc32(own.encode()) and home.setdefault(own, r.shard) == r.shard
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    return [sum(r.size for r in out if r.shard == k) for k in range(8)]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_ROWS", 30)
    rows = documents(spark)
    sums = check(rows, sharding.shard_documents(clashing(spark, rows)).collect())
    assert max(sums) - min(sums) <= 0.01 * sum(sums)


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 10)
    monkeypatch.setattr(sharding, "FAN", 3)
    rows = documents(spark)
    sums = check(rows, sharding.shard_documents(frame(spark, rows)).collect())
    assert max(sums) - min(sums) <= 0.02 * sum(sums)


def test_odd_rows_and_a_large_group(spark):
    rows = odd([(k, "copy " * 50) for k in range(60)] + [(100 + k, f"text {k} " * 9) for k in range(100)])
    check(rows, sharding.shard_documents(frame(spark, rows)).collect())
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def plain(sizes, shards):
    """Sums of the shards by differencing, told plainly: combine the two widest-spread partitions in opposite order until one is left."""
    parts = [[x] + [0] * (shards - 1) for x in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p), reverse=True)
        one, two, *parts = parts
        parts.append([a + b for a, b in zip(sorted(one, reverse=True), sorted(two))])
    return sorted(parts[0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=30, unique=True), st.integers(2, 5))
def test_spread_equals_plain_differencing(sizes, shards):
    """Ties in the spread may be combined in another order, so sums are compared where there are none."""
    to = sharding.difference([(x, *([0] * (shards - 1))) for x in sizes], shards)
    sums = [0] * shards
    for x, parts in zip(sizes, to):
        sums[parts[0]] += x
    want = plain(sizes, shards)
    assert abs((max(sums) - min(sums)) - (want[-1] - want[0])) <= min(sizes) or sorted(sums) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=9))
def test_two_shards_against_the_best_there_is(sizes):
    """Differencing for two shards is within 7/6 of the best largest shard."""
    best = min(max(s, sum(sizes) - s) for s in (sum(x for k, x in enumerate(sizes) if m >> k & 1) for m in range(1 << len(sizes))))
    to = sharding.difference([(x, 0) for x in sizes], 2)
    first = sum(x for x, parts in zip(sizes, to) if parts[0] == 0)
    assert max(first, sum(sizes) - first) <= best * 7 / 6
