import math
from collections import Counter

import pytest
from tests.llm.samples import SF, alphanumeric, clashing, documents, frame, odd

from tarmac.llm import bag_search

ITEMS = "item_id bigint, text string"


def plain(rows, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every row against every item."""
    bags = [(i, Counter(alphanumeric(t or ""))) for i, t in rows]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    number, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        asked = Counter(alphanumeric(text or ""))
        scored = []
        for i, bag, n in bags:
            m = 25 + 75 * n * number // total
            score = sum(q * math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, q in asked.items() if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:top])]
    return sorted(out, key=str)


def result(docs, items, **options):
    return sorted((tuple(r) for r in bag_search.search(docs, items, **options).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(9).collect()]


@pytest.mark.parametrize("block, cells", [(bag_search.BLOCK_CHARS, bag_search.CELLS), (400, 50)])
def test_equals_scoring_every_row(spark, monkeypatch, items, block, cells):
    """Also with the items cut into many blocks and the rows into small tiles."""
    monkeypatch.setattr(bag_search, "BLOCK_CHARS", block)
    monkeypatch.setattr(bag_search, "CELLS", cells)
    rows = odd(documents(spark, 80))
    rows += [(8000, items[0][1].upper()), (8001, items[0][1]), (8002, items[0][1] + " and more")]
    asked = items + [(900, "Long long LONG"), (901, "nowhere-to-be-found-zz"), (902, ""), (903, None), (None, "some words"), (900, "x")]
    assert result(clashing(spark, rows), frame(spark, asked, ITEMS)) == plain(rows, asked)


def test_copies_are_scored_once_and_expanded_by_id(spark):
    """40 copies in other words order and case are one class; ties go by doc_id, rows that repeat an id both count."""
    rows = [(100 + k, "alpha beta gamma filler" if k % 2 else "Filler GAMMA, beta alpha") for k in range(40)] + [(7, "beta alpha gamma; other"), (7, "beta alpha gamma; other"), (8, "nothing here")]
    asked = [(1, "gamma beta")]
    got = result(frame(spark, rows), frame(spark, asked, ITEMS))
    assert got == plain(rows, asked)
    assert [i for _, _, i, _ in sorted(got, key=lambda r: r[1])] == [7, 7, *range(100, 108)]
    block = bag_search.read_block(frame(spark, asked, ITEMS).toArrow())
    import pyarrow as pa

    texts = pa.array([t for _, t in rows])
    made = bag_search._bags(block.vocabulary, pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), texts], names=["doc_id", "text"]))
    assert len(set(made.column("bag").to_pylist())) == 2  # the one for `gamma beta`, and the empty one
    assert len(set(made.column("d1").to_pylist())) == 2


def test_smaller_top(spark, items):
    rows = documents(spark, 60)
    assert result(frame(spark, rows), frame(spark, items, ITEMS), top=3) == plain(rows, items, 3)


def test_empty_tables(spark, items):
    none = frame(spark, [], ITEMS)
    assert result(frame(spark, [(1, "some words")]), none) == []
    assert result(frame(spark, []), frame(spark, items, ITEMS)) == []
    assert result(frame(spark, [(1, None), (2, " ")]), frame(spark, items, ITEMS)) == []
    assert bag_search.search(frame(spark, []), none).columns == ["item_id", "rank", "doc_id", "score"]
