import hashlib

import pytest
from tests.llm.samples import SF, alphanumeric, clashing, documents, frame, odd

from tarmac.llm import decontaminate


def plain(rows, items):
    patterns = {}
    for item, text in items:
        w = alphanumeric(text or "")
        for k in range(max(1, len(w) - 12)):
            if w:
                patterns.setdefault(tuple(w[k : k + 13]), set()).add(item)
    lengths = {len(p) for p in patterns}
    out = []
    for i, text in rows:
        w = alphanumeric(text or "")
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                ids = patterns.get(tuple(w[k : k + m]))
                if ids:
                    hit |= set(range(k, k + m))
                    found |= ids
        found.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(docs, items):
    return sorted((tuple(r)[:6] for r in decontaminate.contamination(docs, items).collect()), key=str)


@pytest.mark.parametrize("block, blocks", [(decontaminate.BLOCK_WORDS, decontaminate.BLOCKS), (20, 100), (20, 2)])
def test_equals_plain_search(spark, monkeypatch, block, blocks):
    """Also with the benchmark cut into many blocks, in one stage or in several."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(12).collect()]
    items += [(900, "Short one"), (901, "x"), (902, ""), (903, None), (None, "item without id"), (904, "a a a a a a a a a a a a a a a"), (900, "other short")]
    text = " ".join(alphanumeric(items[3][1])).upper()
    rows = odd(documents(spark, 60)) + [(8000, text), (8001, "a " * 40), (8002, "SHORT,one! short ONE; item without id"), (8003, "b " * 500 + text)]
    assert result(clashing(spark, rows), frame(spark, items, "item_id bigint, text string")) == plain(rows, items)


def test_empty_tables(spark):
    none = frame(spark, [], "item_id bigint, text string")
    assert result(frame(spark, [(1, "some words")]), none) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert result(frame(spark, []), none) == []


def test_shift_never_skips_an_occurrence():
    sets = decontaminate.pattern_sets([" ".join("abcdefghijklm"), " ".join("bcdefghijklmn"), "m n", "M, n", "m n m n m n m n m n m n m n"])
    assert [s.length for s in sets] == [2, 13]
    assert sets[1].table.max() == sets[1].far == 12
    assert len(sets[0].first) == 1 and sets[0].items.tolist() == [2, 3]
    assert len(sets[1].first) == 4 and sorted(sets[1].items.tolist()) == [0, 1, 4, 4]


def test_a_large_block_is_a_few_arrays():
    """200,000 words take under 40 MB, shift table included, and repeated windows are one pattern each."""
    import pickle

    texts = [" ".join(f"w{(k * 7919 + j * j) % 50_000}" for j in range(400)) for k in range(500)] * 2
    sets = decontaminate.pattern_sets(texts)
    assert len(pickle.dumps(sets)) < 40 << 20
    assert len(sets) == 1 and len(sets[0].first) <= 500 * 388 and len(sets[0].items) == 2 * len(sets[0].first)
