import random
import re

import pytest
from tests.llm.samples import clashing, documents, frame, odd

from tarmac.llm import cover_dedup


def plain(rows, window=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                own = tuple(w[k : k + window])
                first[own] = min(first.get(own, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted((tuple(r) for r in cover_dedup.remove_repeats(docs, **options).collect()), key=str)


def test_every_difference_lies_in_the_cover():
    assert {(a - b) % cover_dedup.PERIOD for a in cover_dedup.COVER for b in cover_dedup.COVER} == set(range(cover_dedup.PERIOD))


def shared_passages(seed):
    """Documents with passages of 10 to 40 words in common, at all offsets, inside and across documents."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.randrange(10, 41))] for k in range(6)] + [["a", "b"] * 12, ["same"] * 20]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"d{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 12))]
            own = rng.choice(passages)
            cut = rng.randrange(0, 4)
            w += own[cut:] if rng.random() < 0.5 else own[: len(own) - cut]
        rows.append((rng.randrange(1000) if i % 7 else None, "  ".join(w) + "\n"))
    return rows


@pytest.mark.parametrize("chunk, bucket", [(cover_dedup.CHUNK, cover_dedup.BUCKET), (300, 60)])
def test_equals_looking_up_every_window(spark, monkeypatch, chunk, bucket):
    """Also with many chunks and buckets."""
    monkeypatch.setattr(cover_dedup, "CHUNK", chunk)
    monkeypatch.setattr(cover_dedup, "BUCKET", bucket)
    rows = shared_passages(1) + odd(documents(spark, 50)) + [(5, "é É ß " * 9), (6, "É é ß " * 9), (7, "é É ß " * 9)]
    got = result(clashing(spark, rows))
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("window", [8, 13, 20])
def test_other_windows(spark, window):
    rows = shared_passages(2)
    assert result(frame(spark, rows), window=window) == plain(rows, window)


def test_case_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(13))
    rows = [(4, text), (4, text), (9, text.upper()), (9, text), (9, text + " end"), (None, text)]
    assert [r[:3] for r in result(frame(spark, rows))] == [(4, 13, 0), (4, 13, 0), (9, 13, 0), (9, 13, 13), (9, 14, 13), (None, 13, 0)]


def test_empty_tables_and_short_windows(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(1, None), (2, "")])) == [(1, 0, 0, ""), (2, 0, 0, "")]
    with pytest.raises(ValueError):
        cover_dedup.remove_repeats(frame(spark, []), window=7)
