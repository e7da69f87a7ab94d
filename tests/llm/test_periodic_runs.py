import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.samples import clashing, documents, frame, odd

from tarmac.llm import periodic_runs, queries


def plain(w, least=12):
    """All runs (start, length, period) by comparing the words at every distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def row(rng):
    kind, n = rng.randrange(6), rng.randrange(150)
    if kind < 2:
        return [str(rng.randrange(kind + 2)) for _ in range(n)]
    if kind == 2:
        return fibonacci(n)
    if kind == 3:
        block = [str(rng.randrange(4)) for _ in range(rng.randrange(1, 40))]
        out = (block * 200)[:n]
        for _ in range(rng.randrange(4) if out else 0):
            out[rng.randrange(len(out))] = "x"
        return out
    if kind == 4:
        return ["same"] * n
    out = []
    while len(out) < n:
        out += [str(rng.randrange(3)) for _ in range(rng.randrange(1, 8))] * rng.randrange(1, 6)
    return out * 2


def all_runs(rows):
    letters = {x: k for k, x in enumerate(sorted({x for w in rows for x in w}))}
    at = np.concatenate([[0], np.cumsum([len(w) for w in rows])]).astype(np.int64)
    start, length, period = periodic_runs.find_runs(np.array([letters[x] for w in rows for x in w], np.uint64), at)
    return sorted(zip(start.tolist(), length.tolist(), period.tolist())), at


def test_equals_comparing_every_distance():
    rng = random.Random(11)
    for _ in range(400):
        rows = [row(rng) for _ in range(rng.randrange(1, 4))]
        got, at = all_runs(rows)
        assert got == sorted((int(at[k]) + s, n, q) for k, w in enumerate(rows) for s, n, q in plain(w))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90), max_size=3), st.integers(1, 4))
def test_equals_comparing_every_distance_on_any_words(rows, times):
    rows = [w * times for w in rows]
    got, at = all_runs(rows)
    assert got == sorted((int(at[k]) + s, n, q) for k, w in enumerate(rows) for s, n, q in plain(w))


def test_range_successor():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 17, 200):
        values = rng.permutation(m)
        tree = periodic_runs.WaveletTree(values)
        low, x = rng.integers(0, m, 300), rng.integers(0, m + 1, 300)
        high = np.array([rng.integers(a, m + 1) for a in low])
        want = [min((v for v in values[a:b] if v >= y), default=-1) for a, b, y in zip(low, high, x)]
        assert tree.successor(low, high, x).tolist() == want


def test_one_long_run_takes_few_steps():
    """A text that is one run, and one with a break in it: candidates do not grow with the square."""
    numbers = np.tile(np.arange(3, dtype=np.uint64), 40_000)
    assert [x.tolist() for x in periodic_runs.find_runs(numbers, np.array([0, len(numbers)]))] == [[0], [120_000], [3]]
    numbers[60_001] = 99
    place, _ = periodic_runs._candidates(periodic_runs.Suffixes(numbers, np.array([0, len(numbers)])))
    assert len(place) < 16 * len(numbers)


def result(docs):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.collapse_runs(docs).collect()), key=str)


@pytest.mark.parametrize("piece", [periodic_runs.PIECE, 2000])
def test_tables(spark, monkeypatch, piece):
    monkeypatch.setattr(periodic_runs, "PIECE", piece)
    rng = random.Random(4)
    rows = odd(documents(spark, 40)) + [(9000 + k, " \t".join(row(rng))) for k in range(60)] + [(9100, "Ab aB " * 9), (9101, "é É " * 9 + "\x0b")]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, len(w), 1)] if len(w) > 50_000 else plain(w)
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert result(clashing(spark, rows)) == sorted(want, key=str)


def test_empty_tables_and_short_runs(spark):
    assert result(frame(spark, [])) == []
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(frame(spark, []), least=11)


def test_planted_runs(spark):
    rows = documents(spark, 150) + [(10**7 + k, "a b c d e") for k in range(40)] + [(10**8 + k, None) for k in range(40)] + [(None, "x y")]
    got = {r.doc_id: r.text for r in queries.with_planted_runs(frame(spark, rows)).collect()}
    changed = 0
    for i, t in rows:
        h = 1 if i is None else zlib.crc32(str(i).encode())
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if h % 10 or not w:
            assert got[i] == t
            continue
        changed += 1
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        assert got[i].split(" ") == [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    assert changed > 10
