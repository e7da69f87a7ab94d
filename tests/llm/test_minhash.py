import random

import numpy as np
import pytest
from tests.llm.samples import clashing, documents, frame, odd, spaced

from tarmac.llm import minhash
from tarmac.llm.words import SPACED, words


def shingles(text):
    w = spaced(text or "")
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def plain(rows):
    """doc_id: (size, smallest reachable id) by comparing all pairs; ids must differ."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 4 * min(len(s), len(t)) >= 3 * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= 75 * (len(s) + len(t) - both):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return [tuple(r)[:4] for r in minhash.near_duplicates(df).collect()]


def test_equals_all_pairs(spark):
    rows = documents(spark)
    rng = random.Random(3)
    base = rows[1][1].split()
    for k in range(40):  # a chain of changes, so that far ends are linked only through others
        base = list(base)
        for _ in range(2):
            base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        rows.append((5000 + k, " ".join(base)))
    rows += [(6000 + k, "one two three four") for k in range(30)] + [(6100, "ONE two  three\nfour"), (6101, "one two three")]
    rows += [(7000, None), (7001, ""), (7002, "\t ")]
    want = plain(rows)
    got = result(frame(spark, rows))
    assert {i: (n, c) for i, n, c, _ in got} == want
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_odd_rows(spark):
    got = result(clashing(spark, odd([(1, "a b c d e f g"), (2, "a b c d e f g")])))
    by = {i: (n, c, k) for i, n, c, k in got}
    assert len(got) == 9
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False)
    assert by[10**6] == (0, 10**6, True) and by[10**6 + 2] == (0, 10**6 + 2, True)
    assert by[None] == (2, None, True)
    assert [k for i, _, _, k in got if i == 10**6 + 3] == [True, True]
    assert by[10**6 + 4][0] == 1


def test_empty_table(spark):
    assert result(frame(spark, [])) == []


def test_words_equal_plain_words(spark):
    texts = [t or "" for _, t in odd(documents(spark, 30))] + ["", "é É ß x\x0by", "z" * (1 << 20) + " " + "y z " * 300_000]
    joined = b"".join(t.encode() for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    numbers, starts, ends, at = words(np.frombuffer(joined, np.uint8), offsets, SPACED)
    known = {}
    for k, text in enumerate(texts):
        own = numbers[at[k] : at[k + 1]]
        want = spaced(text)
        assert len(own) == len(want)
        for number, word in zip(own.tolist(), want):
            assert known.setdefault(word, number) == number
    assert len(set(known.values())) == len(known)


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    """Text A at 1 and 3, B at 1 and 4, B with a word changed at 2: two groups, both named by 1."""
    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    changed = two.replace("b59", "other")
    rows = [(1, one), (1, two), (2, changed), (3, one), (4, two), (5, "c " * 9), (5, two), (6, " ".join(f"u{k}" for k in range(30)))]
    got = result(frame(spark, rows))
    assert sorted((i, c, k) for i, _, c, k in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (5, 5, True), (6, 6, True)]
    # The smallest id of a group need not be what its texts have in common.
    rows = [(5, one), (5, two), (1, one + " x"), (2, changed)]
    assert sorted((i, c) for i, _, c, _ in result(frame(spark, rows))) == [(1, 1), (2, 2), (5, 1), (5, 2)]


def counted(monkeypatch, at):
    """Counts the pairs that are confirmed on full sets from here on."""
    whole = minhash.confirmed

    def confirmed(pairs, texts):
        at.append(pairs.count())
        return whole(pairs, texts)

    monkeypatch.setattr(minhash, "confirmed", confirmed)


def test_changed_copies_of_one_text(spark, monkeypatch):
    """800 copies, each 0.8 alike to the first and under 0.7 to each other: all meet the first; pairs grow with the rows."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = [(500, " ".join(base))]
    for k in range(800):
        own = list(base)
        for at in rng.sample(range(0, 200, 8), 4):
            own[at] = f"x{k}y{at}"
        rows.append((1000 + k, " ".join(own)))
    pairs = []
    counted(monkeypatch, pairs)
    assert {c for _, _, c, _ in result(frame(spark, rows))} == {500}
    assert sum(pairs) < 2 * (minhash.TRIES + 2) * len(rows)


@pytest.mark.parametrize("n", [300, 1200])
def test_pairs_of_a_crowd_of_unlinked_texts(spark, monkeypatch, n):
    """Texts on one template, about 0.7 alike; among them 30 pairs of 0.8, which few sort next to each other."""
    template = [f"t{k}" for k in range(165)]
    rows = [(k, " ".join(template + [f"o{k}x{j}" for j in range(35)])) for k in range(n)]
    for k in range(30):
        own = rows[k][1].split()
        rows.append((10_000 + k, " ".join(own[:183] + [f"p{k}x{j}" for j in range(17)])))
    pairs = []
    counted(monkeypatch, pairs)
    got = {i: c for i, _, c, _ in result(frame(spark, rows))}
    assert got == {k: k for k in range(n)} | {10_000 + k: k for k in range(30)}
    assert sum(pairs) < 2 * (minhash.TRIES + 2) * len(rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.root for r in minhash.components(frame(spark, links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100}
