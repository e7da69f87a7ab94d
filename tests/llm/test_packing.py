import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.samples import clashing, documents, frame, odd

from tarmac.llm import packing
from tarmac.llm.queries import tokenizer_path


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=8), st.integers(0, 60))
def test_fullest_equals_all_subsets(sizes, room):
    best = max(sum(c) for r in range(len(sizes) + 1) for c in combinations(sizes, r) if sum(c) <= room)
    counts = Counter(sizes)
    got = packing.fullest(sorted(counts, reverse=True), counts, room)
    assert sum(got) == best and not Counter(got) - counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_places_every_piece(histogram):
    patterns = packing.plan(histogram, 64)
    used = Counter()
    for copies, pattern in patterns:
        assert copies > 0 and sum(pattern) <= 64
        for size in pattern:
            used[size] += copies
    assert used == Counter(histogram)
    assert len(patterns) <= len(histogram) + sum(len(set(p)) for _, p in patterns)


def check(rows, out, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want[i, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in out) // capacity)


def test_pieces_and_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 40)  # several cells
    monkeypatch.setattr(packing, "STRETCH", 1000)
    rows = odd(documents(spark)) + [(9000 + k, "same text") for k in range(100)] + [(9500, "<|endoftext|> don't I'LL Éa é   \x1c\x85 日本 'S")]
    out = packing.pack(clashing(spark, rows), tokenizer_path()).collect()
    used, least = check(rows, out, 4096)
    assert used <= least + 1
    out = packing.pack(frame(spark, rows), tokenizer_path(), 64).collect()
    used, least = check(rows, out, 64)
    assert used <= 1.01 * least + 1


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbZ019%'.,<|>/ \n\t\x0b\x1c\x85é̸́K日'’s"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
def test_ids_of_any_texts(texts):
    """Stretches put together again give the ids of the whole text, whatever stands beside what."""
    known = packing.encoder(tokenizer_path())
    texts = [*texts, "<|endoftext|>a"] if len(texts) == 3 else texts
    raw = [x.encode() for x in texts]
    ids, begins = known.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, a, b in zip(texts, begins, begins[1:]):
        assert ids[a:b].tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_letters_signs_and_digits_are_parted_only_where_the_tokenizer_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    load = lambda name: Tokenizer.from_file(str(public_tokenizers.path(name)))
    assert packing._cuts_by_kind(load("word_bpe_49k.json"))
    assert not packing._cuts_by_kind(load("byte_bpe_50k.json"))


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    known = packing.Encoder(tokenizer_path())
    for k in range(20):
        text = " ".join(f"word{j} w|x{j}" for j in range(k * 7, k * 7 + 20))
        ids, _ = known.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(known.keys) < 200
