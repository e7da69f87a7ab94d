"""Removal of passages that an earlier document holds, by difference-cover anchors.

A window of 13 words repeats if a document with a smaller doc_id holds the same 13 words. To find
such windows without sending every window through a shuffle:

1. Only the seven words that begin at a cover position are hashed: word numbers that are 0, 1 or 3
   modulo 7. Every difference modulo 7 occurs between two of these, so whichever places two
   documents hold the same 13 words at, both have an anchor at the same offset of at most 6 into
   it, and the anchor's seven words lie inside the 13. Three sevenths of the words are anchors.
2. Documents lie in stored chunks of bounded text. A chunk sends its distinct anchors, as sorted
   arrays cut by hash into buckets, and hears which of them another chunk holds too, one bit each.
3. Anchors held twice are extended: all windows around them are hashed whole and looked up in the
   same way, now with the smallest doc_id that holds them in the chunk. The answer is again one
   bit: another chunk holds the window in a document with a smaller doc_id.

A passage that a third of all documents hold is sent once per chunk, never once per document, so
no bucket grows with a group of copies; buckets are made so many that each holds a bounded number
of anchors. Nothing is paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.shared import ready, stored, utf8
from tarmac.llm.words import CASED, SPACED, mix, sequences, words

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
CHUNK = 4 << 20  # bytes of text
BUCKET = 1 << 19  # anchors expected in a bucket
_CHUNKS = "chunk bigint, n_words bigint, ids array<bigint>, ends binary, texts binary"
_SENT = "bucket bigint, chunk bigint, hashes binary, extra binary"
_TOLD = "chunk bigint, bucket bigint, bits binary"


def _chunks(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task put together to chunks of at most `most` bytes, or of one longer text; texts compressed."""
    place = TaskContext.get().partitionId() << 32
    ids, sizes, texts, count = [], [], [], 0

    def row():
        raw = b"".join(texts)
        ends = np.cumsum(sizes, dtype=np.int64)
        n = len(words(np.frombuffer(raw, np.uint8), np.append(0, ends), SPACED)[0])
        held = [pa.array([place + count]), pa.array([n]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tobytes()], pa.binary()), pa.array([zstandard.compress(raw, 3)], pa.binary())]
        return pa.RecordBatch.from_arrays(held, names=["chunk", "n_words", "ids", "ends", "texts"])

    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        whole, k = raw.tobytes(), 0
        own = batch.column(0).to_pylist()
        while k < len(own):
            room = most - sum(map(len, texts))
            last = min(int(np.searchsorted(offsets, offsets[k] + room, "right")) - 1, len(own))
            last = last if ids else max(last, k + 1)
            ids += own[k:last]
            sizes += np.diff(offsets[k : last + 1]).tolist()
            texts.append(whole[offsets[k] : offsets[last]])
            k = last
            if sum(map(len, texts)) >= most or k < len(own):
                yield row()
                ids, sizes, texts, count = [], [], [], count + 1
    if ids:
        yield row()


class Chunk:
    """A chunk opened: words of its documents as numbers, and which document and place each has."""

    def __init__(self, ids: list, ends: bytes, texts: bytes):
        self.raw = np.frombuffer(zstandard.decompress(texts) if texts else b"", np.uint8)
        offsets = np.append(0, np.frombuffer(ends, np.int64))
        self.numbers, self.starts, self.ends, self.at = words(self.raw, offsets, SPACED, CASED)
        self.named = np.array([x is not None for x in ids], bool)
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(ids)), self.count)
        self.place = np.arange(len(self.numbers)) - np.repeat(self.at[:-1], self.count)
        self.left = np.repeat(self.at[1:], self.count) - np.arange(len(self.numbers))  # words from here to the document's end

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all anchors and their hashes; documents shorter than a window have none."""
        size = window - PERIOD + 1
        every = sequences(self.numbers, size)
        n = len(every)
        good = (self.left[:n] >= size) & np.isin(self.place[:n] % PERIOD, COVER) & (self.count >= window)[self.doc[:n]] & self.named[self.doc[:n]]
        at = np.flatnonzero(good)
        return at, every[at]

    def windows(self, window: int, held_twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold one of the given anchors (places): their places and two hashes."""
        size = window - PERIOD + 1
        if len(self.numbers) < window or not len(held_twice):
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), none, none
        # A window at s holds the anchors at s to s + PERIOD - 1, of its own document.
        step = np.zeros(len(self.numbers) + 1, np.int64)
        np.add.at(step, np.maximum(held_twice - (window - size), held_twice - self.place[held_twice]), 1)
        np.add.at(step, held_twice + 1, -1)
        at = np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= window))
        # Both hashes over the windows' words only.
        one = np.full(len(at), window, np.uint64)
        two = np.full(len(at), window * 2 + 1, np.uint64)
        for k in range(window):
            word = self.numbers[at + k]
            one = mix(one * np.uint64(0xA24BAED4963EE407) + word)
            two = two * np.uint64(0x9FB21C651E98DF25) + (word ^ (word >> np.uint64(29)))
        return at, one, mix(two) >> np.uint64(32)


def _planes(numbers: np.ndarray, size: int) -> bytes:
    """The lowest `size` bytes of each number, all first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(planes) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(planes, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view("<u8")


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and last entry of sorted hashes, for buckets with entries."""
    of = _bucket_of(hashes, buckets)
    edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(of))):
        yield int(of[a]), int(a), int(b)


def _anchor_groups(chunk: Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, each place's group, the groups' hashes, and whether several documents of the chunk hold it."""
    at, hashes = chunk.anchors(window)
    hashes = hashes & ~np.uint64(0xFFFF)  # 48 bits are sent; what they take in too much fails in the next step
    distinct, group = np.unique(hashes, return_inverse=True)
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    ids = chunk.ids[chunk.doc[at]]
    np.minimum.at(least, group, ids)
    np.maximum.at(most, group, ids)
    return at, group, distinct, least < most


def _window_groups(chunk: Chunk, window: int, held_twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, each place's group, the groups' two hashes, and the smallest doc_id of each."""
    at, one, two = chunk.windows(window, held_twice)
    order = np.lexsort((two, one))
    new = np.ones(len(at), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, group, chunk.ids[chunk.doc[at]])
    return at, group, one[order][new], two[order][new], least


def _opened(row: dict) -> Chunk:
    return Chunk(row["ids"], row["ends"], row["texts"])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["bucket", "chunk", "hashes", "extra"])


def _bits(told: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The answers for a chunk's sorted hashes; buckets that sent none answer no."""
    out = np.zeros(len(hashes), bool)
    said = dict(zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist()))
    for bucket, a, b in _cuts(hashes, buckets):
        if bucket in said:
            out[a:b] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=b - a, bitorder="little").astype(bool)
    return out


def _answer(table: pa.Table, judge) -> pa.Table:
    """For one bucket: what `judge` says of the entries of each chunk, where it says anything."""
    chunks, buckets = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    hashes, extra = table.column("hashes").to_pylist(), table.column("extra").to_pylist()
    flags, sizes = judge(hashes, extra)
    ends = np.cumsum(sizes)
    kept = [(c, k, np.packbits(flags[e - n : e], bitorder="little").tobytes()) for c, k, e, n in zip(chunks, buckets, ends, sizes) if flags[e - n : e].any()]
    columns = list(zip(*kept)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["chunk", "bucket", "bits"])


def _held_twice(hashes: list[bytes], _) -> tuple[np.ndarray, list[int]]:
    sizes = [len(x) // 6 for x in hashes]
    own = np.concatenate([_numbers(x, 6) for x in hashes])
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    flags = np.zeros(len(own), bool)
    flags[order[1:]] = same
    flags[order[:-1]] |= same
    return flags, sizes


def _held_earlier(hashes: list[bytes], extra: list[bytes]) -> tuple[np.ndarray, list[int]]:
    sizes = [len(x) // 8 for x in hashes]
    one = np.concatenate([_numbers(x, 8) for x in hashes])
    two = np.concatenate([_numbers(x[: 4 * n], 4) for x, n in zip(extra, sizes)])
    least = np.concatenate([_numbers(x[4 * n :], 8) for x, n in zip(extra, sizes)]).view(np.int64)
    order = np.lexsort((least, two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = least[order][new][np.cumsum(new) - 1]
    flags = np.zeros(len(one), bool)
    flags[order] = first < least[order]
    return flags, sizes


def _told(sent: DataFrame, judge, label: str) -> DataFrame:
    return stored(sent.groupBy("bucket").applyInArrow(lambda table: _answer(table, judge), _TOLD), label)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text for every row of `docs` (doc_id, text); text: the words kept, one space between.

    Words are what ASCII white space separates, unchanged. A word goes if a window of `window`
    words covers it that also starts in a document with a smaller doc_id; all windows are judged
    on the whole input. Null and empty texts have no words; documents of fewer words than a window
    stay whole. Rows that repeat a doc_id lose nothing to each other. Rows without doc_id neither
    lose words nor take them from others. Other columns are ignored; an empty table gives no rows.
    `window` is at least 8.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    spark = ready(docs.sparkSession)
    size = CHUNK
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = stored(rows.mapInArrow(lambda batches: _chunks(size, batches), _CHUNKS), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, math.ceil(total * len(COVER) / PERIOD / BUCKET))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                _, _, hashes, _ = _anchor_groups(_opened(row), window)
                yield _sent([(bucket, row["chunk"], _planes(hashes[a:b] >> np.uint64(16), 6), b"") for bucket, a, b in _cuts(hashes, buckets)])

    twice = _told(chunks.mapInArrow(send_anchors, _SENT), _held_twice, "twice")

    def held_twice(chunk: Chunk, told: pa.Table) -> np.ndarray:
        at, group, hashes, inside = _anchor_groups(chunk, window)
        return at[(_bits(told, hashes, buckets) | inside)[group]]

    def send_windows(left: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            chunk = _opened(row)
            _, _, one, two, least = _window_groups(chunk, window, held_twice(chunk, told))
            rows += [(k, row["chunk"], _planes(one[a:b], 8), _planes(two[a:b], 4) + _planes(least[a:b].view(np.uint64), 8)) for k, a, b in _cuts(one, buckets)]
        return pa.Table.from_batches([_sent(rows)])

    def with_answers(answers: DataFrame, work, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, schema)

    earlier = _told(with_answers(twice, send_windows, _SENT), _held_earlier, "earlier")
    # Both answers in one table; those on windows have the buckets from `buckets` on.
    answers = twice.unionByName(earlier.withColumn("bucket", F.col("bucket") + buckets))

    def remove(left: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        late = np.array(told.column("bucket").to_pylist(), np.int64) >= buckets
        on_anchors, on_windows = told.filter(pa.array(~late)), told.filter(pa.array(late))
        on_windows = on_windows.set_column(1, "bucket", pa.array([x - buckets for x in on_windows.column("bucket").to_pylist()], pa.int64()))
        for row in left.to_pylist():
            chunk = _opened(row)
            at, group, one, two, least = _window_groups(chunk, window, held_twice(chunk, on_anchors))
            gone = _bits(on_windows, one, buckets)[group] | (least[group] < chunk.ids[chunk.doc[at]])
            step = np.zeros(len(chunk.numbers) + 1, np.int64)
            step[at[gone]] += 1
            step[at[gone] + window] -= 1
            out.append(_kept(chunk, row["ids"], np.cumsum(step[:-1]) == 0))
        return pa.concat_tables(out)

    return with_answers(answers, remove, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def _kept(chunk: Chunk, ids: list, kept: np.ndarray) -> pa.Table:
    """The chunk's documents with the kept words, one space between."""
    size = (chunk.ends - chunk.starts + 1)[kept]  # a word and the space after it
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(total[-1]) + np.repeat(chunk.starts[kept] - total[:-1], size)
    out = np.append(chunk.raw, np.uint8(32))[np.minimum(source, len(chunk.raw))]
    out[total[1:] - 1] = 32
    some = np.concatenate([[0], np.cumsum(kept)])
    begins = total[some[chunk.at]]
    left = np.diff(some[chunk.at])
    ends = begins[1:] - (left > 0)
    raw = out.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(begins[:-1], ends)]
    return pa.table([pa.array(ids, pa.int64()), pa.array(chunk.count.astype(np.int64)), pa.array((chunk.count - left).astype(np.int64)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])
