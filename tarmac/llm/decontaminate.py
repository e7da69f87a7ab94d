"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the word. Patterns are all windows of 13 consecutive words of the benchmark
items (one window for a shorter item). Patterns of equal length make one search set: a shift
table, addressed by the hash of a block of two words, tells how far the window may move; where
the shift is zero, the bucket of that last block holds the patterns to compare, first by the
block at their head, then word by word on the bytes themselves.

The benchmark passes through the driver in blocks of a bounded number of words, each made into a
few arrays and broadcast. A block is one pass over the documents; hits and items are carried
from pass to pass on the document's own row, so a benchmark of any size needs no join and no
shuffle. A few passes share a stage; then the rows are stored and the blocks behind them freed, so
that no worker ever holds more than those few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.shared import in_batches, spans_of, stored, utf8
from tarmac.llm.words import ALPHANUMERIC, mix, sequences, words

WINDOW = 13
BLOCK_WORDS = 1 << 20
BLOCKS = 4  # passes of one stage
TABLE_BITS = 24  # of the largest shift table
BLOCK = 4 << 20


def _blocks(numbers: np.ndarray, width: int) -> np.ndarray:
    """At each place the hash of the block of `width` words that ends there (the first has none)."""
    if width == 1:
        return numbers
    out = np.zeros(len(numbers), np.uint64)
    out[1:] = mix(numbers[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + numbers[1:])
    return out


class Words:
    """The words of a block's items: lower-case bytes, places in them, numbers."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        joined = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.numbers, self.starts, self.ends, self.at = words(joined, offsets, ALPHANUMERIC)
        self.lower = joined.tobytes().lower()

    def __getitem__(self, i: int) -> bytes:
        return self.lower[self.starts[i] : self.ends[i]]


class PatternSet:
    """The patterns of one length, ready to search: `first` words that stand at given places of `text`.

    Patterns are sorted by the hash of their last block; the items that hold pattern k are
    `items[held[k]:held[k + 1]]`.
    """

    def __init__(self, length: int, text: Words, place: np.ndarray, owner: np.ndarray):
        self.length, self.width, self.text = length, min(2, length), text
        self.far = length - self.width + 1
        numbers = text.numbers
        blocks = _blocks(numbers, self.width)
        # Equal windows are one pattern; two hashes of all their words tell them apart.
        whole = [sequences(x, length)[place] for x in (numbers, mix(numbers ^ np.uint64(0x9E6C63D0876A9A47)))]
        last = blocks[place + length - 1]
        order = np.lexsort((owner, place, whole[1], whole[0], last))
        place, owner = place[order], owner[order]
        new = np.ones(len(order), bool)
        for x in (*whole, last):
            x = x[order]
            new[1:] &= x[1:] == x[:-1]
        new[1:] = ~new[1:]
        again = np.zeros(len(order), bool)  # the same item holds the pattern more than once
        again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
        self.first = place[new]
        pattern = np.cumsum(new) - 1
        self.items = owner[~again]
        self.held = np.searchsorted(pattern[~again], np.arange(len(self.first) + 1))
        self.last, self.head = blocks[self.first + length - 1], blocks[self.first + self.width - 1]
        self.shift = np.uint64(64 - min(TABLE_BITS, max(12, (16 * len(self.first)).bit_length())))
        self.table = np.full(1 << (64 - int(self.shift)), min(self.far, 255), np.uint8)
        for k in range(self.far):  # distance of each block from the pattern's end
            slots = (blocks[self.first + length - 1 - k] >> self.shift).astype(np.int64)
            np.minimum.at(self.table, slots, np.uint8(min(k, 255)))

    def search(self, numbers: np.ndarray, word: Callable[[int], bytes], hit: np.ndarray, items: set[int]) -> None:
        """Mark in `hit` the words of every occurrence, and add the items whose patterns occur.

        `word(i)` gives the bytes of word i.
        """
        n, m = len(numbers), self.length
        if n < m:
            return
        blocks = _blocks(numbers, self.width)
        shifts = self.table[(blocks >> self.shift).astype(np.int64)].tobytes()
        at = m - 1
        while at < n:
            step = shifts[at]
            if step:
                at += step
                continue
            first = at - m + 1
            head = blocks[first + self.width - 1]
            k = int(np.searchsorted(self.last, blocks[at]))
            while k < len(self.last) and self.last[k] == blocks[at]:
                start = self.first[k]
                if self.head[k] == head and all(word(first + j) == self.text[start + j] for j in range(m)):
                    hit[first : at + 1] = True
                    items.update(self.items[self.held[k] : self.held[k + 1]].tolist())
                k += 1
            at += 1


def pattern_sets(texts: list[str], window: int = WINDOW) -> list[PatternSet]:
    """The sets of all windows of some items, by length; an item goes by its place in the list."""
    held = Words(texts)
    count = np.diff(held.at)
    out = []
    for length in np.unique(np.minimum(count, window)).tolist():
        if length == 0:
            continue
        own = np.flatnonzero(count >= window if length == window else count == length)
        windows = count[own] - length + 1
        place = np.repeat(held.at[own], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        out.append(PatternSet(length, held, place, np.repeat(own, windows)))
    return out


def _benchmark_blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[list[int | None], list[PatternSet]]]:
    """Ids and pattern sets of block after block; an item longer than a block is one of its own."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        ids.append(item), texts.append(text)
        size += len(text) // 4
        if size >= BLOCK_WORDS:
            yield ids, pattern_sets(texts, window)
            ids, texts, size = [], [], 0
    if texts:
        yield ids, pattern_sets(texts, window)


STATE = "text string, n_words bigint, hits binary, items array<bigint>"


def _pass(sent, last: bool):
    """Search one block of the benchmark in a batch of (row, text, n_words, hits, items)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = utf8(batch.column(1))
        hits, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        counts = np.zeros(batch.num_rows, np.int64)
        for a, b in spans_of(offsets, BLOCK):
            part = raw[offsets[a] : offsets[b]]
            numbers, starts, ends, at = words(part, offsets[a : b + 1] - offsets[a], ALPHANUMERIC)
            counts[a:b] = np.diff(at)
            lower = bytes(part).lower()
            for row in range(a, b):
                low, high = at[row - a], at[row - a + 1]
                if low == high:
                    continue
                hit, found = np.zeros(high - low, bool), set()
                ids, sets = sent.value
                for patterns in sets:
                    patterns.search(numbers[low:high], lambda i: lower[starts[low + i] : ends[low + i]], hit, found)
                if hit.any():
                    old = hits[row]
                    if old is not None:
                        hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(hit)).astype(bool)
                    hits[row] = np.packbits(hit).tobytes()
                    items[row] = sorted({ids[k] for k in found if ids[k] is not None} | set(items[row] or ()))
        if last:
            return _summary(batch.column(0), counts, hits, items)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))],
            names=["row", "text", "n_words", "hits", "items"],
        )

    return work


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<bigint>"


def _summary(rows: pa.Array, counts: np.ndarray, hits: list[bytes | None], items: list[list[int] | None]) -> pa.RecordBatch:
    n_hit = [0 if h is None else int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in hits]
    names = [",".join(sorted(map(str, x or ()))) for x in items]
    return pa.RecordBatch.from_arrays(
        [
            rows, pa.array(counts), pa.array(n_hit, pa.int64()), pa.array([len(x or ()) for x in items], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()),
            pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, counts.tolist())], pa.bool_()),
            pa.array([x or [] for x in items], pa.list_(pa.int64())),
        ],
        names=["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` (with a column text), whole, as `row`, and what `contamination` tells of each."""
    spark = docs.sparkSession
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    state = docs.select(row, "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<bigint>").alias("items"))
    kind = state.schema["row"]
    blocks = _benchmark_blocks(benchmark, window)
    block, held = next(blocks, ([], [])), []
    while True:
        following = next(blocks, None)
        held.append(spark.sparkContext.broadcast(block))
        rest = T.StructType.fromDDL(RESULT if following is None else STATE)
        state = in_batches(state, _pass(held[-1], last=following is None), T.StructType([kind, *rest.fields]))
        if following is None:
            return state
        if len(held) == BLOCKS:
            state = stored(state, "searched")
            for sent in held:
                sent.destroy()
            held = []
        block = following


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for every row of `docs`.

    Words are runs of 0-9, a-z (A-Z in lower case) and characters beyond ASCII. A null or empty
    text has no words and is not contaminated; items of null or no words match nothing; an empty
    benchmark hits nothing. Repeated rows are judged each; an item_id that several items share
    counts once, an item without id contaminates but is not listed. Other columns are ignored.
    """
    return judged(docs.select("doc_id", "text"), benchmark, window).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")
