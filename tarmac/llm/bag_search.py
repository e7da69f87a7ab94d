"""Ranked lexical search with bag deduplication.

For a set of items, documents are told apart only by how often they hold the items' terms and by
how long they are. So each document is cut down to its bag: the items' terms it holds, with their
counts. Documents with equal bags and equal length measure form a class; classes are found by
grouping on a 128-bit digest and verified on the bag itself, which is part of the grouping key
(combined before the shuffle, so copies never meet as rows). Each class is scored once against all
items; a task keeps the best of each item only. Last, the members of the winning classes are
expanded by ascending doc_id.

Items are handled in blocks of bounded text, one pass over the documents per block, so what is
broadcast is bounded by the block, not by the items or the corpus. Every statistic covers all
documents: their number and total length, and the number of documents that hold a term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.shared import in_batches, ready, spans_of, stored, utf8
from tarmac.llm.words import ALPHANUMERIC, mix, words

TOP = 10
BLOCK_CHARS = 2 << 20  # text of the items that are searched in one pass
PIECE = 2 << 20  # bytes of documents handled at once
CELLS = 1 << 21  # class and item pairs scored at once
LAST = (1 << 63) - 1
_DIGESTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


@dataclass
class Block:
    """Items as postings: for term `t`, `item[first[t]:first[t + 1]]` hold it, `times` each."""

    ids: pa.Array
    vocabulary: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray


def read_block(rows: pa.Table) -> Block:
    """The block of items (item_id, text); terms are numbered in the order of their hashes."""
    text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
    raw, offsets = utf8(text if isinstance(text, pa.Array) else pa.array([], pa.string()))
    numbers, _, _, at = words(raw, offsets, ALPHANUMERIC)
    vocabulary, term = np.unique(numbers, return_inverse=True)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs, times = np.unique(term.astype(np.int64) * max(1, len(at) - 1) + owner, return_counts=True)
    holder, item = np.divmod(pairs, max(1, len(at) - 1))
    return Block(rows.column("item_id"), vocabulary, np.searchsorted(holder, np.arange(len(vocabulary) + 1)), item, times)


def _bags(vocabulary: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Length in terms, bag and the bag's digest of every text; a bag is (term, count) in int32, by term."""
    raw, offsets = utf8(batch.column(1))
    size = max(1, len(vocabulary))
    known = np.zeros(1 << 16, bool)
    known[vocabulary >> np.uint64(48)] = True
    lengths, starts, entries, digests = [], [np.zeros(1, np.int64)], [], []
    for a, b in spans_of(offsets, PIECE):
        numbers, _, _, at = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALPHANUMERIC)
        maybe = np.flatnonzero(known[numbers >> np.uint64(48)])
        place = np.searchsorted(vocabulary, numbers[maybe])
        hit = place < len(vocabulary)
        hit[hit] = vocabulary[place[hit]] == numbers[maybe[hit]]
        row = np.searchsorted(at, maybe[hit], "right") - 1
        pairs, counts = np.unique(row * size + place[hit], return_counts=True)
        row, term = np.divmod(pairs, size)
        begins = np.searchsorted(row, np.arange(b - a + 1))
        own = term.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own * factor + factor))]) for factor in _DIGESTS]
        digests.append(np.stack([s[begins[1:]] - s[begins[:-1]] for s in sums]))
        entries.append(np.stack([term, counts], axis=1).astype("<i4"))
        starts.append(starts[-1][-1] + begins[1:])
        lengths.append(np.diff(at))
    flat = np.concatenate(entries) if entries else np.zeros((0, 2), "<i4")
    ends = (np.concatenate(starts) * 8).astype(np.int32)
    bag = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    both = np.concatenate(digests, axis=1) if digests else np.zeros((2, 0), np.uint64)
    n = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), bag], names=["doc_id", "n", "d1", "d2", "bag"])


def _entries(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of all bags, and where each bag begins (n + 1)."""
    kind = np.int64 if pa.types.is_large_binary(bags.type) else np.int32
    _, ends, data = bags.buffers()
    at = np.frombuffer(ends, kind)[bags.offset : bags.offset + len(bags) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<i4").reshape(-1, 2) if data is not None else np.zeros((0, 2), np.int32)
    return flat[:, 0], flat[:, 1].astype(np.int64), (at - at[0]) // 8


def _holders(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many bags of a task hold each term."""
    held = np.zeros(size, np.int64)
    for batch in batches:
        held += np.bincount(_entries(batch.column(0))[0], minlength=size)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])


class _Best:
    """The best classes of every item so far; ties go to the class with the smaller first doc_id."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.cut = np.ones(items, np.int64)
        self.rows = np.zeros((6, 0), np.int64)  # item, score, first, d1, d2, m

    def take(self, item: np.ndarray, score: np.ndarray, classes: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.concatenate([np.stack([item, score]), classes])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.top]
        last = place[place < self.top] == self.top - 1
        self.cut[self.rows[0][last]] = self.rows[1][last]


def _scored(block: Block, weights: np.ndarray, top: int, cells: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The `top` best classes (first, d1, d2, m, bag) of each item in one task, scored in whole numbers."""
    items = len(block.ids)
    best, tile = _Best(items, top), 64
    fan = np.diff(block.first)
    for batch in batches:
        first, d1, d2, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        terms, counts, at = _entries(batch.column(4))
        value = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, np.diff(at))))
        work = np.concatenate([np.zeros(1, np.int64), np.cumsum(fan[terms])])[at]  # pairs of entry and posting before each row
        a = 0
        while a < len(m):
            b = min(len(m), a + tile, a + max(1, cells // items), max(a + 1, int(np.searchsorted(work, work[a] + cells, "right")) - 1))
            own = slice(at[a], at[b])
            each = fan[terms[own]]
            posting = np.arange(each.sum()) + np.repeat(block.first[terms[own]] - (np.cumsum(each) - each), each)
            row = np.repeat(np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), each)
            scores = np.zeros((b - a) * items, np.int64)
            np.add.at(scores, row * items + block.item[posting], np.repeat(value[own], each) * block.times[posting])
            row, item = np.nonzero(scores.reshape(-1, items) >= best.cut)
            if len(row):
                best.take(item, scores[row * items + item], np.stack([x[a:b][row] for x in (first, d1, d2, m)]))
            a, tile = b, tile * 2
    if best.rows.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(best.rows[0].astype(np.int32)), *(pa.array(x) for x in best.rows[1:])], names=["item", "score", "first", "d1", "d2", "m"])


def _search_block(docs: DataFrame, rows: pa.Table, top: int, kind: T.DataType) -> DataFrame:
    spark = ready(docs.sparkSession)
    block = read_block(rows)
    sent = spark.sparkContext.broadcast(block)
    bags = stored(in_batches(docs.select("doc_id", "text"), lambda batch: _bags(sent.value.vocabulary, batch), "doc_id bigint, n bigint, d1 bigint, d2 bigint, bag binary"), "bags")
    bags = bags.where("n > 0")
    total = bags.agg(F.count("*"), F.sum("n")).first()
    some = bags.where(F.length("bag") > 0)
    size, cells = len(block.vocabulary), CELLS
    counted = some.select("bag").mapInArrow(lambda batches: _holders(size, batches), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block at most
    weights = np.zeros(size, np.int64)
    weights[counted.column("term").to_numpy()] = [math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df + 1))) for df in counted.column("df").to_pylist()]
    measure = F.expr(f"25 + cast((cast(75 as decimal(2,0)) * cast(n as decimal(18,0)) * cast({total[0]} as decimal(18,0))) div {max(total[1] or 0, 1)} as bigint)")
    some = some.withColumn("m", measure)
    classes = some.groupBy("d1", "d2", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("first"))
    found = classes.select("first", "d1", "d2", "m", "bag").mapInArrow(lambda batches: _scored(sent.value, weights, top, cells, batches), "item int, score bigint, first bigint, d1 bigint, d2 bigint, m bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first", "d1", "d2", "m"))
    won = stored(found.withColumn("place", place).where(F.col("place") <= top), "won")
    sent.destroy()
    named = ["d1", "d2", "m"]
    # At most `top` classes for each item of the block, so what is broadcast is bounded by the block.
    members = some.join(F.broadcast(won.select(*named).distinct()), named).select("doc_id", *named)
    nth = F.row_number().over(Window.partitionBy(*named).orderBy(F.asc_nulls_last("doc_id")))
    members = members.withColumn("nth", nth).where(F.col("nth") <= top)
    ids = spark.createDataFrame(list(enumerate(block.ids.to_pylist())), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "nth"))
    ranked = won.select("item", "score", *named).join(members, named).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents (doc_id, text) of every item (item_id, text).

    Terms are runs of letters and digits, all code points from 128 on among them, with A-Z in
    lower case. Only scores above 0 count; equal scores go by ascending doc_id. Null or empty
    texts and texts without terms are no documents here, and items without terms find nothing.
    Rows that repeat a doc_id each count, and each takes a rank; rows without doc_id count as
    well and come last among equal scores. Every row of `items` is searched for itself, also
    where it repeats an item_id or has none. Other columns are ignored; empty tables give no rows.
    """
    rows = items.select("item_id", "text").where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        own = rows.where(dealt == k).toArrow()
        if own.num_rows == 0:
            continue
        found = _search_block(docs, own, top, items.schema["item_id"].dataType)
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    return out
