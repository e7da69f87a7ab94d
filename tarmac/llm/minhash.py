"""Near duplicates by MinHash and an LSH forest.

Documents are linked when the sets of their five-word shingles have a Jaccard similarity of
at least 0.75. The steps:

1. Equal shingle sets become one class (grouped by a 128-bit digest of the set, combined
   before the shuffle), so copies never meet as pairs. A class has a number of its own, one text,
   and the smallest doc_id of its documents.
2. A class has a signature of 128 MinHash values. Each of 24 orders takes twelve of them, in an
   order of its own, as a sort key. All keys are range-partitioned and sorted, ties broken by
   the class, so no region, however crowded, lands in one task.
3. In every order a class becomes a candidate with the neighbours that share its longest prefix.
   The depth adapts to the region: neighbours that share d values, three at least, are taken
   where no more than five rows share those d, so that the region is compared whole; where more
   do, only deeper prefixes count. Classes of regions too crowded for that are sorted once more by
   48 values in every order, and the few that share the longest prefixes with each are taken. Rows
   at partition borders are matched in a second small step.
4. Candidates are confirmed on the full sets.
5. Classes of regions with more rows than are compared at the least depth are settled exactly: sets
   that are similar enough share one of their rarest shingles (prefix filter). First each class
   meets one centre, the class whose own rarest shingles are the commonest: what many changed copies
   were made from, and its deepest neighbours. A pair inside one component cannot change the
   result, so only what is still apart, and shares a rare shingle, is joined and confirmed.
6. Components grow by alternating star contraction over stored tables.

A pair at the threshold shares a prefix of three in an order with probability 0.42, so all 24
orders miss it with probability 2e-6. A pair that shares one is compared, or settled by step 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tarmac.llm.shared import in_batches, ready, spans_of, stored, utf8
from tarmac.llm.words import SPACED, mix, sequences, words

SHINGLE = 5
VALUES = 128
ORDERS = 24
DEPTH = 12
LEAST = 3
NEIGHBOURS = 4
BLOCK = 2 << 20
FILTER_BITS = 1 << 23
RARITY_CELLS = 1 << 19
SALTED = 4_096  # rows of a shingle that go to one task
DEEP = 48  # values of a key where regions are crowded
BESIDE = 2  # rows after each that are its neighbours there
TRIES = 12  # of these neighbours that are confirmed for each class
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
_FACTORS = (_SEEDS[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_SEEDS[VALUES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all rows, with repeats, and where each row's begin (n + 1).

    A row of fewer words than `size` has one shingle, its whole sequence; one without words none.
    """
    numbers, _, _, at = words(raw, offsets, SPACED)
    count = np.diff(at)
    every = sequences(numbers, size)
    sizes = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begins[-1], np.uint64)
    long = count >= size
    if long.any():
        # Positions of `every` whose shingle lies inside one row.
        inside = np.ones(len(every), bool)
        for border in range(1, size):
            cut = at[1:-1] - border
            inside[cut[(cut >= 0) & (cut < len(every))]] = False
        short = np.zeros(begins[-1], bool)
        short[begins[:-1][~long & (count > 0)]] = True
        out[~short] = every[inside]
    for row in np.flatnonzero(~long & (count > 0)):
        out[begins[row]] = sequences(numbers[at[row] : at[row + 1]], int(count[row]))[0]
    return out, begins


def signatures(shingles: np.ndarray, begins: np.ndarray, values: int = VALUES) -> np.ndarray:
    """MinHash values (16 bits each) of rows that have shingles."""
    out = np.empty((len(begins) - 1, values), np.uint16)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    work = np.empty_like(low)
    for k in range(values):
        np.multiply(low, _FACTORS[k], out=work)
        np.bitwise_xor(work, _SHIFTS[k], out=work)
        least = np.minimum.reduceat(work, begins[:-1])
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _prints(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = utf8(batch.column(1))
    n, first, second, marks = [], [], [], []
    for a, b in spans_of(offsets, BLOCK):
        part = raw[offsets[a] : offsets[b]]
        shingles, begins = shingle_sets(part, offsets[a : b + 1] - offsets[a])
        some = np.flatnonzero(np.diff(begins))
        values = signatures(shingles, np.append(begins[some], begins[-1])) if len(some) else None
        size, one, two = (np.zeros(b - a, t) for t in (np.int64, np.int64, np.int64))
        mark: list[bytes | None] = [None] * (b - a)
        for k, row in enumerate(some):
            own = np.unique(shingles[begins[row] : begins[row + 1]])
            size[row] = len(own)
            one[row] = mix(own).sum(dtype=np.uint64).astype(np.int64)
            two[row] = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
            mark[row] = values[k].astype(">u2").tobytes()
        n.append(size), first.append(one), second.append(two), marks.extend(mark)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (n, first, second)), pa.array(marks, pa.binary())],
        names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "mark"],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit digest of the shingle set, and the signature (null for no words)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return in_batches(rows, _prints, "doc_id bigint, text_hash bigint, n_shingles bigint, d1 bigint, d2 bigint, mark binary")


def _order_columns() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(VALUES) for _ in range(ORDERS)])


def _sort_keys(depth: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = _order_columns()[:, :depth]
    marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, VALUES)
    flat = np.ascontiguousarray(marks[:, columns]).view(np.uint8).reshape(-1)
    n = len(marks) * ORDERS
    key = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 2 * depth * n + 1, 2 * depth, dtype=np.int32)), pa.py_buffer(flat)])
    ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), ORDERS)
    orders = np.tile(np.arange(ORDERS, dtype=np.int32), len(marks))
    return pa.RecordBatch.from_arrays([pa.array(orders), key, pa.array(ids)], names=["ord", "key", "id"])


def _near(orders: np.ndarray, keys: np.ndarray, ids: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows at most `reach` apart that share an order and LEAST values; positions and shared depth."""
    left, right, depth = [], [], []
    for step in range(1, min(reach, len(ids) - 1) + 1):
        same = keys[:-step] == keys[step:]
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        shared[orders[:-step] != orders[step:]] = 0
        at = np.flatnonzero((shared >= LEAST) & (ids[:-step] != ids[step:]))
        left.append(at), right.append(at + step), depth.append(shared[at])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty), np.concatenate(depth or empty)


def _whole_regions(orders: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which pairs lie in a region that is compared whole: at most NEIGHBOURS + 1 rows share the pair's prefix."""
    n = len(orders)
    shared = np.zeros(n + 2 * NEIGHBOURS, np.int64)  # by each row and the next, with room at both ends
    same = np.logical_and.accumulate(keys[:-1] == keys[1:], axis=1).sum(axis=1)
    same[orders[:-1] != orders[1:]] = 0
    shared[NEIGHBOURS : NEIGHBOURS + n - 1] = same
    rows = right - left + 1
    before, after = np.ones(len(left), bool), np.ones(len(left), bool)
    for k in range(NEIGHBOURS):
        before &= shared[NEIGHBOURS + left - 1 - k] >= depth
        after &= shared[np.minimum(NEIGHBOURS + right + k, len(shared) - 1)] >= depth
        rows += before.astype(np.int64) + after
    return rows <= NEIGHBOURS + 1


def _neighbours(depth: int, whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one sorted partition; its first and last rows, for the border, as rows with a place."""
    place = TaskContext.get().partitionId()
    names = ["a", "b", "border", "at", "ord", "key"]
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not held:
        return
    orders, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
    keys = np.frombuffer(b"".join(key for x in held for key in x[1]), ">u2").reshape(-1, depth)
    reach = NEIGHBOURS if whole else BESIDE
    left, right, shared = _near(orders, keys, ids, reach)
    if whole:
        good = _whole_regions(orders, keys, left, right, shared)
        left, right, shared = left[good], right[good], shared[good]
    a, b = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    n = len(a)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.array(shared.astype(np.int32)), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.binary())], names=names)
    for border, rows, at in ((place - 1, slice(0, reach), reach), (place, slice(-reach, None), reach - min(reach, len(ids)))):
        own = ids[rows]
        n = len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(own), pa.array(np.full(n, border, np.int32)), pa.array((at + np.arange(n)).astype(np.int32)), pa.array(orders[rows].astype(np.int32)), pa.array([k.tobytes() for k in keys[rows]], pa.binary())], names=names
        )


def _over_border(depth: int, reach: int, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    keys = np.frombuffer(b"".join(rows["key"]), ">u2").reshape(-1, depth)
    ids, early = rows["a"].to_numpy(), (rows["at"] < reach).to_numpy()
    left, right, shared = _near(rows["ord"].to_numpy(), keys, ids, reach)
    over = early[left] & ~early[right]
    left, right, shared = left[over], right[over], shared[over]
    return pd.DataFrame({"a": np.minimum(ids[left], ids[right]), "b": np.maximum(ids[left], ids[right]), "depth": shared.astype("int64")})


def candidates(classes: DataFrame, depth: int = DEPTH, whole: bool = True) -> DataFrame:
    """(a, b, weight): pairs of classes (id, mark) near in some order, weighted by the values they share there.

    With `whole` those of regions that are compared whole, else each row's next ones in every order.
    """
    spark = ready(classes.sparkSession)
    reach = NEIGHBOURS if whole else BESIDE
    keys = in_batches(classes.select("id", "mark"), lambda batch: _sort_keys(depth, batch), "ord int, key binary, id bigint").select("ord", "key", "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, "ord", "key", "id").sortWithinPartitions("ord", "key", "id")
    found = stored(ordered.mapInArrow(lambda batches: _neighbours(depth, whole, batches), "a bigint, b bigint, border int, at int, ord int, key binary"), "neighbours")
    inner = found.where("border is null").select("a", "b", F.col("at").cast("long").alias("depth"))
    outer = found.where("border is not null").groupBy("border").applyInPandas(lambda rows: _over_border(depth, reach, rows), "a bigint, b bigint, depth bigint")
    return inner.unionByName(outer).groupBy("a", "b").agg(F.sum("depth").alias("weight"))


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of pairs with both texts those whose full sets are similar enough."""
    a, b = batch.column(0), batch.column(1)
    (raw1, at1), (raw2, at2) = utf8(batch.column(2)), utf8(batch.column(3))
    keep, last, set1 = np.zeros(len(a), bool), None, None
    ids = a.to_numpy(zero_copy_only=False)
    for i in range(len(a)):
        if ids[i] != last:
            set1 = np.unique(shingle_sets(raw1[at1[i] : at1[i + 1]], np.array([0, at1[i + 1] - at1[i]]))[0])
            last = ids[i]
        set2 = np.unique(shingle_sets(raw2[at2[i] : at2[i + 1]], np.array([0, at2[i + 1] - at2[i]]))[0])
        both = len(np.intersect1d(set1, set2, assume_unique=True))
        keep[i] = 100 * both >= 75 * (len(set1) + len(set2) - both)
    mask = pa.array(keep)
    return pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets; texts: id, text."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return in_batches(both, _linked, "a bigint, b bigint")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges (v, u) stored, with their number and a sum over them, both observed while writing."""
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("v", "u").cast("decimal(20,0)")).alias("total"))
    return stored(watched, "edges"), (seen.get["n"], seen.get["total"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in `links` (a, b); root is the smallest id that can be reached.

    Large-star and small-star steps in turn, each stored, until a round changes nothing.
    """
    edges, state = _written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct())
    while state[0]:
        both = edges.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.v", "e.u")
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        edges, now = _written(small.select("e.v", "e.u").where("v <> u").distinct())
        if now == state:
            break
        state = now
    return edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "id").unionByName(
        edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct()
    )


def _bit_map(bits: DataFrame) -> Broadcast:
    """Which of FILTER_BITS numbers occur in `bits` (bit), a bit each; of that size however many rows there are."""
    marked = bits.select((F.col("bit") + 1).alias("x"))
    cells = marked.groupBy(F.bitmap_bucket_number("x").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for cell, bits_ in cells:  # at most FILTER_BITS / 32768 rows
        table[(cell - 1) * len(bits_) : cell * len(bits_)] = np.frombuffer(bytes(bits_), np.uint8)
    return bits.sparkSession.sparkContext.broadcast(table)


def _marked(sent: Broadcast, bits: np.ndarray) -> np.ndarray:
    """Which of the numbers a bit map holds."""
    return (sent.value[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def parted(rows: DataFrame, some: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose `key` columns do not occur in `some`, and those where they may; a bit map tells.

    The first need no join. Rows without the first of the key's columns never occur.
    """
    bit = F.when(F.col(key[0]).isNotNull(), F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS)))
    sent = _bit_map(some.select(bit.alias("bit")).where("bit is not null"))
    marked = rows.withColumn("bit", F.coalesce(bit, F.lit(-1)))

    def part(wanted: bool):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            may = _marked(sent, np.maximum(bits, 0)) & (bits >= 0)
            return batch.filter(pa.array(may == wanted))

        return in_batches(marked, work, marked.schema).select(*rows.columns)

    return part(False), part(True)


def texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, text), stored: one text for each of `classes` (id, doc_id, text_hash), by the document and text they name.

    A bit map keeps most other texts out of the shuffle; the join then settles which rows belong.
    """
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FILTER_BITS))
    sent = _bit_map(classes.select(bit.alias("bit")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_marked(sent, batch.column(3).to_numpy(zero_copy_only=False))))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    near = in_batches(rows.withColumn("bit", bit), work, "doc_id bigint, text string, text_hash bigint, bit bigint")
    out = stored(near.join(classes.select("id", "doc_id", "text_hash"), ["doc_id", "text_hash"]).select("id", "text").dropDuplicates(["id"]), "texts")
    sent.destroy()
    return out


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components of `links` (a, b) and those of `roots` (id, root) together."""
    return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links))


def near_links(pairs: DataFrame, classes: DataFrame, unsettled: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): the true links among the best pair of every class and the other candidates.

    Pairs of two classes in `unsettled` (id) are left out, but for the best: these are settled exactly.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.struct("weight", "a", "b").alias("p"))
    best = ends.groupBy("id").agg(F.max("p").alias("p")).select("p.a", "p.b")
    held = unsettled.withColumn("held", F.lit(True))
    rest = pairs
    for end in ("a", "b"):
        rest = rest.join(held.select(F.col("id").alias(end), F.col("held").alias(f"{end}_held")), end, "left")
    chosen = stored(best.unionByName(rest.where("a_held is null or b_held is null").select("a", "b")).distinct(), "chosen")
    return confirmed(chosen, texts_of(docs, _named(chosen, classes)))


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that occur in `pairs` (a, b)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return stored(classes.select("id", "doc_id", "text_hash").join(ids, "id", "left_semi"), "named")


def _stretches(marks: list[bytes]) -> np.ndarray:
    """For each class (rows) and order (columns) a number of the stretch of LEAST values that it lies in."""
    values = np.frombuffer(b"".join(marks), ">u2").reshape(-1, VALUES)[:, _order_columns()[:, :LEAST]].astype(np.uint64)
    out = np.broadcast_to(np.arange(ORDERS, dtype=np.uint64), values.shape[:2])
    for k in range(LEAST):
        out = out << np.uint64(16) | values[:, :, k]
    return out.astype(np.int64)


def crowded(classes: DataFrame) -> DataFrame:
    """(id), stored, of the classes in stretches with more rows than are compared with each other.

    Kept as a bit map of fixed size, which may take in others as well but leaves none out.
    """

    def every(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_stretches(batch.column(0).to_pylist()).reshape(-1))], names=["stretch"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = (mix(_stretches(batch.column(1).to_pylist()).astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(_marked(sent, bits).any(axis=1)))], names=["id"])

    def bit(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) % np.uint64(FILTER_BITS)
        return pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int64))], names=["bit"])

    counted = in_batches(classes.select("mark"), every, "stretch bigint").groupBy("stretch").agg(F.count("*").alias("n"))
    sent = _bit_map(in_batches(counted.where(F.col("n") > NEIGHBOURS + 1).select("stretch"), bit, "bit bigint"))
    out = stored(in_batches(classes.select("id", "mark"), work, "id bigint"), "crowded")
    sent.destroy()
    return out


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The shingle set of every row, sorted."""
    raw, offsets = utf8(batch.column(column))
    for a, b in spans_of(offsets, BLOCK):
        shingles, begins = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for row in range(b - a):
            yield np.unique(shingles[begins[row] : begins[row + 1]])


def _rarity(texts: DataFrame) -> Broadcast:
    """About how many sets hold a shingle: counts of RARITY_CELLS cells, which shingles share by their hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(RARITY_CELLS, np.int32)
        for batch in batches:
            for own in _sets(batch, 0):
                np.add.at(held, own % np.uint64(RARITY_CELLS), 1)
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(held[cells].astype(np.int64))], names=["cell", "n"])

    rows = texts.select("text").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most RARITY_CELLS rows
    table = np.zeros(RARITY_CELLS, np.int32)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return texts.sparkSession.sparkContext.broadcast(table)


def rare_shingles(texts: DataFrame) -> DataFrame:
    """(shingle, id, n, p, common), stored: the first n // 4 + 1 of each set's n shingles, rarest first, and their place p.

    The order is the same for all sets. Sets of sizes s <= t that link share at least
    3 / 7 (s + t) shingles, so the first one they share has a place of at most s / 7 in the
    smaller and t / 4 in the larger. `common` tells how many sets hold the set's own shingle at
    place n / 7: one that many others were made from has no rarer ones.
    """
    ready(texts.sparkSession)
    sent = _rarity(texts)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        first, common = [], []
        for own in _sets(batch, 1):
            rarity = sent.value[own % np.uint64(RARITY_CELLS)]
            order = np.lexsort((own, rarity))
            first.append((own[order[: len(own) // 4 + 1]], len(own)))
            common.append(rarity[order[len(own) // 7]])
        held = np.array([len(x) for x, _ in first], np.int64)
        shingle = np.concatenate([x for x, _ in first] or [np.zeros(0, np.uint64)]).view(np.int64)
        place = np.arange(len(shingle)) - np.repeat(np.cumsum(held) - held, held)
        size = np.repeat(np.array([n for _, n in first], np.int64), held)
        return pa.RecordBatch.from_arrays(
            [pa.array(shingle), pa.array(np.repeat(ids, held)), pa.array(size), pa.array(place), pa.array(np.repeat(np.array(common, np.int64), held))], names=["shingle", "id", "n", "p", "common"]
        )

    out = stored(in_batches(texts.select("id", "text"), work, "shingle bigint, id bigint, n bigint, p bigint, common bigint"), "rare")
    sent.destroy()
    return out


def _centres(rows: DataFrame) -> DataFrame:
    """(a, b): each class with the centre that it shares most rare shingles with; rows: shingle, id, common."""
    centre = rows.groupBy("shingle").agg(F.max(F.struct("common", F.negate("id").alias("id"))).alias("c"), F.count("*").alias("held"))
    centre = centre.where("held > 1").select("shingle", F.negate("c.id").alias("centre"))
    met = rows.select("shingle", "id").join(centre, "shingle").where("id <> centre")
    met = met.groupBy("id", "centre").agg(F.count("*").alias("shared")).groupBy("id").agg(F.max(F.struct("shared", F.negate("centre").alias("centre"))).alias("m"))
    return met.select("id", F.negate("m.centre").alias("centre")).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _deepest(classes: DataFrame) -> DataFrame:
    """(a, b): each class (id, mark) with the TRIES that it shares the longest prefixes with, over all orders."""
    ends = stored(candidates(classes, DEEP, whole=False), "deep").select(F.explode(F.array("a", "b")).alias("id"), "a", "b", "weight")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "a", "b"))  # rows bounded by the orders
    return ends.withColumn("place", place).where(F.col("place") <= TRIES).select("a", "b").distinct()


def settled(links: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, root) of the components of `links` (a, b) and of every link among `classes` (id, doc_id, text_hash, mark).

    Each class meets a centre and the classes nearest to it at the greatest depth. What is still
    apart then is joined by the rarest shingles: of a shingle's rows those of its commonest component
    meet just the others, and hot shingles are dealt out by hash.
    """
    texts = texts_of(docs, classes)
    rows = rare_shingles(texts)
    first = stored(_centres(rows).unionByName(_deepest(classes)).distinct(), "first")
    roots = components(links.unionByName(confirmed(first, texts)))
    apart = rows.drop("common").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    held = apart.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c"), F.count("*").alias("roots"))
    held = held.where("roots > 1").select("shingle", F.col("m.root").alias("main"), F.ceil(F.col("c") / SALTED).cast("int").alias("salts"))
    apart = stored(apart.join(held, "shingle").withColumn("mine", F.col("root") == F.col("main")).drop("main"), "apart")
    less = apart.where("7 * p <= n").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    more = apart.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    renamed = lambda df, x: df.select("shingle", "salt", *(F.col(c).alias(f"{c}{x}") for c in ("id", "root", "n", "p")))
    met = None
    for left, right in ((less.where("not mine"), more), (less.where("mine"), more.where("not mine"))):
        both = renamed(left, 1).join(renamed(right, 2), ["shingle", "salt"])
        both = both.where("root1 <> root2 and (n1 < n2 or n1 = n2 and id1 < id2) and 7 * least(n1 - p1, n2 - p2) >= 3 * (n1 + n2)")
        met = both if met is None else met.unionByName(both)
    # Shared shingles up to the last places, and all that may follow.
    most = F.count("*") + F.least(F.max(F.col("n1") - 1) - F.max("p1"), F.max(F.col("n2") - 1) - F.max("p2"))
    pairs = met.groupBy("id1", "id2").agg(most.alias("most"), F.max(F.col("n1") + F.col("n2")).alias("n"))
    pairs = stored(pairs.where("7 * most >= 3 * n").select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")), "settling")
    found = stored(confirmed(pairs, texts), "links")
    return roots if found.isEmpty() else _joined(roots, found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of `docs` (doc_id, text).

    Words are what ASCII white space separates, with A-Z in lower case. Null or empty texts, and
    texts of white space, have no shingles: they link with nothing and are kept. Rows that repeat
    a doc_id are each judged by their own text: component_id is the smallest doc_id among the
    documents whose sets their own set reaches, and a row is kept if its doc_id is that one. So a
    repeated row is kept like the first. Rows without doc_id stand alone: component null, kept.
    Other columns are ignored. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs), "prints")
    named = prints.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("mark").alias("mark"))
    # The numbers are made while the table is written, so every later step reads the same ones.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "n_shingles", "rep.doc_id", "rep.text_hash", "mark"), "classes")
    pairs = stored(candidates(classes), "pairs")
    unsettled = crowded(classes)
    links = near_links(pairs, classes, unsettled, docs)
    if unsettled.isEmpty():
        roots = components(links)
    else:
        roots = settled(links, classes.select("id", "doc_id", "text_hash", "mark").join(unsettled, "id", "left_semi"), docs)
    rooted = classes.join(roots, "id", "left").select("d1", "d2", "n_shingles", "doc_id", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
    rooted = stored(rooted.join(least, "root").select("d1", "d2", "n_shingles", "component"), "rooted")
    out = prints.drop("mark").join(rooted, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash"
    )
