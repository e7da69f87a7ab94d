"""Nearest neighbours by largest inner product: a forest of hash prefixes.

A vector has a string of 32 sign bits in each of 24 trees (random planes; vectors are first
lengthened to one norm by an extra component, which turns the largest inner product into the
smallest angle). A query descends in every tree to its longest match and then ascends in all
trees at once, two bits at a time, until the prefixes it stands on hold enough vectors. How many
are enough is fitted: a bounded sample of queries is searched exhaustively, and the least number
that finds 96 % of their true neighbours is taken, up to all vectors where the data have no
structure to use. Every vector is indexed and every candidate scored exactly.

A query whose prefixes hold as many vectors over all trees as there are at all looks at each vector
once instead, so it never does more than an exhaustive search would.

Equal vectors are one entry with its 21 smallest ids, which is all that any query can need.
A prefix with many vectors is split into chunks and its queries into blocks; every block meets
every chunk in a group of its own. Scores are those of the vectors as given, floats or doubles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.shared import in_batches, ready, stored

TREES = 24
BITS = 32
NEAREST = 20
EVERY = 20
SAMPLE = 96  # queries the search effort is fitted on
RECALL = 0.96
CHUNK = 1 << 21  # components of the entries that are scored in one group
QUERIES = 16_384  # queries of a prefix that are scored in one group
MOST_LEVELS = 24
STEP = 2  # bits that are ascended at once
SENT = 50_000  # rows of a table that every task is sent
SHALLOW = 8  # levels whose prefixes are few and crowded


@functools.cache
def _planes(dimensions: int) -> np.ndarray:
    return np.random.default_rng(dimensions).standard_normal((dimensions + 1, TREES * BITS)).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of `dim` components, kept as little-endian floats or doubles, as rows of doubles."""
    raw = column.to_pylist()
    kind = "<f8" if raw and len(raw[0]) == 8 * dim else "<f4"
    return np.frombuffer(b"".join(raw), kind).reshape(len(column), -1).astype(np.float64)


def codes(vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The bit strings (trees in columns) of vectors lengthened by `extra`."""
    planes = _planes(vectors.shape[1])
    signs = vectors.astype(np.float32) @ planes[:-1] + extra[:, None].astype(np.float32) * planes[-1] > 0
    packed = np.packbits(signs.reshape(len(vectors), TREES, BITS), axis=2)
    return packed.view(">u4")[:, :, 0].astype(np.int64)


def usable(embedding: Column) -> Column:
    """Neither null nor empty, no null or non-finite component, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    kind = "<f8" if batch.schema.field(1).type.value_type == pa.float64() else "<f4"
    rows = [np.array(x, kind) for x in batch.column(1).to_pylist()]
    norms = [float((x.astype(np.float64) ** 2).sum()) for x in rows]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([len(x) for x in rows], pa.int32()), pa.array(norms, pa.float64())], names=["cls", "vector", "dim", "norm2"]
    )


def known_vectors(vectors: DataFrame) -> DataFrame:
    """The usable rows (vec_id, embedding), once each; components stay floats or are doubles."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # Zeros of either sign are the same number.
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))).distinct()


def entries(rows: DataFrame, keep: int = NEAREST + 1) -> DataFrame:
    """cls (smallest id), ids (the `keep` smallest), vector, dim, norm2 of every distinct vector of `known_vectors`."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= keep)
    grouped = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.col("ids")[0])
    grouped = stored(grouped, "distinct")
    packed = in_batches(grouped.select("cls", "embedding"), _packed, "cls bigint, vector binary, dim int, norm2 double")
    return stored(packed.join(grouped.select("cls", "ids"), "cls"), "entries")


def _by_dimension(batch: pa.RecordBatch, dims: int):
    """Row numbers of a batch by vector length."""
    dim = batch.column(dims).to_numpy(zero_copy_only=False)
    return [(d, np.flatnonzero(dim == d)) for d in np.unique(dim)]


def _coded(longest: dict[int, float], query: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.empty((batch.num_rows, TREES), np.int64)
        norm2 = batch.column(3).to_numpy(zero_copy_only=False)
        for d, own in _by_dimension(batch, 2):
            x = _matrix(batch.column(1).take(pa.array(own)), int(d))
            extra = np.zeros(len(own)) if query else np.sqrt(np.maximum(longest[int(d)] - norm2[own], 0))
            out[own] = codes(x, extra)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(out), pa.list_(pa.int64()))], names=["cls", "vector", "dim", "codes"])

    return work


def _prefix(level: Column) -> Column:
    return (F.col("code") / F.pow(F.lit(2.0), BITS - level)).cast("long")


def _levels(coded: DataFrame, levels: Column) -> DataFrame:
    """One row per tree and level in `levels` with the prefix there."""
    rows = coded.select("*", F.posexplode("codes").alias("tree", "code")).drop("codes")
    return rows.withColumn("level", F.explode(levels)).withColumn("prefix", _prefix(F.col("level")))


def _met(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is sent to every task if it has few rows, and sorted otherwise.

    Its size on disk says little: codes, levels and counts take many times as much in memory.
    """
    return F.broadcast(side) if rows <= SENT else side.hint("merge")


def _on_prefixes(rows: Callable[[bool], DataFrame], side: DataFrame, at: list[str]) -> DataFrame:
    """`rows` joined with `side`, which has one row per prefix.

    `rows` gives those of some levels, up to SHALLOW (False) or beyond it (True). A shallow prefix
    holds a large share of all rows, but there are few of them, so they are sent; deep ones may
    be as many as the entries.
    """
    few, many = side.where(F.col("level") <= SHALLOW), side.where(F.col("level") > SHALLOW)
    return rows(False).join(F.broadcast(few), at).unionByName(rows(True).join(_met(many, many.count()), at))


def _best(query: np.ndarray, points: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the n best points and their exact scores, best first, ties to smaller ids."""
    rough = points @ query
    if len(rough) > n:
        cut = np.partition(rough, len(rough) - n)[len(rough) - n]
        near = np.flatnonzero(rough >= cut - 1e-9 * max(1.0, abs(cut)))
    else:
        near = np.arange(len(rough))
    exact = (points[near] * query).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:n]
    return near[order], exact[order]


def _scorer(n: int):
    """The n best entries of one chunk of one prefix for every query of one block that stands on it."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, cls, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            points, ids = _matrix(right.column("vector").combine_chunks(), dim), right.column("cls").to_numpy()
            queries = _matrix(left.column("vector").combine_chunks(), dim)
            for q, query in zip(left.column("cls").to_pylist(), queries):
                near, exact = _best(query, points, ids, n)
                asked.append(np.full(len(near), q, np.int64)), cls.append(ids[near]), scores.append(exact)
        return pa.table({"q": pa.array(np.concatenate(asked)), "cls": pa.array(np.concatenate(cls)), "score": pa.array(np.concatenate(scores))})

    return score


def exhaustive(sample: list[tuple[int, bytes, int]], points: DataFrame, n: int) -> DataFrame:
    """(q, cls, score) of the n best entries for each of a bounded list of queries, by one pass over all entries."""
    sent = points.sparkSession.sparkContext.broadcast(sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for d, own in _by_dimension(batch, 2):
            x = _matrix(batch.column(1).take(pa.array(own)), int(d))
            for q, vector, dim in sent.value:
                if dim == d:
                    near, exact = _best(np.frombuffer(vector, "<f8" if len(vector) == 8 * dim else "<f4").astype(np.float64), x, ids[own], n)
                    out += [(q, int(ids[own[k]]), float(s)) for k, s in zip(near, exact)]
        q, cls, score = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(cls, pa.int64()), pa.array(score, pa.float64())], names=["q", "cls", "score"])

    rows = in_batches(points.select("cls", "vector", "dim"), work, "q bigint, cls bigint, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def enough(totals: dict[int, dict[int, int]], depths: dict[int, list[int]], recall: float = RECALL) -> float:
    """The least number of vectors to gather so that the sample's mean recall is at least `recall`.

    totals: per query the vectors held at each level; depths: per query the level down to which
    each true neighbour is found. Infinity means all vectors.
    """

    def found(target: float) -> float:
        parts = []
        for q, near in depths.items():
            level = max((k for k, n in totals[q].items() if n >= target), default=0)
            parts.append(sum(d >= level for d in near) / len(near))
        return sum(parts) / len(parts)

    choices = sorted({n for by_level in totals.values() for n in by_level.values()})
    low, high = 0, len(choices)
    while low < high:  # recall grows with the target
        middle = (low + high) // 2
        if found(choices[middle]) >= recall:
            high = middle
        else:
            low = middle + 1
    return float(choices[low]) if low < len(choices) else float("inf")


def search(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each row whose vec_id `every` divides.

    Rows without id or with an unusable vector take no part, nor do pairs of unequal length. Rows
    that repeat an id and vector count once; a query never finds its own id. With fewer candidates
    than asked for all are returned. Other columns are ignored; an empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    known = known_vectors(vectors)
    found = entries(known, nearest + 1)
    query_rows = in_batches(known.where(F.col("vec_id") % every == 0), _packed, "cls bigint, vector binary, dim int, norm2 double")
    asked = query_rows.select(F.col("cls").alias("query_id"), "vector").join(found.select("cls", "vector"), "vector")
    asked = stored(asked.select("query_id", "cls"), "asked")
    asking_rows = asked.count()
    longest = {r.dim: r.m for r in found.groupBy("dim").agg(F.max("norm2").alias("m")).collect()}  # one row per vector length
    points = stored(in_batches(found.select("cls", "vector", "dim", "norm2"), _coded(longest, False), "cls bigint, vector binary, dim int, codes array<bigint>"), "points")
    wanted = found.join(_met(asked.select("cls").distinct(), asking_rows), "cls", "left_semi")
    queries = stored(in_batches(wanted.select("cls", "vector", "dim", "norm2"), _coded(longest, True), "cls bigint, vector binary, dim int, codes array<bigint>"), "queries")

    total = points.count()
    deepest = min(MOST_LEVELS, max(1, int(np.ceil(np.log2(max(total, 2))))))
    climbed = list(range(deepest, 0, -STEP))
    levels = F.array(*(F.lit(k) for k in climbed))

    def parted(of: list[int], make: Callable[[Column], DataFrame]) -> Callable[[bool], DataFrame]:
        return lambda deep: make(F.array(*(F.lit(k) for k in of if (k > SHALLOW) == deep)).cast("array<int>"))

    at = ["dim", "tree", "level", "prefix"]
    held = stored(_levels(points.select("dim", "codes"), levels).groupBy(*at).agg(F.count("*").alias("n")), "held")
    standing = _on_prefixes(parted(climbed, lambda some: _levels(queries.select("cls", "dim", "codes"), some)), held, at)
    stands = standing.groupBy("cls", "level").agg(F.sum("n").alias("n"))
    stands = stored(stands, "stands")

    drawn = queries.select("cls").orderBy(F.xxhash64("cls")).limit(SAMPLE)
    chosen = queries.join(F.broadcast(drawn), "cls", "left_semi").select("cls", "vector", "dim", "codes").collect()
    truth = exhaustive([(r.cls, bytes(r.vector), r.dim) for r in chosen], points, nearest + 1)
    near = points.select("cls", "codes").join(F.broadcast(truth), "cls").select("q", "cls", "codes").collect()  # SAMPLE * (nearest + 1) rows
    own = {r.cls: np.array(r.codes) for r in chosen}
    depths: dict[int, list[int]] = {}
    for r in near:
        if r.q != r.cls:
            differ = own[r.q] ^ np.array(r.codes)
            depths.setdefault(r.q, []).append(max(BITS - int(x).bit_length() for x in differ))
    ids = spark.createDataFrame([(q,) for q in depths], "cls bigint")
    totals: dict[int, dict[int, int]] = {q: {} for q in depths}
    for r in stands.join(F.broadcast(ids), "cls").collect():  # SAMPLE * MOST_LEVELS rows
        totals[r.cls][r.level] = r.n
    target = enough(totals, depths) if depths else float("inf")

    level = stands.where(F.col("n") >= F.lit(target)).groupBy("cls").agg(F.max(F.struct("level", "n")).alias("m"))
    # Prefixes that hold as many entries as there are, with those met in several trees, save nothing.
    placed = queries.join(_met(level, asking_rows), "cls", "left").withColumn("level", F.when(F.col("m.n") < total, F.col("m.level")).otherwise(0)).drop("m")
    requests = placed.select("cls", "vector", "dim", "level", F.posexplode("codes").alias("tree", "code"))
    # At level 0 every tree holds everything, so one is asked.
    requests = requests.where("level > 0 or tree = 0").withColumn("prefix", F.when(F.col("level") > 0, _prefix(F.col("level"))).otherwise(F.lit(0).cast("long")))
    sizes = held.unionByName(points.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.lit(0).alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix"), "n"))
    buckets = stored(requests.groupBy(*at).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(sizes.hint("merge"), at).withColumn("chunks", F.ceil(F.col("n") * F.col("dim") / CHUNK).cast("int")).select(*at, "chunks", "blocks"), "buckets")
    used = [r.level for r in buckets.where("level > 0").select("level").distinct().collect()]  # at most MOST_LEVELS rows
    columns = ["cls", "vector", *at]
    offered_whole = points.select("cls", "vector", "dim", F.lit(0).alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix"))
    deeper = parted(used, lambda some: _levels(points, some).select(*columns))
    offered = _on_prefixes(lambda deep: deeper(deep) if deep else deeper(deep).unionByName(offered_whole), buckets, at).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = _on_prefixes(lambda deep: requests.where((F.col("level") > SHALLOW) == deep), buckets, at).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    key = [*at, "block", "chunk"]
    one = asking.select(*key, "cls", "vector").groupBy(*key)
    two = offered.select(*key, "cls", "vector").groupBy(*key)
    scored = one.cogroup(two).applyInArrow(_scorer(nearest + 1), "q bigint, cls bigint, score double")

    # What several trees found has one rank, so it goes before the shuffle like all that ranks too low.
    rank = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
    best = scored.withColumn("n", rank).where(F.col("n") <= nearest + 1).drop("n").distinct()
    members = best.join(_met(found.select("cls", F.explode("ids").alias("vec_id")), total * (nearest + 1)), "cls").select("q", "vec_id", "score")
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= nearest + 1).drop("n")
    rows = _met(asked, asking_rows).join(members.withColumnRenamed("q", "cls"), "cls").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
