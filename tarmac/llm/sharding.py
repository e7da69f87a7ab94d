"""Sharding by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Groups are dealt by hash into cells; in a cell, partial
partitions (at first one group each) are combined, always the two with the largest spread and
in opposite order, until one is left. The cells' partial partitions are then the items of the
next level, and so on until one partition remains, so no task ever holds more than a bounded
number of items.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.shared import ready, stored

CELL = 20_000  # groups combined by one task
FAN = 2_000  # partial partitions combined by one task at the next level
RANK_ROWS = 20_000


def difference(items: list[tuple[int, ...]], shards: int) -> list[list[int]]:
    """For each item (its sums by part) the shard that each of its parts goes to.

    Every item is a partial partition; the two with the largest spread are combined, the fullest
    part of one with the emptiest of the other, until one is left.
    """
    n = len(items)
    turned = [sorted(range(shards), key=lambda k: -x[k]) for x in items]
    sums = [tuple(x[k] for k in order) for x, order in zip(items, turned)]
    made: list[tuple[int, int, list[int]]] = []
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        one, two = sums[a], sums[b]
        total = [x + y for x, y in zip(one, reversed(two))]
        order = sorted(range(shards), key=lambda k: -total[k])
        made.append((a, b, order))
        new = tuple(total[k] for k in order)
        sums[a] = sums[b] = ()
        sums.append(new)
        heapq.heappush(heap, (new[-1] - new[0], len(sums) - 1))
    place: list[list[int]] = [[] for _ in sums]
    if sums:
        place[-1] = list(range(shards))
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = made[node - n]
        to_a, to_b = [0] * shards, [0] * shards
        for slot, k in enumerate(order):
            to_a[k] = to_b[shards - 1 - k] = place[node][slot]
        place[a], place[b] = to_a, to_b
        place[node] = []
    out = []
    for own, order in zip(place[:n], turned):
        to = [0] * shards
        for slot, k in enumerate(order):
            to[k] = own[slot]
        out.append(to)
    return out


def _differ_groups(shards: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "digest"], ascending=False)
        rest = (0,) * (shards - 1)
        to = difference([(int(x), *rest) for x in rows["bytes"]], shards)
        return pd.DataFrame({"digest": rows["digest"], "bytes": rows["bytes"], "cell": rows["cell"], "part": [x[0] for x in to]})

    return work


def _differ_parts(shards: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="cell", columns="part", values="bytes").reindex(columns=range(shards)).fillna(0).astype("int64")
        to = difference([tuple(map(int, x)) for x in table.to_numpy()], shards)
        return pd.DataFrame(
            {
                "cell": np.repeat(table.index.to_numpy(), shards), "part": np.tile(np.arange(shards), len(table)),
                "parent": int(rows["parent"].iloc[0]), "to": np.concatenate(to), "bytes": table.to_numpy().reshape(-1),
            }
        )

    return work


def assigned(groups: DataFrame, shards: int) -> DataFrame:
    """(digest, shard) for groups (digest, bytes)."""
    ready(groups.sparkSession)
    cells = max(1, math.ceil(groups.count() / CELL))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)))
    placed = stored(dealt.groupBy("cell").applyInPandas(_differ_groups(shards), "digest binary, bytes bigint, cell bigint, part int"), "groups")
    tops = placed.groupBy("cell", "part").agg(F.sum("bytes").alias("bytes"))
    placed = placed.select("digest", "cell", "part")
    while cells > 1:
        cells = math.ceil(cells / FAN)
        level = tops.withColumn("parent", F.pmod(F.col("cell"), F.lit(cells)))
        moved = stored(level.groupBy("parent").applyInPandas(_differ_parts(shards), "cell bigint, part int, parent bigint, to int, bytes bigint"), "level")
        placed = placed.join(moved.select("cell", "part", "parent", "to"), ["cell", "part"]).select("digest", F.col("parent").alias("cell"), F.col("to").alias("part"))
        tops = moved.groupBy(F.col("parent").alias("cell"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
    return placed.select("digest", F.col("part").alias("shard"))


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """`df` (stored) with a gapless number from 0 within each `key`; hot keys are ranked by many tasks."""
    cells = max(1, math.ceil(df.count() / RANK_ROWS))
    df = df.withColumn("_cell", F.pmod(F.hash(*order), F.lit(cells)))
    counts = df.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_cell")) - F.col("_n")
    within = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order))
    joined = df.withColumn("_within", within).join(counts.select(key, "_cell", before.alias("_before")), [key, "_cell"])
    return joined.withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_cell", "_within", "_before")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs` (doc_id, text).

    The law is `bytes`: equal texts stay together and the shards' sizes are as equal as
    differencing makes them, but for a group larger than a shard's share. A null text counts as an
    empty one (size 1). Repeated rows and rows without doc_id each get a slot of their own; other
    columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    dealt = stored(rows.join(assigned(groups, shards), "digest").select("doc_id", "size", "text_crc32", "shard"), "dealt")
    out = numbered(dealt, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
