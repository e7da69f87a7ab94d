"""Time-range means, as-of joins and running recurrences over hot keys.

One key may hold a large share of all rows, so nothing here sorts a whole key in one task.
Rows are first reduced to distinct points in time (with map-side combine), the points of a
key are cut into time buckets, and what a bucket needs from its neighbours is carried in as
a few extra rows. All window frames here are running ones: the cost per row is constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.sources.tables import save_table
from tarmac.workspace import new_folder

MICROS = 1_000_000
DAY = 86_400
PIECES = 8
BOUND = 1_000_000  # rows of a window that one task sorts, at most
SLOTS = 1024  # cells of a crowded bucket


def micros(time: Column) -> Column:
    """Microseconds since the epoch of a timestamp or date (session time zone UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def whole_div(value: Column, by: int) -> Column:
    """Floor of an integer division, exact for large numbers."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def time_points(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Sum and count of `value` for every distinct (key, time): key, time, `_sum`, `_n`.

    Null and NaN values add nothing. Rows without key or time are left out.
    """
    number = F.col(value).cast("double")
    known = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, F.when(~F.isnan(number), number).alias("_v"))
    return known.groupBy(key, time).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_sum"), F.count("_v").alias("_n"))


def rolling_points(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    width: int,
    pieces: int = PIECES,
    at: DataFrame | None = None,
    bound: int = BOUND,
) -> DataFrame:
    """Mean of `value` in [t - width, t) for every distinct (key, t). Columns: key, t, mean.

    The t are those of `df`, or those of `at` if given; then only the parts of `df` that their
    ranges touch are kept. Times are in seconds, `pieces` a divisor of the width in microseconds.
    The mean is null where the range is empty. Null and NaN values are left out.
    """
    if at is not None:
        asked = at.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time).distinct()
        ends = asked.select(F.min(time).alias("low"), F.max(time).alias("high"))
        low = ends.select((F.col("low").cast("timestamp") - F.expr(f"interval {width} seconds")).cast(df.schema[time].dataType)).scalar()
        cell = whole_div(micros(F.col(time)), _piece(width, pieces))
        touched = asked.withColumn("_bucket", F.explode(F.sequence(cell - pieces, cell))).select(key, "_bucket").distinct()
        # The outer times prune files; the buckets then leave what some range can hold.
        source = df.where(F.col(time).between(low, ends.select("high").scalar()))
        source = source.withColumn("_bucket", cell).join(touched, [key, "_bucket"], "left_semi")
        return range_means(time_points(source, key, time, value), key, time, width, pieces, asked, bound)
    return range_means(time_points(df, key, time, value), key, time, width, pieces, bound=bound)


def _piece(width: int, pieces: int) -> int:
    if width * MICROS % pieces:
        raise ValueError(f"{pieces} pieces do not divide {width} seconds")
    return width * MICROS // pieces


def range_means(
    points: DataFrame, key: str, time: str, width: int, pieces: int = PIECES, at: DataFrame | None = None, bound: int = BOUND
) -> DataFrame:
    """As `rolling_points`, from `points` (key, time, `_sum`, `_n`), one per key and time; `at`: distinct (key, time).

    Time is cut into buckets of width / pieces. A range is the tail of the bucket it starts in,
    the whole buckets after it, and the head of the bucket of t: a running sum from the end, a
    sum of bucket totals and a running sum from the start. Nothing is subtracted, so neither a
    large value nor one that is no number spoils a sum it is not part of.

    The points are stored, as several steps read them. A bucket with more than `bound` / 2 points
    is cut into 1,024 cells of time, and a cell in which still more than `bound` fall once more, so
    that no task sorts more than `bound` rows together, or what a microsecond clock can tell apart
    within a millionth of a bucket.
    """
    span, size = width * MICROS, _piece(width, pieces)
    spark = points.sparkSession
    marked = points.withColumn("_wanted", F.lit(True))
    if at is not None:
        none = at.withColumns({"_sum": F.lit(0.0), "_n": F.lit(0).cast("bigint"), "_wanted": F.lit(True)})
        marked = points.withColumn("_wanted", F.lit(False)).unionByName(none.select(*marked.columns))
        marked = marked.groupBy(key, time).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.max("_wanted").alias("_wanted"))
    kind_of_time = points.schema[time].dataType
    points = save_table(marked.withColumn("_t", micros(F.col(time))), new_folder(spark, "points"))
    totals = points.groupBy(key, whole_div(F.col("_t"), size).alias("_bucket")).agg(F.sum("_sum").alias("_s"), F.sum("_n").alias("_c"), F.count(F.lit(1)).alias("_points"))
    zero = F.lit(0).cast("bigint")

    def mark(at_: Column, kind: int, total: Column, count: Column) -> Column:
        return F.struct(at_.alias("_at"), F.lit(kind).alias("_kind"), total.alias("_s"), count.alias("_c"))

    # Every point stands at its own time (kind 1) and, without a value, where its range starts
    # (kind 2). What comes before a bucket, or a cell of one, stands at its beginning (kind 0), what
    # follows a cell in its bucket behind its end (kind 3).
    own = mark(F.col("_t"), 1, F.col("_sum"), F.col("_n"))
    start = mark(F.col("_t") - span, 2, F.lit(0.0), zero)
    marks = points.select(key, time, "_wanted", F.inline(F.array(own, start))).where("_kind = 1 or _wanted")
    marks = marks.withColumns({"_bucket": whole_div(F.col("_at"), size), "_cell": F.lit(0)})

    def more(of: DataFrame, at_: Column, kind: int, total: str, count: str) -> DataFrame:
        rows = of.select(key, F.lit(None).cast(kind_of_time).alias(time), F.lit(False).alias("_wanted"), at_.alias("_at"), F.lit(kind).alias("_kind"), F.col(total).alias("_s"), F.col(count).alias("_c"), "_bucket", "_cell")
        return rows.where("_c > 0")

    whole = None
    if pieces > 1:
        ahead = totals.withColumn("_bucket", F.explode(F.sequence(F.col("_bucket") + 1, F.col("_bucket") + (pieces - 1))))
        whole = ahead.groupBy(key, "_bucket").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")).withColumn("_cell", F.lit(0))
    most = totals.agg(F.max("_points")).first()[0] or 0
    if most <= bound // 2:
        if whole is not None:
            marks = marks.unionByName(more(whole, F.col("_bucket") * size, 0, "_s", "_c"))
    else:
        large = totals.where(F.col("_points") > bound // 2).select(key, "_bucket")
        large = save_table(large.unionByName(large.withColumn("_bucket", F.col("_bucket") - pieces)).distinct(), new_folder(spark, "large"))
        usual = marks.join(large, [key, "_bucket"], "left_anti")
        if whole is not None:
            usual = usual.unionByName(more(whole.join(large, [key, "_bucket"], "left_anti"), F.col("_bucket") * size, 0, "_s", "_c"))
        crowded = _in_cells(marks.join(large, [key, "_bucket"], "left_semi"), key, size, bound)
        cells = crowded.groupBy(key, "_bucket", "_cell").agg(
            F.sum(F.when(F.col("_kind") == 1, F.col("_s")).otherwise(0.0)).alias("_s"), F.sum("_c").alias("_c"), F.min("_at").alias("_from"), F.max("_at").alias("_to")
        )
        if whole is not None:  # the whole buckets before stand in a cell before the first
            cells = cells.unionByName(whole.join(large, [key, "_bucket"], "left_semi").select(key, "_bucket", F.lit(-1).alias("_cell"), "_s", "_c", F.lit(None).cast("bigint").alias("_from"), F.lit(None).cast("bigint").alias("_to")))
        line = W.partitionBy(key, "_bucket").orderBy("_cell")
        earlier, later = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing)
        cells = cells.select(key, "_bucket", "_cell", "_from", "_to", *[F.sum(c).over(w).alias(f"{c}{x}") for c in ("_s", "_c") for w, x in ((earlier, "b"), (later, "a"))]).where("_cell >= 0")
        marks = usual.unionByName(crowded).unionByName(more(cells, F.col("_from"), 0, "_sb", "_cb")).unionByName(more(cells, F.col("_to") + 1, 3, "_sa", "_ca"))
    inside = W.partitionBy(key, "_bucket", "_cell")
    head = inside.orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, -1)
    tail = inside.orderBy(F.desc("_at"), "_kind").rowsBetween(W.unboundedPreceding, -1)

    def part(of: str) -> Column:
        return F.when(F.col("_kind") == 1, F.sum(of).over(head)).when(F.col("_kind") == 2, F.sum(F.when(F.col("_kind").isin(1, 3), F.col(of))).over(tail))

    parts = marks.withColumns({"_ps": part("_s"), "_pc": part("_c")}).where("_wanted")

    def both(of: str, none: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("_kind") == 2, F.col(of))), none) + F.coalesce(F.max(F.when(F.col("_kind") == 1, F.col(of))), none)

    return (
        parts.groupBy(key, time)
        .agg(both("_ps", F.lit(0.0)).alias("_s"), both("_pc", zero).alias("_c"))
        .select(key, time, (F.col("_s") / F.nullif(F.col("_c"), F.lit(0))).alias("mean"))
    )


def _in_cells(marks: DataFrame, key: str, size: int, bound: int) -> DataFrame:
    """The marks of crowded buckets, numbered by cells of time in the order of time.

    A bucket has SLOTS cells; a cell with more than `bound` marks has as many again.
    """
    inside = F.pmod(F.col("_at"), F.lit(size)) * SLOTS
    first = whole_div(inside, size)
    second = whole_div(F.pmod(inside, F.lit(size)) * SLOTS, size)
    marks = marks.withColumns({"_first": first.cast("int"), "_second": second.cast("int")})
    full = marks.groupBy(key, "_bucket", "_first").agg(F.count(F.lit(1)).alias("_marks")).where(F.col("_marks") > bound)
    marks = marks.join(full.select(key, "_bucket", "_first", F.lit(1).alias("_full")), [key, "_bucket", "_first"], "left")
    cell = F.col("_first") * SLOTS + F.when(F.col("_full").isNotNull(), F.col("_second")).otherwise(0)
    return marks.withColumn("_cell", cell).drop("_first", "_second", "_full")


def rolling_mean(
    df: DataFrame,
    key: str,
    time: str,
    value: str,
    width: int = 7200,
    out: str = "rolling_mean",
    pieces: int = PIECES,
    history: DataFrame | None = None,
    bound: int = BOUND,
) -> DataFrame:
    """Every row with the mean of its key's rows in [t - width, t); 0 where there are none.

    The values come from `history` (same columns) if given, else from the rows themselves.
    """
    if history is None:
        points = rolling_points(df, key, time, value, width, pieces, bound=bound)
    else:
        points = rolling_points(history, key, time, value, width, pieces, at=df, bound=bound)
    points = points.withColumnRenamed("mean", out)
    return df.join(points, [key, time], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def _sort_key(time: str, df: DataFrame, sign: int) -> Column:
    kind = df.schema[time].dataType.simpleString()
    column = micros(F.col(time)) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(time).cast("bigint")
    return column * sign


def asof_points(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str],
    values: Sequence[str],
    direction: str = "backward",
    bucket: int = DAY * MICROS,
) -> DataFrame:
    """For every distinct (by, left time) the nearest right row not after it (backward) or not
    before it (forward). Columns: by, left time, `_match` (struct with `_k` and the values).
    """
    sign = {"backward": 1, "forward": -1}[direction]
    by = list(by)
    left_points = (
        left.select(*by, left_on).where(F.col(left_on).isNotNull()).distinct()
        .withColumn("_k", _sort_key(left_on, left, sign))
    )
    match = F.struct("_k", *[F.col(v) for v in values])
    right_points = (
        right.where(F.col(right_on).isNotNull())
        .withColumn("_k", _sort_key(right_on, right, sign))
        .groupBy(*by, "_k")
        .agg(F.max(match).alias("_match"))
    )
    cell = whole_div(F.col("_k"), bucket)
    both = (
        left_points.withColumns({"_bucket": cell, "_side": F.lit(1), "_match": F.lit(None)})
        .unionByName(
            right_points.withColumns({"_bucket": cell, "_side": F.lit(0), left_on: F.lit(None)}),
        )
    )
    # Per bucket the last match so far, from one small row per (key, bucket).
    newest = both.groupBy(*by, "_bucket").agg(F.max_by("_match", F.when(F.col("_side") == 0, F.col("_k"))).alias("_new"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        newest.withColumn("_match", F.last("_new", ignorenulls=True).over(before))
        .where(F.col("_match").isNotNull())
        .select(*by, "_bucket", "_match", F.lit(None).alias(left_on), (F.col("_bucket") * bucket).alias("_k"), F.lit(-1).alias("_side"))
    )
    running = W.partitionBy(*by, "_bucket").orderBy("_k", "_side").rowsBetween(W.unboundedPreceding, 0)
    return (
        both.unionByName(carried)
        .withColumn("_match", F.last("_match", ignorenulls=True).over(running))
        .where(F.col("_side") == 1)
        .select(*by, left_on, "_match")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    values: Sequence[str] = (),
    direction: str = "backward",
    bucket: int = DAY * MICROS,
) -> DataFrame:
    """Left rows with the values of the nearest right row in time, per `by` key.

    `direction` is backward (not later, exact times included), forward or nearest (the
    earlier one on a tie). `values` are the right columns to add; null where none matches.
    Several right rows at one time: the greatest values.
    """
    by, values = list(by), list(values)
    if not by:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
        keys = ["_all"]
    else:
        keys = by
    arguments = (left, right, left_on, right_on, keys, values)
    if direction == "nearest":
        back = asof_points(*arguments, "backward", bucket).withColumnRenamed("_match", "_back")
        ahead = asof_points(*arguments, "forward", bucket).withColumnRenamed("_match", "_ahead")
        own = _sort_key(left_on, left, 1)
        to_back, to_ahead = own - F.col("_back._k"), -F.col("_ahead._k") - own
        take_back = F.col("_ahead").isNull() | (to_back <= to_ahead)
        points = back.join(ahead, [*keys, left_on]).withColumn(
            "_match", F.when(take_back, F.col("_back")).otherwise(F.col("_ahead"))
        ).drop("_back", "_ahead")
    else:
        points = asof_points(*arguments, direction, bucket)
    joined = left.join(points, [*keys, left_on], "left")
    return joined.withColumns({v: F.col(f"_match.{v}") for v in values}).drop("_match", "_all")


def cascade(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    own: str,
    slack: str,
    chunk: str,
    carried: str = "carried_delay",
    total: str = "total_delay",
) -> DataFrame:
    """Delay handed down the legs of one aircraft.

    Each leg takes over the former leg's delay less its spare turnaround time, never below 0,
    and adds its own. With S the running sum of (former own delay - slack), the delay taken
    over is S - min(0, lowest S so far), so sums and minima are enough. `chunk` (a day, say)
    sorts before `order` and cuts a key's legs into pieces; a piece needs only the sum and
    the lowest point of those before it. Legs without key or chunk form one of their own.
    """
    legs = [chunk, *order]
    inside = W.partitionBy(key, chunk).orderBy(*legs)
    sofar = inside.rowsBetween(W.unboundedPreceding, 0)
    gain = F.col(own) - F.col(slack)
    steps = df.withColumn("_s", F.sum(gain).over(sofar) - F.col(own)).withColumn("_low", F.min("_s").over(sofar))
    before = W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        steps.groupBy(key, chunk)
        .agg(F.sum(gain).alias("_sum"), F.min("_s").alias("_piece_low"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("_low_before", F.min(F.col("_base") + F.col("_piece_low")).over(before))
        .select(F.col(key).alias("_key"), F.col(chunk).alias("_chunk"), "_base", "_low_before")
    )
    lowest = F.least(F.lit(0), F.col("_low_before"), F.col("_base") + F.col("_low"))
    return (
        steps.join(pieces, F.col(key).eqNullSafe(F.col("_key")) & F.col(chunk).eqNullSafe(F.col("_chunk")))
        .withColumn(carried, F.col("_base") + F.col("_s") - lowest)
        .withColumn(total, F.col(carried) + F.col(own))
        .drop("_s", "_low", "_base", "_low_before", "_key", "_chunk")
    )


def leg_cause(df: DataFrame, key: str, order: Sequence[str], out: str = "leg_cause") -> DataFrame:
    """The first leg of an aircraft is delayed by weather, every later one by the late aircraft.

    The first leg is found by a minimum per key, so no key is sorted as a whole.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    weather = F.struct(*order).eqNullSafe(F.col("_first"))
    joined = df.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.when(weather, F.lit("Weather")).otherwise(F.lit("Late Aircraft"))).drop("_first", "_key")
