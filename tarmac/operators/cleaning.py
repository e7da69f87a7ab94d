"""Row filters, renames and fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.clock import weekday_from_monday
from tarmac.functions.text import clean_key, flight_display, flight_key
from tarmac.sources.tables import save_table
from tarmac.workspace import new_folder

RENAMES = {
    "FL_NUMBER": "FLIGHT_NUMBER",
    "ORIGIN": "ORIGIN_AIRPORT",
    "DEST": "DESTINATION_AIRPORT",
    "CRS_DEP_TIME": "SCHEDULED_DEPARTURE",
    "DEP_DELAY": "DEPARTURE_DELAY",
    "DELAY_DUE_WEATHER": "WEATHER_DELAY",
}


def parse_date(df: DataFrame, column: str) -> DataFrame:
    """The column as a date; rows whose text is no date are dropped."""
    if df.schema[column].dataType.simpleString() == "date":
        return df.where(F.col(column).isNotNull())
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz").cast("date")).where(F.col(column).isNotNull())


def rename_flight_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})


def normalise(df: DataFrame) -> DataFrame:
    """Raw flight records to the twelve normalised columns; a missing delay becomes 0."""
    day = F.col("FL_DATE")
    renamed = rename_flight_columns(parse_date(df, "FL_DATE"))
    return renamed.select(
        F.year(day).alias("YEAR"),
        F.month(day).alias("MONTH"),
        F.dayofmonth(day).alias("DAY"),
        weekday_from_monday(day).alias("DAY_OF_WEEK"),
        "AIRLINE",
        F.col("FLIGHT_NUMBER").cast("string").alias("FLIGHT_NUMBER"),
        "ORIGIN_AIRPORT",
        "DESTINATION_AIRPORT",
        "SCHEDULED_DEPARTURE",
        F.coalesce("DEPARTURE_DELAY", F.lit(0.0)).alias("DEPARTURE_DELAY"),
        "CANCELLED",
        "WEATHER_DELAY",
    )


def flight_date(df: DataFrame) -> Column:
    """Date of a normalised flight."""
    return F.make_date("YEAR", "MONTH", "DAY")


def clean_target(df: DataFrame, column: str, low: float = -30, high: float = 720) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def filter_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of one year, as a date range so that date partitions and row groups are skipped."""
    dated = parse_date(df, column)
    start = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    end = F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
    return dated.where((F.col(column) >= start) & (F.col(column) < end))


def fill_const(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Missing values replaced; an absent column is added with the constant."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in values.items()}
    )


@dataclass
class _Wanted:
    """One rank of one column that is still looked for, among the values from `low` to `high`."""

    column: int
    rank: int  # from 1, among those values
    low: float
    high: float
    values: int  # distinct ones in between


def _finite(value: Column) -> Column:
    """A value for measuring distances: halved, so that none overflows, and with no end left out."""
    most = float.fromhex("0x1.fffffffffffffp+1023")
    return F.when(value > most, most).when(value < -most, -most).otherwise(value) / 2


def exact_medians(
    df: DataFrame, columns: Sequence[str], band: float = 0.0005, cells: int = 10_000, bound: int = 50_000
) -> dict[str, float | None]:
    """The exact median of every column, None without values. NaN counts as infinity.

    Two passes over the rows whatever the number of columns: one sketches all columns and
    brackets each median within the middle thousandth, the other counts the values inside the
    brackets, with one counter for those below. The counts are stored. A cell of equal width that
    holds the wanted rank is cut again into as many cells until it holds at most `bound` distinct
    values; only those are put in order.
    """
    if not columns:
        return {}
    spark = df.sparkSession
    number = [F.col(c).cast("double") for c in columns]
    values = [F.when(F.isnan(v), float("inf")).otherwise(v) for v in number]
    sketches = [F.percentile_approx(v, [0.5 - band, 0.5 + band], int(5 / band)) for v in values]
    outline = df.agg(*[F.count(v) for v in values], *sketches).first()
    sizes, brackets = outline[: len(columns)], outline[len(columns) :]
    some = [k for k, n in enumerate(sizes) if n]
    out: dict[str, float | None] = {c: None for c in columns}
    if not some:
        return out
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("c"), values[k].alias("v")) for k in some]))).where("v is not null")
    low, high = (F.element_at(F.create_map(*[x for k in some for x in (F.lit(k), F.lit(brackets[k][end]))]), F.col("c")) for end in (0, 1))
    below = F.col("v") < low
    counted = pairs.where(F.col("v") <= high).groupBy("c", F.when(~below, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counted = save_table(counted, new_folder(spark, "medians"))
    under = {r["c"]: r for r in counted.groupBy("c").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n"), F.count("v").alias("values")).collect()}  # a row per column
    inside = counted.where("v is not null")
    wanted = [_Wanted(k, rank - under[k]["n"], *brackets[k], under[k]["values"]) for k in some for rank in ((sizes[k] + 1) // 2, sizes[k] // 2 + 1)]
    while any(w.values > bound for w in wanted):
        wanted = _narrowed(inside, wanted, cells)
    found: dict[int, list[float]] = {}
    for number, (w, rows) in enumerate(zip(wanted, _ordered(inside, wanted))):
        seen = 0
        for value, n in rows:
            seen += n
            if seen >= w.rank:
                found.setdefault(w.column, []).append(value)
                break
    return out | {columns[k]: (a + b) / 2 for k, (a, b) in found.items()}


def _of_ranks(inside: DataFrame, wanted: Sequence[_Wanted]) -> DataFrame:
    """The counted values (c, v, n) beside the number, `w`, and range of each rank that lies among them."""
    rows = [F.struct(*(F.lit(x).alias(name) for x, name in ((k, "w"), (w.column, "c"), (w.low, "low"), (w.high, "high")))) for k, w in enumerate(wanted)]
    ranges = inside.sparkSession.range(1).select(F.inline(F.array(*rows)))  # two per column
    return inside.join(F.broadcast(ranges), "c").where("v between low and high")


def _narrowed(inside: DataFrame, wanted: Sequence[_Wanted], cells: int) -> list[_Wanted]:
    """Each rank within the one cell of its range that holds it; a cell's range is that of its values."""
    low, high = _finite(F.col("low")), _finite(F.col("high"))
    share = F.coalesce((_finite(F.col("v")) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    cell = F.floor(share * cells).cast("int")
    counts = _of_ranks(inside, wanted).groupBy("w", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("values"))
    rows = sorted(tuple(r) for r in counts.collect())  # at most `cells` + 1 rows for each rank
    out = list(wanted)
    for k, w in enumerate(wanted):
        seen = 0
        for _, _, n, low_, high_, values in (r for r in rows if r[0] == k):
            if seen + n >= w.rank:
                out[k] = _Wanted(w.column, w.rank - seen, low_, high_, values if low_ < high_ else 1)
                break
            seen += n
    return out


def _ordered(inside: DataFrame, wanted: Sequence[_Wanted]) -> list[list[tuple[float, int]]]:
    """The values of each rank's range in order, with their counts."""
    out: list[list[tuple[float, int]]] = [[] for _ in wanted]
    for r in _of_ranks(inside, wanted).select("w", "v", "n").orderBy("w", "v").collect():
        out[r["w"]].append((r["v"], r["n"]))
    return out


def exact_median(df: DataFrame, column: str, out: str = "median") -> DataFrame:
    """One row with the exact median; null without values."""
    return df.sparkSession.range(1).select(F.lit(exact_medians(df, [column])[column]).cast("double").alias(out))


def approximate_median(df: DataFrame, column: str, out: str = "median", accuracy: int = 10_000) -> DataFrame:
    return df.agg(F.percentile_approx(F.col(column).cast("double"), 0.5, accuracy).alias(out))


def fill_medians(df: DataFrame, defaults: Mapping[str, float], reference: DataFrame | None = None) -> DataFrame:
    """Missing values replaced by the exact medians over `reference` (the training part, say), all found at once.

    A column that is absent, or without values there, gets its default.
    """
    source = df if reference is None else reference
    medians = exact_medians(source, [c for c in defaults if c in df.columns])
    return df.withColumns(
        {
            c: F.lit(float(default)) if c not in df.columns else F.coalesce(F.col(c).cast("double"), F.lit(medians[c] if medians[c] is not None else float(default)))
            for c, default in defaults.items()
        }
    )


def fill_median(
    df: DataFrame, column: str, default: float, reference: DataFrame | None = None, exact: bool = True
) -> DataFrame:
    """Missing values of one column replaced by the median over `reference`; without the column the constant is used."""
    if exact or column not in df.columns:
        return fill_medians(df, {column: default}, reference)
    source = df if reference is None else reference
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), approximate_median(source, column).scalar()))


def delayed(df: DataFrame, column: str, low: float, high: float | None = None, **equal: str) -> DataFrame:
    """Rows with low < delay (< high) and the given key values, e.g. ORIGIN_AIRPORT='ATL'."""
    kept = df.where(F.col(column) > low)
    if high is not None:
        kept = kept.where(F.col(column) < high)
    for name, value in equal.items():
        kept = kept.where(F.trim(name) == value.strip().upper())
    return kept


def flight_label(df: DataFrame, date: Column | None = None) -> DataFrame:
    """Id `AIRLINE|NUMBER|DATE`, display text and whole-minute delay of normalised flights."""
    day = flight_date(df) if date is None else date
    number = F.col("FLIGHT_NUMBER").cast("string")
    return df.select(
        flight_key(F.col("AIRLINE"), number, day).alias("id"),
        flight_display(F.col("AIRLINE"), number, F.col("DESTINATION_AIRPORT"), F.col("DEPARTURE_DELAY"), day).alias("display"),
        F.col("DEPARTURE_DELAY").cast("int").alias("delay"),
    )


def aligned(df: DataFrame, column: str) -> Column:
    """One model input as a double; a missing column or value is 0."""
    if column.upper() not in {c.upper() for c in df.columns}:
        return F.lit(0.0).alias(column)
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias(column)


def align_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the model's columns, in its order."""
    return df.select(*[aligned(df, c) for c in columns])


def ground_truth(delay: Column, cancelled: Column) -> dict[str, Column]:
    return {
        "actual_delay_minutes": F.coalesce(delay.cast("int"), F.lit(0)).cast("bigint"),
        "actual_action_taken": F.when(cancelled == 1, F.lit("CANCELLED")).otherwise(F.lit("DEPARTED LATE")),
    }


def clean_flight_keys(df: DataFrame) -> DataFrame:
    """Trimmed text keys of a flight table, flight numbers without a trailing `.0`."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def cleaned(name: str) -> Column:
        if kinds[name] in ("int", "bigint"):
            return F.col(name).cast("string")
        return clean_key(F.col(name)) if name == "FLIGHT_NUMBER" else F.trim(F.col(name).cast("string"))

    keys = ("AIRLINE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "FLIGHT_NUMBER")
    return df.withColumns({c: cleaned(c) for c in keys if c in kinds})
