"""WARC archives: written and read back with boundary-chain verification.

Writing: one record per page, through Spark's text writer with the record's closing blank lines
as separator, so a file is a plain sequence of WARC/1.1 records. Pages whose payload another
page already stores become revisit records without a body.

Reading: the files are split anywhere; a task cuts its split at every occurrence of the magic
line and emits, for each, where it stands and where the record that would begin there ends. Magic
lines inside payloads give false candidates. From the start of every file pointers are followed,
doubled in each round; only records reached that way are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.shared import ready, stored
from tarmac.workspace import new_folder

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Archive `pages` (page_id, url, html) in `folder`.

    Of records with equal payloads of at least `least` bytes the smallest page_id is stored and
    the others refer to it. A null html is an empty payload. Repeated rows of the smallest page_id
    are all stored; a payload that no page_id names is stored by every row that has it. Line ends
    in a url are percent-encoded.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    prints = base.where(F.octet_length("payload") >= least).select("page_id", "digest")
    firsts = prints.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stored(firsts.select("digest", "first"), "firsts")  # small where few pages repeat; the planner then broadcasts it
    rows = base.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(BLANK))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC),
        F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.when(revisit, "").otherwise("Content-Type: application/http;msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK),
    )
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", BLANK).text(folder)


def _after(text: Column, head: Column) -> Column:
    """What follows a head and its blank line."""
    return F.substr(text, F.length(head) + F.lit(len(BLANK) + 1))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between magic lines: file, split, value."""
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


_PARSED = "file string, split bigint, bytes bigint, head_bytes bigint, length bigint, kind string, page string, refers string, payload_bytes bigint, digest string"


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the segments of a task the bytes before each in its split, and its number there."""
    file = split = None
    at = number = 0
    for batch in batches:
        files, splits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sizes = batch.column(2).to_pylist()
        begins, numbers = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for i, size in enumerate(sizes):
            if files[i] != file or splits[i] != split:
                file, split, at, number = files[i], splits[i], 0, 0
            begins[i], numbers[i] = at, number
            at += size + len(MAGIC)
            number += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begins), pa.array(numbers)], names=[*batch.schema.names, "inside", "number"])


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every magic line: file, split, number, place of the magic, place of the successor, and the parsed record."""
    ready(spark)
    value = F.col("value")
    head = F.substring_index(value, BLANK, 1)
    field = lambda name, pattern: F.regexp_extract(head, rf"(?:^|\n){name}: {pattern}\r?(?:\n|$)", 1)
    length = F.when(F.octet_length(head) < F.octet_length(value), field("Content-Length", r"(\d{1,18})").try_cast("long"))
    block = _after(value, head)
    # A record's block ends before its two closing line ends.
    http = F.substring_index(block, BLANK, 1)
    payload = F.substr(_after(block, http), F.lit(1), F.length(_after(block, http)) - F.lit(len(BLANK)))
    parsed = _segments(spark, folder).select(
        "file", "split", F.octet_length(value).cast("long").alias("bytes"), F.octet_length(head).cast("long").alias("head_bytes"), length.alias("length"),
        field("WARC-Type", r"(\w+)").alias("kind"), field("WARC-Record-ID", r"<urn:page:(-?\d*)>").alias("page"), field("WARC-Refers-To", r"<urn:page:(-?\d*)>").alias("refers"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.when(field("WARC-Type", r"(\w+)") == "revisit", field("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})")).otherwise(F.sha2(payload.cast("binary"), 256)).alias("digest"),
    )
    found = stored(parsed.mapInArrow(_offsets, _PARSED + ", inside bigint, number bigint"), "segments")
    splits = found.groupBy("file", "split").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
    base = F.sum("total").over(Window.partitionBy("file").orderBy("split")) - F.col("total")
    splits = splits.select("file", "split", base.alias("base"))  # a file has few splits
    place = F.col("base") + F.col("inside") - len(MAGIC)
    follow = F.col("place") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 2 * len(BLANK)
    placed = found.join(splits, ["file", "split"]).withColumn("place", place).where("place >= 0")
    return placed.withColumn("next", follow).drop("base", "inside")


def reached(chains: DataFrame) -> DataFrame:
    """(file, place) of the records on the chain from each file's start, by pointer jumping; chains: file, place, next."""
    chains = stored(chains.select("file", "place", "next", (F.col("place") == 0).alias("sure")), "chains")
    while not chains.where("next is not null").isEmpty():
        one = chains.select("file", F.col("place").alias("p"), F.col("next").alias("place"), "sure")
        two = chains.select("file", "place", F.col("next").alias("n"))
        step = one.where("place is not null").join(two, ["file", "place"])
        far = F.struct(F.col("p").alias("place"), F.col("n").alias("next"), F.lit(False).alias("sure"))
        hit = F.struct(F.col("place"), F.lit(None).cast("long").alias("next"), F.lit(True).alias("sure"))
        new = step.select("file", F.explode(F.when(F.col("sure"), F.array(far, hit)).otherwise(F.array(far))).alias("x")).select("file", "x.*")
        old = chains.select("file", "place", F.lit(None).cast("long").alias("next"), "sure")
        chains = stored(old.unionByName(new).groupBy("file", "place").agg(F.max("next").alias("next"), F.max("sure").alias("sure")), "chains")
    return chains.where("sure").select("file", "place")


def _long_payloads(spark: SparkSession, folder: str, found: DataFrame, open_records: DataFrame) -> DataFrame:
    """(file, place, payload_bytes, digest) of records whose block holds magic lines: their segments joined again."""
    own = F.max(F.when(F.col("start"), F.col("place"))).over(Window.partitionBy("file").orderBy("place"))
    starts = open_records.select("file", "place", F.lit(True).alias("start"), F.col("next").alias("end"))
    some = found.join(open_records.select("file").distinct(), "file", "left_semi")  # a file's size is bounded
    marked = some.select("file", "split", "number", "place").join(starts.drop("end"), ["file", "place"], "left").withColumn("owner", own).where("owner is not null")
    marked = marked.join(starts.select("file", F.col("place").alias("owner"), "end"), ["file", "owner"]).where("place < end")
    numbered = _segments(spark, folder).select("file", "split", F.octet_length("value").cast("long").alias("bytes"), "value")
    numbered = numbered.mapInArrow(_offsets, "file string, split bigint, bytes bigint, value string, inside bigint, number bigint")
    pieces = numbered.join(marked, ["file", "split", "number"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: x["value"]), MAGIC)
    block = _after(whole, F.substring_index(whole, BLANK, 1))
    rest = _after(block, F.substring_index(block, BLANK, 1))
    payload = F.substr(rest, F.lit(1), F.length(rest) - F.lit(len(BLANK)))
    return pieces.select("file", F.col("owner").alias("place"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in `folder`.

    A revisit refers to the record of a page with the digest that its own head names; it has that
    record's size. An archive without records gives no rows.
    """
    found = candidates(spark, folder)
    records = stored(found.join(reached(found.where("length is not null")), ["file", "place"]), "records")
    whole = F.col("bytes") == F.col("head_bytes") + F.col("length") + 2 * len(BLANK)
    responses = records.where(F.col("kind") == "response")
    shown = responses.where(whole).select("page", "payload_bytes", "digest")
    cut = responses.where(~whole)
    if not cut.isEmpty():
        joined = cut.select("file", "place", "page").join(_long_payloads(spark, folder, found, cut), ["file", "place"])
        shown = shown.unionByName(joined.select("page", "payload_bytes", "digest"))
    shown = stored(shown, "responses")
    page = F.col("page").try_cast("long")
    told = shown.where("page <> ''").dropDuplicates(["page", "digest"]).withColumnRenamed("page", "refers")
    again = records.where(F.col("kind") == "revisit").select("page", "refers", "digest").join(told, ["refers", "digest"])
    rows = shown.select(page.alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return rows.unionByName(
        again.select(page.alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("refers").try_cast("long").alias("refers_to"))
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) to archives in the shared folder and read them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, one row for every row of
    `pages`. A null html is an empty payload. Rows that repeat a page_id are kept apart by their
    payloads: each keeps its own size and digest, and revisits refer to the one that equals them.
    Rows without page_id never are what others refer to. Other columns are ignored; an empty table
    gives no rows.
    """
    folder = new_folder(pages.sparkSession, "warc")
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder)
