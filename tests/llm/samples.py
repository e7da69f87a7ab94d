"""Small tables for the tests of the corpus operators."""

import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, limit=None):
    """(doc_id, text) rows of the smallest table, in Python."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows][:limit]


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, T.StructType.fromDDL(schema)).repartition(parts)


def odd(rows):
    """Rows with nulls, empty and white texts, a repeated row and a long text added."""
    top = 10**6
    return [*rows, (top, None), (top + 1, ""), (top + 2, " \n\t "), (None, "no id at all here today"), (top + 3, "x"), (top + 3, "x"), (top + 4, "long " * 60_000)]


def clashing(spark, rows):
    """The rows with extra columns whose names the operators use inside."""
    names = ["row", "value", "score", "n", "id", "a", "b", "digest", "cell", "rep", "items", "masked", "n_words", "shard"]
    schema = DOCS + "".join(f", `{x}` string" for x in names)
    return frame(spark, [(*r, *names) for r in rows], schema)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
