"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes what the stage before kept, as (spark, docs, sf_dir), and all but the last
return the columns of `documents`. `run` writes each result as Parquet to the shared folder and
reads it again for the next stage. No stage can be told in SQL as a whole, so there is no
ORACLE_SQL; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm import decontaminate, minhash, packing, secret_scan, toxicity
from tarmac.llm.queries import table, tokenizer_path
from tarmac.llm.shared import stored

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5. The network is fitted on the labelled rows of the whole table.

    Every row is judged by its own text, so repeated rows stay or go together; null and empty
    texts score 0 and stay. An empty table gives no rows.
    """
    network = toxicity.fitted(toxicity.training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, network).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: of the texts of its smallest doc_id the first, once.

    Documents are told apart by doc_id and text, so a text that links with nothing stays, whatever
    becomes of other rows of its doc_id; rows that repeat doc_id and text stay once. Rows without
    doc_id stay, as nothing tells them apart. Null and empty texts link with nothing. An empty table
    gives no rows.
    """
    key = ["doc_id", "text_hash"]
    found = minhash.near_duplicates(docs).where("doc_id is not null")
    found = found.groupBy(*key).agg(F.max("component_id").alias("group"), F.max("n_shingles").alias("n"), F.max("kept").alias("kept"), F.count("*").alias("rows"))
    first = found.where("kept and n > 0").groupBy("group").agg(F.min("text_hash").alias("first"))
    judged = found.join(first, "group", "left").withColumn("stays", F.expr("kept and (n = 0 or text_hash = first)"))
    judged = stored(judged.where("not stays or rows > 1").select(*key, "stays"), "judged")  # few beside the rows that stay as they are
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    others, near = minhash.parted(rows, judged, key)
    kept = near.join(judged, key, "left").where("coalesce(stays, true)").dropDuplicates(key)
    return others.select("row").unionByName(kept.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Every row is judged by its own text; null and empty texts hold nothing and stay. An empty table
    gives no rows.
    """
    return decontaminate.judged(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the new text.

    A null text stays null, with n_chars null. Repeated rows are masked alike. An empty table gives
    no rows.
    """
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    A null or empty text is the end mark alone; repeated rows are packed each. An empty table gives
    no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
