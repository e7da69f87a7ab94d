"""Queries over the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import aggregates, retrieval
from tarmac.plans.registry import query
from tarmac.plans.views import airport, oracle, table, view
from tarmac.sources import fixed_values as fixed


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "regulatory_docs").withColumnRenamed("embedding", "vector")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search vector per label, the mean of its embeddings, with a route."""
    parts = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("id"), F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return vectors.select(
        "id", F.col("v.x").alias("vector"),
        F.expr(airport("id")).alias("origin"), F.expr(airport("(id+1)%20")).alias("destination"),
    )


SEARCH = {
    "parts": "select cast(label as bigint) as id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings",
    "centroids": """select id, list(x order by pos) as vector from (select id, pos, avg(cast(x as double)) as x from parts group by id, pos) m group by id""",
    "pairs": """select c.id as query_id, e.vec_id as doc_id,
        list_sum(list_transform(list_zip(c.vector, cast(e.embedding as double[])), lambda z: (z[1]-z[2])*(z[1]-z[2]))) as distance
      from centroids c, embeddings e""",
    "hits": "select *, row_number() over (partition by query_id order by distance, doc_id) as rank from pairs qualify rank <= 10",
    "retrieved": f"""select h.query_id, h.doc_id, h.distance, r.icao, row_number() over (partition by query_id order by distance, doc_id) as place
      from hits h join regulatory_docs r on r.id = h.doc_id
      where distance < 1.5e0 and r.icao in ('ALL', {airport('query_id')}, {airport('(query_id+1)%20')}) qualify place <= 2""",
}
UP_TO_HITS = {k: SEARCH[k] for k in ("parts", "centroids", "pairs", "hits")}


@query("r1_corpus_text", oracle("select id, concat_ws(': ', title, content) as text from regulatory_docs", "regulatory_docs"))
def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", retrieval.corpus_text(F.col("title"), F.col("content")).alias("text"))


@query("r2_embed", "select doc_id, cast(384 as int) as dimensions, true as unit from documents")
def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's embedding, and whether its length is 1, or 0 where no word has any weight."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    embedder = retrieval.fit_text_embedder(documents, "text")
    embedded = retrieval.embed(documents, "text", embedder)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return embedded.select("doc_id", F.size("embedding").alias("dimensions"), ((F.abs(length - 1) < 1e-4) | (length == 0)).alias("unit"))


LETTERS = "etaoinsr"


def letter_model():
    """A small model that SQL can repeat: how often each of some letters occurs in a text."""
    import numpy as np

    def predict(texts):
        return np.array([[float(text.count(letter)) for letter in LETTERS] for text in texts], dtype="float32")

    return predict


@query(
    "r2_embed_with",
    "select doc_id, [" + ", ".join(f"cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{x}', '')) as float)" for x in LETTERS) + "] as embedding from documents",
)
def embed_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by a model that is handed in."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.embed_with(documents, "text", letter_model).select("doc_id", "embedding")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn_exact(centroids(spark, sf_dir), corpus(spark, sf_dir))


@query(
    "r3_knn_exact",
    oracle("select query_id, doc_id, round(distance, 6) as distance, cast(rank as int) as rank from hits", **UP_TO_HITS),
)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(
    "r4_retrieve",
    oracle("select query_id, doc_id, round(distance, 6) as distance, icao, cast(place as int) as rank from retrieved", "regulatory_docs", **SEARCH),
)
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve(hits(spark, sf_dir), centroids(spark, sf_dir), corpus(spark, sf_dir))
    return found.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "icao", "rank")


@query(
    "r5_citations",
    oracle(
        f"""select c.id as query_id, coalesce(string_agg('[' || r.id || '] ' || concat_ws(': ', r.title, r.content), ' || ' order by t.place), '{fixed.CITATION_NO_MATCH}') as citations
            from centroids c left join retrieved t on t.query_id = c.id left join regulatory_docs r on r.id = t.doc_id group by c.id""",
        "regulatory_docs",
        **SEARCH,
    ),
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, documents = centroids(spark, sf_dir), corpus(spark, sf_dir)
    found = retrieval.retrieve(retrieval.knn_exact(asked, documents), asked, documents)
    return retrieval.citations(asked, found, documents).withColumn("citations", F.array_join("citations", " || "))


@query(
    "r6_knn_blocks",
    oracle(
        """select query_id, doc_id, round(distance, 6) as distance, cast(rank as int) as rank from (
             select doc_id as query_id, query_id as doc_id, distance, row_number() over (partition by doc_id order by distance, query_id) as rank from pairs) t
           where rank <= 3""",
        **{k: SEARCH[k] for k in ("parts", "centroids", "pairs")},
    ),
)
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest label means per embedding, the means sent out in several blocks."""
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.knn_exact(every, centroids(spark, sf_dir), n=3, block_bytes=2048)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "a6_precision_at_k",
    oracle(
        """select avg(coalesce(p, 0e0)) as precision, count(*) as queries from (select id as query_id from centroids union all select -1) q left join (
             select query_id, count(*) filter (where e.label = query_id) / 5e0 as p from hits join embeddings e on e.vec_id = doc_id where rank <= 5 group by query_id) t using (query_id)""",
        **UP_TO_HITS,
    ),
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("label"))
    labelled = hits(spark, sf_dir).join(labels, "doc_id")
    # One query more that finds nothing.
    asked = centroids(spark, sf_dir).select(F.col("id").alias("query_id")).unionByName(spark.range(-1, 0).withColumnRenamed("id", "query_id"))
    return aggregates.precision_at_k(asked, labelled, "query_id", "rank", F.col("label") == F.col("query_id"), 5)
