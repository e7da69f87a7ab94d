"""Language of web pages by Bayesian fusion of evidence.

The text of a page speaks through a trigram model, fitted on documents whose language is known.
To its likelihood come the language that the markup declares, weighed by how far declarations
are borne out by the texts that carry them, and the prior of the host. Priors are counted from
the text evidence of all pages and smoothed level by level: a host towards its domain, the domain
towards its address suffix, the suffix towards all pages. A page's own text counts once, as its
likelihood: what it added to the counts of its host and of the levels above is taken off again
for its own prior, and likewise for what its declaration says.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.shared import in_batches, stored
from tarmac.llm.site_style import host_of, kept_blocks, parse
from tarmac.llm.words import mix

SAMPLE = 500  # documents of each language that the model is fitted on, at most
LONGEST = 20_000  # characters of a document in that sample, at most
BUCKETS = 1 << 15
BLOCK = 1 << 19  # characters
TEMPER = 0.25  # neighbouring trigrams say much the same, so each counts a quarter
DRAW = 5.0  # pages that a level of the priors counts as much as
_HTML = re.compile(r"<html\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_LANG = re.compile(r"(?:^|\s)(xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
_META = re.compile(r"<meta\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_CONTENT = re.compile(r"(?:^|\s)content\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
# Labels that stand between a name and a two-letter suffix.
SECOND = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ne", "net", "or", "org")


def declared(page: str) -> str | None:
    """The language that a page's markup declares: that of <html lang>, else xml:lang, else a content-language."""
    found = _HTML.search(page)
    said = {bool(xml): tag for xml, tag in reversed(_LANG.findall(found[1]))} if found else {}
    tag = said.get(False) or said.get(True)
    for attributes in () if tag else _META.findall(page):
        if "content-language" in attributes.lower():
            content = _CONTENT.search(attributes)
            tag = tag or (content and content[1])
    return tag.lower() if tag else None


def _codes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64)
    out[65:91] += np.uint64(32)
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = letters[128:] = True
    out[~letters] = 32
    return mix(out + np.uint64(0x51ED270B27F4A7C1))


_CODES = _codes()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts, each set off by blanks, and where each text's begin (n + 1)."""
    parts = [b"  " + t.encode() + b"  " for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    c = _CODES[np.frombuffer(b"".join([*parts, b"  "]), np.uint8)]
    gram = mix(mix(mix(c[:-2]) + c[1:-1]) + c[2:])
    return (gram >> np.uint64(64 - 15)).astype(np.int64), begins


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log probability of each bucket in each language, buckets in rows

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Tempered log likelihood of each text in each language; 0 for a text without letters.

        Worked through in blocks, as every byte has a row of weights.
        """
        out = np.zeros((len(texts), len(self.languages)))
        blank = trigrams([""])[0][0]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK):
                size += len(texts[last])
                last += 1
            gram, begins = trigrams(texts[first:last])
            rows = self.weights[gram]
            rows[gram == blank] = 0
            out[first:last] = np.add.reduceat(rows, begins[:-1], axis=0) * TEMPER
            first = last
        return out


def fit(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    gram, begins = trigrams(texts)
    own = np.repeat([names.index(x) for x in languages], np.diff(begins)) if texts else np.zeros(0, np.int64)
    counts = np.zeros((BUCKETS, len(names)))
    np.add.at(counts, (gram[: len(own)], own), 1.0)
    spread = (counts.sum(axis=1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    smooth = counts + 2_000 * spread
    return Model(names, np.log(smooth / smooth.sum(axis=0)))


def training_sample(docs: DataFrame, size: int = SAMPLE) -> tuple[list[str], list[str]]:
    """At most `size` documents of each language, chosen by hash; those over LONGEST characters left out.

    Counts per language and cell of the hash tell in which cell the last of them lies, so only
    documents up to that cell are ranked. Of a repeated doc_id the first text by language and text
    counts.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(F.length("text") <= LONGEST)
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("cell", F.shiftright("h", 48))
    counts = hashed.groupBy("lang", "cell").agg(F.count("*").alias("n"))  # at most 65,536 cells a language
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) - F.col("n")
    wanted = counts.withColumn("before", before).where(F.col("before") < size).select("lang", "cell")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = hashed.join(wanted, ["lang", "cell"], "left_semi").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)
    ids = F.broadcast(few.select("doc_id").distinct())  # `size` rows a language
    rows = known.select("doc_id", "text", "lang").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r"))
    found = rows.select("doc_id", "r.*").orderBy("doc_id").collect()
    return [r.text for r in found], [r.lang for r in found]


def _evidence(sent):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, said = [], []
        for page in batch.column(2).to_pylist():
            said.append(declared(page or ""))
            texts.append("\n".join(b.text for b in kept_blocks(*parse(page))) if page else "")
        logs = sent.value.likelihoods(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(list(logs), pa.list_(pa.float64()))], names=["page_id", "host", "declared", "logs"]
        )

    return work


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def _less(counts: Column, own: Column) -> Column:
    """Counts without what one page added to them, if it added anything."""
    return F.when(own.isNull(), counts).otherwise(F.zip_with(counts, own, lambda c, x: F.greatest(c - x, F.lit(0.0))))


def _drawn(counts: Column, towards: Column) -> Column:
    """Shares of the counts after DRAW pages of the level above are added."""
    total = F.aggregate(counts, F.lit(DRAW), lambda s, c: s + c)
    return F.zip_with(counts, towards, lambda c, q: (c + DRAW * q) / total)


def identify(pages: DataFrame, docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared for every row of `pages` (page_id, url, html).

    The languages are those of `docs` (doc_id, text, lang). A page without text is judged by its
    declaration and its host, a page without host by those that have none either; with no known
    language, or for ties, the first language by name (null if there is none). text_lang is
    null without text. Repeated rows are judged each, and all count for their host; other columns are
    ignored; an empty table gives no rows, whole and very long texts are read.
    """
    spark = pages.sparkSession
    model = fit(*training_sample(docs, size))
    n = len(model.languages)
    if n == 0:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared"))
    sent = spark.sparkContext.broadcast(model)  # BUCKETS rows
    rows = in_batches(pages.select("page_id", host_of(F.col("url")).alias("host"), "html"), _evidence(sent), "page_id bigint, host string, declared string, logs array<double>")
    heard = F.exists("logs", lambda x: x != 0)
    rows = stored(rows.withColumn("post", F.when(heard, _softmax(F.col("logs")))), "evidence")
    sums = [F.coalesce(F.sum(F.col("post")[k]), F.lit(0.0)).alias(f"c{k}") for k in range(n)]
    listed = lambda prefix, of="c": F.array(*(F.col(f"{of}{k}") for k in range(n))).alias(prefix)
    hosts = rows.groupBy("host").agg(*sums)
    labels = F.split("host", r"\.")
    # A two-letter suffix takes the label before it along where that is none of a name.
    parts = F.when((F.length(F.element_at(labels, -1)) == 2) & (F.size(labels) > 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND), 2).otherwise(1)
    tail = lambda count: F.array_join(F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), count), ".")
    hosts = stored(hosts.withColumns({"domain": tail(parts + 1), "suffix": tail(parts)}), "hosts")
    again = [F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*again), "domains")
    suffixes = domains.groupBy("suffix").agg(*again)
    everywhere = suffixes.agg(*again).first()
    counts = [everywhere[k] or 0.0 for k in range(n)]
    levels = hosts.select("host", "domain", "suffix", listed("ch")).join(domains.select("domain", listed("cd")), "domain").join(suffixes.select("suffix", listed("cs")), "suffix")
    # How often a text of each language carries this declaration; one page's worth goes to what a declaration says.
    said = rows.where("declared is not null").groupBy("declared").agg(*sums).select("declared", listed("cl"))
    joined = rows.join(levels.select("host", "ch", "cd", "cs"), "host").join(said, "declared", "left")
    own = F.col("post")
    every = _less(F.array(*(F.lit(float(c)) for c in counts)), own)
    whole = F.transform(every, lambda c: (c + 1) / (F.aggregate(every, F.lit(float(n)), lambda s, x: s + x)))
    joined = joined.withColumn("p", whole)
    for level in ("cs", "cd", "ch"):
        joined = joined.withColumn("p", _drawn(_less(F.col(level), own), F.col("p")))
    prior = F.transform("p", lambda x: F.log(x))
    languages = F.array(*(F.lit(x) for x in model.languages))
    carried = F.zip_with(F.arrays_zip(_less(F.col("cl"), own).alias("c"), languages.alias("l")), every, lambda x, t: F.log((x["c"] + F.when(F.col("declared") == x["l"], 1.0).otherwise(0.02)) / (t + 1.0)))
    silent = F.array(*(F.lit(0.0) for _ in range(n)))
    total = F.zip_with(F.zip_with("logs", prior, lambda a, b: a + b), F.when(F.col("declared").isNotNull(), carried).otherwise(silent), lambda a, b: a + b)
    names = F.array(*(F.lit(x) for x in model.languages))

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    judged = joined.withColumn("p", _softmax(total))
    return judged.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"), F.when(F.col("post").isNotNull(), best(F.col("post"))).alias("text_lang"), "declared")
