"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bag_search, cover_dedup, decontaminate, language, minhash, packing, periodic_runs, prefix_forest, secret_scan, sharding, site_style, toxicity, warc

TOKENIZER = "word_bpe_49k.json"

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@query
def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


SQL["op4_minhash_forest"] = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, root) as (
  select doc_id, doc_id from documents
  union select r.doc_id, e.b from reach r join edges e on e.a = r.root),
roots as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join roots using (doc_id)
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


SQL["op9_decontamination"] = """
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) < 13 then [w]
    else list_transform(range(1, len(w) - 11), lambda k: w[k:k + 12]) end) as p
  from item_words),
lengths as (select distinct len(p) as m from windows),
places as (
  select doc_id, m, unnest(range(1, len(w) - m + 2)) as k, w from words, lengths where len(w) >= m),
found as (
  select distinct doc_id, k, m, item_id from places join windows on p = w[k:k + m - 1]),
hits as (select doc_id, count(distinct i) as n from (select doc_id, unnest(range(k, k + m)) as i from found) group by doc_id),
items as (
  select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as listed
  from (select distinct doc_id, item_id from found) group by doc_id)
select w.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) as contaminated
from words w left join hits h using (doc_id) left join items i using (doc_id)
"""


@query
def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op10_warc_round_trip"] = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join f using (payload_digest)
"""


@query
def op1_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


@query
def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(table(spark, sf_dir, "embeddings"))


@query
def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_bag_search"] = """
with words as (
  select rowid_ as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t
  from (select row_number() over () as rowid_, doc_id, text from documents)),
tf as (select r, doc_id, t, count(*) as tf from words group by all),
lengths as (select r, sum(tf)::bigint as n from tf group by r),
total as (select count(*) as docs, sum(n)::bigint as l from lengths),
measured as (select r, 100 - 75 + ((75 * n * docs) // l) as m from lengths, total),
weights as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select t, count(*) as df from tf group by t), total),
item_words as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t
  from benchmark),
asked as (select item_id, t, count(*) as times from item_words group by all),
scores as (
  select item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (t) join tf using (t) join measured using (r) group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


@query
def op12_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cover_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["op12_cover_dedup"] = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select doc_id, k, w[k:k + 12] as p from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from words where len(w) >= 13)),
firsts as (select p, min(doc_id) as first from windows group by p),
gone as (
  select distinct doc_id, unnest(range(k, k + 13)) as i from windows join firsts using (p) where first < doc_id),
places as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from words),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as text
  from places anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from words w left join kept using (doc_id)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs` with the tail of every text repeated whose doc_id has a CRC-32 divisible by ten.

    With n words and g a tenth of the CRC-32, the words from a = g % n on repeat the first
    1 + (n - a) / (3 + g % 8) of them.
    """
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    docs = docs.withColumns({"n": F.size("w").cast("bigint"), "g": F.expr("h div 10")})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then cast(sign(y.length - x.length) as int) when x.start <> y.start then cast(sign(x.start - y.start) as int) else cast(sign(x.period - y.period) as int) end)[0]")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


# Equal words a period apart are joined by six words in a row, as a run goes on for six after its first period at least.
SQL["op13_periodic_runs"] = """
with crcs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda s, x: case when x >= 0 then xor(s, x) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295) as h
  from documents),
cut as (select doc_id, w, len(w) as n, h, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from crcs),
planted as (
  select doc_id, n, case when a is null then w
    else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as w
  from cut),
grams as (select doc_id, i, w[i + 1:i + 6] as six from (select doc_id, w, unnest(range(0, n - 5)) as i from planted where n >= 6)),
pairs as (
  select x.doc_id, y.i - x.i as period, x.i as i, x.i - row_number() over (partition by x.doc_id, y.i - x.i order by x.i) as stretch
  from grams x join grams y on x.doc_id = y.doc_id and x.six = y.six and x.i < y.i),
runs as (
  select doc_id, min(i) as start, max(i) - min(i) + 6 + period as length, period from pairs group by doc_id, period, stretch),
least as (
  select doc_id, start, length, min(period) as period from runs where length >= greatest(12, 2 * period) group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from least),
places as (select doc_id, unnest(range(0, n)) as i, unnest(w) as word from planted),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from places anti join gone using (doc_id, i) group by doc_id),
listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text,
    min_by(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) as r
  from least group by doc_id)
select p.doc_id, coalesce(n_runs, 0)::bigint as n_runs, r.s::bigint as start, r.l::bigint as length, r.p::bigint as period,
  (1000 * r.l // r.p)::bigint as exponent_milli, sha256(coalesce(l.text, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from planted p left join listed l using (doc_id) left join kept k using (doc_id)
"""
