import re

import pytest
from tests.llm.samples import SF, alphanumeric, odd
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_minhash import plain as linked
from tests.llm.test_packing import check as packed
from tests.llm.test_secret_scan import plain as secrets

import corpus_pipeline as pipeline
from tarmac.llm import secret_scan, toxicity
from tarmac.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage was given and what it made of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(i, t, None, "s", None) for i, t in odd([]) if i is not None and i != 10**6 + 3] + [(None, "no id", "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = []
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_return_documents(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes and after.columns == COLUMNS


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    network = toxicity.fitted(toxicity.training_sample(spark.read.parquet(f"{SF}/documents.parquet"), labels))
    good = toxicity.scored(before, network).where("score < 0.5").select("row.*")
    assert rows(after) == rows(good) and 0 < after.count() < before.count()


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want = linked([x for x in rows(before) if x[0] is not None])
    assert rows(after) == sorted([x for x in rows(before) if x[0] is None or want[x[0]][1] == x[0]], key=str)


def test_near_duplicates_with_repeated_ids(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    docs = [(1, one), (2, one), (2, two), (3, three), (3, three + " more"), (4, None), (4, None), (None, one), (None, one), (5, two + " again")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = rows(pipeline.drop_near_duplicates(spark, df, SF))
    mine = [x for x in got if x[0] == 3]
    assert len(mine) == 1 and mine[0][1].startswith(three)
    assert [x for x in got if x[0] != 3] == sorted([(1, one), (2, two), (4, None), (None, one), (None, one)], key=str)


def test_every_stage_on_an_empty_table_and_further_columns(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15, "x", "y", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row string, rows int")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        after = stage(spark, docs, SF)
        assert after.count() == 1
        if name != "packing":
            assert after.columns == docs.columns and after.first().rows == 3


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {(r[0], r[1]) for r in contaminated(rows(before), items) if r[-1]}
    assert bad
    assert rows(after) == [x for x in rows(before) if (x[0], len(alphanumeric(x[1] or ""))) not in bad]


def test_secrets(stages):
    before, after = stages["secrets"]
    want = [(i, t and secret_scan.mask(t, secrets(t))) for i, t in rows(before)]
    assert rows(after) == sorted(want, key=str)
    for r in after.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert not re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r.text or "")


def test_packing(stages):
    before, after = stages["packing"]
    used, least = packed(rows(before), after.collect(), 4096)
    assert used <= least + 1


def test_run(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 100
