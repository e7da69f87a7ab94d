import math
import re
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.samples import SF, frame

from tarmac.llm import language
from tarmac.llm.site_style import kept_blocks, parse

PAGES = "page_id bigint, url string, html string"


def page(text, declared=None):
    return f"<html{f' lang={declared}' if declared else ''}><body><article><p>{text}</p></article></body></html>"


def test_given_pages(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "pages"))
    rows = language.identify(pages, docs).collect()
    assert len(rows) == pages.count()
    assert sum(r.lang == r.declared for r in rows) >= 0.97 * len(rows)


def test_evidence_is_weighed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {}
    for r in docs.orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text[:600])
    rows = [(k, "http://a.eins.de/x", page(by["de"][k % 9], "en")) for k in range(40)]  # a host that declares wrongly
    rows += [(100 + k, "http://b.two.com/x", page(by["en"][k % 9], "en")) for k in range(40)]
    rows += [(200, "http://a.eins.de/y", page("")), (201, "http://c.eins.de/y", page("")), (202, "http://new.de/y", page("")), (203, "http://b.two.com/y", page(""))]
    rows += [(300, None, None), (301, "http://b.two.com/z", page(by["fr"][0])), (302, "http://x.org/", page("", "es"))]
    out = {r.page_id: r for r in language.identify(frame(spark, rows, PAGES), docs).collect()}
    assert all(out[k].lang == "de" for k in range(40)) and all(out[100 + k].lang == "en" for k in range(40))
    assert [out[k].lang for k in (200, 201, 202, 203)] == ["de", "de", "de", "en"]  # host, domain, suffix, host
    assert out[301].lang == "fr" and out[302].lang == "es" and out[300].text_lang is None and out[300].lang in by
    assert all(0 < r.confidence <= 1 for r in out.values())


def test_empty_tables_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.identify(frame(spark, [], PAGES), docs).collect() == []
    none = frame(spark, [], "doc_id bigint, text string, lang string")
    assert [r.lang for r in language.identify(frame(spark, [(1, "u", "x"), (1, "u", "x")], PAGES), none).collect()] == [None, None]
    one = frame(spark, [(1, "hello there", "xx"), (2, None, "yy"), (3, "z", None)], "doc_id bigint, text string, lang string")
    assert {r.lang for r in language.identify(frame(spark, [(None, None, ""), (2, "http://h", page("hello"))], PAGES), one).collect()} == {"xx"}


def plain(pages, model):
    """(page_id, lang, confidence) by loops: every page against the counts of all other pages."""
    n = len(model.languages)
    rows = []
    for page_id, url, html in pages:
        host = re.match(r"[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = host[1].lower() if host else ""
        labels = host.split(".")
        second = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in language.SECOND else 1
        levels = [".".join(labels[-second:]), ".".join(labels[-second - 1 :]), host]
        logs = model.likelihoods(["\n".join(b.text for b in kept_blocks(*parse(html))) if html else ""])[0]
        post = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum() if logs.any() else np.zeros(n)
        rows.append((page_id, levels, language.declared(html or ""), logs, post))
    counts, said, whole = [defaultdict(lambda: np.zeros(n)) for _ in range(3)], defaultdict(lambda: np.zeros(n)), np.zeros(n)
    for _, levels, tag, _, post in rows:
        for level, name in zip(counts, levels):
            level[name] = level[name] + post
        said[tag] = said[tag] + post
        whole = whole + post
    out = []
    for page_id, levels, tag, logs, post in rows:
        others = np.maximum(whole - post, 0)
        p = (others + 1) / (others.sum() + n)
        for level, name in zip(counts, levels):
            c = np.maximum(level[name] - post, 0)
            p = (c + language.DRAW * p) / (c.sum() + language.DRAW)
        total = logs + np.log(p)
        if tag is not None:
            own = np.array([1.0 if tag == x else 0.02 for x in model.languages])
            total = total + np.log((np.maximum(said[tag] - post, 0) + own) / (others + 1))
        share = np.exp(total - total.max())
        share /= share.sum()
        out.append((page_id, model.languages[int(np.argmax(share))], float(share.max())))
    return sorted(out, key=str)


def test_equals_loops(spark):
    """Given pages and odd ones: ties, no text, no host, very long texts, further columns with clashing names."""
    docs, pages = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "pages"))
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    text = docs.where("lang = 'fr'").orderBy("doc_id").first().text
    rows += [(9000, "http://a.bbc.co.uk/x", page(text, "fr")), (9001, "http://z.bbc.co.uk/", page("")), (9002, "http://other.co.uk/", page("")), (9003, None, None), (9004, "nonsense", ""), (9005, "http://h.de", page("long " * 40_000, "de"))]
    rows += [(9006, "http://h.de", page("long " * 40_000, "de"))] * 2
    names = ["host", "declared", "logs", "post", "p", "domain", "suffix", "lang"]
    df = frame(spark, [(*r, *names) for r in rows], PAGES + "".join(f", `{x}` string" for x in names))
    got = sorted(((r.page_id, r.lang, r.confidence) for r in language.identify(df, docs).collect()), key=str)
    want = plain(rows, language.fit(*language.training_sample(docs)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(got, want))


def test_a_page_is_no_witness_for_itself(spark):
    """The only page of its host: its own text is not counted once more as the host's prior."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(*language.training_sample(docs))
    rows = [(1, "http://one.example/", page("the of and"))]
    got = language.identify(frame(spark, rows, PAGES), docs).first()
    logs = model.likelihoods(["the of and"])[0]
    share = np.exp(logs - logs.max())
    assert math.isclose(got.confidence, share.max() / share.sum(), rel_tol=1e-9)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html lang=de><p>", "de"), ("<HTML class='x' LANG='de-AT'>", "de"), ("<html xml:lang='fr' lang=\"DE\">", "de"), ("<html xml:lang='fr'>", "fr"), ("<html data-lang=xx>", None),
        ("<html><meta http-equiv='Content-Language' content='es, en'>", "es"), ("<html lang=''><meta content=it http-equiv=content-language>", "it"), ("<meta name=x content=fr>", None), ("", None),
    ],
)
def test_declarations(html, want):
    assert language.declared(html) == want


def test_the_sample_is_the_first_by_hash(spark):
    """With every language cut, in many cells; a repeated id counts once."""
    rows = [(k % 900, f"text {k}", "ab"[k % 2]) for k in range(1000)] + [(None, "x", "a"), (5000, None, "a"), (5001, "y", None)]
    texts, languages = language.training_sample(frame(spark, rows, "doc_id bigint, text string, lang string"), 30)
    assert 50 <= len(texts) <= 60
    first = spark.range(900).selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()
    by = {t: i for i, t, _ in rows if i is not None}
    for k, lang in enumerate("ab"):
        own = {by[t] for t, x in zip(texts, languages) if x == lang}
        assert own == set([r.id for r in first if r.id % 2 == k][: len(own)])
