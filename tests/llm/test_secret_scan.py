import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.samples import clashing, documents, frame, odd

from tarmac.llm import secret_scan as s

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], s.KINDS.index(x[2])))


def token(prefix, body):
    return prefix + body + s.checksum(body)


PIECES = st.sampled_from(
    ["password", "PassWord", "passwd", "token", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", '"', "'", "é", "İ", "AKIA", "ABCD1234", "Z9", "deadbeef", "0123456789abcdef", "xyz", "\n", "AKIAAKIA", "𝒳", "a.b-c/d"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_equals_whole_scan(text):
    assert [x for x in s.scan(text) if x[2] in s.BASE] == plain(text)


def test_checksum_decides():
    body = "0123456789abcdefghijABCDEFGHIJ"
    good, npm = token("ghp_", body), token("npm_", body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"é {good} {bad} {npm} {good}x"
    assert [(x[2], text[x[0] : x[1]]) for x in s.scan(text)] == [("github", good), ("npm", npm)]
    assert s.mask(text, s.scan(text)).startswith("é [github] " + bad + " [npm]")


def test_mask_covers_overlaps():
    text = 'a token = "' + "ab" * 20 + '" z'
    assert s.mask(text, s.scan(text)) == 'a [assign]" z'


def test_documents(spark):
    rows = odd(documents(spark)) + [(9000, "secret: " + "é" * 9 + " AKIA" + "Q" * 20)]
    got = sorted((tuple(r) for r in s.find_secrets(clashing(spark, rows)).collect()), key=str)
    want = []
    for i, text in rows:
        spans = plain(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        counts = [sum(x[2] == k for x in spans) for k in s.BASE]
        want.append((i, *counts, hashlib.sha256(listed.encode()).hexdigest(), listed, 0, 0))
    assert got == sorted(want, key=str)
    assert s.find_secrets(frame(spark, [])).collect() == []


def test_mask_keeps_rows_and_columns(spark):
    rows = [(1, None), (2, ""), (3, "password=abcdefgh1"), (3, "password=abcdefgh1"), (None, "x")]
    docs = clashing(spark, rows)
    out = s.mask_secrets(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.masked) for r in out.collect() if r.doc_id) == [(1, None, "masked"), (2, "", "masked"), (3, "[assign]", "masked"), (3, "[assign]", "masked")]
