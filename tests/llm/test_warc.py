import glob
import hashlib

from tests.llm.samples import SF, frame

from tarmac.llm import warc

PAGES = "page_id bigint, url string, html string"


def plain(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = first.get(raw) if len(raw) >= 100 else None
        again = refers is not None and refers != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", refers if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ODD = [
    (1, "http://a/", "x" * 99), (2, "http://a/", "x" * 99), (3, "http://b/", "y" * 100), (4, "http://b/", "y" * 100), (5, "http://b/\r\nWARC-Type: x", "é" * 100 + FAKE + "WARC/1.1\r\ntail"),
    (6, None, None), (7, "http://c", "\r\n\r\n"), (8, "http://c", "WARC/1.1\r\n" * 20), (9, "u", ""), (None, "u", "y" * 100), (None, "u", "z" * 200), (10, "u", FAKE * 30), (3, "http://b/", "y" * 100), (11, "u", FAKE * 30),
    (12, "u", "WARC/1.1\r\nContent-Length: 999999999999999999\r\n\r\n"), (13, "u", "long " * 200_000),
]


def test_round_trip_with_magic_in_payloads(spark):
    rows = ODD + [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = [(None if i is None else i + (1000 if k >= len(ODD) else 0), u, h) for k, (i, u, h) in enumerate(rows)]
    assert result(frame(spark, rows, PAGES + "")) == plain(rows)


def test_round_trip_over_many_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert result(frame(spark, ODD[:13], PAGES, parts=1)) == plain(ODD[:13])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_repeated_page_ids_and_clashing_columns(spark):
    """Page 5 has two payloads, each referred to by others; further columns have names that are used inside."""
    one, two = "a" * 300, "b" * 400 + FAKE
    rows = [(5, "u", one), (5, "u", two), (10, "u", two), (11, "u", one), (12, "u", one), (5, "u", "c" * 120), (5, None, None), (11, "u", two), (None, "u", two)]
    names = ["payload", "digest", "first", "n", "place", "next", "kind", "value", "file"]
    df = frame(spark, [(*r, *names) for r in rows], PAGES + "".join(f", `{x}` string" for x in names))
    assert result(df) == plain(rows)


def test_empty_table(spark):
    assert result(frame(spark, [], PAGES)) == []


def test_files_are_plain_warc(spark, tmp_path):
    warc.write_archive(frame(spark, ODD[:9], PAGES, parts=1), str(tmp_path / "w"))
    (name,) = [x for x in glob.glob(str(tmp_path / "w" / "part-*"))]
    raw, at, count = open(name, "rb").read(), 0, 0
    while at < len(raw):
        assert raw.startswith(b"WARC/1.1\r\n", at)
        end = raw.index(b"\r\n\r\n", at)
        length = int(raw[at:end].rsplit(b"Content-Length: ", 1)[1])
        at = end + 4 + length
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
        count += 1
    assert count == 9
