import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from attesta.llm import warc

PAGES = "page_id long, url string, html string, key string, payload string, first string"


def expected(rows):
    by = {}
    for page, _, html, *_ in rows:
        by.setdefault(html or "", []).append(page)
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        first = min((p for p in by[html or ""] if p is not None), default=None)
        revisit = first is not None and page != first
        out.append((str(page), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.b.example.com/x?y=1", "<p>one</p>", None, None, None), (3, "http://a.b.example.com/x?y=1", "<p>one</p>", None, None, None),
    (9, "HTTPS://User@Example.COM:8080/ä b\n#f", "<p>\r\n\r\n WARC/1.1 ü</p>", "k", "p", "f"), (10, None, None, None, None, None),
    (11, "", "", None, None, None), (12, "no url at all", "x" * 300_000, None, None, None), (-4, "http://z/", "minus", None, None, None),
    (None, "http://n/", "null id", None, None, None), (None, "http://n/", "<p>one</p>", None, None, None), (7, "http://z/", "twice", None, None, None), (7, "http://z/", "twice", None, None, None),
]


@pytest.mark.parametrize("lines", [3_000, 2])
def test_round_trip(spark, make, lines):
    pages = make(PAGES, [*ROWS, *[(100 + i, f"http://hot.example.com/{i % 3}", f"page {i}", None, None, None) for i in range(60)]])
    rows = [tuple(r) for r in pages.collect()]
    archive = warc.write_archive(pages, lines=lines)
    out = warc.lookup(pages.select(warc.url_key("url", "page_id").alias("key")), archive).collect()
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == expected(rows)
    assert {(r["page_id"], r["url"]) for r in out} == {(r[0], r[1]) for r in rows}
    assert {bytes(r["payload"]).decode() for r in out if r["payload"] is not None} == {r[2] or "" for r in rows}
    assert spark.read.parquet(archive.directory).agg(F.sum("lines")).first()[0] == len(rows)


def test_unknown_keys_and_empty(spark, make):
    archive = warc.write_archive(make(PAGES, ROWS))
    assert warc.lookup(make("key string", [("com,none)/ -",), ("",), ("~~~",)]), archive).count() == 0
    assert warc.round_trip(spark, make(PAGES, [])).count() == 0


def test_small_payloads_are_responses(make):
    archive = warc.write_archive(make(PAGES, ROWS), least=100)
    out = warc.lookup(make(PAGES, ROWS).select(warc.url_key("url", "page_id").alias("key")), archive)
    assert out.filter("record_type = 'revisit'").count() == 0


def test_key_reverses_the_host(make):
    row = make(PAGES, ROWS[:1]).select(warc.url_key("url", "page_id").alias("k")).first()
    assert row["k"] == "com,example,b,a)/x?y=1 09223372036854775813"
