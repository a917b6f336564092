"""Posts straight from raw pages: the same rows, and only the columns that are read."""

from quillstack import queries as Q
from quillstack.functions import lines as L
from quillstack.operators import parse

DATA = "/root/testdata/sf0.001"


def test_posts_of_pages_are_those_of_parsed_pages(spark):
    for made in (Q.forum_pages, Q.rich_pages, Q.raw_pages):
        pages = made(spark, DATA)
        got, want = parse.posts_of_pages(pages), parse.posts_of(parse.parse_pages(pages))
        assert got.schema == want.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_texts_are_not_made_where_only_urls_are_read(spark):
    plan = Q.QUERIES["image_urls"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "pictures" in plan and "body_text" not in plan and "attachment_labels" not in plan


def test_long_urls_are_not_kept():
    before = parse.short_url.cache_info().currsize
    assert parse.absolute("https://x.org/", "data:" + "a" * 2000) == "data:" + "a" * 2000
    assert parse.absolute("https://x.org/", "http://[bad") == ""
    assert parse.short_url.cache_info().currsize <= before + 1


def test_repair_of_whole_and_spoilt_texts():
    for text in ("plain \u00fc &amp; \u4e2d", "\x93a\x94 \x81", "\u00e2\u20ac\u2122", "\u00c2 x", "\ufeffx", "&#147;&Acirc;&nbsp;", "\u00e2\x80\x99"):
        out = L.html.unescape(text).translate(L.CP1252)
        for bad, good in L.MOJIBAKE:
            out = out.replace(bad, good)
        assert L.repair(text) == out
