import re

import duckdb
import pytest

from quillstack.llm import url_filter as U
from quillstack.staging import read_table


@pytest.mark.parametrize(
    "url, host, path",
    [
        ("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x"),
        ("https://x.org", "x.org", ""),
        ("https://x.org?a/b", "x.org", ""),
        ("https://x.org#a://b", "x.org", ""),
        ("no scheme", "", ""),
        (None, "", ""),
        ("", "", ""),
        ("a://b://c/d", "b:", "//c/d"),
        ("https://ÄB.org/Ä", "Äb.org", "/Ä"),
    ],
)
def test_split(url, host, path):
    assert U.split_url(url) == (host, path)


@pytest.mark.parametrize(
    "host, path, expected",
    [
        ("net", "/", ("block", "net/")),
        ("a.net", "/x", ("block", "net/")),
        ("anet", "/x", None),
        ("m.example.net", "/en/1", ("allow", "example.net/en/")),
        ("example.net", "/en", ("block", "net/")),
        ("example.com", "/de/", ("block", "example.com/de/")),
        ("example.com", "/fr/", None),
        ("x.org", "/fr/z", ("allow", "org/fr/")),
        ("x.net", "", None),
    ],
)
def test_longest_rule(host, path, expected):
    assert U.rule_for(host, path) == expected


def verdict(spark, *urls):
    rows = U.filter_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(2)).collect()
    return [x.verdict for x in sorted(rows, key=lambda x: x.page_id)]


def test_vocabulary(spark):
    urls = ["https://x.example/casino", "https://x.example/casinos", "https://free.example/", "https://free.example/free-free", "https://free.example/win", "https://free.example/winner", None, "", "SPAM", "https://x.net/clean", "https://m.example.net/en/casino"]
    assert verdict(spark, *urls) == ["block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "block", "block", "allow"]
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    assert U.filter_urls(spark.createDataFrame([(1, "https://x.org/casino")], "page_id long, url string"), vocabulary=(), rules=()).first().verdict == "allow"


def test_hits_match_regular_expressions():
    terms = U.terms_of(U.VOCABULARY)
    for url in ("free-winwin.bet/win/free_deal", "xxx", "axxx.xxxb", "cheap" * 3 + "/cheap", "éfree", "free1 1free free"):
        assert U.term_hits(url, terms) == {t: w for t, w in terms if re.search(f"(^|[^a-z0-9]){t}([^a-z0-9]|$)", url)}


def test_vocabulary_of_a_table(spark):
    rows = [("Bad", 2), ("so", 1), ("so", 1), ("meh", 1), (None, 2), ("", 2), ("none", None)]
    table = spark.createDataFrame(rows, "term string, weight int")
    urls = spark.createDataFrame([(1, "http://a.b/bad"), (2, "http://a.b/so-so"), (3, "http://a.b/so/MEH"), (4, "http://a.b/none"), (5, "x" * 200_000 + "-bad")], "page_id long, url string")
    got = {x.page_id: (x.verdict, x.weight) for x in U.filter_urls(urls, rules=(), vocabulary=table).collect()}
    assert got == {1: ("block", 2), 2: ("allow", 1), 3: ("block", 2), 4: ("allow", 0), 5: ("block", 2)}


def test_oracle(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    got = U.filter_urls(read_table(spark, "/root/testdata/sf0.01", "pages"))
    want = con.sql(U.oracle_sql())
    assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
