import html
import random
import re
from html.entities import html5
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import lines as L
from quillstack.functions import text as T
from quillstack.functions import urls as U
from quillstack.operators import merge, report, validate
from quillstack.operators import select as S


def value(spark, column, **given_values):
    row = spark.createDataFrame([tuple(given_values.values())], ", ".join(f"{k} string" for k in given_values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "spec, hashes, expected",
    [
        ("145,200-202", False, [(145, 145), (200, 202)]),
        ("5-3", False, [(3, 5)]),
        ("145 - 200", False, [(145, 145), (200, 200)]),
        ("1-2-3", False, []),
        ("0-2", False, [(1, 2)]),
        ("#2886,#3000-#3002", True, [(2886, 2886), (3000, 3002)]),
        ("#2886,#3000-#3002", False, []),
        ("1-1000000000", False, [(1, 1000000000)]),
        (None, False, []),
        ("3 2,1", False, [(1, 3)]),
    ],
)
def test_parse_ranges(spec, hashes, expected):
    assert S.parse_ranges(spec, hashes=hashes) == expected


@given(st.sets(st.integers(1, 300)))
@settings(max_examples=60, deadline=None)
def test_label_and_parse_are_inverse(values):
    ranges = S.parse_ranges(",".join(map(str, values)))
    assert {x for a, b in S.parse_ranges(S.ranges_label(ranges)) for x in range(a, b + 1)} == values


def test_users_and_labels():
    assert S.parse_users("Ann, ann ,,Bob") == ["Ann", "Bob"]
    assert S.filter_label() == "all posts"
    assert S.filter_label("Ann,Bob", "1,2,3,7,9,10", "#5") == "Ann, Bob | pages 1-3, 7, 9-10 | posts 5"


def test_text_columns(spark):
    cases = [
        (T.repair_cp1252(F.col("a")), "a\x96b\x81", "a–b\x81"),
        (T.repair_mojibake(F.col("a")), "&amp;lt; â€\x9d Â\xa0x﻿", "&lt; ”  x"),
        (T.normalize_space(F.col("a")), " a  b\x1f&nbsp;c\n", "a b c"),
        (T.slugify(F.col("a")), " M1 Counter--Trend! ", "m1-counter-trend"),
        (T.slugify(F.col("a")), "!!!", "thread"),
        (T.safe_filename(F.col("a")), "../é a?b.png", "é_a_b.png"),
        (T.safe_filename(F.col("a")), "...", "file"),
        (T.normalize_timestamp(F.col("a")), "Jan 5, 2024 1:05pm | Edited Jan 6, 3:10am", "Jan 5, 2024 1:05pm | Jan 6, 3:10am"),
        (T.normalize_timestamp(F.col("a")), "none", ""),
        (T.html_escape(F.col("a")), "<a href='x'>\"&", "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;"),
        (U.normalize_thread_url(F.col("a")), " https://x.org/t/9-a?a=1&page=3&b=2#p ", "https://x.org/t/9-a?a=1&b=2"),
        (U.normalize_thread_url(F.col("a")), "https://x.org/t?b=1&a=2&b=3&page=1", "https://x.org/t?b=1&b=3&a=2"),
        (U.thread_key(F.col("a")), "https://x.org/t/9-A_b/?q=1", "9-a-b"),
        (U.guess_extension(F.col("a")), "https://x.org/a.b/c.JPEG?x=.png", ".jpeg"),
        (U.guess_extension(F.col("a")), "https://x.org/c.toolong", ".jpg"),
        (U.guess_extension(F.col("a")), "https://x.org/.png", ".jpg"),
        (U.data_uri(F.col("a"), F.lit(None).cast("binary")), "images/x.png", "images/x.png"),
        (U.data_uri(F.col("a"), F.encode(F.lit("y" * 90), "UTF-8")), "images/x.zip", "data:application/octet-stream;base64," + "eXl5" * 30),
    ]
    for column, given_value, expected in cases:
        assert value(spark, column, a=given_value) == expected, given_value


def column(spark, f, texts):
    """``f`` of many texts in one job, in their order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, a string").repartition(2)
    return [x.x for x in rows.select("i", f("a").alias("x")).orderBy("i").collect()]


def references():
    """All named ones, whole, cut and run on; numbers around every bound, in both spellings."""
    out = []
    for name in html5:
        out += [f"&{name}", f"a &{name} b", f"&{name.rstrip(';')}x;", f"&{name[:-1]}", f"&{name}&{name}=1"]
    bounds = [*range(0, 0x110), 0x2028, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x1FFFF, 0x20000, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 10**9, 10**40]
    for n in bounds:
        out += [f"&#{n};", f"&#{n}", f"&#{n}z", f"x&#x{n:x};y", f"&#X{n:X}", f"&#00{n};", f"&#x000{n:x}."]
    return out + ["", "&", "&&", "&;", "&#", "&#;", "&#x;", "&#x", "& amp;", "&amp;amp;", "&ampamp;", "&notit;", "&NOTIT", "&no\ttab;", "&" + "a" * 40 + ";", "&" + "é" * 40, "&amp" * 50, "x&lt", "&lt&gt", "&😀;", "&am😀p;"]


def test_references_equal_the_librarys(spark):
    texts = references()
    assert column(spark, lambda c: T.html_unescape(F.col(c)), texts) == [html.unescape(t) for t in texts]
    assert column(spark, lambda c: T.html_unescape(F.col(c)), [None]) == [None]
    assert column(spark, lambda c: T.normalize_space(F.col(c)), texts) == [L.squeeze(t) for t in texts]


def some_lines(n=3000):
    r = random.Random(6)
    words = ["a", "b ", " b", "A", "", " ", "&nbsp;", "\xa0", "x &amp; y", "x & y", "&#10;", "12 KB", "12.5 kb ", "1,204 downloads", "|", "File Type: zip", "Attached File(s)", "attached file(s)", "Sig: s", "Sig:", "Attachment: a", " Attachment:  a&amp;amp;b", "Attachment : no", "é\x96", "â€™", "> q", "٣ KB"]
    ends = ["\n", "\n", "\n", "\r\n", "\r", "\x0b", "\f", "\x1c", "\x1e", "\x85", "\u2028", "\u2029", "\x1f", "\n\n"]
    return [None, "", "\n", "\r\n", "\n\n\n", "a\n&nbsp;\nb"] + ["".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(9))) + r.choice(words) for _ in range(n)]


def test_line_columns_equal_the_helpers(spark):
    texts = some_lines()
    pairs = [(T.normalize_multiline, L.multiline), (T.dedupe_consecutive_lines, L.drop_echoes), (T.dedupe_all_lines, L.distinct_lines), (T.strip_attachment_artifacts, L.without_artifacts)]
    for native, helper in pairs:
        got = column(spark, native, texts)
        wrong = [(t, g, helper(t)) for t, g in zip(texts, got) if g != (None if t is None else helper(t))]
        assert not wrong, (native.__name__, wrong[:3])


def test_sections_equal_the_helper(spark):
    r, texts = random.Random(8), some_lines(600)
    rows = [(i, r.choice(texts), r.choice(texts), r.choice([None, [], ["a", None, " a ", "&nbsp;", "b&amp;c"]]), r.choice(texts)) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, b string, t string, l array<string>, s string").repartition(2)
    got = {x.i: (x.s.body, x.s.attachments, x.s.signature) for x in df.select("i", T.export_sections("b", "t", "l", "s").alias("s")).collect()}
    for i, *rest in rows:
        assert got[i] == L.sections(*rest), rest


def test_text_stays_in_the_jvm(spark):
    """Names, lines and sections: no plan hands rows to a Python worker."""
    p = spark.createDataFrame([("t", "1", "1", "", 1, "a", "", "x", [])], "thread_id string, post_id string, post_number string, post_url string, page int, author string, timestamp string, text string, image_urls array<string>")
    kept = [report.top_authors(p), report.author_totals(p), report.author_rank(report.author_counts(p)), S.filter_by_users(p, "a"), validate.judged_posts(p), merge.repair_added_vs_replaced(p, p)]
    kept += [p.select(f("text")) for f in (T.normalize_multiline, T.dedupe_consecutive_lines, T.dedupe_all_lines, T.strip_attachment_artifacts)]
    kept.append(p.select(T.export_sections("text", "text", F.array().cast("array<string>"), "text")))
    assert not [d for d in kept if re.search("EvalPython|InArrow|InPandas", d._jdf.queryExecution().executedPlan().toString())]


def hostile_urls():
    r = random.Random(12)
    parts = ["http", "HTTPS", "ftp", "foo", "1x", ":", ":", "//", "//", "/", "///", "a.b", "user@h", "[::1]", "[", "]", "[1:2::3.4.5.6]", "[v1.x]", "[12345::]", "[fe80::1%eth0]", "\uff1a", "\u2100", "é", "?", "?", "&", "&", "=", "page=3", "page", "a=1", "b=%20x", "c=+y", "%zz", "%", "%C3%A9", "%FF%FE", "*~-_.", "a=2", ";", ";p", "#", "#f", "\t", "\n", " ", "\x1f", "\x00", "日本", "'\"<>", "|"]
    fixed = ["", " ", "?", "#", "//", "///x", "////x", "http:", "http:x", "http:/x", "http://", "http://h", "http://h?", "http://h/?&&", "http://h;?a", "http://h/a;b/c;", "foo:///x", "file:///x", "mailto:a@b?page=1&x=1", "//h/p?page=1", "a?page=1&page=2", "http://h/p?=v&=w&k", "http://h/p??a=1?", "http://h/p?a=1&b=2&a=3&page=9&b=", "x:y:z", "http://h\u212fx/", "http://[::ffff:1.2.3.4]:80/x?a", "http://[1::2::3]/", "http://[::1]x/", "http://x[::1]/", "http://h/%E2%82?q=%E2%82&r=%F0%9F%98", "https://x.org/t/9-a?a=1&page=3&b=2#p"]
    for scheme in ("", "http:", "foo:"):
        fixed += [f"{scheme}//[{a}]/p?page=2&x=1" for a in ("", "1", "::", "1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::256.1.1.1", "::01.2.3.4", "g::", "v1.", "v.x", "vF.y:z", "::1%", "::1%a%b", "1.2.3.4")]
    return [None, *fixed] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(12_000)]


def test_thread_urls_equal_the_helper(spark):
    def helper(u):
        """The same by the language's own library."""
        u = (u or "").strip()
        try:
            parts = urlparse(u)
            kept = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k != "page"}
            return urlunparse(parts._replace(query=urlencode(kept, doseq=True), fragment="")).rstrip("?")
        except ValueError:
            return u

    urls = hostile_urls()
    got = column(spark, lambda c: U.normalize_thread_url(F.col(c)), urls)
    wrong = [(u, g, helper(u)) for u, g in zip(urls, got) if g != helper(u)]
    assert not wrong, (len(wrong), wrong[:6])


def test_many_lines_take_time_in_proportion(spark):
    text = "\n".join(f"line {i % 7000}" for i in range(150_000))
    assert column(spark, T.dedupe_all_lines, [text]) == ["\n".join(f"line {i}" for i in range(7000))]
    assert column(spark, T.dedupe_consecutive_lines, [text]) == [text]


def test_line_helpers():
    assert L.distinct_lines("a\n&nbsp;\nb") == "a\n\nb"
    assert L.multiline("\n a  b \n\n\n c\n\n") == "a b\n\nc"
    assert L.drop_echoes("a\na\n\na\nb\nb ") == "a\n\na\nb"
    assert L.distinct_lines("a\nb\n\n\na\nc") == "a\nb\n\nc"
    assert L.without_artifacts("Attached File(s)\nx.zip\n12 KB\n1,204 downloads\n|\nFile Type: zip") == "x.zip"
    assert L.is_noise("123", "Unknown date", "") and L.is_noise("# 7 x", "Unknown date", "7") and not L.is_noise("name", "Unknown date", "")
    assert L.sections("text\nSig: s\nAttachment: a", "", ["a"], "s\nt") == ("text", ["a"], ["s", "t"])
    assert L.sections("", "whole", None, None) == ("whole", [], [])


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_line_helpers_are_stable(text):
    once = L.distinct_lines(text)
    assert L.drop_echoes(once) == once or "\n\n" in once
    assert L.multiline(L.multiline(text)) == L.multiline(L.multiline(L.multiline(text))) or "&" in text
