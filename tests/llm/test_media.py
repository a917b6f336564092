import hashlib
import re
import zlib
from html import unescape

from quillstack.llm import media as M
from quillstack.staging import read_table

PAGE = """<html><head><title>T</title><script>no</script></head><body>one <b>two</b>
<figure><img src="sha256:aa" alt="alt"><img src="sha256:bb"><figcaption>cap &amp; more</figcaption></figure>
<p>three<img src="sha256:cc" alt=" own "> four</p><img><style>x</style></body>"""


def test_items_keep_order_and_captions():
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in M.interleaved(PAGE)]
    assert got == [
        (0, "text", "T", None, None),
        (1, "text", "one two", None, None),
        (2, "media", None, "aa", "cap & more"),
        (3, "media", None, "bb", "cap & more"),
        (4, "text", "three", None, None),
        (5, "media", None, "cc", "own"),
        (6, "text", "four", None, None),
        (7, "media", None, None, None),
    ]
    assert M.interleaved(None) == [] and M.interleaved("  ") == [] and M.interleaved("<p>a<p>b")[1]["text"] == "b"


def test_grey_map_is_lossless():
    for t in ("", "a", "é" * 32, "x" * 64, "x" * 65, "line\n" * 999):
        p = M.payload_of(t)
        assert len(p) % 64 == 0 and p and p.rstrip(b"\0") == t.encode() and M.from_media(M.to_media(p, len(t.encode()))) == (len(t.encode()), p)


def test_documents_read_back(spark):
    rows = [(1, "a" * 64, "x"), (2, None, "x"), (3, "", "x"), (4, "é\n" * 100, "x"), (5, "é\n" * 100, "x"), (5, "é\n" * 100, "x"), (None, "z", "x"), (7, "<img src='sha256:q'>" * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = M.documents_as_media(spark, df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for d, t, _ in rows:
        t = t or ""
        n = len(t.encode())
        p = t.encode() + b"\0" * (-n % 64 if n else 64)
        for x in by[d]:
            m = M.to_media(p, n)
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes, x.media_sha256) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest())
            lines = [y for y in t.split("\n") if y.strip()]
            assert x.caption == f"{len(t)} characters in {len(t.split(chr(10)))} lines" and x.n_items == len(lines) + 1
            assert x.position == sum(bool(y.strip()) for y in t.split("\n")[: len(t.split("\n")) // 2])
            assert x.text_chars == sum(len(" ".join(y.split())) for y in lines)
    assert by[2][0].feature == by[3][0].feature and by[4][0].feature == by[5][0].feature != by[1][0].feature
    assert M.documents_as_media(spark, df.limit(0)).collect() == []


def test_pages_resolve_what_is_stored(spark):
    text = "payload"
    pages = spark.createDataFrame([(1, f'a<img src="sha256:{M.digest_of(text)}" alt="c">b'), (2, '<img src="sha256:none">'), (3, None)], "page_id long, html string")
    described = M.features(M.store(spark.createDataFrame([(text,)], "text string"), "text"))
    got = {(x.page_id, x.position): (x.kind, x.text, x.caption, x.payload and x.payload.n_bytes) for x in M.resolve(M.media_rows(pages, "page_id", "html").selectExpr("*", "0 AS payload", "'x' AS feature"), described).collect()}
    assert got == {(1, 0): ("text", "a", None, None), (1, 1): ("media", None, "c", 7), (1, 2): ("text", "b", None, None), (2, 0): ("media", None, None, None)}


def slow_feature(payload):
    n = len(payload)
    total, square, step = sum(payload), sum(b * b for b in payload), sum(abs(a - b) for a, b in zip(payload, payload[1:]))
    return f"{total * 100 // n}:{(square * n - total * total) * 100 // (n * n)}:{step * 100 // n}"


def test_feature_follows_its_definition():
    for t in ("", "a", "héllo wörld " * 30, "x" * 5000):
        assert M.feature_of(M.payload_of(t)) == slow_feature(M.payload_of(t))


def test_supplied_pages_interleave(spark):
    """Text of the given pages stays whole and in order around their references."""
    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    html = {x.page_id: x.html for x in pages.collect()}
    got = {}
    for x in M.media_rows(pages, "page_id", "html").orderBy("page_id", "position").collect():
        got.setdefault(x.page_id, []).append(x)
    assert got.keys() == html.keys()
    for i, items in got.items():
        assert [x.position for x in items] == list(range(len(items)))
        said = re.sub(r"(?s)<(script|style|noscript|template)[^>]*>.*?</\1>|<!--.*?-->|<![^>]*>", " ", html[i])
        want = unescape(re.sub(r"<[^>]*>", " ", said)).split()
        assert "".join("".join(x.text.split()) for x in items if x.kind == "text") == "".join(want)
        assert sum(x.kind == "media" for x in items) == len(re.findall(r"<img\b", said))


def test_odd_markup_is_text():
    assert M.interleaved("a<![foo[ b ]]>c")[0]["kind"] == "text" and len(M.interleaved("<p>" * 50_000 + "x")) == 1
