"""Documents in parts against the ones that are folded into a row; images of posts without ids of their own."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import images, render
from quillstack.sources import writers

POST = "thread_id string, post_id string, post_number string, post_url string, page int, author string, timestamp string, text string, body_text string, signature_text string, attachment_labels array<string>, image_urls array<string>, images array<string>"


def post(thread, ident, number, page, body, pictures=()):
    return (thread, ident, number, "/p", page, "a & b", "Jan 5, 2024 1:05pm", body, body, "sig", ["x.zip"], [], list(pictures))


def thread(spark, posts=60, words=200):
    r = random.Random(2)
    rows = [post("big", str(i), str(i), i // 3 + 1, " ".join(r.choices(["wörd", "日本語", "<b>", "line\nbreak", "x"], k=r.randrange(words)))) for i in range(posts)]
    rows += [post("one", "1", "1", 1, "short"), post("gone", "1", "1", 1, "no such thread")]
    return spark.createDataFrame(rows, POST), spark.createDataFrame([("big", "T & U", "https://x.org/?a=1&b"), ("one", "One", "u"), ("none", "No posts", "u")], "thread_id string, title string, source_url string")


def together(parts):
    out = {}
    for x in sorted(parts.collect(), key=lambda x: (x.thread_id, x.part)):
        out.setdefault(x.thread_id, []).append((x.part, x.text))
    return out


@pytest.mark.parametrize("part_bytes", [300, 4000, 8 << 20])
def test_parts_make_the_document(part_bytes, spark):
    posts, threads = thread(spark)
    for one, whole, cut, column in ((render.render_html, render.html_document, render.html_parts, "html"), (render.render_markdown, render.markdown_document, render.markdown_parts, "markdown")):
        want = {x.thread_id: x.document for x in whole(threads, render.assemble_threads(one(posts), column, joiner="\n")).collect()}
        parts, manifest = cut(threads, one(posts), part_bytes=part_bytes)
        got = together(parts)
        assert {t: "".join(text for _, text in p) for t, p in got.items()} == want and set(want) == {"big", "one"}
        assert all([n for n, _ in p] == list(range(len(p))) for p in got.values())
        assert all(len(text.encode()) <= part_bytes for p in got.values() for _, text in p[1:-1])
        if part_bytes < 5000:
            assert len(got["big"]) > 10  # far longer than a part
        told = {x.thread_id: (x.parts, x.bytes, x.posts) for x in manifest.collect()}
        assert told == {t: (len(p), len(want[t].encode()), 60 if t == "big" else 1) for t, p in got.items()}


@pytest.mark.parametrize("part_bytes", [700, 8 << 20])
def test_json_of_a_thread_in_parts(part_bytes, spark):
    posts, threads = thread(spark)
    parts, manifest = render.thread_document_parts(posts.withColumn("raw_html", F.lit("<p>")), threads, part_bytes=part_bytes)
    got = {t: json.loads("".join(text for _, text in p)) for t, p in together(parts).items()}
    want = {x["thread_id"]: x for x in map(json.loads, render.thread_document(posts, threads).toJSON().collect()) if x["total_posts"]}
    assert got == want and len(got["big"]["posts"]) == 60
    assert {x.thread_id: x.posts for x in manifest.collect()} == {"big": 60, "one": 1}


def pictured(spark):
    """Posts with empty, null and equal ids, one twice the same, and images that several share."""
    body = "look\n[[POST_IMAGE]]\nend"
    rows = [
        post("t", "", "1", 1, body, ["images/a.png", "images/b.jpg"]),
        post("t", "", "2", 1, body, ["images/c.gif"]),
        post("t", None, "3", 2, body, ["images/a.png", "https://x.org/d.png", "images/gone.png"]),
        post("t", None, "4", 2, "", ["images/a.png"]),
        post("t", "7", "5", 3, body, ["images/b.jpg"]),
        post("t", "7", "6", 3, body, ["images/odd &.bin", ""]),
        post("t", "8", "7", 4, body, ["images/a.png"]),
        post("t", "8", "7", 4, body, ["images/a.png"]),
        post("u", "", "1", 1, body, ["images/a.png"]),
        post("u", "9", "2", 1, body),
    ]
    r = random.Random(1)
    content = {("t", "images/a.png"): r.randbytes(5000), ("t", "images/b.jpg"): b"", ("t", "images/c.gif"): r.randbytes(1), ("t", "images/odd &.bin"): r.randbytes(3001), ("u", "images/a.png"): r.randbytes(77)}
    content["u", "images/same.png"] = content["t", "images/a.png"]
    files = spark.createDataFrame([(t, p, c) for (t, p), c in content.items()] + [("t", "images/gone.png", None)], "thread_id string, path string, content binary")
    return spark.createDataFrame(rows, POST), files, rows, content


MIME = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bin": "application/octet-stream"}


def test_posts_without_an_id_keep_their_own_images(spark):
    posts, files, rows, content = pictured(spark)
    uri = lambda t, p: f"data:{MIME[p[-3:]]};base64,{base64.b64encode(content[t, p]).decode()}" if (t, p) in content else p
    want = []
    for t, _, number, *rest in rows:
        uris = [uri(t, p) for p in rest[-1]]
        shown = uris if rest[5] else []
        inline = sum(u.startswith("data:") for u in shown)
        want.append((t, number, uris, inline, len(shown) - inline))
    got = render.with_embedded(posts, files).collect()
    assert sorted((x.thread_id, x.post_number, x.images, x.n_embedded, x.n_fallback) for x in got) == sorted(want)


@pytest.mark.parametrize("part_bytes", [200, 1000, 8 << 20])
def test_embedded_parts_make_the_document(part_bytes, spark):
    posts, files, *_ = pictured(spark)
    threads = spark.createDataFrame([("t", "T", "u"), ("u", "U", "u")], "thread_id string, title string, source_url string")
    want = {x.thread_id: x.document for x in render.html_document(threads, render.assemble_threads(render.render_html(render.with_embedded(posts, files)), "html", joiner="\n")).collect()}
    pieces = render.embedded_pieces(posts, files, part_bytes=part_bytes)
    parts, manifest = render.html_parts(threads, pieces, "text", part_bytes=part_bytes)
    got = together(parts)
    assert {t: "".join(text for _, text in p) for t, p in got.items()} == want
    assert all(len(text.encode()) <= part_bytes for p in got.values() for _, text in p[1:-1])
    assert {x.thread_id: x.posts for x in manifest.collect()} == {"t": 8, "u": 2}


def test_parts_are_written_in_order(spark, tmp_path):
    posts, threads = thread(spark, posts=9)
    parts, _ = render.html_parts(threads, render.render_html(posts), part_bytes=600)
    writers.write_document_parts(parts, f"{tmp_path}/parts")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parts").select("thread_id", "part", "text").collect())) == sorted(map(tuple, parts.select("thread_id", "part", "text").collect()))


def test_one_reference_is_the_first(spark):
    """Two posts without any key, and a row that stands twice."""
    rows = [("t", None, None, None, ["https://x.org/a.png"])] * 2 + [("t", "", "", 0, ["https://x.org/a.png", "https://x.org/a.png"])] + [("t", "5", "5", 5, ["https://x.org/b.png"])] * 2
    posts = spark.createDataFrame(rows, "thread_id string, post_id string, post_number string, page int, image_urls array<string>")
    got = images.image_manifest(posts).groupBy("url").agg(F.count_if(F.col("status") == "first").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("local_path").alias("names")).collect()
    assert sorted(map(tuple, got)) == [("https://x.org/a.png", 1, 4, 1), ("https://x.org/b.png", 1, 2, 1)]
