import json

import pytest

from quillstack.operators import parse
from quillstack.sources import readers, writers
from quillstack.sources.archive_log import ArchiveLog
from quillstack.streaming import ingest

HTML = '<h1>T</h1><div class="post"><a class="username">a</a><span class="date">Jan 5, 2024 1:05pm</span> <a href="/thread/post/{i}"># {n}</a><div class="message">text number {i} that is long enough</div></div>'


@pytest.fixture
def root(tmp_path):
    for thread in ("t1", "t2"):
        for folder in ("raw_html", "page_state", "images"):
            (tmp_path / thread / folder).mkdir(parents=True)
        for page in (1, 2):
            (tmp_path / thread / "raw_html" / f"page_{page:04d}.html").write_text(HTML.format(i=page, n=page))
            (tmp_path / thread / "page_state" / f"page_{page:04d}.done.json").write_text("{}" if page == 1 else "broken")
        (tmp_path / thread / "images" / "a.png").write_bytes(b"\x01\x02")
        (tmp_path / thread / "resume_state.json").write_text(json.dumps({"next_page": 3, "validation_warning_pages": [2]}))
        (tmp_path / thread / "thread.json").write_text(json.dumps({"title": "T", "posts": [{"post_id": "1", "page": 1, "author": "a", "image_urls": ["u"]}]}) if thread == "t1" else "not json")
    (tmp_path / "t1" / "raw_html" / "page_0002.html").write_bytes(b"bad \xff byte")
    return str(tmp_path)


def test_readers(spark, root, tmp_path):
    pages = {(x.thread_id, x.page): x.html for x in readers.read_raw_pages(spark, root).collect()}
    assert set(pages) == {("t1", 1), ("t1", 2), ("t2", 1), ("t2", 2)} and pages["t1", 2] == "bad � byte"
    assert [(x.thread_id, x.post_id, x.image_urls) for x in readers.read_archive(spark, root).collect()] == [("t1", "1", ["u"])]
    assert [x.thread_id for x in readers.corrupt_documents(spark, root).collect()] == ["t2"]
    assert sorted(map(tuple, readers.read_page_state(spark, root).collect())) == [("t1", 1), ("t1", 2), ("t2", 1), ("t2", 2)]
    assert sorted((x.thread_id, x.next_page, x.validation_warning_pages) for x in readers.read_resume_state(spark, root).collect()) == [("t1", 3, [2]), ("t2", 3, [2])]
    assert sorted((x.thread_id, x.path, bytes(x.content)) for x in readers.read_images(spark, root).collect()) == [("t1", "images/a.png", b"\x01\x02"), ("t2", "images/a.png", b"\x01\x02")]
    (tmp_path / "sel.txt").write_text("#5, 7-9\n12 x")
    assert sorted(map(tuple, readers.read_selection_file(spark, f"{tmp_path}/sel.txt").collect())) == [(5, 5), (7, 9), (12, 12)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_selection_file(spark, f"{tmp_path}/missing.txt")


def test_archive_update_keeps_other_buckets(spark, tmp_path):
    path, schema = f"{tmp_path}/archive", "thread_id string, post_id string, page int, raw_html string"
    writers.write_archive(spark.createDataFrame([(f"t{i}", "1", 1, "x") for i in range(9)], schema), path)
    writers.write_archive(spark.createDataFrame([("t0", "2", 1, "x")], schema), path)
    got = {(x.thread_id, x.post_id) for x in spark.read.parquet(path).collect()}
    assert ("t0", "2") in got and ("t0", "1") not in got and "raw_html" not in spark.read.parquet(path).columns


def test_stream_equals_batch(spark, root, tmp_path):
    stream = lambda: ingest.pages_stream(spark, root, max_files=1)
    out = [f"{tmp_path}/{x}" for x in ("archive", "checkpoint", "repair")]
    ingest.ingest_pages_stream(spark, stream(), *out)
    want = {(x.thread_id, x.post_id) for x in parse.posts_of(parse.parse_pages(readers.read_raw_pages(spark, root))).filter("accepted").collect()}
    got = lambda: sorted((x.thread_id, x.post_id) for x in ArchiveLog(spark, out[0]).read().collect())
    assert got() == sorted(want) and want
    assert ingest.pages_to(spark, out[2], "repair").collect() == [] and ingest.pages_to(spark, out[2], "retry").collect() == []
    (tmp_path / "t2" / "raw_html" / "page_0003.html").write_text(HTML.format(i=2, n=2) + HTML.format(i=3, n=3))
    ingest.ingest_pages_stream(spark, stream(), *out)
    assert got() == sorted(want | {("t2", "3")})
