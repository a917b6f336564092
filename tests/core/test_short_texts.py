"""Queries and their SQL over short texts, cut titles and posts without dates."""

import duckdb

from quillstack import queries as Q
from quillstack.sources import writers

TURNS = "conv_id long, turn int, role string, text string"


def both(spark, path, name, table):
    """Rows of a query and of its SQL over one table."""
    made = Q.QUERIES[name](spark, str(path))
    columns = sorted(made.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, made.select(columns).collect())), sorted(want)


def turns(spark, path):
    said = ["Of was the sea.", "a short\n\n one here.", "exactly 20 characters", "exactly 20 character", "just 19 characters.", "a text that is long enough\nto be a content", "x  <b> & \"y\"'s", "Tiny one."]
    spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], said[(c + t) % 8]) for c in range(1, 9) for t in range(8)], TURNS).write.parquet(f"{path}/conversations.parquet")


def test_bodies_of_short_contents(spark, tmp_path):
    turns(spark, tmp_path)
    got, want = both(spark, tmp_path, "body_text", "conversations")
    assert got == want and len(got) == 64
    assert {b for b, i in got if i == "8000"} == {"user Jan 5, 2024 1:05pm # 1Of was the sea."}


def test_longest_blocks_of_short_contents(spark, tmp_path):
    turns(spark, tmp_path)
    got, want = both(spark, tmp_path, "longest_block_per_label", "conversations")
    assert got == want and len(got) == 64


def test_titles_that_end_in_a_reference(spark, tmp_path):
    heads = ["a &amp;&amp;&amp", "a &lt", "b &gt;&quot", "c &am", "d &", "&amp;lt; e", "&amplt f", "g &amp;amp"]
    rows = [(k, f"<html><head><title>{h}</title></head><body><h1>{h}</h1><p>x</p></body></html>", "https://x.org/") for k, h in enumerate(heads * 3)]
    spark.createDataFrame(rows, "page_id long, html string, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = both(spark, tmp_path, "page_title", "pages")
    assert got == want and ("0", "a &&&") in got


def test_every_post_without_a_date_is_returned(spark, tmp_path):
    turns(spark, tmp_path)
    got, want = both(spark, tmp_path, "unknown_date_posts", "conversations")
    assert got == want and len(got) == 64


def test_files_of_threads_are_written_by_many_tasks(spark, tmp_path):
    spark.range(60).selectExpr("cast(id as string) AS thread_id", "'x' AS value").write.parquet(f"{tmp_path}/names")
    writers.write_thread_files(spark.read.parquet(f"{tmp_path}/names"), f"{tmp_path}/files")
    files = list((tmp_path / "files").glob("thread_id=*/part-*"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 8
