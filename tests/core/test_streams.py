"""State of streams: retries of pages, and repeats that the state store has forgotten."""

import time

from pyspark.sql import functions as F

from quillstack.sources.archive_log import ArchiveLog
from quillstack.streaming import ingest

POST = "thread_id string, post_id string, post_number string, post_url string, page int, author string"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, ingest.SEEN).write.mode("append").parquet(f"{path}/validated")


def actions(spark, path):
    return sorted((x.thread_id, x.page, x.action, x.attempts) for x in spark.read.schema(ingest.ACTIONS).parquet(f"{path}/actions").collect())


def test_a_page_that_heals_never_reaches_repair(spark, tmp_path):
    path, run = str(tmp_path / "r"), lambda: ingest.judge_pages(spark, str(tmp_path / "r"), str(tmp_path / "c"))
    arrive(spark, path, [("t", 1, 0, True, []), ("t", 2, 0, False, ["w"]), ("t", 3, 0, False, ["w"]), ("t", 4, 0, False, ["w"]), ("t", 4, 0, True, [])])
    run()
    assert actions(spark, path) == [("t", 2, "retry", 1), ("t", 3, "retry", 1)]
    arrive(spark, path, [("t", 2, 0, False, ["w"])])  # the first arrival again, as after a restart
    run()
    assert len(actions(spark, path)) == 2
    arrive(spark, path, [("t", 2, 1, True, []), ("t", 3, 1, False, ["again"])])
    query = run()
    assert actions(spark, path) == [("t", 2, "retry", 1), ("t", 3, "repair", 2), ("t", 3, "retry", 1)]
    assert [x.warnings for x in ingest.pages_to(spark, path, "repair").collect()] == [["again"]]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    arrive(spark, path, [("t", 2, 2, False, ["w"]), ("t", 5, 2, False, []), ("t", 5, 3, False, []), ("t", 6, 2, False, []), ("t", 6, 3, True, [])])
    run()
    assert actions(spark, path)[-1:] == [("t", 5, "repair", 2)] and ("t", 2, "retry", 1) in actions(spark, path) and not [x for x in actions(spark, path) if x[1] == 6]


def test_a_page_that_does_not_come_again_goes_to_repair(spark, tmp_path):
    path, run = str(tmp_path / "r"), lambda: ingest.judge_pages(spark, str(tmp_path / "r"), str(tmp_path / "c"), patience="1 second")
    arrive(spark, path, [("t", 2, 0, False, ["w"])])
    run()
    time.sleep(1.5)
    arrive(spark, path, [("t", 9, 1, True, [])])
    run()
    assert actions(spark, path) == [("t", 2, "repair", 1), ("t", 2, "retry", 1)]


def test_repeats_are_found_after_the_state_forgot_them(spark, tmp_path):
    """Each batch repeats earlier posts.  State rows stay as few as two batches, and the archive holds each post once."""
    log, source, rows_of_state, emitted = ArchiveLog(spark, f"{tmp_path}/log"), f"{tmp_path}/in", [], []
    post = lambda i, who: ("t", "" if i % 10 == 0 else str(i), str(i), f"/p/{i}", 1, who)
    for k in range(5):
        rows = [post(i, f"b{k}") for i in range(max(0, 40 * k - 80), 40 * k + 40)]
        spark.createDataFrame(rows + rows[:7], POST).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(POST).parquet(source)
        query = ingest.dedupe_into(stream, log, f"{tmp_path}/c", delay="1 second", emit=lambda fresh, _: emitted.append(fresh.count()))
        rows_of_state += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        time.sleep(1.2)
    got = sorted((int(x.post_number), x.author) for x in log.read().collect())
    assert got == [(i, f"b{i // 40}") for i in range(200)]
    assert sum(emitted) == 200 and max(rows_of_state) <= 240


def test_only_new_posts_are_written(spark, tmp_path):
    log = ArchiveLog(spark, f"{tmp_path}/log")
    make = lambda *rows: spark.createDataFrame([("t", *r) for r in rows], POST)
    assert log.append_new(make(("1", "1", "", 1, "a"), ("1", "2", "", 2, "b"), (None, "1", "", 1, "a"), ("", "1", "", 1, "b")), "s-0").count() == 2
    log.compact()
    assert {x.post_id for x in log.append_new(make(("1", "9", "", 9, "c"), ("2", "2", "", 1, "c"), ("", "1", None, 1, "c")), "s-1").collect()} == {"2"}
    assert log.append_new(make(("2", "2", "", 1, "d"), ("3", "2", "", 1, "d")), "s-1").count() == 2  # the same batch again
    assert sorted(x.post_id or "" for x in log.read().collect()) == ["", "1", "2", "3"]
    assert log.append_new(make().limit(0), "s-2").count() == 0
    assert log.read().filter(F.col("post_id") == "1").count() == 1


def test_failing_pages_may_tell_nothing(spark, tmp_path):
    arrive(spark, str(tmp_path / "r"), [("t", 1, 0, False, None), ("t", 2, 0, True, None), ("t", 3, 0, False, ["a", "b"]), ("t", 3, 1, False, ["c, d"])])
    ingest.judge_pages(spark, str(tmp_path / "r"), str(tmp_path / "c"))
    assert actions(spark, str(tmp_path / "r")) == [("t", 1, "retry", 1), ("t", 3, "repair", 2)]
    assert [list(x.warnings) for x in ingest.pages_to(spark, str(tmp_path / "r"), "repair").collect()] == [["c, d"]]


def test_a_batch_of_one_file_is_parsed_by_all_cores(spark, tmp_path):
    spark.range(400).selectExpr("cast(id AS string) AS thread_id", "1 AS page", "'' AS page_url", "'' AS html").coalesce(1).write.parquet(f"{tmp_path}/raw")
    dealt = ingest.spread(spark.read.parquet(f"{tmp_path}/raw"))
    assert dealt.count() == 400 and dealt.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
