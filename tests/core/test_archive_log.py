"""The appended archive against plain merging of the same batches."""

import os

import pytest
from pyspark.sql import functions as F

from quillstack.operators import merge
from quillstack.sources import archive_log
from quillstack.sources.archive_log import ArchiveLog

POST = "thread_id string, post_id string, post_number string, post_url string, page int, author string, timestamp string, text string, image_urls array<string>"


def posts(spark, rows):
    return spark.createDataFrame([(t, i, n, u, p, a, "", "", []) for t, i, n, u, p, a in rows], POST)


BATCHES = [
    [("t", "1", "1", "", 1, "a"), ("t", "1", "1", "x", 2, "a"), ("t", "", "2", "", 1, "a"), (None, "7", "1", "", 1, "a"), ("u", None, None, None, None, "a")],
    [("t", "1", "9", "", 9, "b"), ("t", "2", "2", "", 1, "b"), ("t", "2", "2", "", 1, "b"), ("t", "", "2", "", 1, "b"), ("u", "", "", "", 0, "b"), (None, "7", "1", "", 1, "b")],
    [],
    [("t", "2", "2", "", 5, "c"), ("t", "3", "3", "", 5, "c"), ("t", "", "2", "y", 1, "c"), ("w", "3", "3", "", 5, "c"), ("w", "3", "4", "", 5, "c")],
    [("w", "3", "5", "", 5, "d"), ("w", "", "5", "", 5, "d"), ("w", "", "5", "", 5, "d")],
]


def plain(spark, batches):
    """Batch after batch by the operators for whole tables; ids without a thread are told apart by a stand-in."""
    held = posts(spark, [])
    for b in batches:
        new = posts(spark, [("\u0001" if t is None else t, *rest) for t, *rest in b])
        held = spark.createDataFrame(merge.merge_posts(held, merge.new_posts_only(new, held)).collect(), POST)
    return sorted((("" if x.thread_id == "\u0001" else x.thread_id), x.post_id or "", x.post_number or "", x.post_url or "", x.page or 0, x.author) for x in held.collect())


def shown(log):
    return sorted((x.thread_id or "", x.post_id or "", x.post_number or "", x.post_url or "", x.page or 0, x.author) for x in log.read().collect())


@pytest.mark.parametrize("compact_after", [(), (0,), (1, 3), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("few", [500_000, 0])
def test_reads_equal_the_merged_batches(compact_after, few, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive_log, "FEW_KEYS", few)
    log = ArchiveLog(spark, f"{tmp_path}/log", buckets=4)
    assert log.read().collect() == [] and log.compact() is None
    for k, b in enumerate(BATCHES):
        log.append(posts(spark, b).withColumn("raw_html", F.lit("<p>")), f"s-{k}")
        if k in compact_after:
            log.compact()
            log.clean()
    assert shown(log) == plain(spark, BATCHES)
    assert "raw_html" not in log.read().columns


def written(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_itself_and_nothing_else(spark, tmp_path):
    """Batches of one size cost the same however large the archive has become, and leave all earlier files as they are."""
    log, path = ArchiveLog(spark, f"{tmp_path}/log"), f"{tmp_path}/log"
    batch = lambda k: posts(spark, [(f"t{i}", f"{k}-{i}", str(i), f"/p/{k}-{i}", k, "a") for i in range(400)])
    log.append(posts(spark, [(f"t{i % 400}", f"old-{i}", str(i), f"/p/{i}", 1, "a") for i in range(20_000)]))
    log.compact()
    cost = []
    for k in range(6):
        before = {f: (n, os.stat(f).st_mtime_ns) for f, n in written(path).items()}
        log.append(batch(k), f"s-{k}")
        after = written(path)
        assert all(after[f] == n and os.stat(f).st_mtime_ns == at for f, (n, at) in before.items())
        cost.append(sum(after.values()) - sum(n for n, _ in before.values()))
    assert max(cost) < 1.2 * min(cost) and max(cost) < log.size("base") / 4
    assert log.read().count() == 22_400


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    log = ArchiveLog(spark, f"{tmp_path}/log")
    log.append(posts(spark, BATCHES[0]), "s-0")
    log.append(posts(spark, BATCHES[1]), "s-1")
    log.append(posts(spark, BATCHES[1]), "s-1")
    assert shown(log) == plain(spark, BATCHES[:2])


def test_compaction_is_due_by_size(spark, tmp_path):
    log = ArchiveLog(spark, f"{tmp_path}/log")
    assert not log.compact_if_due()
    log.append(posts(spark, BATCHES[0]))
    assert log.compact_if_due() and not log.compact_if_due()
    log.append(posts(spark, BATCHES[1]))
    assert not log.compact_if_due(share=1e9) and log.compact_if_due(share=1e-9)
    assert shown(log) == plain(spark, BATCHES[:2])


def test_an_unfinished_folder_does_not_count(spark, tmp_path):
    log = ArchiveLog(spark, f"{tmp_path}/log")
    name = log.append(posts(spark, BATCHES[0]))
    log.append(posts(spark, BATCHES[1]))
    os.remove(f"{tmp_path}/log/batch/{name}/_SUCCESS")
    assert shown(log) == plain(spark, [BATCHES[1]])


def test_the_base_is_not_shuffled(spark, tmp_path):
    """With few new keys the base's scan feeds no exchange but that of the keys it shares with them."""
    log = ArchiveLog(spark, f"{tmp_path}/log")
    log.append(posts(spark, BATCHES[0]))
    log.compact()
    log.append(posts(spark, BATCHES[1]))
    plan = log.read()._jdf.queryExecution().executedPlan().toString()
    base = plan.split("Union", 1)[1].strip().splitlines()[0:4]
    assert not any("Exchange" in line for line in base) and "BroadcastHashJoin" in plan
