"""Scans over range partitions against plain windows, with one thread split over many partitions."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.operators import ordering, select
from quillstack.plans import archive


@pytest.fixture(params=[1, 8])
def split(request, spark):
    """A number of range partitions that adaptive execution leaves as they are."""
    keys = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def log(spark, n=120):
    r = random.Random(3)
    rows = [("big", i, r.choice(["x", "y", "", None]), r.choice([None, 1.0, 2.5, 9.0])) for i in range(n)] + [("small", 7, "x", 3.0), (None, 1, "x", 2.0), (None, 2, "x", None)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "thread_id string, page int, first_post string, seconds double")


def shown(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 4, 50])
def test_values_before_and_sums_equal_the_window(n, split, spark):
    pages = log(spark)
    got = ordering.scanned(pages, ["thread_id"], [F.col("page")], before={"before": (F.col("first_post"), n), "times": (F.col("seconds"), 2)}, sums={"place": F.lit(1), "odd": F.col("page") % 2})
    line = Window.partitionBy("thread_id").orderBy("page")
    plain = lambda c, k: F.transform(F.collect_list(F.struct(F.col(c).alias("v"))).over(line.rowsBetween(-k, -1)), lambda x: x["v"])
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    want = pages.select("*", plain("first_post", n).alias("before"), plain("seconds", 2).alias("times"), F.sum(F.lit(1)).over(upto).alias("place"), F.sum(F.col("page") % 2).over(upto).alias("odd"))
    assert shown(got) == shown(want.select(got.columns))


def test_a_thread_is_split(spark):
    """The sorted table has several partitions of the one large thread, and no window of the plan takes a thread whole."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = archive.repeated_first_post(log(spark))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        wide = [line for line in plan.splitlines() if "Window [" in line and "__part" not in line]
        assert "__part" in plan and not wide
        assert ordering.scanned(log(spark), ["thread_id"], [F.col("page")], sums={"n": F.lit(1)}).count() == 123
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_page_scans_equal_plain_windows(split, spark):
    pages = log(spark)
    line = Window.partitionBy("thread_id").orderBy("page")
    want = pages.withColumn("repeated", F.coalesce((F.col("first_post") != "") & (F.lag("first_post").over(line) == F.col("first_post")), F.lit(False)))
    assert shown(archive.repeated_first_post(pages)) == shown(want)
    recent = line.rowsBetween(-4, 0)
    values = F.collect_list("seconds").over(recent)
    mean = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x) / (F.size(values) * (F.size(values) + 1) / 2)
    estimate = F.when(F.size(values) == 0, 15.0).otherwise(F.greatest(F.lit(1.0), 0.70 * mean + 0.20 * F.percentile("seconds", F.lit(0.5)).over(recent)))
    got = archive.page_time_estimate(pages).withColumn("estimate", F.round("estimate", 9))
    assert shown(got) == shown(pages.withColumn("estimate", F.round(estimate, 9)))
    for n in (3, 5000):
        kept = pages.filter("page >= 2").withColumn("r", F.row_number().over(line)).filter(F.col("r") <= n).drop("r")
        assert shown(select.limit_pages(pages, 2, n)) == shown(kept)


def test_stops_of_a_split_thread(split, spark):
    rows = [("big", i, 3, 3, f"p{i - (i == 90)}", 1000) for i in range(1, 120)] + [(None, 1, 3, 3, "x", 9), (None, 2, 0, 0, "", 9)]
    pages = spark.createDataFrame(rows, "thread_id string, page int, n_blocks int, n_new int, first_post string, last_page int")
    assert sorted(map(tuple, archive.crawl_stop_page(pages).collect()), key=str) == [("big", 90, "first post repeated"), (None, 2, "no posts on page")]
    assert sorted(((x.thread_id or "", x.page) for x in archive.pages_before_stop(pages).collect())) == [("", 1)] + [("big", i) for i in range(1, 90)]
    assert {(x.thread_id, x.stop_page) for x in archive.crawl_stop_page(pages, limit=60).collect()} == {("big", 61), (None, 2)}


@pytest.mark.parametrize("kind", ["one run", "gaps", "pairs", "none touch"])
def test_islands_meet_at_partition_bounds(kind, split, spark):
    own = {"one run": range(1, 200), "gaps": [i for i in range(1, 200) if i not in (50, 51, 120)], "pairs": [i for i in range(1, 300) if i % 3], "none touch": range(1, 300, 2)}[kind]
    rows = [("big", i) for i in own] + [("big", 5), ("b", 7), ("b", 9), ("b", 8), (None, 4), ("z", 0), ("z", -3)]
    values = spark.createDataFrame(rows, "k string, v int").repartition(3)
    got = {x.k: x.label for x in select.collapse_ranges(values, ["k"], "v").collect()}
    want = {k: select.ranges_label(select.parse_ranges(",".join(str(v) for k2, v in rows if k2 == k and v > 0))) for k in ("big", "b", None)}
    assert got == want
