"""Where an archive goes on: resume and repair plans, progress, stop pages and summaries per thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators.ordering import scanned
from quillstack.staging import Stage

FIRST_ESTIMATE, WINDOW = 15.0, 5


def resume_plan(
    threads: DataFrame, *, state: DataFrame, markers: DataFrame, posts: DataFrame, cached: DataFrame, requested: int = 1, enabled: bool = True, overlap: int = 0
) -> DataFrame:
    """(thread_id, start_page, source): the first rule that holds.

    A saved next page, pages with markers, archived posts and cached pages count if they reach the
    requested page.  A cached page is read again; the other sources go on with the page after.
    """
    highest = lambda df, name: df.groupBy("thread_id").agg(F.max("page").alias(name))
    out = threads.select("thread_id").distinct()
    out = out.join(state.groupBy("thread_id").agg(F.max("next_page").alias("next_page")), "thread_id", "left")
    for df, name in ((markers, "marked"), (posts, "posted"), (cached, "cached")):
        out = out.join(highest(df, name), "thread_id", "left")
    rules = [
        (F.lit(not enabled), F.lit(requested), "disabled"),
        (F.col("next_page") >= requested, F.col("next_page"), "state"),
        (F.col("marked") + 1 >= requested, F.col("marked") + 1, "page_markers"),
        (F.col("posted") >= requested, F.col("posted") + 1, "thread_json"),
        (F.col("cached") >= requested, F.col("cached"), "raw_html"),
        (F.lit(overlap > 0 and requested > 1), F.lit(max(1, requested - overlap)), "requested_with_overlap"),
    ]
    page, source = F.lit(requested), F.lit("requested")
    for test, value, name in reversed(rules):
        page, source = F.when(test, value).otherwise(page), F.when(test, F.lit(name)).otherwise(source)
    return out.select("thread_id", page.cast("int").alias("start_page"), source.alias("source"))


def repair_candidates(state: DataFrame, summary: DataFrame, explicit: DataFrame | None = None, *, warnings: bool = True) -> DataFrame:
    """(thread_id, page): explicit pages, and the pages with warnings of the state, or if it has none of the last summary."""
    out = explicit.select("thread_id", "page") if explicit is not None else None
    if warnings:
        some = lambda c: F.when(F.size(c) > 0, F.col(c))
        a = state.select("thread_id", F.col("validation_warning_pages").alias("a"))
        b = summary.select("thread_id", F.col("validation_warning_pages").alias("b"))
        own = a.join(b, "thread_id", "full").select("thread_id", F.explode(F.coalesce(some("a"), some("b"))).alias("page")).withColumn("page", F.col("page").cast("int"))
        out = own if out is None else out.unionByName(own)
    return out.filter("page >= 1").distinct()


def latest_page_state(attempts: DataFrame) -> DataFrame:
    """The newest attempt of each page; combined before the shuffle."""
    columns = attempts.columns
    return attempts.groupBy("thread_id", "page").agg(F.max_by(F.struct(*columns), "completed_at").alias("x")).select(*(F.col(f"x.{c}").alias(c) for c in columns))


def warning_pages_update(attempts: DataFrame) -> DataFrame:
    """(thread_id, warning_pages): pages whose newest validation failed; a page that passes leaves."""
    last = latest_page_state(attempts)
    return last.groupBy("thread_id").agg(F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("page")))).alias("warning_pages"))


def run_summary(pages: DataFrame) -> DataFrame:
    """Totals of the pages of a run, one row per thread."""
    v = lambda name: F.col(f"validation.{name}")
    return pages.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("pages_completed"),
        F.sum("new_posts_count").alias("new_posts"),
        F.sum("new_images_downloaded").alias("images_downloaded"),
        F.sum("new_images_reused").alias("images_reused"),
        F.count_if("used_cached_html").alias("cached_pages"),
        F.sum(v("rejected_post_count")).alias("rejected_candidates"),
        F.sum(v("unknown_date_posts")).alias("unknown_date_posts"),
        F.count_if(~v("passed")).alias("validation_failures"),
        F.sort_array(F.collect_set(F.when(~v("passed"), F.col("page")))).alias("validation_warning_pages"),
    )


def repair_summary(requested: DataFrame, validated: DataFrame, counted: DataFrame) -> DataFrame:
    """Requested, processed, clean and still failing pages, and posts added and replaced, per thread."""
    pages = requested.select("thread_id", "page").distinct().join(validated.select("thread_id", "page", "passed"), ["thread_id", "page"], "left").join(counted, ["thread_id", "page"], "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pages.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("pages_requested"),
        F.count("passed").alias("pages_processed"),
        F.count_if("passed").alias("pages_repaired_cleanly"),
        F.count_if(~F.col("passed")).alias("pages_still_warning"),
        zero("added").alias("posts_added"),
        zero("replaced").alias("posts_replaced"),
    )


def completion_status(threads: DataFrame, validated: DataFrame) -> DataFrame:
    """(thread_id, complete, reason) of threads (last_page_seen, last_completed_page)."""
    last = validated.select("thread_id", F.col("page").alias("last_page_seen"), "passed", "accepted_post_count", F.lit(True).alias("seen"))
    rules = [
        (F.col("last_page_seen").isNull(), "last page unknown"),
        (F.col("last_completed_page") < F.col("last_page_seen"), "did not reach detected last page"),
        (F.col("seen").isNull(), "final page validation missing"),
        (~F.col("passed"), "final page validation failed"),
        (F.coalesce("accepted_post_count", F.lit(0)) <= 0, "final page contained no accepted posts"),
    ]
    reason = F.lit("final page validated")
    for test, text in reversed(rules):
        reason = F.when(test, F.lit(text)).otherwise(reason)
    out = threads.join(last, ["thread_id", "last_page_seen"], "left").withColumn("reason", reason)
    return out.select("thread_id", (F.col("reason") == "final page validated").alias("complete"), "reason")


def full_total_pages(start: Column, last: Column) -> Column:
    return F.when(last >= start, last - start + 1)


def progress_total_pages(requested: Column, actual: Column, last: Column, limit: Column) -> Column:
    """Pages in scope of a run: up to the limit if there is one, else all from the requested page."""
    left = F.greatest(F.lit(0), last - actual + 1)
    limited = F.when(last.isNull(), limit).otherwise(F.least(limit, left))
    return F.when(limit.isNotNull(), limited).otherwise(full_total_pages(requested, last))


def _page_log(pages: DataFrame) -> DataFrame:
    """Pages in order, with ``repeated`` (their first post is that of the page before) and ``at``, their place."""
    seen = scanned(pages, ["thread_id"], [F.col("page")], before={"__before": (F.col("first_post"), 1)}, sums={"at": F.lit(1)})
    same = (F.col("first_post") != "") & (F.get("__before", F.lit(0)) == F.col("first_post"))
    return seen.withColumn("repeated", F.coalesce(same, F.lit(False))).drop("__before")


def repeated_first_post(pages: DataFrame) -> DataFrame:
    """Pages with ``repeated``: their first post is that of the page before."""
    return _page_log(pages).drop("at")


def stop_reasons(pages: DataFrame, *, start: int = 1, limit: int | None = None) -> DataFrame:
    """Pages (page, n_blocks, n_new, first_post, last_page) with ``reason`` to stop and whether the page still counts."""
    own = _page_log(pages.filter(F.col("page") >= start))
    rules = [
        (F.lit(limit is not None) & (F.col("at") > (limit or 0)), "limit reached", False),
        (F.col("n_blocks") == 0, "no posts on page", False),
        (F.col("repeated"), "first post repeated", False),
        (F.col("page") >= F.col("last_page"), "last page", True),
        ((F.col("n_new") == 0) & (F.col("page") > start), "no new posts", True),
    ]
    reason, counts = F.lit(None).cast("string"), F.lit(True)
    for test, text, keep in reversed(rules):
        reason, counts = F.when(test, F.lit(text)).otherwise(reason), F.when(test, F.lit(keep)).otherwise(counts)
    return own.select(*pages.columns, reason.alias("reason"), counts.alias("counts"))


def crawl_stop_page(pages: DataFrame, **options) -> DataFrame:
    """(thread_id, stop_page, reason) of the first page that stops a run; threads that never stop have none."""
    told = stop_reasons(pages, **options).filter("reason IS NOT NULL")
    return told.groupBy("thread_id").agg(F.min("page").alias("stop_page"), F.min_by("reason", "page").alias("reason"))


def pages_before_stop(pages: DataFrame, **options) -> DataFrame:
    """The pages of a run, up to the one that stops it, which is left out unless it counts."""
    told = Stage(pages.sparkSession, "stops").put("told", stop_reasons(pages, **options))
    stops = told.filter("reason IS NOT NULL").groupBy(F.col("thread_id").alias("__thread")).agg(F.min("page").alias("__stop"))
    kept = told.join(stops, F.col("thread_id").eqNullSafe(F.col("__thread")), "left")
    return kept.filter((F.col("__stop").isNull() | (F.col("page") <= F.col("__stop"))) & F.col("counts")).select(pages.columns)


def middle_of(values: Column) -> Column:
    """Median of an array without nulls; null of an empty one."""
    line = F.sort_array(values)
    return (F.get(line, F.floor((F.size(line) - 1) / 2).cast("int")) + F.get(line, F.floor(F.size(line) / 2).cast("int"))) / 2


def page_time_estimate(pages: DataFrame, history: Column | None = None) -> DataFrame:
    """``estimate`` of seconds per page after each page, from ``seconds`` of the last five.

    Weighted mean and median count for nine tenths in all; a historical mean takes its part; never below one second.
    """
    seconds = F.col("seconds").cast("double")
    seen = scanned(pages, ["thread_id"], [F.col("page")], before={"__before": (seconds, WINDOW - 1)})
    seen = seen.withColumn("__recent", F.filter(F.concat("__before", F.array(seconds)), lambda x: x.isNotNull()))
    values = F.col("__recent")
    weighted = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x) / (F.size(values) * (F.size(values) + 1) / 2)
    estimate = 0.70 * weighted + 0.20 * middle_of(values)
    if history is not None:
        estimate = F.when(history > 0, 0.85 * estimate + 0.15 * history).otherwise(estimate)
        first = F.when(history > 0, history).otherwise(FIRST_ESTIMATE)
    else:
        first = F.lit(FIRST_ESTIMATE)
    return seen.withColumn("estimate", F.when(F.size(values) == 0, first).otherwise(F.greatest(F.lit(1.0), estimate))).select(*pages.columns, "estimate")
