"""Author reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.functions.text import normalize_space


def author_counts(posts: DataFrame) -> DataFrame:
    """Posts of every (thread, author) with normalised names; a blank author counts as ``Unknown``.

    Equal spellings are counted first, so names are normalised once each.
    """
    spelt = posts.groupBy("thread_id", "author").agg(F.count(F.lit(1)).alias("n"))
    name = normalize_space(F.col("author"))
    named = spelt.select("thread_id", F.when(name == "", "Unknown").otherwise(name).alias("author"), "n")
    return named.groupBy("thread_id", "author").agg(F.sum("n").alias("post_count"))


def author_rank(counts: DataFrame) -> DataFrame:
    """Ranks without ties: most posts first, then name without case, then name."""
    order = Window.partitionBy("thread_id").orderBy(F.col("post_count").desc(), F.lower("author"), F.col("author"))
    return counts.withColumn("rank", F.row_number().over(order))


def top_authors(posts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most active authors of every thread with their share of all its posts."""
    counts = author_counts(posts)
    totals = posts.groupBy(F.col("thread_id").alias("whole")).agg(F.count(F.lit(1)).alias("total"))
    best = author_rank(counts).filter(F.col("rank") <= k)  # cut to k rows a thread before the shuffle
    return best.join(totals, F.col("thread_id").eqNullSafe(F.col("whole"))).select("thread_id", "rank", "author", "post_count", F.round(100 * F.col("post_count") / F.col("total"), 2).alias("share_percent"))


def author_totals(posts: DataFrame) -> DataFrame:
    """(thread_id, total_posts, distinct_users), from author counts: no thread is counted in one task."""
    return author_counts(posts).groupBy("thread_id").agg(F.sum("post_count").alias("total_posts"), F.count(F.lit(1)).alias("distinct_users"))


def export_report(posts: DataFrame, exported: DataFrame, *, filtered: bool) -> DataFrame:
    """(thread_id, total_posts, exported_posts, filter_mode)."""
    total = posts.groupBy("thread_id").agg(F.count(F.lit(1)).alias("total_posts"))
    out = exported.groupBy("thread_id").agg(F.count(F.lit(1)).alias("exported_posts"))
    return total.join(out, "thread_id", "left").select("thread_id", "total_posts", F.coalesce("exported_posts", F.lit(0)).cast("long").alias("exported_posts"), F.lit("filtered" if filtered else "all_posts").alias("filter_mode"))


def embedded_report(rendered: DataFrame) -> DataFrame:
    """(thread_id, posts, images_embedded, images_fallback) of posts rendered with inline images."""
    return rendered.groupBy("thread_id").agg(F.count(F.lit(1)).alias("posts"), F.sum("n_embedded").alias("images_embedded"), F.sum("n_fallback").alias("images_fallback"))
