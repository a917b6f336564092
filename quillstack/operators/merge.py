"""Merging new and repaired posts into an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import filled, normalize_space


def merge_key() -> list[Column]:
    """Two posts are the same if these agree; nulls count as empty."""
    return [F.col("thread_id"), filled(F.col("post_id")).alias("k_id"), filled(F.col("post_url")).alias("k_url"), F.coalesce(F.col("page"), F.lit(0)).alias("k_page"), filled(F.col("post_number")).alias("k_number")]


def repair_key() -> Column:
    return F.struct(filled(F.col("post_number")).alias("number"), normalize_space(F.col("author")).alias("author"), normalize_space(F.col("timestamp")).alias("timestamp"))


def snapshot_key() -> Column:
    """Name of a post's own record."""
    number = F.coalesce(F.when(F.col("post_number") != "", F.col("post_number")), F.lit("unknown"))
    return F.coalesce(F.when(F.col("post_id") != "", F.col("post_id")), F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_post"), number))


def first_by(rows: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """The row of each key that comes first; combined before the shuffle, so a hot key costs a row per task."""
    value = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("__row")).select("__row.*")


def merge_posts(existing: DataFrame, new: DataFrame, *, seq: str | None = None) -> DataFrame:
    """Union without repeats: the archive's row wins over the new one, an earlier ``seq`` over a later.

    Without ``seq`` equal keys of one side are told apart by their content, for a fixed result.
    """
    columns = existing.columns
    both = existing.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    place = F.col(seq) if seq else F.xxhash64(*columns)
    return first_by(both, merge_key(), F.struct(F.col("__src"), place.alias("place"))).select(columns)


def union_posts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def new_posts_only(parsed: DataFrame, archive: DataFrame) -> DataFrame:
    """Parsed posts whose id the archive does not hold; posts without an id always pass.

    Posts without an id are kept out of the join: as one key they would meet in one task.
    """
    known = archive.filter("post_id <> ''").select("thread_id", "post_id").distinct()
    some = filled(F.col("post_id")) != ""
    return parsed.filter(some).join(known, ["thread_id", "post_id"], "left_anti").select(parsed.columns).unionByName(parsed.filter(~some))


def except_pages(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Posts that are not on the given (thread_id, page)."""
    return posts.join(pages.select("thread_id", "page").distinct(), ["thread_id", "page"], "left_anti").select(posts.columns)


def replace_pages(existing: DataFrame, replacement: DataFrame, pages: DataFrame, *, only_if_passed: DataFrame | None = None, seq: str | None = None, merged: bool = False) -> DataFrame:
    """All posts of the pages go, the replacement's come.

    A page is replaced whatever its validation says, unless ``only_if_passed`` (thread_id, page, passed) is given.
    ``merged`` says that ``existing`` holds each key once, as an archive does: its rows are then passed on as they are,
    and of a table in buckets of thread and page nothing is shuffled.
    """
    if only_if_passed is not None:
        good = only_if_passed.filter("passed").select("thread_id", "page").distinct()
        pages = pages.join(good, ["thread_id", "page"], "left_semi")
        replacement = replacement.join(good, ["thread_id", "page"], "left_semi").select(replacement.columns)
    kept = except_pages(existing, pages)
    return kept.unionByName(not_held(replacement, kept, seq).select(existing.columns)) if merged else merge_posts(kept, replacement, seq=seq)


def not_held(new: DataFrame, held: DataFrame, seq: str | None = None) -> DataFrame:
    """The posts of ``new``, once each, whose key ``held`` does not have.

    The key has thread and page in it, so only rows on the new posts' own pages are asked for their keys.  Rows without a
    thread or a page meet no other by a join of these two; their keys are all asked for.
    """
    named = lambda columns: [c.alias(f"__k{i}") for i, c in enumerate(columns)]
    own = new.select("thread_id", "page").distinct()
    placed = held.join(own, ["thread_id", "page"], "left_semi").select(named(merge_key()))
    loose = held.filter("thread_id IS NULL OR page IS NULL OR page = 0").select(named(merge_key()))
    keys = placed.unionByName(loose).distinct()
    place = F.col(seq) if seq else F.xxhash64(*new.columns)
    once = first_by(new, merge_key(), F.struct(place.alias("place")))
    same = [a.eqNullSafe(F.col(f"__k{i}")) for i, a in enumerate(merge_key())]
    return once.join(keys, reduce(lambda x, y: x & y, same), "left_anti")


def repair_added_vs_replaced(existing: DataFrame, repaired: DataFrame) -> DataFrame:
    """(thread_id, page, added, replaced): a repaired post is added if its id, or else its key, is new on its page.

    The archive is cut to the repaired pages first; only what is left of it is dealt out.
    """
    existing = existing.join(repaired.select("thread_id", "page").distinct(), ["thread_id", "page"], "left_semi")
    ids = existing.filter("post_id <> ''").select("thread_id", "page", "post_id").distinct().withColumn("has_id", F.lit(True))
    keys = existing.select("thread_id", "page", repair_key().alias("key")).distinct().withColumn("has_key", F.lit(True))
    told = repaired.withColumn("key", repair_key()).join(ids, ["thread_id", "page", "post_id"], "left").join(keys, ["thread_id", "page", "key"], "left")
    added = ((filled(F.col("post_id")) != "") & F.col("has_id").isNull()) | F.col("has_key").isNull()
    return told.groupBy("thread_id", "page").agg(F.count_if(added).alias("added"), F.count_if(~added).alias("replaced"))
