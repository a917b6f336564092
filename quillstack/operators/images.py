"""Image plans and local image contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import safe_filename
from quillstack.functions.urls import data_uri, guess_extension
from quillstack.operators.select import sort_key
from quillstack.staging import Stage


def image_manifest(posts: DataFrame) -> DataFrame:
    """(thread_id, post_id, idx, url, local_path, status): the first reference to a url names its file.

    The first reference is a minimum per url, combined before the shuffle: a popular url costs a row per task.
    References that stand at the same place of the order are told apart by their row, so one only is the first.
    """
    each = posts.select("thread_id", "post_id", "post_number", "page", F.struct(*sort_key()).alias("key"), F.posexplode("image_urls").alias("pos", "url")).withColumn("idx", F.col("pos") + 1)
    some = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    stem = F.coalesce(some("post_id"), some("post_number"), some("page"))
    name = safe_filename(F.concat(F.lit("post_"), stem, F.lit("_"), F.lpad(F.col("idx").cast("string"), 2, "0"), guess_extension(F.col("url"))))
    each = each.select("thread_id", "post_id", "idx", "url", F.concat(F.lit("images/"), name).alias("name"), F.struct("key", "idx", F.monotonically_increasing_id().alias("row")).alias("order"))
    each = Stage(posts.sparkSession, "manifest").put("references", each)
    first = each.groupBy("thread_id", "url").agg(F.min(F.struct("order", "name")).alias("first"))
    status = F.when(F.col("order") == F.col("first.order"), "first").otherwise("reused")
    return each.join(first, ["thread_id", "url"]).select("thread_id", "post_id", "idx", "url", F.col("first.name").alias("local_path"), status.alias("status"))


def resolve_images(posts: DataFrame, images: DataFrame, *, keys: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """(thread_id, keys, idx, path, uri): local images inline, others by their path; posts without images have none."""
    refs = posts.select("thread_id", *keys, F.posexplode("images").alias("pos", "path"))
    known = images.select("thread_id", "path", "content").dropDuplicates(["thread_id", "path"])
    return refs.join(known, ["thread_id", "path"], "left").select("thread_id", *keys, (F.col("pos") + 1).alias("idx"), "path", data_uri(F.col("path"), F.col("content")).alias("uri"))


def image_counts(files: DataFrame) -> DataFrame:
    """(thread_id, images): finished files per thread; contents are not read."""
    return files.filter(~F.col("path").endswith(".part")).groupBy("thread_id").agg(F.count(F.lit(1)).alias("images"))
