"""Writers of archive tables and documents.  Spark's commit protocol replaces temporary files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.merge import first_by, snapshot_key
from quillstack.operators.validate import public_posts

BUCKETS = 64


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``thread_bucket`` by hash of the thread: the partition that an update rewrites."""
    return df.withColumn("thread_bucket", F.pmod(F.xxhash64("thread_id"), F.lit(buckets)).cast("int"))


def _replace(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_archive(posts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Posts without raw HTML; only the buckets that the posts touch are replaced.

    The posts must not be read from ``path`` itself: stage them first.
    """
    _replace(with_bucket(public_posts(posts), buckets).repartition("thread_bucket", F.pmod(F.xxhash64("post_id"), F.lit(8))).sortWithinPartitions("thread_bucket", "thread_id"), path, "thread_bucket")


def save_bucketed_archive(posts: DataFrame, table: str, buckets: int = BUCKETS, keys: tuple[str, ...] = ("thread_id", "post_id"), path: str | None = None) -> None:
    """Posts without raw HTML as a catalogued table, at ``path`` or in the warehouse, in buckets of ``keys``: joins and sums by just these keys read it where it lies, without a shuffle.

    ``merge.new_posts_only`` meets it by thread and id, ``merge.except_pages`` and the page counts of a repair by thread and page.
    """
    public = public_posts(posts)
    writer = public.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_raw_pages(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Page texts as a table by thread bucket, not a folder per page."""
    _replace(with_bucket(pages.select("thread_id", "page", "page_url", "html"), buckets), path, "thread_bucket")


def write_thread_files(files: DataFrame, path: str) -> None:
    """Lines (thread_id, value) as text files in a folder per thread.

    Making a file costs more than what it holds, so threads are dealt to a number of tasks that is given: left to their bytes, all of them would end in one.
    """
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    files.select("value", "thread_id").repartition(tasks, "thread_id").write.partitionBy("thread_id").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per thread."""
    documents.write.mode("overwrite").json(path)


def latest_snapshots(posts: DataFrame, order: str | None = None) -> DataFrame:
    """One public post per snapshot key, the last by ``order``."""
    public = public_posts(posts).withColumn("snapshot", snapshot_key())
    if order is None:
        return first_by(public, [F.col("thread_id"), F.col("snapshot")], F.struct(F.xxhash64(*public.columns).alias("place")))
    return public.groupBy("thread_id", "snapshot").agg(F.max_by(F.struct(*public.columns), order).alias("x")).select("x.*")


def write_post_snapshots(posts: DataFrame, path: str, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Snapshots as a table by thread bucket, not as a file per post."""
    _replace(with_bucket(latest_snapshots(posts, order), buckets), path, "thread_bucket")


def write_page_state(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    _replace(with_bucket(pages, buckets), path, "thread_bucket")


def write_resume_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report table as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_texts(documents: DataFrame, path: str, column: str = "document", buckets: int = BUCKETS) -> None:
    """Rendered documents (thread_id, document) as a table by thread bucket, not a folder per thread."""
    _replace(with_bucket(documents.select("thread_id", F.col(column).alias("document")), buckets), path, "thread_bucket")


def write_document_parts(parts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parts of long documents (thread_id, part, text) as a table by thread bucket, in order of thread and part."""
    placed = with_bucket(parts.select("thread_id", "part", "text"), buckets)
    _replace(placed.repartitionByRange("thread_bucket", "thread_id", "part").sortWithinPartitions("thread_bucket", "thread_id", "part"), path, "thread_bucket")


def write_ordered_parts(parts: DataFrame, path: str, column: str) -> None:
    """Sections of very long threads as ordered part files; the input is range-partitioned and sorted."""
    parts.select(column).write.mode("overwrite").text(path)
