"""Readers of archive files.  Schemas are declared; bad documents are counted, not hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack import schemas
from quillstack.operators.select import ranges_of

PAGE_FILE, MARKER_FILE = r"page_([0-9]+)\.html$", r"page_([0-9]+)\.done\.json$"


def _name():
    return F.col("_metadata.file_name")


def file_path():
    """Path of the file that a row is from, as it is named: the reader gives it with per cent signs for blanks and more."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _thread(depth: int):
    """Name of the folder ``depth`` levels above a file."""
    return F.element_at(F.split(file_path(), "/"), -(depth + 1))


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, page, page_url, html) of files ``<thread>/raw_html/page_0001.html``; undecodable bytes are replaced."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "page_*.html").option("recursiveFileLookup", True).text(path)
    return whole.select(_thread(2).alias("thread_id"), F.regexp_extract(_name(), PAGE_FILE, 1).try_cast("int").alias("page"), F.lit("").alias("page_url"), F.make_valid_utf8("value").alias("html")).filter("page IS NOT NULL")


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, page, page_url, html) of pages written by ``write_raw_pages``."""
    return spark.read.schema("thread_id string, page int, page_url string, html string").parquet(path).select("thread_id", "page", "page_url", "html")


def read_document_table(spark: SparkSession, path: str) -> DataFrame:
    """Posts of documents written by ``write_documents``, one document a line."""
    return spark.read.schema(f"thread_id STRING, {schemas.THREAD_DOCUMENT}").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).select("thread_id", F.inline("posts"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Thread documents ``<thread>/thread.json`` with ``_corrupt_record``."""
    return spark.read.schema(schemas.THREAD_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "thread.json").option("recursiveFileLookup", True).json(path).withColumn("thread_id", _thread(1))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Posts of thread documents; a missing or bad list of posts gives none."""
    return read_documents(spark, path).select("thread_id", F.inline("posts"))


def corrupt_documents(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id) of documents that could not be read."""
    return read_documents(spark, path).filter("_corrupt_record IS NOT NULL AND posts IS NULL").select("thread_id")


def read_page_state(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, page) of completed pages, by the names of files ``<thread>/page_state/page_0001.done.json``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.done.json").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -3).alias("thread_id"), F.regexp_extract("path", MARKER_FILE, 1).try_cast("int").alias("page")).filter("page IS NOT NULL").distinct()


def read_page_markers(spark: SparkSession, path: str) -> DataFrame:
    """Page state of the markers' contents."""
    return spark.read.schema(schemas.PAGE_STATE).option("multiLine", True).option("pathGlobFilter", "page_*.done.json").option("recursiveFileLookup", True).json(path)


def read_page_state_table(spark: SparkSession, path: str) -> DataFrame:
    """(thread_id, page) of completed pages of a table written by ``write_page_state``; other columns are not read."""
    return spark.read.schema("thread_id string, page int").parquet(path).select("thread_id", "page").distinct()


def read_resume_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per thread of a table written by ``write_resume_state``."""
    return spark.read.schema(schemas.RESUME_STATE).json(path)


def read_resume_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per file ``<thread>/resume_state.json``."""
    return spark.read.schema(schemas.RESUME_STATE).option("multiLine", True).option("pathGlobFilter", "resume_state.json").option("recursiveFileLookup", True).json(path).withColumn("thread_id", F.coalesce("thread_id", _thread(1)))


def read_selection_file(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi) of a text of post numbers and ranges; a missing file is an error."""
    return spark.read.text(path).select(F.explode(ranges_of(F.col("value"), hashes=True)).alias("r")).select("r.lo", "r.hi").distinct()


def read_images(spark: SparkSession, path: str, folder: str = "images") -> DataFrame:
    """(thread_id, path, content) of files ``<thread>/images/...``; the path is relative to the thread.  Without a folder files stand in the thread's own."""
    inner = f"/{folder}" if folder else ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("path").rlike(f"{inner}/[^/_.][^/]*$"))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -3 if folder else -2).alias("thread_id"), F.concat(F.lit(f"{folder}/" if folder else ""), F.element_at(parts, -1)).alias("path"), "content")
