"""Supplied tables seen as forum posts, so that archive operators can run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators.ordering import numbered
from quillstack.staging import read_table


def conversation_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as posts: three turns make a page."""
    turn = F.col("turn")
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("thread_id"),
        (F.col("conv_id") * 1000 + turn).cast("string").alias("post_id"),
        (turn + 1).cast("string").alias("post_number"),
        F.concat(F.lit("/thread/post/"), (F.col("conv_id") * 1000 + turn).cast("string")).alias("post_url"),
        (F.floor(turn / 3) + 1).cast("int").alias("page"),
        F.col("role").alias("author"),
        F.lit("Unknown date").alias("timestamp"),
        F.col("text").alias("body_text"),
        F.col("text").alias("text"),
    )


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as dated posts of many authors; a thread per event type, twenty posts a page."""
    events = read_table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    return (
        numbered(events, ["event_type"], [F.col("ts"), F.col("event_id")], "n")
        .select(
            F.col("event_type").alias("thread_id"),
            F.col("event_id").cast("string").alias("post_id"),
            F.col("n").cast("string").alias("post_number"),
            (F.floor((F.col("n") - 1) / 20) + 1).cast("int").alias("page"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"),
            F.date_format("ts", "MMM d, yyyy h:mma").alias("timestamp"),
        )
    )


def event_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread and author of every event, without numbering the posts: no shuffle."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("thread_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"))


#: The same adapters as SQL, for oracles.
CONVERSATION_POSTS_SQL = """
    SELECT CAST(conv_id AS VARCHAR) AS thread_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS post_id, CAST(turn + 1 AS VARCHAR) AS post_number,
        '/thread/post/' || CAST(conv_id * 1000 + turn AS VARCHAR) AS post_url, CAST(turn // 3 + 1 AS INTEGER) AS page, role AS author,
        'Unknown date' AS "timestamp", text AS body_text, text FROM conversations"""
EVENT_POSTS_SQL = """
    SELECT event_type AS thread_id, CAST(event_id AS VARCHAR) AS post_id, CAST(n AS VARCHAR) AS post_number, CAST((n - 1) // 20 + 1 AS INTEGER) AS page,
        'user_' || CAST(user_id AS VARCHAR) AS author, strftime(ts, '%b %-d, %Y %-I:%M%p') AS "timestamp"
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)"""
