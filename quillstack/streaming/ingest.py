"""Incremental ingest of page files with Structured Streaming; the checkpoint is the resume state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstack.operators import parse
from quillstack.sources.archive_log import ArchiveLog, post_key
from quillstack.sources.readers import PAGE_FILE, file_path
from quillstack.staging import Stage


def pages_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw pages as they arrive, each file once."""
    reader = spark.readStream.option("wholetext", True).option("pathGlobFilter", "page_*.html").option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    parts = F.split(file_path(), "/")
    return reader.schema("value string").format("text").load(path).select(F.element_at(parts, -3).alias("thread_id"), F.regexp_extract(F.col("_metadata.file_name"), PAGE_FILE, 1).try_cast("int").alias("page"), F.lit("").alias("page_url"), F.make_valid_utf8("value").alias("html"))


def upsert_posts(spark: SparkSession, posts: DataFrame, path: str, token: str | None = None) -> None:
    """Adds a batch's accepted posts; what the archive holds already is left out when it is read.  The batch is all that is written."""
    ArchiveLog(spark, path).append(posts.filter("accepted"), token)


def spread(batch: DataFrame) -> DataFrame:
    """Pages of few files on all cores: parsing a page costs far more than moving it."""
    tasks = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(2 * tasks, "thread_id", "page") if batch.rdd.getNumPartitions() < tasks else batch


def ingest_pages_stream(spark: SparkSession, pages: DataFrame, archive: str, checkpoint: str, repair: str | None = None):
    """Parses arriving pages, appends their posts and notes failed pages for repair; ends when all present files are done.

    A batch that is run again after a failure replaces its own files.  The archive is compacted when it is due, between batches.
    """
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def step(batch: DataFrame, batch_id: int) -> None:
        stage = Stage(batch.sparkSession, "ingest")
        parsed = stage.put("parsed", parse.parse_pages(spread(batch)))
        upsert_posts(batch.sparkSession, parse.posts_of(parsed), archive, f"{stream}-{batch_id}")
        ArchiveLog(batch.sparkSession, archive).compact_if_due()
        if repair:
            seen = parse.validated_pages(parsed).select("thread_id", "page", F.lit(batch_id).cast("long").alias("arrival"), "validation.passed", "validation.warnings")
            seen.write.mode("append").parquet(f"{repair}/validated")

    query = run_available(pages, step, checkpoint)
    if repair:
        judge_pages(pages.sparkSession, repair, f"{checkpoint}-retries")
    return query


#: Arrivals of a page that fails up to which it is asked for again; then it goes to repair.
RETRIES = 1
#: How long a failed page may wait for its next arrival before it goes to repair.
PATIENCE = "1 hour"
SEEN = "thread_id string, page int, arrival long, passed boolean, warnings array<string>"
ACTIONS = "thread_id string, page int, action string, attempts int, warnings array<string>"


def page_actions(seen: DataFrame, *, retries: int = RETRIES, patience: str = PATIENCE) -> DataFrame:
    """(thread_id, page, action, attempts, warnings) of a stream of validated pages: ``retry`` asks for a page again, ``repair`` gives it up.

    State is kept for failing pages only, until they pass, go to repair or have waited for ``patience``.  Rows of one arrival are one attempt, and pass if any of them does; an
    arrival that was counted already, as after a restart, counts no more.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        attempts, last, warnings = state.get if state.exists else (0, -1, [])
        if state.hasTimedOut:
            out.append((*key, "repair", attempts, list(warnings)))
            state.remove()
        else:
            # Most pages have one row: plain lists, as a frame per page would cost more than all else.
            arrivals: dict[int, list[tuple[bool, str | None]]] = {}
            for b in batches:
                for arrival, passed, told in zip(b.arrival.tolist(), b.passed.tolist(), b.told.tolist()):
                    if arrival > last:
                        arrivals.setdefault(int(arrival), []).append((bool(passed), told))
            for last, own in sorted(arrivals.items()):
                if any(passed for passed, _ in own):
                    attempts = 0
                    continue
                attempts, warnings = attempts + 1, json.loads(own[0][1] or "[]")
                out.append((*key, "retry" if attempts <= retries else "repair", attempts, warnings))
                if attempts > retries:
                    attempts = 0
            if attempts:
                state.update((attempts, last, warnings))
                state.setTimeoutDuration(wait)
            elif state.exists:
                state.remove()
        # Of one batch only the last word on a page counts: a retry that has come already is not asked for.
        if out and (attempts or out[-1][2] == "repair"):
            yield pd.DataFrame(out[-1:], columns=["thread_id", "page", "action", "attempts", "warnings"])

    flat = seen.select("thread_id", "page", "arrival", "passed", F.when(~F.col("passed"), F.to_json("warnings")).alias("told"))
    return flat.groupBy("thread_id", "page").applyInPandasWithState(step, ACTIONS, "attempts int, last long, warnings array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def judge_pages(spark: SparkSession, repair: str, checkpoint: str, **options):
    """Runs ``page_actions`` over all validated pages that have arrived, and adds to the table ``<repair>/actions``."""
    seen = spark.readStream.schema(SEEN).parquet(f"{repair}/validated")
    # One batch: with timeouts by the clock, a run over all that is there would go on with empty batches for ever.
    query = page_actions(seen, **options).writeStream.format("parquet").option("path", f"{repair}/actions").option("checkpointLocation", checkpoint).trigger(once=True).start()
    query.awaitTermination()
    return query


def pages_to(spark: SparkSession, repair: str, action: str) -> DataFrame:
    """(thread_id, page, attempts, warnings) of pages asked for again (``retry``) or given up (``repair``), in all."""
    return spark.read.schema(ACTIONS).parquet(f"{repair}/actions").filter(F.col("action") == action).drop("action")


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a foreachBatch step over all that is there, then stops."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_dedupe(posts: DataFrame, watermark: str | None = None, delay: str = "1 day") -> DataFrame:
    """First occurrence of each post id of a stream.

    Without a watermark ids are remembered for ever, as an archive must: the state grows with the archive, so for
    large ones use ``dedupe_into``.  With a watermark column ids are forgotten after ``delay``: bounded, but a different result.
    """
    if watermark is None:
        return posts.dropDuplicates(["thread_id", "post_id"])
    return posts.withWatermark(watermark, delay).dropDuplicatesWithinWatermark(["thread_id", "post_id"])


def dedupe_into(posts: DataFrame, archive: ArchiveLog, checkpoint: str, *, delay: str = "10 minutes", emit: Callable[[DataFrame, int], None] | None = None):
    """Adds the posts of a stream that the archive does not hold, each once, and hands them to ``emit``; ends when all that is there is done.

    Repeats within ``delay`` of their arrival meet in the state store, which forgets them then; older ones are found in the archive, of whose touched
    buckets only keys are read.  So the state is bounded by what arrives in ``delay``, and nothing is ever taken for new twice.
    """
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    key = post_key()
    timed = posts.withColumn("__at", F.current_timestamp()).withColumn("__thread", key["t"]).withColumn("__post", key["k"])
    recent = timed.withWatermark("__at", delay).dropDuplicatesWithinWatermark(["__thread", "__post"]).drop("__at", "__thread", "__post")

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = archive.append_new(batch, f"{stream}-{batch_id}")
        if emit:
            emit(fresh, batch_id)
        archive.compact_if_due()

    return run_available(recent, step, checkpoint)
