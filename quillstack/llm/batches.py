"""Arrow batches inside tasks, cut into pieces of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.staging import Stage

#: Rows of an Arrow batch: whole texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000
#: What a worker has for its next tasks, by name; tasks that do not ask for it drop it.
kept: dict[str, object] = {}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text each; one longer text is a slice alone.  Of what the worker has, ``keep`` stays."""
    if keep not in kept:
        kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)
    release()


def release() -> None:
    """Gives freed memory back to the machine: a worker lives on after its task, beside the executor's next ones."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # the C library's, which holds numpy's arrays


def texts(column: pa.Array) -> list[str]:
    """Python strings; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def within_bytes(stage: Stage, sample: DataFrame, fit_bytes: int) -> DataFrame:
    """Rows (doc_id, text, ...) of a sample of bounded rows whose texts have at most ``fit_bytes`` in all, in order of a hash of the id.

    Texts over a sixteenth of that are left out: a few of them would take the place of all others.  Only sizes pass the window.
    """
    rows = stage.put("sample", sample.withColumn("__row", F.monotonically_increasing_id()))
    sizes = rows.select("__row", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).filter(F.col("size") <= fit_bytes // 16)
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    kept = stage.put("fits", sizes.select("__row", upto.alias("upto")).filter(F.col("upto") <= fit_bytes).select("__row"))
    return rows.join(kept, "__row", "left_semi").drop("__row")
