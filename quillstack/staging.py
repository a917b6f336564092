"""Tables that cut lineage: written once to the shared folder, then read back.

A staged table outlives the executors that wrote it, so a lost executor costs a re-read
and never a recomputation of everything before it.  The folder is the one the session
names in ``spark.checkpoint.dir``; only a local session without that setting (tests) gets a
folder of its own, since on a cluster nobody else would see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-staged-")
    return _own[app]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """Staged tables of one job.  ``drop`` frees those that no later step reads."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.count = 0

    def put(self, name: str, df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        path = f"{self.root}/{name}-{self.count}"
        self.count += 1
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete staged tables that were consumed by a later staged table."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
