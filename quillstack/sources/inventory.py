"""An inventory of archive files, refreshed folder by folder, so that a run lists and reads only what is new.

    <path>/folders/   (folder, modified, run)        a row for each folder whenever it was listed
    <path>/files/     (thread_id, page, file, length, modified, run)   a row for each new or changed file

A refresh looks up the time of change of every thread's folder, lists those that changed since they were last listed (many folders are listed by tasks, not on
the driver), and adds their new files.  Readers take the files of a run: Spark opens the changed folders only, drops files by their time before it reads
any, and packs the others into partitions by size.

Defined cases: a root without such folders gives no files; a file that was written again counts as new; a deleted file stays known until ``files`` is
asked for existing ones only by reading it; names that are no pages are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.sources.readers import PAGE_FILE, file_path

FOLDERS, FILES = "folder string, modified long, run int", "thread_id string, page int, file string, length long, modified timestamp, run int"
#: Folders that one reader is given at a time.
GROUP = 10_000


class Inventory:
    """Files ``<root>/<thread>/<folder>/page_*`` as known at ``path``."""

    def __init__(self, spark: SparkSession, root: str, path: str, *, folder: str = "raw_html", pattern: str = PAGE_FILE, glob: str = "page_*.html"):
        self.spark, self.root, self.path = spark, root.rstrip("/"), path.rstrip("/")
        self.folder, self.pattern, self.glob = folder, pattern, glob

    def _table(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """The newest row of every file."""
        return self._table("files", FILES).groupBy("file").agg(F.max_by(F.struct("thread_id", "page", "length", "modified", "run"), "run").alias("x")).select("x.thread_id", "x.page", "file", "x.length", "x.modified", "x.run")

    def last_run(self) -> int:
        return self._table("folders", FOLDERS).agg(F.max("run")).first()[0] or 0

    def _changed(self) -> list[tuple[str, int]]:
        """(folder, time of change) of folders that are new or changed since they were listed; a status for each folder, none for its files."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/{self.folder}")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        now = [(x.getPath().toString(), x.getModificationTime()) for x in found if x.isDirectory()]
        if not now:
            return []
        known = self._table("folders", FOLDERS).groupBy("folder").agg(F.max("modified").alias("known"))
        return [(x.folder, x.modified) for x in self.spark.createDataFrame(now, "folder string, modified long").join(known, "folder", "left").filter("known IS NULL OR modified > known OR modified = 0").orderBy("folder").collect()]

    def refresh(self) -> tuple[int, int]:
        """(run, folders listed): lists what changed and adds its new files; a run without changes adds nothing."""
        changed, run = self._changed(), self.last_run() + 1
        if not changed:
            return run - 1, 0
        known = self.files().select("file", F.col("modified").alias("known"))
        for a in range(0, len(changed), GROUP):
            listed = self.spark.read.format("binaryFile").option("pathGlobFilter", self.glob).option("recursiveFileLookup", True).load([f for f, _ in changed[a : a + GROUP]])
            parts = F.split("path", "/")
            rows = listed.select(F.element_at(parts, -3).alias("thread_id"), F.regexp_extract("path", self.pattern, 1).try_cast("int").alias("page"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), F.lit(run).alias("run"))
            fresh = rows.filter("page IS NOT NULL").join(known, "file", "left").filter("known IS NULL OR modified > known").select("thread_id", "page", "file", "length", "modified", "run")
            fresh.write.mode("append").parquet(f"{self.path}/files")
        # Last: a refresh that fails before lists the same folders again.
        self.spark.createDataFrame([(f, m, run) for f, m in changed], FOLDERS).coalesce(1).write.mode("append").parquet(f"{self.path}/folders")
        return run, len(changed)

    def new_pages(self, run: int) -> DataFrame:
        """(thread_id, page, page_url, html) of the files that a run added; undecodable bytes are replaced."""
        folders = [r.folder for r in self._table("folders", FOLDERS).filter(F.col("run") == run).select("folder").distinct().collect()]
        schema = "thread_id string, page int, page_url string, html string"
        if not folders:
            return self.spark.createDataFrame([], schema)
        own = self._table("files", FILES).filter(F.col("run") == run).select(F.col("file").alias("__file"))
        oldest = self._table("files", FILES).filter(F.col("run") == run).agg(F.min("modified")).first()[0]
        out = None
        for a in range(0, len(folders), GROUP):
            whole = self.spark.read.option("wholetext", True).option("pathGlobFilter", self.glob).option("recursiveFileLookup", True).text(folders[a : a + GROUP])
            if oldest is not None:
                whole = whole.filter(F.col("_metadata.file_modification_time") >= F.lit(oldest))
            parts = F.split(file_path(), "/")
            some = whole.select(F.element_at(parts, -3).alias("thread_id"), F.regexp_extract(F.col("_metadata.file_name"), self.pattern, 1).try_cast("int").alias("page"), F.lit("").alias("page_url"), F.make_valid_utf8("value").alias("html"), file_path().alias("__path"))
            out = some if out is None else out.unionByName(some)
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        return out.join(own, plain(F.col("__path")) == plain(F.col("__file")), "left_semi").select("thread_id", "page", "page_url", "html")
