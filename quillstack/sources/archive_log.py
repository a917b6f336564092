"""A post archive that is added to in steps: appended batches over a merged base, merged when read.

    <path>/base/upto=<n>     all posts of the batches up to n, merged, partitioned by thread bucket
    <path>/batch/no=<n>-<token>   the posts of one batch, sorted by bucket

Adding a batch writes that batch and nothing else, whatever the archive holds.  A reader takes the base as it is and adds the later
batches' posts that nothing before them holds; the base gives only key columns of the touched buckets for that and is never shuffled
unless the batches have grown large.  ``compact`` merges base and batches to a new base.  Spark's own commits make both safe: a folder counts once its
``_SUCCESS`` file is there.  One writer at a time is assumed; readers may run beside it.

What counts as held is as in ``merge``: an earlier batch's post with the same id in the thread, or without an id one that agrees in id, url, page and number, wins.

Defined cases: an archive without batches has no posts; a batch written again under its token replaces itself; an empty batch adds nothing; posts without a
thread are kept under a bucket of their own; columns that a batch lacks are null.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.text import filled
from quillstack.operators.merge import first_by, merge_key
from quillstack.schemas import POSTS
from quillstack.staging import Stage

BUCKETS = 64
#: Keys of later batches that are sent to every task of the base's scan.
FEW_KEYS = 500_000
#: Bytes of later batches, as a share of the base's, from which ``compact_if_due`` merges.
DUE = 0.5


def post_key() -> Column:
    """One key a post: its id in the thread, or without one all that tells it apart."""
    named = filled(F.col("post_id")) != ""
    other = F.concat_ws("\u0001", filled(F.col("post_url")), F.coalesce(F.col("page"), F.lit(0)).cast("string"), filled(F.col("post_number")))
    return F.struct(F.coalesce("thread_id", F.lit("\u0001")).alias("t"), F.when(named, F.concat(F.lit("i"), F.col("post_id"))).otherwise(F.concat(F.lit("o"), other)).alias("k"))


class ArchiveLog:
    """Appends to, reads and compacts the archive at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------ folders

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _committed(self, kind: str) -> list[str]:
        """Names of finished folders, oldest first."""
        fs, where = self._folder(f"{self.path}/{kind}")
        if not fs.exists(where):
            return []
        done = lambda f: fs.exists(self._folder(f"{f.getPath().toString()}/_SUCCESS")[1])
        return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory() and done(f))

    def _base(self) -> tuple[int, str | None]:
        """Last batch that the newest base holds, and the base's name."""
        names = self._committed("base")
        return (int(names[-1].partition("=")[2]), names[-1]) if names else (0, None)

    def _batches(self) -> list[tuple[int, str]]:
        """(number, name) of the batches after the base."""
        upto = self._base()[0]
        return [(n, name) for name in self._committed("batch") for n in [int(name.partition("=")[2].partition("-")[0])] if n > upto]

    def size(self, kind: str) -> int:
        """Bytes of the newest base, or of all later batches."""
        names = [n for n in [self._base()[1]] if n] if kind == "base" else [name for _, name in self._batches()]
        total = 0
        for name in names:
            fs, where = self._folder(f"{self.path}/{kind}/{name}")
            total += fs.getContentSummary(where).getLength()
        return total

    # ------------------------------------------------------------ rows

    def _bucketed(self, posts: DataFrame) -> DataFrame:
        return posts.withColumn("thread_bucket", F.pmod(F.xxhash64("thread_id"), F.lit(self.buckets)).cast("int"))

    def append(self, posts: DataFrame, token: str | None = None) -> str:
        """Writes one batch without raw HTML; posts of one batch that are the same stay once.  A token that was used before replaces its batch."""
        token = (token or uuid.uuid4().hex).replace("/", "_")
        names = self._committed("batch")
        own = [n for n in names if n.partition("-")[2] == token]
        last = max([self._base()[0], *(int(n.partition("=")[2].partition("-")[0]) for n in names)])
        name = own[0] if own else f"no={last + 1:09d}-{token}"
        public = posts.drop("raw_html", "thread_bucket")
        once = first_by(public, merge_key(), F.xxhash64(*public.columns))
        self._bucketed(once).sortWithinPartitions("thread_bucket", "thread_id").write.mode("overwrite").parquet(f"{self.path}/batch/{name}")
        return name

    def _later(self, batches: list[tuple[int, str]]) -> DataFrame:
        """Posts of the batches after the base that no earlier one of them holds."""
        parts = [self.spark.read.parquet(f"{self.path}/batch/{name}").withColumn("__no", F.lit(n)) for n, name in batches]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        columns = [c for c in rows.columns if c != "__no"]
        once = first_by(rows, merge_key(), F.struct("__no", F.xxhash64(*columns)))
        if len(batches) == 1:
            return once.select(columns)
        # Of an id only the rows of its first batch count.  Posts without an id are kept out of that join: as one key they would meet in one task.
        named = filled(F.col("post_id")) != ""
        first = rows.filter(named).groupBy(F.col("thread_id").alias("__t"), F.col("post_id").alias("__p")).agg(F.min("__no").alias("__first"))
        kept = once.filter(named).join(first, F.col("thread_id").eqNullSafe(F.col("__t")) & (F.col("post_id") == F.col("__p")) & (F.col("__no") == F.col("__first")), "left_semi")
        return kept.select(columns).unionByName(once.filter(~named).select(columns))

    def read(self) -> DataFrame:
        """All posts, with ``thread_bucket``."""
        base, batches = self._base()[1], self._batches()
        stored = self.spark.read.parquet(f"{self.path}/base/{base}") if base else None
        if not batches:
            return stored if stored is not None else self._bucketed(self.spark.createDataFrame([], POSTS))
        later = self._later(batches)
        if stored is None:
            return later
        return stored.unionByName(self._not_in(later, stored, batches), allowMissingColumns=True)

    def _not_in(self, later: DataFrame, stored: DataFrame, batches: list[tuple[int, str]]) -> DataFrame:
        """Posts of later batches that the base does not hold."""
        raw = reduce(lambda a, b: a.unionByName(b), (self.spark.read.parquet(f"{self.path}/batch/{name}").select("thread_id", "post_id", "post_url", "page", "post_number", "thread_bucket") for _, name in batches))
        return self._unheld(later, raw, stored)

    def _unheld(self, rows: DataFrame, asked: DataFrame, stored: DataFrame) -> DataFrame:
        """``rows`` whose key ``stored`` does not hold; ``asked`` has at least their keys and is cheap to read."""
        key = post_key()
        touched = [r[0] for r in asked.select("thread_bucket").distinct().collect()]  # at most the number of buckets
        held = stored.filter(F.col("thread_bucket").isin(touched)).select(key.alias("__key"))
        if asked.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
            # Few keys visit the base where it lies; what they meet is no more than they are.
            held = held.join(F.broadcast(asked.select(key.alias("__asked")).distinct()), F.col("__key") == F.col("__asked"), "left_semi").distinct()
        columns = rows.columns
        return rows.withColumn("__own", key).join(held, F.col("__own") == F.col("__key"), "left_anti").select(columns)

    def append_new(self, posts: DataFrame, token: str | None = None) -> DataFrame:
        """Like ``append``, but writes only posts that the archive does not hold, once each, and returns these.  Of one batch the first by content stays."""
        token = (token or uuid.uuid4().hex).replace("/", "_")
        once = self._bucketed(first_by(posts.drop("raw_html", "thread_bucket"), [post_key().alias("__k")], F.xxhash64(*[c for c in posts.columns if c not in ("raw_html", "thread_bucket")])))
        once = Stage(self.spark, "new").put("batch", once)
        keys = ["thread_id", "post_id", "post_url", "page", "post_number", "thread_bucket"]
        base = self._base()[1]
        earlier = [f"{self.path}/base/{base}"] if base else []
        earlier += [f"{self.path}/batch/{name}" for _, name in self._batches() if name.partition("-")[2] != token]
        fresh = once
        if earlier:
            fresh = self._unheld(once, once, reduce(lambda a, b: a.unionByName(b), (self.spark.read.parquet(p).select(keys) for p in earlier)))
        name = self.append(fresh, token)
        return self.spark.read.schema(once.schema).parquet(f"{self.path}/batch/{name}")

    # ------------------------------------------------------------ merging

    def compact(self) -> str | None:
        """Writes a new base of all that is there, by thread bucket; earlier folders stay until ``clean``."""
        batches = self._batches()
        if not batches:
            return self._base()[1]
        name = f"upto={batches[-1][0]:09d}"
        spread = F.pmod(F.xxhash64("post_id"), F.lit(8))
        rows = self.read().repartition("thread_bucket", spread).sortWithinPartitions("thread_bucket", "thread_id")
        rows.write.mode("overwrite").partitionBy("thread_bucket").parquet(f"{self.path}/base/{name}")
        return name

    def compact_if_due(self, share: float = DUE) -> bool:
        """Compacts when the later batches have grown to ``share`` of the base, so that a post is rewritten a bounded number of times for each doubling."""
        if not self._batches() or self.size("batch") < share * self.size("base"):
            return False
        self.compact()
        return True

    def clean(self) -> None:
        """Deletes bases before the newest one and the batches that it holds; for times when no reader uses them."""
        upto, base = self._base()
        for name in self._committed("base"):
            if name != base:
                fs, where = self._folder(f"{self.path}/base/{name}")
                fs.delete(where, True)
        for name in self._committed("batch"):
            if int(name.partition("=")[2].partition("-")[0]) <= upto:
                fs, where = self._folder(f"{self.path}/batch/{name}")
                fs.delete(where, True)
