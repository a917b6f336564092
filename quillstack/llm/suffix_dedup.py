"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are retained at content-selected positions only: a word position is kept if its
five-word hash is the smallest of some ``KEY + 1`` consecutive ones.  So every passage of
``2 * KEY`` words holds a kept suffix whose first ``KEY`` words lie inside the passage, at
the same place in every copy.

1. Kept suffixes are ordered by the hash of their first ``KEY`` words; suffixes that are neighbours
   in that order and come from different documents match over ``KEY`` words at least.
   Each group is represented by its first and last (document, position), so a popular passage costs
   one row per occurrence and never pairs.
2. Within a document, neighbouring matches that lie on one diagonal with the same partner are
   chained: the words from the first to the end of the last are common to both documents.
3. The ends of chains are extended left and right: around a suffix that ends a chain in any document, all
   windows of ``min_words`` words over it are compared by hash.  A window that meets another
   document is a repeated passage, so the ends are exact to the word.

Chains of ``min_words`` words or more and matched windows cover exactly the words of passages of at
least ``min_words`` words that occur in another document too.  Words and windows are compared by hashes of 64 bits: a random
pair of different ones is taken for equal once in about 2**64 cases.  Sums of powers take words of up to ``FOLD`` bytes and windows of
few words only, since long periodic strings can be built to meet in such sums; longer words are hashed by XXH64.

Words are runs of characters other than ASCII white space, compared as they are.  Defined
cases: null, empty and short texts hold no passage.  Rows without an id are not
reported and keep their text.  Rows that share an id count as one document, so they never repeat each
other.  Repeats inside one document are not reported.  Empty tables give no rows.
Only the id and text columns are read; ``remove_repeats`` keeps the others as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm.batches import bounded, small_batches
from quillstack.staging import Stage

GRAM = 5
CHUNK = 1 << 18
#: Bytes of a word beyond which it is hashed by XXH64.
FOLD = 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = _inverses = np.ones(1, dtype=np.uint64)


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 to the 64th."""
    global _powers, _inverses
    if len(_powers) <= n:
        m = 1 << n.bit_length()
        _powers, _inverses = (np.cumprod(np.r_[np.uint64(1), np.full(m, x, dtype=np.uint64)], dtype=np.uint64) for x in (BASE, INVERSE))
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of values[first:last] for each range, whatever stands around it."""
    power, inverse = _up_to(len(values) + 1)
    prefix = np.r_[np.uint64(0), np.cumsum(values * power[: len(values)], dtype=np.uint64)]
    return mixed((prefix[last] - prefix[first]) * inverse[first])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word."""
    inside = np.r_[False, ~SPACE[data], False]
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and where it begins; long texts go in chunks that end between words."""
    hashes, starts, begin = [], [], 0
    while begin < len(text):
        end = begin + CHUNK
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        data = np.frombuffer(text[begin:end], dtype=np.uint8)
        first, last = word_bounds(data)
        value = spread(CODE[data], first, last)
        for i in np.flatnonzero(last - first > FOLD).tolist():
            value[i] = xxhash.xxh64_intdigest(data[first[i] : last[i]].tobytes(), 7)
        hashes.append(value)
        starts.append(first + begin)
        begin = end
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (empty.astype(np.uint64), empty)


def batch_words(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a slice, and where each text's words begin (with the end)."""
    said = [(x or "").encode() for x in batch.column(column).to_pylist()]
    hashes, starts = word_hashes(b"\n".join(said))
    at = np.cumsum([0] + [len(x) + 1 for x in said])
    return hashes, np.searchsorted(starts, at)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width] for each i with a whole window."""
    done = 1
    while 2 * done <= width:
        values, done = pick(values[:-done], values[done:]), 2 * done
    return pick(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def kept_positions(words: np.ndarray, at: np.ndarray, key: int, width: int | None = None) -> np.ndarray:
    """Positions with ``key`` words after them whose gram hash is the smallest of some ``width`` consecutive ones, ``key + 1`` by default."""
    n, top = len(words), np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.full(n, top, dtype=np.uint64)
    if n >= GRAM:
        i = np.arange(n - GRAM + 1)
        value[: n - GRAM + 1] = spread(words, i, i + GRAM) >> np.uint64(1)
    ends = np.zeros(n + 1, dtype=np.int64)
    np.add.at(ends, np.maximum(at[:-1], at[1:] - key + 1), 1)
    np.add.at(ends, at[1:], -1)
    value[np.cumsum(ends[:-1]) > 0] = top  # too near to the end of its text
    width = width or key + 1
    padded = np.r_[np.full(width - 1, top), value, np.full(width - 1, top)]
    least = _sliding(padded, width, np.minimum)
    return np.flatnonzero((_sliding(least, width, np.maximum) == value) & (value != top)) if n else np.zeros(0, dtype=np.int64)


def suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, pos) of the kept suffixes of all documents that can hold a passage; a narrow job."""
    key = min_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            words, at = batch_words(batch)
            ids = batch.column(0).to_numpy()
            pos = kept_positions(words, at, key)
            row = np.searchsorted(at, pos, side="right") - 1
            long = np.diff(at)[row] >= min_words
            pos, row = pos[long], row[long]
            yield pa.RecordBatch.from_arrays([pa.array(spread(words, pos, pos + key).view(np.int64)), pa.array(ids[row]), pa.array((pos - at[row]).astype(np.int32))], names=["key", "doc_id", "pos"])

    return docs.mapInArrow(run, "key long, doc_id long, pos int")


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(window, doc_id, start): hashes of all windows over the suffixes at ``positions``."""
    key = min_words // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            words, at = batch_words(batch)
            ids, offsets = batch.column("doc_id").to_numpy(), batch.column("positions")
            many = np.diff(offsets.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), many)
            pos = offsets.flatten().to_numpy().astype(np.int64)
            lo = at[row] + np.maximum(0, pos - (min_words - key))
            hi = at[row] + np.minimum(pos, np.diff(at)[row] - min_words) + 1
            good = lo < hi
            open_ = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(open_, lo[good], 1)
            np.add.at(open_, hi[good], -1)
            start = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
            row = np.searchsorted(at, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(spread(words, start, start + min_words).view(np.int64)), pa.array(ids[row]), pa.array((start - at[row]).astype(np.int32))], names=["window", "doc_id", "start"])

    return docs.mapInArrow(run, "window long, doc_id long, start int")


def repeated_passages(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, last_doc_id, earlier), one row per maximal run of words.

    ``earlier`` runs are made of passages that a document of smaller id holds too; the other
    runs are first occurrences.  ``first_doc_id`` and ``last_doc_id`` are the smallest and largest
    documents met along the run, the document itself included.
    """
    if min_words < 2 * GRAM or min_words % 2:
        raise ValueError(f"min_words must be even and at least {2 * GRAM}")
    small_batches(spark)
    key, stage = min_words // 2, Stage(spark, "suffixes")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    kept = stage.put("kept", suffixes(docs, min_words))

    where = F.struct("doc_id", "pos")
    groups = kept.groupBy("key").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("a.doc_id <> b.doc_id")
    groups = stage.put("groups", groups.selectExpr("key", "a.doc_id AS a_doc", "a.pos AS a_pos", "b.doc_id AS b_doc", "b.pos AS b_pos"))
    met = stage.put("met", kept.join(groups, "key"))
    stage.drop("kept")

    order = Window.partitionBy("doc_id").orderBy("pos")
    own = F.col("doc_id") == F.col("a_doc")
    sided = met.select("key", "doc_id", "pos", "a_doc", "b_doc", F.when(own, F.col("b_doc")).otherwise(F.col("a_doc")).alias("partner"), (F.when(own, F.col("b_pos")).otherwise(F.col("a_pos")) - F.col("pos")).alias("diagonal"))
    follows = (F.lag("partner").over(order) == F.col("partner")) & (F.lag("diagonal").over(order) == F.col("diagonal")) & (F.col("pos") - F.lag("pos").over(order) <= key)
    chained = sided.withColumn("begins", ~F.coalesce(follows, F.lit(False)))
    chained = chained.withColumn("chain", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ends", F.coalesce(F.lead("begins").over(order), F.lit(True)))
    chained = stage.put("chained", chained)
    whole = chained.groupBy("doc_id", "chain").agg(F.min("pos").alias("lo"), (F.max("pos") + key).alias("hi"), F.min("a_doc").alias("first"), F.max("b_doc").alias("last"), F.min("partner").alias("partner")).filter(F.col("hi") - F.col("lo") >= min_words)
    # Along a chain only its partner is known to hold all of the words.
    whole = whole.select("doc_id", "lo", "hi", F.least("doc_id", "partner").alias("first"), F.greatest("doc_id", "partner").alias("last"))

    edge = stage.put("edge", chained.filter("begins OR ends").select("key").distinct())
    spots = chained.select("key", "doc_id", "pos").join(edge, "key").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    around = stage.put("windows", windows(docs.join(spots, "doc_id").select("doc_id", "text", "positions"), min_words))
    shared = stage.put("shared", around.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last"))
    found = around.join(shared, "window").select("doc_id", F.col("start").alias("lo"), (F.col("start") + min_words).alias("hi"), "first", "last")

    parts = found.unionByName(whole).withColumn("earlier", F.col("first") < F.col("doc_id"))
    line = Window.partitionBy("doc_id", "earlier").orderBy("lo", "hi")
    apart = F.col("lo") > F.coalesce(F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = parts.withColumn("run", F.sum(apart.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("doc_id", "earlier", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first_doc_id"), F.max("last").alias("last_doc_id"))
        .select("doc_id", F.col("lo").cast("int").alias("start_word"), (F.col("hi") - F.col("lo")).cast("int").alias("n_words"), "first_doc_id", "last_doc_id", "earlier")
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, number of words) and the white space after them."""
    data = text.encode()
    _, starts = word_hashes(data)
    edges = np.r_[starts, len(data)]
    out, at = [], 0
    for first, n in sorted(spans):
        if first < len(starts):
            out.append(data[at : max(at, int(edges[first]))])
            at = max(at, int(edges[min(first + n, len(starts))]))
    return b"".join([*out, data[at:]]).decode()


def remove_repeats(spark: SparkSession, docs: DataFrame, *, min_words: int = 50, size_col: str | None = "n_chars") -> DataFrame:
    """Documents without the passages that a document of smaller id holds; columns as before.

    Only changed texts get a new ``size_col``.  A document of which no word is left goes.
    """
    stage = Stage(spark, "passages")
    cuts = repeated_passages(spark, docs, min_words=min_words).filter("earlier").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("__cuts"))
    cuts = stage.put("cuts", cuts)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: without(t or "", [(int(x["start_word"]), int(x["n_words"])) for x in s]))

    joined = docs.join(cuts, docs["doc_id"] == cuts["__id"], "left")
    changed = joined.filter("__id IS NOT NULL").withColumn("text", cut("text", "__cuts")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if size_col in docs.columns:
        changed = changed.withColumn(size_col, F.length("text").cast(docs.schema[size_col].dataType))
    same = joined.filter("__id IS NULL")
    return same.select(docs.columns).unionByName(changed.select(docs.columns))
