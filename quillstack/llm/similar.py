"""Pairs of documents whose word shingles have a high Jaccard similarity, checked exactly.

Candidates are complete.  Documents of equal shingle sets are linked to the smallest and stand as one.  All shingles have one
fixed order, frequent ones last; two sets of similarity ``s`` share one of the first
``n - ceil(s n) + 1`` shingles of either; and behind the first shingle that they share, itself included, either has at least as many as they must have in common.

1. Every such shingle points to the smallest document that holds it: a row per document.  What is similar
   enough is linked, which joins a large group of copies without its pairs.
2. Of every shingle that still joins documents of different components, pairs across components meet
   that it may be the first common one of; large groups are dealt in blocks.  The common first shingles of such a pair
   drop most of them, the others are compared by their whole shingle sets.

A candidate must have lengths and places of the shared shingle that allow the similarity, also in the first step: a long document
that quotes many short ones is compared with none of them.

The order is estimated from a part of the documents; it changes the work and never the result.

Defined cases: null and empty texts have no shingles and no links; a text of fewer words than a shingle is one shingle.  Rows without an
id are left out.  Repeated rows are one document; an id of several texts is linked if any of them is.  A similarity of exactly the
threshold links.  Very long texts are taken whole.  Empty tables give no links.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.batches import bounded
from quillstack.llm.graph import components
from quillstack.llm.suffix_dedup import mixed, spread, word_hashes
from quillstack.staging import Stage

#: Share of the documents that tell which shingles are frequent, from how many of them on, and the largest number of such shingles.
SAMPLE, FREQUENT, MOST = 8, 4, 1 << 19
#: Rows of a block of a large group.
BLOCK = 256
EPSILON = 1e-9


def lowered_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with A to Z lower-cased, and where each text's words begin (with the end)."""
    said = [(x or "").encode().lower() for x in column.to_pylist()]
    hashes, starts = word_hashes(b"\n".join(said))
    return hashes, np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in said]))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Different shingle hashes of one text; of a shorter text the whole, of an empty one none."""
    if not len(words):
        return words
    first = np.arange(max(1, len(words) - n + 1))
    return np.unique(spread(words, first, np.minimum(first + n, len(words))))


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all different shingles of a slice, ordered by both."""
    words, at = lowered_words(batch.column("text"))
    size = np.diff(at)
    many = np.where(size > 0, np.maximum(1, size - n + 1), 0)
    row = np.repeat(np.arange(len(size)), many)
    first = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    value = spread(words, first, np.minimum(first + n, at[1:][row])) if len(row) else words[:0]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])][: len(row)]
    return row[new], value[new]


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k1, k2): 128 bits that name the shingle set of every document that has shingles; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            row, value = _sets(batch, words)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            keys = [np.add.reduceat(mixed(value ^ np.uint64(salt)), first) if len(first) else value for salt in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[first]))] + [pa.array(k.view(np.int64)) for k in keys], names=["doc_id", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long")


def frequent(stage: Stage, docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ordered by hash, and the class (2 to the power of) of their frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_sets(batch, words)[1].view(np.int64))], names=["shingle"])

    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "shingle long")
    found = stage.put("frequent", part.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).select("shingle", F.floor(F.log2("n")).cast("int").alias("class")))
    least, total = 99, 0
    for x in sorted(found.groupBy("class").count().collect(), reverse=True):
        total += x["count"]
        if total > MOST:
            break
        least = x["class"]
    table = found.filter(F.col("class") >= least).toArrow()
    value, kind = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(value)
    return value[order], kind[order].astype(np.int8)


def prefixes(docs: DataFrame, words: int, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, doc_id, n, rest): the first shingles of every document, the size of its set and how much of it begins there; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            row, value = _sets(batch, words)
            kind = np.zeros(len(value), dtype=np.int8)
            if len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], value), len(hot[0]) - 1)
                kind = np.where(hot[0][at] == value, hot[1][at], 0)
            order = np.lexsort((value, kind, row))
            row, value = row[order], value[order]
            n = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            keep = place < (n - np.ceil(similarity * n - EPSILON) + 1)[row]
            row, value, rest = row[keep], value[keep], (n[row] - place)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column("doc_id").take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(rest.astype(np.int32))], names=["shingle", "doc_id", "n", "rest"])

    return docs.mapInArrow(run, "shingle long, doc_id long, n int, rest int")


def both_of(similarity: float) -> float:
    """The share of two equally large sets that they have in common."""
    return 2 * similarity / (1 + similarity)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of all documents; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            row, value = _sets(batch, words)
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def across(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b, na, nb), once each, of documents of different components that may be similar by a shingle they share, from (shingle, doc_id, n, rest, component).

    A shingle's main component is that of its smallest document: documents of others meet all documents.
    """
    groups = rows.groupBy("shingle").agg(F.min_by("component", "doc_id").alias("main"), F.count(F.lit(1)).alias("all"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed_rows = rows.join(groups.filter("low <> high").drop("low", "high"), "shingle")
    others = mixed_rows.filter("component <> main").groupBy("shingle").agg(F.count(F.lit(1)).alias("others"))
    dealt = mixed_rows.join(others, "shingle")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.hash("doc_id"), blocks(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    left = dealt.filter("component <> main").select("shingle", own("others").alias("x"), every("all").alias("y"), F.col("doc_id").alias("p"), F.col("n").alias("np"), F.col("rest").alias("rp"), F.col("component").alias("cp"))
    right = dealt.select("shingle", every("others").alias("x"), own("all").alias("y"), F.col("doc_id").alias("q"), F.col("n").alias("nq"), F.col("rest").alias("rq"), F.col("component").alias("cq"), (F.col("component") == F.col("main")).alias("at_main"))
    met = left.join(right, ["shingle", "x", "y"]).filter("cp <> cq AND (at_main OR p > q)").filter(F.least("rp", "rq") >= common_of(similarity, "np", "nq"))
    turned = F.col("p") > F.col("q")
    return met.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"), F.when(turned, F.col("np")).otherwise(F.col("nq")).alias("na"), F.when(turned, F.col("nq")).otherwise(F.col("np")).alias("nb")).distinct()


def common_of(similarity: float, a: str = "na", b: str = "nb") -> Column:
    """Shingles that two documents of so many must have in common."""
    return F.ceil(F.lit(both_of(similarity) / 2) * (F.col(a) + F.col(b)) - EPSILON)


def likely(stage: Stage, pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those pairs whose common first shingles, all of them, allow the similarity.

    Common shingles that are not first ones of both stand behind the first ones of one of them.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    firsts = stage.put("firsts", rows.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("shingle").alias("firsts")))
    both = pairs.join(firsts.select(F.col("doc_id").alias("a"), F.col("firsts").alias("x")), "a").join(firsts.select(F.col("doc_id").alias("b"), F.col("firsts").alias("y")), "b")
    rest = F.greatest(*(F.ceil(F.lit(similarity) * F.col(c) - EPSILON) for c in ("na", "nb"))) - 1
    return both.filter(F.size(F.array_intersect("x", "y")) + rest >= common_of(similarity)).select("a", "b").distinct()


def compared(stage: Stage, pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of those pairs whose shingle sets, made once for each document, have the similarity."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stage.put("sets", shingle_sets(docs.join(needed, "doc_id").select("doc_id", "text"), words))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    met = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    links = stage.put("links", met.filter(F.col("common") / F.greatest(F.lit(1), F.col("total") - F.col("common")) >= similarity).select("a", "b").distinct())
    stage.drop("sets")
    return links


def similar_pairs(stage: Stage, docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b), b the smaller id: links of at least that similarity that join all documents which such links can join."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    keys = stage.put("keys", set_keys(docs, words))
    least = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("b"))
    named = stage.put("named", keys.join(least, ["k1", "k2"]).select(F.col("doc_id").alias("a"), "b"))
    equal = named.filter("a <> b").distinct()
    # An id of several texts stands for itself unless all of them are copies.
    copies = stage.put("copies", named.groupBy(F.col("a").alias("doc_id")).agg(F.bool_and(F.col("a") != F.col("b")).alias("copy")).filter("copy").select("doc_id"))
    single = docs.join(copies, "doc_id", "left_anti")
    made = stage.put("prefixes", prefixes(single, words, similarity, frequent(stage, single, words)))
    stage.drop("keys", "frequent")
    shared = made.groupBy("shingle").agg(F.min(F.struct("doc_id", "n", "rest")).alias("least"), F.max("doc_id").alias("last")).filter("least.doc_id <> last")
    rows = stage.put("rows", made.join(shared.select("shingle", F.col("least.doc_id").alias("b"), F.col("least.n").alias("nb"), F.col("least.rest").alias("rb")), "shingle"))
    stage.drop("prefixes")
    possible = F.least("rest", "rb") >= common_of(similarity, "n", "nb")
    star = rows.filter("doc_id <> b").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("same"), F.max("n").alias("n"), F.bool_or(possible).alias("possible"))
    # Here a share is enough to try: what is left out is met below.
    tried = stage.put("tried", star.filter("possible").filter(F.col("same") >= F.col("n") * (both_of(similarity) - similarity)).select("a", "b"))
    first = compared(stage, tried, single, words, similarity)
    joined = components(stage, first).select(F.col("node").alias("doc_id"), "component")
    labelled = stage.put("labelled", rows.join(joined, "doc_id", "left").select("shingle", "doc_id", "n", "rest", F.coalesce("component", "doc_id").alias("component")))
    stage.drop("rows")
    met = stage.put("met", across(labelled, similarity).join(tried, ["a", "b"], "left_anti"))
    left = stage.put("left", likely(stage, met, labelled, similarity))
    stage.drop("labelled", "met", "firsts")
    return equal.unionByName(first).unionByName(compared(stage, left, single, words, similarity))
