"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into two blocks of 32 bits.  Fingerprints that differ in at most three
bits differ in at most one bit of some block.  The anchors of a block are the words of the
perfect Hamming code of length 31 beside one free bit: every block value lies within one bit
of exactly one anchor, its home.  Each fingerprint also visits all anchors within two bits,
that is, within the covering radius plus the block's threshold.  So a linked pair meets at the
home of either, where full fingerprints are compared.  An anchor has 27 bits, and a
fingerprint makes at most 34 rows, however many documents share it.

An anchor with very many fingerprints is dealt out as a grid of home chunks by visitor
chunks: every pair still meets in exactly one cell, and no task holds more than a cell.
Tasks emit a spanning forest of the links they find, never all pairs of a group.

Defined cases: a null text is an empty one; an empty text has fingerprint zero and is linked like any other.
Repeated rows are kept; rows without an id get the component of their fingerprint's other rows, else null.
An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.batches import bounded, small_batches, texts
from quillstack.llm.graph import components, forest
from quillstack.llm.similar import similar_pairs
from quillstack.staging import Stage

#: Homes and rows of one cell of an anchor's grid.
HOMES, VISITORS = 4096, 16384
#: Shingles of a text that are hashed at a time.
CHUNK = 1 << 16
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """Bit i is set if it is set in over half the shingle hashes, which are taken ``CHUNK`` at a time."""
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = iter([b" ".join(w)]) if len(w) < words else map(b" ".join, zip(*(islice(w, i, None) for i in range(words))))
    counts, n = np.zeros(64, dtype=np.int64), max(1, len(w) - words + 1)
    for begin in range(0, n, CHUNK):
        size = min(CHUNK, n - begin)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, size), repeat(SEED)), dtype=np.uint64, count=size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, print) with the fingerprint as a signed long; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            prints = np.array([fingerprint(t, words) for t in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, print long")


def _flips() -> np.ndarray:
    """For each syndrome, what to flip to reach each anchor within two bits; the home is first."""
    free = 1 << 31
    rows = [[0, free] + [0] * 15]
    for s in range(1, 32):
        home = 1 << (s - 1)
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i != s and i < i ^ s]
        rows.append([home, home | free, *pairs])
    return np.array(rows, dtype=np.uint32)


FLIPS = _flips()
CHECKS = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) for j in range(5)]


def anchors_of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, visitor) of all anchors within two bits of each 32-bit value."""
    syndrome = np.zeros(len(block), dtype=np.int64)
    for j, mask in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(block & mask) & 1).astype(np.int64) << j
    near = block[:, None] ^ FLIPS[syndrome]
    valid = np.ones(near.shape, dtype=bool)
    valid[syndrome == 0, 2:] = False
    visitor = np.ones(near.shape, dtype=bool)
    visitor[:, 0] = False
    return np.nonzero(valid)[0], near[valid], visitor[valid]


def _meetings(nodes: DataFrame) -> DataFrame:
    """(anchor, visitor, print, node): every fingerprint at its two homes and at the anchors it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            value = prints.view(np.uint64)
            for k in (0, 1):
                row, anchor, visitor = anchors_of((value >> np.uint64(32 * k)).astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | (k << 32)), pa.array(visitor), pa.array(prints[row]), pa.array(ids[row])], names=["anchor", "visitor", "print", "node"])

    return nodes.select("print", "node").mapInArrow(run, "anchor long, visitor boolean, print long, node long")


def _linked(key: np.ndarray, home: np.ndarray, value: np.ndarray, node: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between a home and any other row of its group; rows are sorted by key, homes first."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(key)]
    homes = np.add.reduceat(home.astype(np.int64), start)
    use = (homes > 0) & (end - start > 1)
    start, end, homes = start[use], end[use], homes[use]
    found = []
    big = end - start > 256
    for s, e, n in zip(start[big].tolist(), end[big].tolist(), homes[big].tolist()):
        pairs = []
        for i in range(s, s + n):
            hit = np.flatnonzero(np.bitwise_count(value[i + 1 : e] ^ value[i]) <= bits)
            if len(hit):
                pairs.append((np.full(len(hit), node[i]), node[i + 1 + hit]))
        if pairs:
            found.append(forest(*map(np.concatenate, zip(*pairs))))
    start, end, homes = start[~big], end[~big], homes[~big]
    h = 0
    while len(start):
        size = end - start - h - 1
        left = np.repeat(start + h, size)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.bitwise_count(value[left] ^ value[right]) <= bits
        if hit.any():
            found.append((node[left[hit]], node[right[hit]]))
        h += 1
        more = homes > h
        start, end, homes = start[more], end[more], homes[more]
    return found


def links(stage: Stage, nodes: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links that join all nodes whose prints differ in at most ``bits`` (up to three) bits."""
    met = stage.put("met", _meetings(nodes))
    heavy = met.groupBy("anchor").agg(F.count_if(~F.col("visitor")).alias("homes"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > VISITORS) | (F.col("homes") > HOMES))
    heavy = stage.put("heavy", heavy.select("anchor", F.ceil(F.col("homes") / HOMES).cast("int").alias("rows"), F.ceil(F.col("n") / VISITORS).cast("int").alias("columns")))
    # A home is compared with the visitors of all columns of its row; it also stands in its own column, as one that is visited.
    one, n_rows, n_columns = F.lit(0), F.coalesce("rows", F.lit(1)), F.coalesce("columns", F.lit(1))
    row, column = F.pmod(F.xxhash64("print"), n_rows).cast("int"), F.pmod(F.hash("print"), n_columns).cast("int")
    as_home = F.transform(F.sequence(one, n_columns - 1), lambda c: F.struct(row.alias("row"), c.alias("column"), F.lit(True).alias("home")))
    as_guest = F.transform(F.sequence(one, n_rows - 1), lambda r: F.struct(r.alias("row"), column.alias("column"), F.lit(False).alias("home")))
    cells = F.when(F.col("visitor"), as_guest).when((n_rows == 1) & (n_columns == 1), as_home).otherwise(F.concat(as_home, as_guest))
    dealt = met.join(heavy, "anchor", "left").select("anchor", "print", "node", F.explode(cells).alias("cell")).select("anchor", "cell.row", "cell.column", "cell.home", "print", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rest: list[np.ndarray] | None = None

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held and (final or sum(len(x) for x, _ in held) > 500_000):
                held = [forest(*map(np.concatenate, zip(*held)))]
                if final:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])

        for batch in batches:
            anchor, row, column, home, value, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            new = [anchor, row, column, home, value.view(np.uint64), node]
            new = [np.concatenate(x) for x in zip(rest, new)] if rest else new
            same = (new[0] == new[0][-1]) & (new[1] == new[1][-1]) & (new[2] == new[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest, now = [x[cut:] for x in new], [x[:cut] for x in new]
            if cut:
                held += _linked(_group(*now[:3]), *now[3:], bits)
                yield from out(False)
        if rest:
            held += _linked(_group(*rest[:3]), *rest[3:], bits)
        yield from out(True)

    ordered = dealt.repartition("anchor", "row", "column").sortWithinPartitions("anchor", "row", "column", F.col("home").desc())
    return ordered.mapInArrow(run, "a long, b long")


def _group(anchor: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """A number for each run of equal keys."""
    change = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    return np.r_[0, np.cumsum(change)]


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    The component is named by its smallest id; every document reaches itself.
    """
    small_batches(spark)
    stage = Stage(spark, "simhash")
    prints = stage.put("prints", fingerprints(docs, id_col, text_col, words))
    nodes = stage.put("nodes", prints.groupBy("print").agg(F.min("doc_id").alias("node")))
    found = components(stage, links(stage, nodes.filter("node is not null"), bits))
    named = stage.put("named", nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")))
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, *, words: int = 5, similarity: float = 0.8, print_words: int = 3, bits: int = 3) -> DataFrame:
    """Documents without all but the smallest id of every group of near-duplicates; columns unchanged.

    Two documents are linked by fingerprints of ``print_words``-word shingles that differ in at most ``bits`` bits, or by
    a Jaccard similarity of their ``words``-word shingles of at least ``similarity``: a few edits of a short
    text move more than three bits, so fingerprints alone would leave such copies.

    Null and empty texts have fingerprint zero: of all of them one stays.  Rows without an id stay.  Repeated rows of an id that
    stays all stay.  Empty tables give no rows.
    """
    small_batches(spark)
    stage = Stage(spark, "keep-one")
    prints = stage.put("prints", fingerprints(docs, words=print_words).filter("doc_id IS NOT NULL"))
    nodes = stage.put("nodes", prints.groupBy("print").agg(F.min("doc_id").alias("node")))
    equal = prints.join(nodes, "print").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = equal.unionByName(links(stage, nodes, bits)).unionByName(similar_pairs(stage, docs, words=words, similarity=similarity))
    gone = components(stage, stage.put("found", found)).filter("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(stage.put("gone", gone), "doc_id", "left_anti").select(docs.columns)
