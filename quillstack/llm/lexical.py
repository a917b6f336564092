"""Ranked lexical search by dense blocked products of item weights and document impacts.

1. Every document becomes its number of terms and the frequencies of those terms that some item asks for (the compact
   vocabulary); that table is staged, and the numbers of documents, terms and documents of each term are sums over it.
2. A task takes the documents in tiles.  A tile's impacts are a dense matrix over a tile of the vocabulary, the items' weights
   another, both of whole numbers in float64.  A vocabulary tile ends where an item's partial sum could reach 2**53, so each product
   of the two is exact in whatever order it is summed; products of further vocabulary tiles are added as 64-bit integers.
3. Of a tile an item keeps all scores that are not below its ``k``-th one, ties included, and then the ``k`` first by score and id.
   Tasks return ``k`` rows an item, which meet in two steps.

Items are asked in groups of a bounded number of (item, term) entries: a group's vocabulary and weights are what the driver and the
workers hold.  Documents are read once for each group.

Defined cases: null and empty texts have no term, count in no sum and are never found.  Rows without an id are left out.  Every row is a document:
repeated rows are ranked each.  Rows of one item id are one item (equal rows once), its terms those of all of them; items without an id, without terms
or without a document of positive score give no rows.  Equal scores go to the smaller id.  Empty tables give no rows.  Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm.batches import bounded, release, small_batches
from quillstack.llm.suffix_dedup import word_hashes
from quillstack.llm.terms import LOWER, PATTERN, UPPER, spaced
from quillstack.llm.tokens import _ranges
from quillstack.staging import Stage

#: (item, term) entries and items of a group, documents and terms of a tile, salted parts of the last ranking.
ENTRIES, ITEMS, DOCS, WIDTH, PARTS = 1 << 20, 4096, 1024, 2048, 32
#: No impact is larger: 10**9 tf div (1000 tf + 12 m).
IMPACT = 1_000_000
EXACT = 1 << 53


@dataclass
class Vocabulary:
    """Different terms in order of their hashes."""

    hashes: np.ndarray
    letters: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> tuple[Vocabulary, np.ndarray]:
        """A vocabulary and the place of each term in it."""
        coded = [t.encode() for t in terms]
        hashes = word_hashes(b" ".join(coded))[0]
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        coded = [coded[i] for i in order.tolist()]
        return cls(hashes[order], np.frombuffer(b"".join(coded), dtype=np.uint8), np.cumsum([0] + [len(t) for t in coded])), place

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of every word, positions among them of the words that are terms, their places here); letters are compared."""
        hashes, starts = word_hashes(data)
        if not len(hashes) or not len(self.hashes):
            return starts, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        which = np.flatnonzero(self.hashes[place] == hashes)
        found, text = [], np.frombuffer(data + b" " * int(np.diff(self.begin).max() + 1), dtype=np.uint8)
        # Terms of one hash stand side by side; the letters tell which one it is.
        place = place[which]
        while len(which):
            size = self.begin[place + 1] - self.begin[place]
            own, upto = _ranges(starts[which], size)
            wrong = text[own] != self.letters[own + np.repeat(self.begin[place] - starts[which], size)]
            same = text[starts[which] + size] == 0x20
            same[np.searchsorted(upto, np.flatnonzero(wrong), side="right")] = False
            found.append((which[same], place[same]))
            again = ~same & (place + 1 < len(self.hashes))
            which, place = which[again], place[again] + 1
            more = self.hashes[place] == self.hashes[place - 1]
            which, place = which[more], place[more]
        return starts, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def frequencies(docs: DataFrame, vocabulary: object) -> DataFrame:
    """(doc_id, n, terms, times): terms of each document in all, and those of the vocabulary with their frequencies; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in bounded(batches):
            said = [spaced(t) for t in batch.column("text").to_pylist()]
            at = np.cumsum([0] + [len(x) + 1 for x in said])
            starts, which, place = known.find(b" ".join(said))
            row = np.searchsorted(at, starts, side="right") - 1
            n = np.bincount(row, minlength=len(said))
            key, times = np.unique(row[which] * len(known.hashes) + place, return_counts=True)
            row, term = np.divmod(key, max(1, len(known.hashes)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(said) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


@dataclass
class Tile:
    """Weights of the items over the terms from ``first`` to before ``end``, as entries."""

    first: int
    end: int
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def dense(self, items: int) -> np.ndarray:
        out = np.zeros((items, self.end - self.first))
        out[self.item, self.term - self.first] = self.weight
        return out


def vocabulary_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int = WIDTH) -> list[Tile]:
    """Tiles of at most ``width`` terms in which every item's sum of weight times the largest impact stays below 2**53.

    A weight too large for any sum is cut into parts, which stand in tiles of their own.
    """
    most = (EXACT - 1) // IMPACT
    order = np.argsort(term, kind="stable")
    item, term, weight = item[order], term[order], weight[order]
    begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
    sums, parts, tiles = np.zeros(item.max(initial=-1) + 1, dtype=np.int64), [], []

    def close() -> None:
        if parts:
            i, t, w = map(np.concatenate, zip(*parts))
            tiles.append(Tile(int(t[0]), int(t[-1]) + 1, i, t, w.astype(np.float64)))
            parts.clear()
            sums[:] = 0

    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(term)]):
        who, rest = item[a:b], weight[a:b].copy()
        while len(who):
            part = np.minimum(rest, most)
            if parts and (term[a] - parts[0][1][0] >= width or (sums[who] + part > most).any()):
                close()
            parts.append((who, np.full(len(who), term[a]), part))
            sums[who] += part
            rest = rest - part
            who, rest = who[rest > 0], rest[rest > 0]
    close()
    return tiles


def best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first entries of each item by score, then id; ordered so."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)])
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return item[rank < k], score[rank < k], doc[rank < k]


def tile_scores(tiles: list[Tile], items: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
    """Exact scores (items x rows) of a tile of documents, whose entries are ordered by term."""
    total = np.zeros((items, rows), dtype=np.int64)
    for tile in tiles:
        a, b = np.searchsorted(term, [tile.first, tile.end])
        if a < b:
            dense = np.zeros((tile.end - tile.first, rows))
            dense[term[a:b] - tile.first, row[a:b]] = impact[a:b]
            total += (tile.dense(items) @ dense).astype(np.int64)
    return total


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20, entries: int = ENTRIES, width: int = WIDTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest positive scores for each item."""
    small_batches(spark)
    stage = Stage(spark, "lexical")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    kind = items.schema[item_col].dataType
    said = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("item_id IS NOT NULL").dropDuplicates(["item_id", "text"])
    asked = stage.put("asked", said.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({PATTERN})"), F.lit(1))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    there = asked.agg(F.count(F.lit(1)), F.count_distinct("item_id")).first()
    groups = max(1, -(-there[0] // entries), -(-there[1] // ITEMS))
    found = [_search_group(spark, stage, docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), kind, k, width) for g in range(groups)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id")]
    salted = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_group(spark: SparkSession, stage: Stage, docs: DataFrame, asked: DataFrame, kind, k: int, width: int) -> DataFrame:
    """(item_id, doc_id, score) of the best rows of every task, for the items of one group."""
    rows = asked.toArrow()
    ids = rows.column("item_id").combine_chunks().dictionary_encode()
    words = rows.column("term").combine_chunks().dictionary_encode()
    vocabulary, place = Vocabulary.of(words.dictionary.to_pylist())
    sparse = (ids.indices.to_numpy(), place[words.indices.to_numpy()] if len(place) else np.zeros(0, dtype=np.int64), rows.column("times").to_numpy())
    names, n_terms = ids.dictionary, len(vocabulary.hashes)
    postings = stage.put("postings", frequencies(docs, spark.sparkContext.broadcast(vocabulary)))
    n_docs, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, dtype=np.int64)
    for x in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[x.term] = x["count"]
    w = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    held = spark.sparkContext.broadcast((sparse, w, names))
    result = f"item_id {kind.simpleString()}, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (item, term, times), w, names = held.value
        tiles = vocabulary_tiles(item, term, times * w[term], width)
        kept = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        least = np.ones(len(names), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, DOCS):
                part = batch.slice(a, DOCS)
                doc, n, lists, tf = part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2), part.column(3).flatten().to_numpy().astype(np.int64)
                own = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(doc)), np.diff(lists.offsets.to_numpy()))
                # Exact in Python's integers: the product of lengths may pass 64 bits on a very large corpus.
                m = np.array([75 + 25 * x * n_docs // length for x in n], dtype=np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
                order = np.argsort(own, kind="stable")
                score = tile_scores(tiles, len(names), row[order], own[order], impact[order], len(doc))
                bar = np.maximum(least, np.partition(score, -k, axis=1)[:, -k]) if len(doc) > k else least
                at, column = np.nonzero(score >= bar[:, None])
                kept = best(*(np.concatenate([x, y]) for x, y in zip(kept, (at, score[at, column], doc[column]))), k)
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(names)) == k)
                least[full] = kept[1][np.searchsorted(kept[0], full, side="right") - 1]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(kept[0])), pa.array(kept[2]), pa.array(kept[1])], names=["item_id", "doc_id", "score"])
        release()

    return stage.put("found", postings.filter(F.size("terms") > 0).mapInArrow(run, result))


def oracle_sql() -> str:
    """The same ranking, for DuckDB over documents and benchmark."""
    terms = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}'))"
    return f"""
    WITH said AS (SELECT doc_id, {terms} AS term FROM documents WHERE doc_id IS NOT NULL),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
    n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
    m AS (SELECT doc_id, 75 + (25 * n * docs) // length AS m FROM n, total),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
    scored AS (
        SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
        FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY ALL
    )
    SELECT item_id, rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
    ) WHERE rank <= 20
    """
