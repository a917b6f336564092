"""Nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Vectors are dealt by their length, in bands of a factor of about 1.4, and by a hash of their id to shards of about ``shard_rows``;
so no shard is hot, and within a shard the order by inner product is close to the order by angle.  Neighbouring bands of few vectors share a shard.
In each shard equal vectors are one node (which keeps the ids that could ever be reported), and nodes are linked by angle as follows: a node's
neighbours are proposed by a greedy search for it through the graph of the nodes before it, thinned so that a candidate stays only if no
kept neighbour is closer to it by a relaxed factor, and linked back; over-full nodes are thinned again.
A search goes by inner product, from the first node and the longest ones.

What a beam finds depends on the data, so each shard measures it: a sample of at most ``TRIED`` queries is searched and compared with all products of the shard,
with wider beams until ``RECALL`` of the ``k`` best are found.  A shard in which none of ``BEAMS`` reaches that, or of few vectors, is scanned exactly, in blocks.
A built graph is one row of a staged table.

Queries are dealt in blocks of up to ``BLOCK_ROWS`` to every shard (a stated query set against all rows, in blocks); a graph travels once per block; a
beam search runs all queries of a block in step.  What it finds is scored exactly, in double precision on the
original vectors, and the shards' lists are merged.

Defined cases: null, empty and zero vectors and those with null or non-finite components take no part, nor
do vectors whose length differs from the most frequent one.  Ties go to the smaller id, also among equal
vectors.  A repeated (id, vector) row counts once; null ids take no part.  With fewer than ``k`` candidates all
are returned.  Empty tables give no rows.  Only the id and vector columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.staging import Stage

#: Links kept by thinning, beam of building, relaxation.
DEGREE, BEAM, ALPHA = 24, 48, 1.2
#: Beams of searching, the share of the nearest that one must find, queries that measure it at most, long nodes to start from.
BEAMS, RECALL, TRIED, LONG = (128, 192, 256, 384, 512), 0.97, 128, 8
#: Vectors of a shard; queries of a block at most, and at least while there are too few pairs of blocks and shards to keep all cores busy.
SHARD_ROWS, BLOCK_ROWS, FEW_ROWS = 16384, 16384, 1024
#: Length of the longest vector of a band over that of the shortest, as a power of two; vectors of a shard up to which it is scanned.
BAND, SMALL = 0.5, 1024


def usable(x: Column) -> Column:
    """Finite, not null, not zero."""
    return F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def log_length(x: Column) -> Column:
    """Logarithm to the base of two of a vector's length, for any finite components."""
    square = lambda y: F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v)
    largest = F.array_max(F.transform(x, F.abs))
    plain = square(x)
    return F.when(plain.between(1e-280, 1e300), F.log2(plain) / 2).otherwise(F.log2(largest) + F.log2(square(F.zip_with(x, F.array_repeat(largest, F.size(x)), lambda v, m: v / m))) / 2)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minus inner product of unit rows, for the last two axes."""
    return 1 - np.einsum("...d,...d->...", a, b)


def thin(point: int, candidates: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Relaxed pruning: the closest stays, and drops those that it is clearly closer to than the point is."""
    candidates = np.unique(candidates[candidates != point])
    d = 1 - x[candidates] @ x[point]
    order = np.lexsort((candidates, d))
    candidates, d = candidates[order], d[order]
    among = 1 - x[candidates] @ x[candidates].T
    alive, kept = np.ones(len(candidates), dtype=bool), []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(candidates[i])
            if len(kept) == degree:
                break
            alive &= alpha * among[i] > d
    return np.array(kept, dtype=np.int32)


def beam_search(queries: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, distance), the ``beam`` nearest that a greedy search met for each query; -1 and infinity fill up.

    All queries step together: each opens its nearest node not opened yet, until none is left in its beam.
    """
    n, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((n, len(x)), dtype=bool)
    node = np.full((n, beam), -1, dtype=np.int64)
    dist = np.full((n, beam), np.inf, dtype=np.float32)
    opened = np.ones((n, beam), dtype=bool)
    first = start[:beam]
    node[:, : len(first)] = first
    dist[:, : len(first)] = 1 - queries @ x[first].T
    opened[:, : len(first)] = False
    seen[:, first] = True
    active = rows
    while len(active):
        waiting = np.where(opened[active], np.inf, dist[active])
        at = waiting.argmin(axis=1)
        go = waiting[np.arange(len(active)), at] < np.inf
        active, at = active[go], at[go]
        if not len(active):
            break
        opened[active, at] = True
        near = links[node[active, at]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        row, column = np.nonzero(fresh)
        seen[active[row], near[row, column]] = True
        d = np.full(near.shape, np.inf, dtype=np.float32)
        d[row, column] = distances(queries[active[row]], x[near[row, column]])
        all_d = np.concatenate([dist[active], d], axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        pick = lambda own, new: np.take_along_axis(np.concatenate([own[active], new], axis=1), order, axis=1)
        node[active], opened[active] = pick(node, np.where(fresh, near, -1)), pick(opened, ~fresh)
        dist[active] = np.take_along_axis(all_d, order, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(node, order, axis=1), np.take_along_axis(dist, order, axis=1)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512) -> np.ndarray:
    """Links of each node of the unit rows ``x``; -1 fills up.  Node 0 is the entry."""
    n, room = len(x), 2 * degree
    links = np.full((n, room), -1, dtype=np.int32)
    used = np.zeros(n, dtype=np.int64)

    def connect(a: int, b: int) -> None:
        """A node takes links up to its room and is then thinned to the degree."""
        if a in links[b, : used[b]]:
            return
        if used[b] == room:
            kept = thin(b, np.r_[links[b], a], x, degree, alpha)
            links[b] = -1
            links[b, : len(kept)] = kept
            used[b] = len(kept)
        else:
            links[b, used[b]] = a
            used[b] += 1

    done = 0
    while done < n:
        size = min(n - done, batch, max(1, done))
        new = np.arange(done, done + size)
        found, _ = beam_search(x[new], x, links, np.arange(min(done, 1)), beam) if done else (np.full((size, 1), -1), None)
        # Nodes that join together could not find each other: their nearest fellows are proposed too.
        fellows = new[np.argsort(-(x[new] @ x[new].T), axis=1)[:, : degree + 1]]
        for i, p in enumerate(new.tolist()):
            kept = thin(p, np.r_[found[i][found[i] >= 0], fellows[i]], x, degree, alpha)
            links[p] = -1
            links[p, : len(kept)] = kept
            used[p] = len(kept)
        for p in new.tolist():
            for q in links[p, : used[p]].tolist():
                connect(p, q)
        done += size
    return links


HEAD = struct.Struct("<IIIII")


def pack_shard(ids: np.ndarray, vectors: np.ndarray, k: int, tried: np.ndarray, beams: tuple[int, ...] = BEAMS) -> bytes:
    """A shard as bytes: distinct vectors, links, the beam to search with (0: scan), and for each vector its ``k + 1`` smallest ids."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    first = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
    group = np.cumsum(first) - 1
    rank = np.arange(len(ids)) - np.flatnonzero(first)[group]
    keep = (rank <= k) & (first | (np.r_[-1, ids[:-1]] != ids))
    owner, member = group[keep], ids[keep]
    distinct = vectors[first]
    mixed = np.random.default_rng(1).permutation(len(distinct))
    place = np.empty(len(mixed), dtype=np.int64)
    place[mixed] = np.arange(len(mixed))
    distinct, owner = distinct[mixed], place[owner]
    order = np.lexsort((member, owner))
    links, beam = np.zeros((len(distinct), 0), dtype=np.int32), 0
    if len(distinct) > SMALL:
        x = scaled(distinct)
        made = build(unit_rows(distinct))
        beam = enough(unit_rows(tried), x, made, k, beams)
        links = made if beam else links
    return HEAD.pack(len(distinct), distinct.shape[1], links.shape[1], len(member), beam) + distinct.astype("<f8").tobytes() + links.astype("<i4").tobytes() + owner[order].astype("<i8").tobytes() + member[order].astype("<i8").tobytes()


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    n, width, degree, members, beam = HEAD.unpack_from(data)
    at = HEAD.size
    vectors = np.frombuffer(data, "<f8", n * width, at).reshape(n, width)
    at += 8 * n * width
    links = np.frombuffer(data, "<i4", n * degree, at).reshape(n, degree)
    at += 4 * n * degree
    return vectors, links, np.frombuffer(data, "<i8", members, at), np.frombuffer(data, "<i8", members, at + 8 * members), beam


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, for any finite components."""
    rows = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one at most, in the order of the vectors' own inner products."""
    rows = vectors / np.abs(vectors).max()
    return (rows / np.sqrt((rows * rows).sum(axis=1).max())).astype(np.float32)


def entries(x: np.ndarray) -> np.ndarray:
    """The first node, which building starts from, and the longest ones."""
    length = np.einsum("nd,nd->n", x, x)
    return np.unique(np.r_[0, np.argsort(-length, kind="stable")[:LONG]])


def enough(queries: np.ndarray, x: np.ndarray, links: np.ndarray, k: int, beams: tuple[int, ...]) -> int:
    """The first beam that finds ``RECALL`` of the nodes with the ``k`` largest products; 0 if none does."""
    if not len(queries):
        return beams[-1]
    products = queries @ x.T
    k = min(k, len(x))
    bar = np.partition(products, -k, axis=1)[:, -k]
    for beam in beams:
        found, _ = beam_search(queries, x, links, entries(x), beam)
        hits = (np.take_along_axis(products, np.maximum(found, 0), axis=1) >= bar[:, None]) & (found >= 0)
        if np.minimum(hits.sum(axis=1), k).mean() >= RECALL * k:
            return beam
    return 0


def scan(queries: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """Nodes of each query that can be among its ``k`` nearest, by all products; rounding cannot lose one."""
    products = queries @ x.T
    bar = np.partition(products, -k, axis=1)[:, -k] if k < len(x) else np.full(len(queries), -np.inf)
    return [np.flatnonzero(row >= b) for row, b in zip(products, bar - 1e-12)]


def search_shard(ids: np.ndarray, queries: np.ndarray, shard: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): up to ``k`` nearest candidates of the shard for each query."""
    vectors, links, owner, member, beam = shard
    largest = np.abs(vectors).max()
    unit = queries / np.abs(queries).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    if beam:
        x = scaled(vectors)
        start = entries(x)
    else:
        x = vectors / largest
        x = x / np.sqrt((x * x).sum(axis=1).max())
    begin = np.searchsorted(owner, np.arange(len(vectors) + 1))
    out = []
    for a in range(0, len(ids), 256):
        # One node more than asked for: the query's own may be among them.
        found = [f[f >= 0] for f in beam_search(unit[a : a + 256].astype(np.float32), x, links, start, beam)[0]] if beam else scan(unit[a : a + 256], x, k + 1)
        for i, nodes in enumerate(found):
            score = exact(queries[a + i], vectors[nodes])
            many = begin[nodes + 1] - begin[nodes]
            who = np.concatenate([member[begin[q] : begin[q + 1]] for q in nodes.tolist()]) if len(nodes) else member[:0]
            score = np.repeat(score, many)
            other = who != ids[a + i]
            who, score = who[other], score[other]
            top = np.lexsort((who, -score))[:k]
            out.append((np.full(len(top), ids[a + i]), who[top], score[top]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def nearest(
    spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20, beams: tuple[int, ...] = BEAMS, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_every``, its ``k`` nearest others."""
    stage = Stage(spark, "ann")
    x = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("vec_id IS NOT NULL").filter(usable(F.col("x")))
    widths = good.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(log_length(F.col("x"))).alias("longest")).orderBy(F.desc("n"), "width").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width, longest = widths[0].width, widths[0].longest
    good = good.filter(F.size("x") == width)
    band = F.floor((F.lit(longest) - log_length(F.col("x"))) / BAND).cast("int")
    bands, shards, shared = [], 0, 0
    for row in good.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy("band").collect():
        own = -(-row.n // shard_rows)
        if shared and shared + row.n <= SMALL:  # with the band before it still few enough to be scanned
            bands.append((row.band, shards - 1, 1))
            shared += row.n
            continue
        bands.append((row.band, shards, own))
        shards += own
        shared = row.n if row.n <= SMALL else 0
    places = F.broadcast(spark.createDataFrame(bands, "band int, first int, own int"))
    asked = good.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "x"])
    tried = np.array([r.x for r in asked.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(TRIED).collect()]).reshape(-1, width)

    def make(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        rows = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        return pa.table({"shard": table.column("shard").slice(0, 1), "graph": pa.array([pack_shard(ids, rows, k, tried, beams)], pa.binary())})

    graphs = stage.put("graphs", good.withColumn("band", band).join(places, "band").select("vec_id", "x", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("own"))).cast("int").alias("shard")).groupBy("shard").applyInArrow(make, "shard int, graph binary"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                rows = part.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], names=["ids", "rows"])

    # Full blocks, however the input was partitioned: every block meets every graph once, so large blocks read few graphs.
    n_asked, pairs_wanted = asked.count(), 2 * spark.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n_asked // BLOCK_ROWS), min(-(-n_asked // FEW_ROWS), -(-pairs_wanted // shards)))
    asked = asked.repartition(n_blocks)
    blocks = asked.mapInArrow(block, "ids binary, rows binary").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[i].as_py(), "<i8")
                rows = np.frombuffer(batch.column(1)[i].as_py(), "<f8").reshape(-1, width)
                found = search_shard(ids, rows, unpack_shard(batch.column(2)[i].as_py()), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    # A pair of a block and a graph is a few MB: as many partitions as pairs keep a task's memory bounded.
    pairs = blocks.join(graphs, "shard").select("ids", "rows", "graph").repartition(min(2 * shards * n_blocks, 100_000))
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    # One shuffle by query serves both windows; the first leaves one row of an id that has several vectors.
    once = F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy(F.col("score").desc()))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.repartition("query_id").withColumn("copy", once).filter("copy = 1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
