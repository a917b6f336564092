"""Best-fit packing of tokenised documents into sequences of fixed capacity, in bulk-synchronous rounds.

Pieces of equal length are alike, so documents and gaps are kept as runs: a piece is
(length, rank among its length), a gap is (free tokens, sequence).  Both are range-partitioned by size, each
range half as large as the one before.  In a round all ranges sweep their own pieces and gaps at
the same time: from the longest piece down each takes its successor, the smallest gap that still holds it.
Conflicts are settled by rank: the first ranks get the gap's first sequences, the rest go on to the next larger
gap.  Gaps are updated and dealt to their new ranges for the next round.  A piece that no gap of its
range holds waits there, since gaps of its size still appear; only the longest pieces left, which no other piece can
be ahead of, climb from range to range, and in the range of the largest gaps they open sequences.  Rounds end when every piece has its place.

There are at most ``capacity`` lengths and ``capacity`` gaps, so runs are bounded by
the capacity and not by the corpus; every round is a staged table.  Ranks are dealt
without a shuffle by length (a third of all documents may have one length): each task counts
its own pieces by length while it tokenises, and a prefix sum over (length, task), joined by a sort and never broadcast, makes the ranks global.
Every document then finds its run by (length, rank).

Defined cases: a null text is empty (one end id).  Repeated rows are packed each.  An
empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm import tokens
from quillstack.llm.batches import small_batches
from quillstack.staging import Stage

#: The last range of sizes: a sixteenth of the capacity and less.
LAST = 4
STATE = "kind string, size int, first long, n long, at int, sequence long, offset int"
KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, numbered by length within the task; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId(), defaultdict(int)
        tail = np.array([end_id], dtype="<u4")
        for batch, ids, counts in tokens.encoded(batches, tokenizer_path):
            rows, ends = [], np.cumsum(counts).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), [0, *ends], ends):
                own = np.r_[ids[a:b].astype("<u4"), tail]
                for k, (start, length) in enumerate(cut(len(own), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(own[start : start + length]), part, used[length]))
                    used[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def range_of(size: int, capacity: int) -> int:
    """0 for sizes over half the capacity, 1 for those over a quarter, and so on up to ``LAST``."""
    return min(LAST, (capacity // size).bit_length() - 1)


Run = tuple[int, int, int]


def sweep(pieces: list[Run], gaps: list[Run], capacity: int, fresh: int | None) -> tuple[list[tuple[int, int, int, int, int]], list[Run], list[Run], int | None]:
    """Best fit of runs of pieces (length, first rank, number) in runs of gaps (free, first sequence, number), longest first.

    Gives runs (length, first rank, pieces per sequence, first sequence, offset), whose pieces fill their sequences one after
    another, then pieces without a gap, gaps, and the next new sequence.  Sequences are opened only if ``fresh`` is a number.
    """
    order: list[int] = []
    free: dict[int, deque[tuple[int, int]]] = {}
    runs, left = [], []

    def give(gap: int, first: int, last: int) -> None:
        if gap and first < last:
            if gap not in free:
                insort(order, gap)
                free[gap] = deque()
            free[gap].append((first, last))

    for gap, first, n in sorted(gaps):
        give(gap, first, first + n)
    for length, rank, n in sorted(pieces, key=lambda x: (-x[0], x[1])):
        end = rank + n
        while rank < end:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, last = free[gap].popleft()
                if not free[gap]:
                    del free[gap], order[at]
            elif fresh is None:
                left.append((length, rank, end - rank))
                break
            else:
                gap, first = capacity, fresh
                fresh = last = first + -(-(end - rank) // (capacity // length))
            each = gap // length
            full, over = divmod(min(end - rank, each * (last - first)), each)
            runs.append((length, rank, each, first, capacity - gap))
            rank += full * each + over
            give(gap - each * length, first, first + full)
            if over:
                give(gap - over * length, first + full, first + full + 1)
            give(gap, first + full + bool(over), last)
    return runs, left, [(gap, first, last - first) for gap in order for first, last in free[gap]], fresh


def rounds(stage: Stage, pieces: DataFrame, capacity: int) -> DataFrame:
    """(size, first, n, sequence, offset): runs that place all pieces (size, n), as ``sweep`` gives them."""
    size_range = F.least(F.lit(LAST), F.length(F.bin((F.lit(capacity) / F.col("size")).cast("long"))) - 1).cast("int")
    state = pieces.select(F.lit("piece").alias("kind"), F.col("size").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), size_range.alias("at"), F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("offset"))
    following = stage.spark.range(1).select(F.lit("next").alias("kind"), *(F.lit(0).cast(kind).alias(name) for name, kind in map(str.split, STATE.split(", ")[1:])))
    state = stage.put("round", state.unionByName(following))
    placed = []
    while True:
        longest = state.filter("kind = 'piece'").agg(F.max("size")).first()[0]
        if longest is None:
            break
        front = range_of(longest, capacity)

        def work(table: pa.Table) -> pa.Table:
            here, rows = table.column("at")[0].as_py(), {"piece": [], "gap": [], "next": []}
            for kind, *row in zip(*(table.column(c).to_pylist() for c in ("kind", "size", "first", "n"))):
                rows[kind].append(tuple(row))
            fresh = rows["next"][0][1] if rows["next"] else None
            runs, left, gaps, fresh = sweep(rows["piece"], rows["gap"], capacity, fresh)
            out = [("run", *run[:2], run[2], -1, *run[3:]) for run in runs]
            # Only pieces of the front move: nothing longer can want the gaps that they come to.
            out += [("piece", size, first, n, here - (range_of(size, capacity) == front), 0, 0) for size, first, n in left]
            out += [("gap", size, first, n, range_of(size, capacity), 0, 0) for size, first, n in gaps]
            if fresh is not None:
                out.append(("next", 0, fresh, 0, 0, 0, 0))
            return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, KINDS)], names=[x.split()[0] for x in STATE.split(", ")])

        done = stage.put("round", state.groupBy("at").applyInArrow(work, STATE))
        placed.append(done.filter("kind = 'run'"))
        state = done.filter("kind <> 'run'")
    none = state.filter("kind = 'run'")
    return reduce(DataFrame.unionByName, placed, none).select("size", "first", "n", "sequence", "offset")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    small_batches(spark)
    stage = Stage(spark, "packing")
    made = stage.put("pieces", pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    own = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = stage.put("base", own.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("base")))
    counts = stage.put("counts", base.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")))  # at most `capacity` rows
    runs = np.array(sorted(map(tuple, rounds(stage, counts, capacity).collect())), dtype=np.int64).reshape(-1, 5)  # bounded by the capacity
    shift = np.int64(1) << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = runs[:, 0] * shift + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, lo, each, first, offset = runs[np.searchsorted(begin, length * shift + rank, side="right") - 1].T
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(first + (rank - lo) // each), pa.array(offset + (rank - lo) % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(base.drop("n").hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
