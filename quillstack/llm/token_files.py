"""Token ids in fixed-width blocks, in ascending order of document ids.

A block holds whole documents: a header, the ids of its documents, the number of token ids
before each, and the token ids packed in the fewest bits that the vocabulary needs.
``ids_between`` unpacks any range of a block with numpy and touches only the bytes of that range.
Blocks are rows of a table that Spark writes and reads (part, block, first, n_docs, n_ids, first_doc, last_doc,
payload), so they reach any store that Spark reaches and survive lost executors; files and rows are in
the order of document ids.  ``lookup`` finds documents by the first and last id of each block: other
blocks' payloads are not read.

Texts are tokenised where they lie; only token ids travel to their place in the order.

Defined cases: a null text is empty (one end id).  Rows without an id come first.  Repeated
ids keep their rows, in the order of a hash of their token ids.  An empty table gives no rows.  Very long texts are blocks of their own,
packed and unpacked in slices.  Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm import tokens
from quillstack.llm.batches import small_batches
from quillstack.staging import Stage

#: Magic, version, bits per id, documents, ids.
HEADER = struct.Struct("<4sBBxxIQ")
MAGIC, VERSION = b"QTOK", 1
#: A block ends after the document that brings it to this many ids.
BLOCK_IDS = 1 << 18
#: Ids that are packed or unpacked at a time; a multiple of 8, so slices begin at whole bytes.
SLICE = 1 << 16


def bits_for(size: int) -> int:
    """The fewest bits that hold ids 0 to size - 1."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit stream of equal fields."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits than the vocabulary")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (np.unpackbits(ids[i : i + SLICE].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits] for i in range(0, len(ids), SLICE))
    return b"".join(np.packbits(f.reshape(-1), bitorder="little").tobytes() for f in fields)


def unpack_bits(data: memoryview | bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of a bit stream."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=stop - start, offset=start * bits // 8).astype(np.uint32)
    out = np.zeros(stop - start, dtype=np.uint32)
    for a in range(start, stop, SLICE):
        b = min(stop, a + SLICE)
        first, last = a * bits, b * bits
        raw = np.frombuffer(data, dtype=np.uint8, count=-(-last // 8) - first // 8, offset=first // 8)
        wide = np.zeros((b - a, 32), dtype=np.uint8)
        wide[:, :bits] = np.unpackbits(raw, bitorder="little")[first % 8 :][: last - first].reshape(-1, bits)
        out[a - start : b - start] = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)
    return out


def make_block(docs: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """Bytes of a block; a missing document id is stored as the smallest long."""
    keys = np.array([-(1 << 63) if d is None else d for d in docs], dtype="<i8")
    before = np.r_[0, np.cumsum(counts)].astype("<u8")
    return HEADER.pack(MAGIC, VERSION, bits, len(docs), len(ids)) + keys.tobytes() + before.tobytes() + pack_bits(ids, bits)


class Block:
    """Random access to a block's bytes."""

    def __init__(self, data: bytes):
        magic, version, self.bits, n, self.n_ids = HEADER.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token block")
        at = HEADER.size
        self.keys = np.frombuffer(data, dtype="<i8", count=n, offset=at)
        self.before = np.frombuffer(data, dtype="<u8", count=n + 1, offset=at + 8 * n).astype(np.int64)
        self.data = memoryview(data)[at + 16 * n + 8 :]

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        return unpack_bits(self.data, self.bits, start, stop)

    def document(self, k: int) -> np.ndarray:
        return self.ids_between(int(self.before[k]), int(self.before[k + 1]))


BLOCKS = "part int, block int, first long, n_docs long, n_ids long, first_doc long, last_doc long, payload binary"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, ids): the ids of every document in the fewest whole bytes, with a hash that orders rows of one id; a narrow job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = width_of(tokenizer_path, end_id)
        for batch, ids, sizes in tokens.encoded(batches, tokenizer_path):
            ends = np.cumsum(sizes)
            data = np.insert(ids, ends, end_id).astype(width).tobytes()
            upto = (np.r_[0, ends + 1 + np.arange(len(ends))] * width.itemsize).tolist()
            packed = [data[a:b] for a, b in zip(upto, upto[1:])]
            tie = np.array([xxhash.xxh64_intdigest(x) for x in packed], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tie), pa.array(packed, pa.binary())], names=["doc_id", "tie", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, tie long, ids binary")


def width_of(tokenizer_path: str, end_id: int) -> np.dtype:
    """Whole bytes of an id on its way."""
    return np.dtype("<u2" if max(tokens.tokenizer(tokenizer_path).size, end_id + 1) <= 1 << 16 else "<u4")


def blocks(rows: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of tokenised rows (doc_id, tie, ids) in ascending order of ids: one range shuffle.

    The rows are read twice (the ranges are sampled), so they should be staged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bits, width = TaskContext.get().partitionId(), bits_for(max(tokens.tokenizer(tokenizer_path).size, end_id + 1)), width_of(tokenizer_path, end_id)
        first = k = 0
        docs, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, k, docs, held, n
            ids = np.frombuffer(b"".join(held), dtype=width).astype(np.uint32)
            payload = make_block(docs, np.array([len(x) // width.itemsize for x in held]), ids, bits)
            known = [d for d in docs if d is not None]
            row = [part, k, first, len(docs), n, min(known, default=None), max(known, default=None), payload]
            first, k, docs, held, n = first + n, k + 1, [], [], 0
            kinds = (pa.int32(), pa.int32(), *(pa.int64() for _ in range(5)), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                docs.append(doc)
                held.append(ids.as_py())
                n += len(held[-1]) // width.itemsize
                if n >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def lookup(written: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the named documents.  Only blocks that may hold one are unpacked, and of these only the documents' own ranges."""
    wanted = sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(wanted, dtype=np.int64)
        for batch in batches:
            for payload in batch.column(0):
                block = Block(payload.as_py())
                at = np.flatnonzero(np.isin(block.keys, names))
                yield pa.RecordBatch.from_arrays([pa.array(block.keys[at].astype(np.int64)), pa.array([block.document(i).tolist() for i in at], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = F.lit(False)
    for i in range(0, len(wanted), max(1, -(-len(wanted) // 64))):
        own = wanted[i : i + max(1, -(-len(wanted) // 64))]
        near = near | ((F.col("first_doc") <= own[-1]) & (F.col("last_doc") >= own[0]))
    return written.filter(near).select("payload").mapInArrow(run, "doc_id long, ids array<long>")


def read_documents(written: DataFrame) -> DataFrame:
    """(doc_id, part, at, n_tokens, ids_crc32) of every document of a table of blocks; ``at`` counts ids from the part's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = Block(payload)
                ids = block.ids_between(0, block.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(block.before[:-1].tolist(), block.before[1:].tolist())]
                keys = pa.array(block.keys.astype(np.int64), mask=block.keys == -(1 << 63))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), part, dtype=np.int32)), pa.array(first + block.before[:-1]), pa.array(np.diff(block.before)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    return written.select("part", "first", "payload").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the written blocks."""
    small_batches(spark)
    stage = Stage(spark, "tokens")
    rows = stage.put("ids", tokenised(docs, tokenizer_path, end_id, id_col, text_col))
    written = stage.put("blocks", blocks(rows, tokenizer_path, end_id))
    stage.drop("ids")
    # One row per written part: a running sum over parts needs no more than their number.
    totals = written.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = stage.put("base", totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))
    rows = read_documents(written).join(base, "part")
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
