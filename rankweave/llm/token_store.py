"""Token ids in patched frame-of-reference blocks.

A shard holds whole documents in ascending doc_id order.  Its payload, little-endian:

    u32 number of ids, u32 block size, u32 number of blocks b,
    u32[b] minima, u8[b] widths, u16[b] numbers of exceptions, u32[b] starts of the packed blocks (the index),
    packed blocks: block-size deltas of the block's width each, least significant bit first,
    u16[] positions and u32[] high parts of all exceptions, block after block.

A block's width is a percentile of the bit lengths of its deltas; longer deltas keep their low bits in place and have
the rest in the exception list.  ``read_block`` reads one block through the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from rankweave.llm.common import id_and_text
from rankweave.llm.word_tokens import encode_text

BLOCK = 128
PERCENTILE = 90
SHARD_IDS = 1 << 18
HEAD = 12


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, size) values below 2**width -> (blocks, bytes)."""
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, size: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, count=width * size, bitorder="little").reshape(len(packed), size, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def pack_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n, b = len(ids), -(-len(ids) // block)
    if not b:
        return np.array([0, block, 0], "<u4").tobytes()
    grid = np.full(b * block, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(b, block)
    minima = grid.min(axis=1)
    deltas = grid - minima[:, None]
    need = _bit_lengths(deltas)
    widths = np.percentile(need, percentile, axis=1, method="higher").astype(np.uint8)
    where, position = np.nonzero(need > widths[:, None])
    high = deltas[where, position] >> widths[where].astype(np.uint32)
    low = deltas & ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    lengths = (widths.astype(np.int64) * block + 7) // 8
    starts = np.cumsum(lengths) - lengths
    body = np.zeros(int(lengths.sum()), np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.nonzero(widths == width)[0]
        packed = _pack(low[rows], width)
        body[(starts[rows][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    counts = np.bincount(where, minlength=b)
    return b"".join(x.tobytes() for x in (
        np.array([n, block, b], "<u4"), minima.astype("<u4"), widths, counts.astype("<u2"), starts.astype("<u4"), body,
        position.astype("<u2"), high.astype("<u4")))


def _sections(payload: bytes) -> tuple:
    n, block, b = np.frombuffer(payload, "<u4", 3).tolist()
    at, out = HEAD, []
    for kind in ("<u4", "u1", "<u2", "<u4"):
        out.append(np.frombuffer(payload, kind, b, at))
        at += b * np.dtype(kind).itemsize
    minima, widths, counts, starts = out
    size = int(((widths.astype(np.int64) * block + 7) // 8).sum())
    patches = at + size
    total = int(counts.sum())
    return (n, block, b, minima, widths, counts, starts, np.frombuffer(payload, np.uint8, size, at),
            np.frombuffer(payload, "<u2", total, patches), np.frombuffer(payload, "<u4", total, patches + 2 * total))


def _blocks(payload: bytes, wanted: np.ndarray | None = None) -> np.ndarray:
    n, block, b, minima, widths, counts, starts, body, position, high = _sections(payload)
    wanted = np.arange(b) if wanted is None else wanted
    out = np.zeros((len(wanted), block), np.uint32)
    for width in np.unique(widths[wanted]).tolist():
        rows = np.nonzero(widths[wanted] == width)[0]
        if width:
            span = np.arange((width * block + 7) // 8)
            out[rows] = _unpack(body[starts[wanted[rows]].astype(np.int64)[:, None] + span], width, block)
    owner = np.repeat(np.arange(b), counts)
    place = np.full(b, -1)
    place[wanted] = np.arange(len(wanted))
    mine = place[owner] >= 0
    rows = place[owner[mine]]
    out[rows, position[mine]] |= high[mine] << widths[owner[mine]].astype(np.uint32)
    return out + minima[wanted][:, None]


def unpack_ids(payload: bytes) -> np.ndarray:
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    return _blocks(payload).ravel()[:n].astype("<u4") if n else np.zeros(0, "<u4")


def read_block(payload: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, found through the index of block starts."""
    n, block, _ = np.frombuffer(payload, "<u4", 3).tolist()
    return _blocks(payload, np.array([k])).ravel()[:max(0, n - k * block)]


def write_token_store(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block: int = BLOCK, percentile: float = PERCENTILE,
    shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encodes, appends the end id and stores the ids in ascending doc_id order (null first; equal doc_ids by text).

    Rows are range partitioned by doc_id and each task writes the shards of its range, closed when they hold
    ``shard_ids`` ids; a document is never split, so one longer than that makes a shard of its own size.  Spark's
    writer commits files, so a lost executor leaves no half shard.  A shard row carries its partition's number and its
    place in it; partition numbers ascend with doc_id.
    """
    docs = id_and_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType
    schema = StructType([
        StructField("part", IntegerType()), StructField("first", LongType()), StructField("n_ids", LongType()),
        StructField("doc_ids", ArrayType(kind)), StructField("doc_lengths", ArrayType(LongType())),
        StructField("payload", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, names, arrow = TaskContext.get().partitionId(), 0, [], [], None

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            columns = [
                pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(arrow)), pa.array([[len(h) for h in held]], pa.list_(pa.int64())),
                pa.array([pack_ids(ids, block, percentile)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        size = 0
        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.append(encode_text(text.as_py(), tokenizer_path, end_id))
                names.append(doc_id)
                size += len(held[-1])
                if size >= shard_ids:
                    yield shard()
                    first, size, held, names = first + size, 0, [], []
        if held:
            yield shard()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids, and the number of ids of all documents before it."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = StructType([
        StructField("part", IntegerType()), StructField("doc_id", kind), StructField("within", LongType()),
        StructField("ids", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = batch.schema.field("doc_ids").type.value_type
            for k in range(batch.num_rows):  # one shard at a time
                row = batch.slice(k, 1).to_pylist()[0]
                ids, lengths = unpack_ids(row["payload"]), row["doc_lengths"]
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], arrow),
                    pa.array(row["first"] + starts, pa.int64()),
                    pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())], schema.names)

    # One row for each partition of the writing job: a bounded table, numbered in one task.
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    read = shards.select("part", "first", "doc_ids", "doc_lengths", "payload").mapInArrow(run, schema)
    return read.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "ids")
