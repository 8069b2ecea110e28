"""Line dedup: a line that several documents share stays only in the smallest document that holds it.

Hashes of the line keys are range partitioned and sorted by document and position; a stream over each partition meets
the first document of a key first and drops the key everywhere else.  The document is part of the range key, so a key
that many documents hold spreads over several partitions: the run that crosses a border is settled by the first
documents that the partitions pass on.  The result is a compressed bitmap of kept lines per document, no text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from rankweave.llm.common import Scratch, id_and_text, row_hash, same_row, whole_rows, with_text

STRIPPED = b" \t\n\v\f\r"
SHORTEST = 10


def line_keys(text: str, shortest: int = SHORTEST) -> dict[bytes, list[int]]:
    """Positions of each line key of a text that has at least ``shortest`` code points."""
    found: dict[bytes, list[int]] = {}
    for position, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):  # bytes: only A-Z are lowered
        key = line.strip(STRIPPED)
        if len(key) >= shortest and (len(key) >= 4 * shortest or len(key.decode("utf-8", "surrogatepass")) >= shortest):
            found.setdefault(key, []).append(position)
    return found


def _hashes(docs: DataFrame, shortest: int) -> DataFrame:
    """(h1, h2, doc_id, _rh, positions): one row per key and document."""
    schema = StructType([
        StructField("h1", LongType()), StructField("h2", LongType()), docs.schema["doc_id"], docs.schema["_rh"],
        StructField("positions", ArrayType(IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, owners, positions = [], [], []
            for row, text in enumerate(batch.column("text")):
                for key, at in line_keys(text.as_py(), shortest).items():
                    digests.append(xxhash.xxh3_128_digest(key))
                    owners.append(row)
                    positions.append(at)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(owner), batch.column("_rh").take(owner),
                pa.array(positions, pa.list_(pa.int32()))], schema.names)

    return docs.mapInArrow(run, schema)


def _streamed(rows: DataFrame) -> DataFrame:
    """Sorted partitions -> the rows that are dropped (``drop``) and those of runs at a border, to be settled (not ``drop``)."""
    schema = StructType([*rows.schema.fields, StructField("drop", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = last_key = holder = None
        held: list[pa.RecordBatch] = []  # the first row of the run that is open at the end of a batch

        def out(batch: pa.RecordBatch, drop: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([drop] * batch.num_rows, pa.bool_())], schema.names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            docs = batch.column("doc_id").to_pylist()
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            key = (h1[0], h2[0])
            new[0] = key != last_key
            if first_key is None:
                first_key = key
            starts = np.nonzero(new)[0]
            run_of = np.cumsum(new) - 1  # -1: the run that was open before this batch
            border = (h1 == first_key[0]) & (h2 == first_key[1])
            holders = [docs[s] for s in starts]
            other = np.fromiter((d != (holders[r] if r >= 0 else holder) for d, r in zip(docs, run_of)), bool, n)
            dropped, waits = np.nonzero(other & ~border)[0], np.nonzero(border)[0]
            if len(dropped):
                yield out(batch.take(pa.array(dropped)), True)
            if len(waits):
                yield out(batch.take(pa.array(waits)), False)
            if len(starts):
                holder, held = holders[-1], [] if border[starts[-1]] else [batch.slice(int(starts[-1]), 1)]
            last_key = (h1[-1], h2[-1])
        for batch in held:  # the last run may go on in the next partition
            yield out(batch, False)

    return rows.mapInArrow(run, schema)


def _bitmap(n_lines: Column, dropped: Column) -> Column:
    @F.pandas_udf("binary")
    def run(counts: pd.Series, positions: pd.Series) -> pd.Series:
        out = []
        for n, lost in zip(counts, positions):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(lost, dtype=np.int64)] = 0
            out.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
        return pd.Series(out, dtype=object)

    return run(n_lines, dropped)


def keep_bitmaps(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _rh, n_lines, n_dropped, bitmap): one row per distinct row of docs; bit i (least significant first) of the
    zlib-compressed bitmap tells whether line i stays.

    Lines end at a line feed; a null or empty text is one empty line.  Rows with equal doc_id are one document that
    holds the lines of all of them.  A null doc_id is a document of its own and larger than every other.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("_rh", row_hash(F.col("text")))
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = scratch.store(_hashes(docs, shortest))  # sampled for the range borders, then read again
    ordered = rows.repartitionByRange("h1", "h2", F.col("doc_id").asc_nulls_last()).sortWithinPartitions(
        "h1", "h2", F.col("doc_id").asc_nulls_last(), "_rh")
    streamed = scratch.store(_streamed(ordered))
    waits = streamed.filter("not drop")
    # Each partition names at most two keys, its first and its last, and all waiting rows are of such keys: holders has at
    # most two rows per partition of the shuffle and is broadcast, so the rows of a common line stay where they are.
    holders = waits.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("_holder"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").drop("_rows")
    settled = waits.join(F.broadcast(holders), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("_holder"))).drop("_holder")
    # A run's first row may stand among the waiting rows and, where its partition did know a smaller holder, be dropped
    # already; repeated positions make no difference.
    lost = (
        streamed.filter("drop").unionByName(settled).groupBy("doc_id", "_rh")
        .agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("_lost"))
    )
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    counts = docs.select("doc_id", "_rh", lines.cast("long").alias("n_lines")).distinct()
    joined = counts.join(lost, same_row(counts, lost), "left").select(counts["doc_id"], counts["_rh"], "n_lines", "_lost")
    gone = F.coalesce("_lost", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "_rh", "n_lines", F.size(gone).cast("long").alias("n_dropped"), _bitmap(F.col("n_lines"), gone).alias("bitmap"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The kept lines, joined by line feeds."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(texts, bitmaps):
            lines = t.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines), bitorder="little")
            out.append(t if keep.all() else "\n".join(x for x, k in zip(lines, keep) if k))
        return pd.Series(out, dtype=object)

    return run(text, bitmap)


def kept_documents(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, text, n_lines, n_dropped): each row of docs with its kept lines."""
    keyed = whole_rows(docs)
    joined = keyed.join(bitmaps, same_row(keyed, bitmaps)).select("row", "_text", "n_lines", "n_dropped", "bitmap")
    text = F.when(F.col("n_dropped") == 0, F.col("_text")).otherwise(kept_text(F.col("_text"), F.col("bitmap")))
    return joined.select("row", text.alias("text"), "n_lines", "n_dropped")


def drop_lines(docs: DataFrame, **settings) -> DataFrame:
    """docs with the kept lines as ``text`` (and their length as ``n_chars``, if there is one); all rows and columns stay."""
    kept = kept_documents(docs, keep_bitmaps(docs, **settings))
    return kept.select(with_text(F.col("row"), F.col("text"), docs.columns).alias("row")).select("row.*")
