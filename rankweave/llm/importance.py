"""Target-distribution importance resampling (Xie, Santurkar, Ma and Liang, 2023) over hashed word features.

Features are runs of one and two words, hashed by crc32 into buckets.  Within a batch of texts each distinct feature is
hashed once: features of equal byte length form one two-dimensional uint8 array, whose checksums are all updated column
by column, and the buckets are scattered back to where the features stand.  A document's weight is the mean of its buckets'
log-ratios between target and corpus; Gumbel noise makes the highest scores a draw without replacement.

The buckets of each document are stored once, as sorted differences (about a byte each on disk); counts and weights are
both read from there, so texts are read and hashed a single time.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch

BUCKETS = 10_000
TOGETHER = 200_000  # words whose distinct features are hashed together
WIDEST = 256  # bytes; the rare longer features go to zlib one by one

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lowered, then the runs of digits, letters a-z and bytes from 0x80 on."""
    return text.lower().translate(_WORD_BYTES).split()


def _crc_table() -> np.ndarray:
    """Remainders of the 256 bytes for the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def crc_matrix(matrix: np.ndarray) -> np.ndarray:
    """crc32 of every row of a uint8 matrix, one column at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc_of(features: list[bytes]) -> np.ndarray:
    """crc32 of each feature, by length-bucketed matrices."""
    out = np.zeros(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    wide = int(np.searchsorted(lengths[order], WIDEST, side="right"))
    buffer, at = b"".join([features[i] for i in order[:wide]]), 0
    sizes, firsts = np.unique(lengths[order[:wide]], return_index=True)
    for size, first, end in zip(sizes.tolist(), firsts, np.append(firsts[1:], wide)):
        rows = int(end - first)
        out[order[first:end]] = crc_matrix(np.frombuffer(buffer, np.uint8, rows * size, at).reshape(rows, size))
        at += rows * size
    for i in order[wide:]:
        out[i] = zlib.crc32(features[i])
    return out


def _hashed(texts: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature of every text."""
    known: dict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((k for t in texts for k in map(known.__getitem__, t)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    vocabulary = list(known)
    inside = np.nonzero(owner[1:] == owner[:-1])[0]
    pairs, place = np.unique(ids[inside] * max(1, len(vocabulary)) + ids[inside + 1], return_inverse=True)
    left, right = np.divmod(pairs, max(1, len(vocabulary)))
    both = [vocabulary[a] + b" " + vocabulary[b] for a, b in zip(left.tolist(), right.tolist())]
    bucket = (crc_of(vocabulary + both) % np.uint32(buckets)).astype(np.int64)
    return np.concatenate([owner, owner[inside]]), np.concatenate([bucket[: len(vocabulary)][ids], bucket[len(vocabulary):][place]])


def _batches(column: pa.Array) -> Iterator[list[list[bytes]]]:
    texts, words = [], 0
    for text in column:
        texts.append(words_of(text.as_py() or b""))
        words += len(texts[-1])
        if words >= TOGETHER:
            yield texts
            texts, words = [], 0
    yield texts


def feature_buckets(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, steps): ``steps`` are the document's sorted buckets as differences, unsigned 32-bit
    little-endian where ``buckets`` needs more than 16 bits, else 16-bit.  A null text has no words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind, dtype = rows.schema["doc_id"].dataType.simpleString(), _step_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _batches(batch.column("text")):
                if not texts:
                    continue
                owner, bucket = _hashed(texts, buckets)
                keys = np.sort(owner * buckets + bucket)
                counts = np.bincount(owner, minlength=len(texts))
                first = np.cumsum(counts) - counts
                steps = np.diff(keys, prepend=0)
                steps[first[counts > 0]] = keys[first[counts > 0]] % buckets
                data = steps.astype(dtype).tobytes()
                ends = (np.cumsum(counts) * np.dtype(dtype).itemsize).tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(done, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
                ], ["doc_id", "n_words", "n_features", "steps"])
                done += len(texts)

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, steps binary")


def _step_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _read_steps(batch: pa.RecordBatch, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each row, buckets of all rows)."""
    counts = batch.column("n_features").to_numpy()
    steps = np.frombuffer(b"".join(x.as_py() for x in batch.column("steps")), dtype).astype(np.int64)
    total = np.cumsum(steps)
    first = (np.cumsum(counts) - counts)[counts > 0]
    return counts, total - np.repeat((total - steps)[first], counts[counts > 0])


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): one row per bucket that occurs; every task passes on at most one row per bucket."""
    dtype = _step_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(_read_steps(batch, dtype)[1], minlength=buckets)
        seen = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["bucket", "n"])

    parts = features.select("n_features", "steps").mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) of every bucket."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    ratio = ((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """The features' rows without ``steps``, with ``weight``: the floored mean gain of the row's features (none: 0)."""
    buckets, kept = len(gain), [c for c in features.columns if c != "steps"]
    dtype = _step_type(buckets)
    fields = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bucket = _read_steps(batch, dtype)
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            ends = np.cumsum(counts)
            weight = (sums[ends] - sums[ends - counts]) // np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(weight, pa.int64())], [*kept, "weight"])

    return features.mapInArrow(run, f"{fields}, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 8 hex digits of sha256("<seed>:<doc_id>"); a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, scratch: Scratch, percent: int, least_words: int, seed: int) -> DataFrame:
    """The rows with ``score`` and ``rank`` (1, 2, 3 ... for the drawn ones, else null).

    Rows are range partitioned by their place in the draw and numbered by partition sizes, so no task sees all rows; the
    row number of the stored table ends the order and spreads rows of one id.
    """
    scored = scratch.store(
        weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        .withColumn("_able", F.col("n_words") >= least_words).withColumn("_row", F.monotonically_increasing_id()))
    order = [F.desc("_able"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("_row")]
    ranged = scratch.store(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    drawn = scored.filter("_able").count() * percent // 100
    number = F.col("_offset") + place + 1
    return (
        ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn("rank", F.when(number <= drawn, number)).drop("_part", "_offset", "_at", "_able", "_row")
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per row of docs.

    ``percent`` of the documents with at least ``least_words`` words are drawn, the highest scores first, ties to the
    smaller doc_id (null last).  Corpus and target counts are over all rows.  A null or empty text has no features and
    the weight 0; an empty target leaves only the smoothing.  Repeated rows count and are drawn on their own; other
    columns of either table are not read.  Only one count per bucket reaches the driver.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    path = scratch.path()
    own = feature_buckets(docs, buckets, id_col, text_col)
    own.write.option("compression", "zstd").parquet(path)
    own = docs.sparkSession.read.schema(own.schema).parquet(path)
    wanted = feature_buckets(target.select(F.lit(0).alias("_i"), target_col), buckets, "_i", target_col)

    def counts(features: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(features, buckets).collect():  # at most one row per bucket
            out[bucket] = n
        return out

    return draw(weigh(own, gains(counts(own), counts(wanted))), scratch, percent, least_words, seed)
