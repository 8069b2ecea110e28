"""Byte-level BPE: long texts are encoded in chunks that are stitched where their pre-token boundaries agree.

The pre-tokeniser reads from left to right and never looks back, so two runs that share one boundary share all later
ones.  Chunk i runs from its own first character and into the next chunk's; the first boundary that it shares with its
left neighbour in their overlap is a boundary of the whole text.  Between two such points a piece is encoded on
its own.  A piece never ends in white space, where the pattern looks ahead at what follows the run.  A text with an
overlap without such a boundary (one pre-token or white space fills it) is encoded in one piece.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from rankweave.llm.common import id_and_text, row_hash

CHUNK, OVERLAP = 32_768, 1_024
MARGIN = 4  # a match that ends so close to the end of a chunk might be longer in the whole text


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def _tokens(path: str) -> list[bytes]:
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids as little-endian unsigned 32-bit integers, the whole text at once."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks_path, pattern)
        return texts.map(lambda t: np.array(encoding.encode_ordinary(t), "<u4").tobytes())

    return run(text)


def decode_column(ids: Column, ranks_path: str) -> Column:
    """The bytes of the ids one after the other; they need not be valid UTF-8."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        tokens = _tokens(ranks_path)
        return values.map(lambda v: b"".join(map(tokens.__getitem__, np.frombuffer(v, "<u4").tolist())))

    return run(ids)


def boundaries(text: str, pattern: str, start: int, complete: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk as positions of the whole text, only those that neither more text nor a cut can move."""
    import regex

    last = len(text) - (0 if complete else MARGIN)
    return [start + m.end() for m in regex.finditer(pattern, text) if m.end() <= last and not text[m.end() - 1].isspace()]


def _chunked(docs: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(doc_id, _rh, _copies, i, n, chunk, head, tail): one row per chunk, dealt out evenly before it is pre-tokenised.

    head and tail: boundaries in the overlap with the left and with the right neighbour.
    """
    cut = StructType([
        docs.schema["doc_id"], docs.schema["_rh"], StructField("_copies", LongType()), StructField("i", IntegerType()),
        StructField("n", IntegerType()), StructField("chunk", StringType()),
    ])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                n = max(1, -(-len(row[2]) // chunk))
                parts = [row[2][i * chunk:(i + 1) * chunk + overlap] for i in range(n)]
                yield pd.DataFrame({
                    "doc_id": pd.Series([row[0]] * n, dtype=frame["doc_id"].dtype), "_rh": row[1], "_copies": row[3],
                    "i": range(n), "n": n, "chunk": parts,
                })

    @F.pandas_udf("struct<head: array<int>, tail: array<int>>")
    def overlaps(i: pd.Series, n: pd.Series, part: pd.Series) -> pd.DataFrame:
        heads, tails = [], []
        for k, total, text in zip(i, n, part):
            start, after = k * chunk, (k + 1) * chunk
            ends = boundaries(text, pattern, start, k + 1 == total)
            heads.append([e for e in ends if e <= start + overlap] if k else [])
            tails.append([e for e in ends if e >= after] if k + 1 < total else [])
        return pd.DataFrame({"head": heads, "tail": tails})

    rows = docs.groupBy("doc_id", "_rh", "text").agg(F.count(F.lit(1)).alias("_copies"))
    return (
        rows.select("doc_id", "_rh", "text", "_copies").mapInPandas(split, cut).repartition("_rh", "i")
        .withColumn("_o", overlaps("i", "n", "chunk"))
        .select("doc_id", "_rh", "_copies", "i", "n", "chunk", "_o.head", "_o.tail")
    )


def _stitched(chunks: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, _rh, _copies, i, piece): the text between two points where neighbours agree.

    All rows of one text meet to find the points; that is bounded by the text, which was one row before.
    """
    from pyspark.sql import Window

    of = Window.partitionBy("doc_id", "_rh", "_copies")
    in_order = of.orderBy("i")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(in_order)))
    cut = chunks.withColumn("_from", F.when(F.col("i") == 0, F.lit(0)).otherwise(shared))
    cut = cut.withColumn("_whole", F.max(F.col("_from").isNull()).over(of)).withColumn("_to", F.lead("_from").over(in_order))
    start, at = F.col("i") * chunk, F.col("_from")
    length = F.when(F.col("_whole"), chunk).otherwise(F.coalesce(F.col("_to") - at, F.length("chunk")))
    cut = cut.select(
        "doc_id", "_rh", "_copies", "i", "_whole",
        F.substring("chunk", F.when(F.col("_whole"), 1).otherwise(at - start + 1), length).alias("piece"),
    )
    whole = cut.filter("_whole").groupBy("doc_id", "_rh", "_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda p: p["piece"]), "").alias("piece"))
    return cut.filter("not _whole").drop("_whole").unionByName(whole.withColumn("i", F.lit(0)))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids): one row per document, ids as little-endian unsigned 32-bit integers.

    A text of one chunk has no boundary to look for and is encoded where it is read.  A null or empty text has no
    ids; null and repeated doc_ids keep their rows; an empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("_rh", row_hash(F.col("text")))
    one = docs.filter(F.length("text") <= chunk)
    short = one.select("doc_id", encode_column(F.col("text"), ranks_path, pattern).alias("ids"))
    pieces = _stitched(_chunked(docs.filter(F.length("text") > chunk), chunk, overlap, pattern), chunk)
    long = (
        pieces.withColumn("ids", encode_column(F.col("piece"), ranks_path, pattern))
        .groupBy("doc_id", "_rh", "_copies").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("_p"))
        .select("doc_id", F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["ids"])), "")).alias("ids"),
                F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    )
    return short.unionByName(long.drop("_copy"))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``bytes`` to (doc_id, ids)."""
    return encoded.withColumn("bytes", decode_column(F.col("ids"), ranks_path))
