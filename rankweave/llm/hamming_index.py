"""Approximate nearest neighbours by multi-index hashing (Norouzi, Punjani and Fleet, 2012) over learned binary codes.

A rotation learned by iterative quantisation (Gong and Lazebnik, 2011) turns a vector into a code of bits.  Codes are
cut into substrings and each substring is an index.  By the pigeonhole principle a code within Hamming radius r agrees
with the query in some substring but for its share of r, so probing those values retrieves every code within the
radius; their vectors are then ranked by the true distance.

Bits, radius and substrings follow from the vectors: the radius is the smallest that holds the wanted share of the true
neighbours of a sample, and the substrings are those whose probes meet the least of the table.  Where even these would
meet more than all of it (vectors spread evenly in many dimensions), the codes are not cut and each query passes over
all codes once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch
from rankweave.llm.metric_join import usable

MOST_BITS = 256  # a code has 64 bits for each 64 dimensions, up to this
RECALL = 0.97  # share of true neighbours within the radius, in the sample
SAMPLE = 20_000  # vectors that the rotation and the radius are learned from; every vector is indexed
ASKED_OF_SAMPLE = 512  # of them are queries when the radius is learned
PROBES = 2048  # of one query, at most
ROUNDS = 20
BLOCK = 4096
ASKED = 1024


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def learn_rotation(x: np.ndarray, bits: int = 64, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` values whose signs are the code)."""
    mean = x.mean(axis=0)
    centred, draw = x - mean, np.random.default_rng(9)
    _, basis = np.linalg.eigh(centred.T @ centred)
    basis = basis[:, ::-1][:, :bits]
    if basis.shape[1] < bits:  # fewer dimensions than bits: further directions at random
        more = draw.normal(size=(x.shape[1], bits - basis.shape[1]))
        basis = np.hstack([basis, more / np.linalg.norm(more, axis=0)])
    flat = centred @ basis
    rotation = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(flat.T @ np.sign(flat @ rotation))
        rotation = u @ w
    return mean, basis @ rotation


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(rows, bytes): the signs, packed."""
    return np.packbits((x - mean) @ projection > 0, axis=1)


def learn_radius(x: np.ndarray, code: np.ndarray, k: int, recall: float, asked: int = ASKED_OF_SAMPLE) -> int:
    """Smallest Hamming radius around a row that holds the share ``recall`` of its k nearest rows, over ``asked`` rows.

    Of a sample's rows; in the whole table the k nearest are no farther, so the radius holds at least as many of them.
    """
    far, norms = [], (x * x).sum(axis=1)
    for i in range(min(asked, len(x))):
        gap = norms - 2 * (x @ x[i])
        gap[i] = np.inf
        near = np.argpartition(gap, min(k, len(x) - 1) - 1)[:min(k, len(x) - 1)] if len(x) > 1 else []
        far.append(np.bitwise_count(code[near] ^ code[i]).sum(axis=1))
    far = np.sort(np.concatenate(far)) if far else np.zeros(0, int)
    return int(far[int(np.ceil(recall * len(far))) - 1]) if len(far) else 0


def best_substrings(bits: int, radius: int, probes: int = PROBES) -> int:
    """Number of substrings whose probes meet the smallest share of evenly used codes; 0 (codes stay whole) if that is all of them."""
    best, found = 1.0, 0
    for n in (n for n in range(2, bits // 2 + 1) if bits % n == 0 and bits // n <= 32):
        width = bits // n
        values = [sum(comb(width, d) for d in range(s + 1)) for s in shares(bits, n, radius)]
        if sum(values) <= probes and sum(values) / 2**width < best:
            best, found = sum(values) / 2**width, n
    return found


def shares(bits: int, substrings: int, radius: int) -> list[int]:
    """Radius to probe in each substring (-1: none) so that no code within ``radius`` is missed."""
    if radius >= bits:
        return [bits // substrings] + [-1] * (substrings - 1)
    whole, rest = divmod(radius, substrings)
    return [whole if j <= rest else whole - 1 for j in range(substrings)]


def _substrings(packed: np.ndarray, substrings: int) -> np.ndarray:
    """(rows, substrings) values."""
    bits = np.unpackbits(packed, axis=1).reshape(len(packed), substrings, -1)
    return bits @ (1 << np.arange(bits.shape[2]))


def _flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(max(-1, radius) + 1) for c in combinations(range(width), k)], dtype=np.int64)


def _search(frame: pd.DataFrame, j: int, share: list[int], radius: int, k: int) -> pd.DataFrame:
    """One bucket of substring j: each query's k best of the codes within the radius that no earlier substring finds."""
    asked = frame["asked"].to_numpy()
    queries, rows = frame[asked], frame[~asked]
    out = []
    if len(queries) and len(rows):
        v, code, ids, keys = _matrix(rows["v"]), np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), rows["vec_id"].to_numpy(), rows["_row"].to_numpy()
        for q, q_code, q_row in zip(queries["v"], queries["code"], queries["_row"]):
            differ = np.frombuffer(q_code, np.uint8) ^ code
            near = np.bitwise_count(differ).sum(axis=1) <= radius
            near &= keys != q_row
            near = np.nonzero(near)[0]
            if j and len(near):
                parts = np.bitwise_count(_substrings(differ[near], len(share))[:, :j])
                near = near[~(parts <= np.array(share[:j])).any(axis=1)]
            if len(near):
                gap = v[near] - np.frombuffer(q, np.float64)
                score = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                out.append(pd.DataFrame({"query": q_row, "vec_id": ids[near][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "vec_id": [], "score": []})


def _probed(index: DataFrame, asked: DataFrame, radius: int, bits: int, substrings: int, k: int, block: int, ask: int) -> DataFrame:
    """(query, vec_id, score): up to k for each query and bucket.

    Every vector goes to its value of each substring, every query to the values it has to probe.  Large buckets are cut
    into blocks of vectors and blocks of queries, so a vector that very many rows share fills no single task.  Without
    substrings, or with a radius of all bits, there is one bucket.
    """
    cut = substrings if radius < bits else 0
    share = shares(bits, cut, radius) if cut else [radius]
    flips = [_flips(bits // cut, s) for s in share] if cut else [np.zeros(1, np.int64)]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), bits // 8)
            values = _substrings(packed, cut) if cut else np.zeros((len(frame), 1), np.int64)
            for j in range(len(flips)):
                if len(flips[j]) and len(frame):
                    probes = flips[j] if frame["asked"].iat[0] else flips[j][:1]
                    at = np.repeat(np.arange(len(frame)), len(probes))
                    yield frame.iloc[at].assign(j=j, value=(values[:, j][:, None] ^ probes).ravel())

    kind = "_row long, vec_id {}, v binary, code binary, asked boolean, j int, value long".format(index.schema["vec_id"].dataType.simpleString())
    cells, probes = (f.mapInPandas(spread, kind) for f in (index.withColumn("asked", F.lit(False)), asked.withColumn("asked", F.lit(True))))
    sizes = cells.groupBy("j", "value").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_nb"))
    loads = probes.groupBy("j", "value").agg(F.ceil(F.count(F.lit(1)) / F.lit(ask)).cast("int").alias("_na"))
    sizes = sizes.join(loads, ["j", "value"])  # at most one row per bucket
    own = lambda n: F.pmod(F.xxhash64("_row", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = cells.join(sizes, ["j", "value"]).withColumn("_b", own("_nb")).withColumn("_a", every("_na"))
    probes = probes.join(sizes, ["j", "value"]).withColumn("_a", own("_na")).withColumn("_b", every("_nb"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _search(frame, int(frame["j"].iat[0]), share, radius, k)

    return cells.unionByName(probes).groupBy("j", "value", "_a", "_b").applyInPandas(
        run, "query long, vec_id {}, score double".format(index.schema["vec_id"].dataType.simpleString()))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, bits: int | None = None, substrings: int | None = None, radius: int | None = None,
    recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, ask: int = ASKED, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` selects, its own row left out.

    Queries with fewer than k codes within the radius look through all codes in a second pass, so that only a table of
    too few vectors gives fewer than k.  What is not given is chosen: bits from the dimensions, the radius from a sample of
    at most ``sample`` vectors so that it holds the share ``recall`` of their neighbours, the substrings from both.  Vectors that are null, zero or not finite, and vectors of another length than
    most, take no part; ties go to the smaller vec_id; rows with equal vec_id are candidates of each other.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamming-index")
    able = vectors.filter(usable(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("_q"), F.col(vector_col).cast("array<double>").alias("a"))
    usual = able.groupBy(F.size("a").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], f"query_id {able.schema['vec_id'].dataType.simpleString()}, rank int, vec_id {able.schema['vec_id'].dataType.simpleString()}, score double")
    if usual is None:
        return empty
    able = able.filter(F.size("a") == usual["d"])
    bits = bits or min(MOST_BITS, 64 * -(-usual["d"] // 64))
    if bits % 8 or bits % (substrings or 1):
        raise ValueError("bits must be a multiple of 8 and of the number of substrings")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [np.stack(f["a"].to_numpy()) for f in frames if len(f)]
        x = np.concatenate(found)
        mean, projection = learn_rotation(x, bits)
        held = radius if radius is not None else learn_radius(x, codes(x, mean, projection), k, recall)
        yield pd.DataFrame({"mean": [mean.tobytes()], "projection": [projection.tobytes()], "radius": [held]})

    # Rows are drawn by a hash below a threshold, so that few more than the sample are ever sorted.
    share = 1.2 * sample / usual["count"]
    drawn = able if share >= 1 else able.filter(F.pmod(F.xxhash64("a", "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.orderBy(F.xxhash64("a"), "vec_id").limit(sample).select("a").coalesce(1)
    learned = drawn.mapInPandas(learn, "mean binary, projection binary, radius int").first()
    radius = learned["radius"]
    substrings = best_substrings(bits, radius) if substrings is None else substrings
    mean = np.frombuffer(learned["mean"])
    projection = np.frombuffer(learned["projection"]).reshape(usual["d"], bits)

    @F.pandas_udf("struct<v: binary, code: binary>")
    def coded(a: pd.Series) -> pd.DataFrame:
        x = np.stack(a.to_numpy()).astype(np.float64) if len(a) else np.zeros((0, usual["d"]))
        return pd.DataFrame({"v": [r.tobytes() for r in x], "code": [r.tobytes() for r in codes(x, mean, projection)]})

    index = scratch.store(able.withColumn("_c", coded("a")).select("vec_id", "_q", "_c.v", "_c.code").withColumn("_row", F.monotonically_increasing_id()))
    rows = index.select("_row", "vec_id", "v", "code")
    asked = index.filter("_q").select("_row", "vec_id", "v", "code")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = scratch.store(best(_probed(rows, asked, radius, bits, substrings, k, block, ask)))
    full = found.filter(F.col("rank") == k).select(F.col("query").alias("_row"))
    few = asked.join(full, "_row", "left_anti")
    all_found = found.join(few.select(F.col("_row").alias("query")), "query", "left_anti").unionByName(
        best(_probed(rows, few, bits, bits, 0, k, block, ask)))
    names = asked.select(F.col("_row").alias("query"), F.col("vec_id").alias("query_id"))
    return all_found.join(names, "query").select("query_id", "rank", "vec_id", "score")
