"""Exact top-k inner products by multi-resolution segment statistics (Hwang, Han and Ahn, 2012).

A vector is cut into segments of w components, each with mean m and deviation s.  For a query q and a vector v,

    |q - v|^2 >= sum of w ((m_q - m_v)^2 + (s_q - s_v)^2)

over the segments, and the bound rises as segments are split.  With the known lengths of both, a lower bound of the distance
is an upper bound of the inner product: q.v <= sum of w (m_q m_v + s_q s_v).  Each query meets the vectors block by block:
the coarsest bound is taken of all of them, the exact products of the best few give the score to beat, only vectors whose bound
reaches it go on to the next finer level, and what survives the finest level is computed exactly.  Nothing else is cut
away, so the result is that of a full scan, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch

LEVELS = (1, 4, 16)  # segments, coarse to fine
BLOCK = 4096  # vectors and queries of a cell, about
EXACT = float(1 << 53)  # integers up to here are exact in a double
LONG = np.iinfo(np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): means and deviations of each row's segments, times the root of the segment's width."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    width = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / width
    gap = x - np.repeat(mean, width, axis=1)
    deviation = np.sqrt(np.add.reduceat(gap * gap, edges[:-1], axis=1) / width)
    return np.hstack([mean, deviation]) * np.sqrt(np.concatenate([width, width]))


def _best(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller name."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.nonzero(score >= least)[0]
    else:
        some = np.arange(len(score))
    return some[np.lexsort((names[some], -score[some]))][:k]


def search_block(
    queries: np.ndarray, vectors: np.ndarray, names: np.ndarray, own: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS
) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Per query the places and the exact products of its k best vectors; at last how many products were computed.

    ``names`` break ties, ``own`` is the place of the query's own row or -1.  The numbers are integers in doubles whose
    products stay within 2^53.
    """
    places, scores, computed = [], [], 0
    of_queries = [statistics(queries, n) for n in levels]
    of_vectors = [statistics(vectors, n) for n in levels]
    # Slack for the rounding of the bounds; products are integers, so half of one is never more than a tie.
    slack = 0.5 + 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0.0)
    for i, query in enumerate(queries):
        known = np.full(len(vectors), np.nan)  # exact products so far
        left, least = np.arange(len(vectors)), -np.inf
        left = left[left != own[i]]
        for q, v in zip(of_queries, of_vectors):
            if len(left) <= k:
                break
            bound = (v if len(left) == len(v) else v[left]) @ q[i]
            first = left[np.argpartition(bound, len(bound) - k)[-k:]]
            first = first[np.isnan(known[first])]
            known[first] = vectors[first] @ query
            computed += len(first)
            done = known[~np.isnan(known)]
            least = max(least, np.partition(done, len(done) - k)[len(done) - k])
            left = left[bound >= least - slack[i]]
        todo = left[np.isnan(known[left])]
        known[todo] = vectors[todo] @ query if len(todo) < len(vectors) // 2 else (vectors @ query)[todo]
        computed += len(todo)
        best = left[_best(known[left], names[left], k)]
        places.append(best)
        scores.append(known[best])
    return places, scores, computed


def _search_whole(queries: np.ndarray, vectors: np.ndarray, names: np.ndarray, own: np.ndarray, k: int) -> tuple[list, list]:
    """The same for integers of any size, without bounds; products beyond a long are cut to its range."""
    places, scores = [], []
    for i, query in enumerate(queries):
        left = np.delete(np.arange(len(vectors)), own[i]) if own[i] >= 0 else np.arange(len(vectors))
        products = [min(max(int(x), LONG.min), LONG.max) for x in vectors[left] @ query] if vectors.shape[1] else [0] * len(left)
        score = np.array(products, object)
        best = sorted(range(len(left)), key=lambda p: (-score[p], names[left[p]]))[:k]
        places.append(left[best])
        scores.append(score[best])
    return places, scores


def _rows(table: pa.Table, dims: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dims)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, levels: tuple[int, ...] = LEVELS, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x) for each row that ``is_query`` selects.

    Candidates are all rows of as many components but the query's own; fewer than k are returned whole.  Ties go to the smaller vec_id,
    a null id last.  Rows with equal ids are rows of their own.  Vectors that are null or hold a null or a non-finite
    component take no part, zero vectors do, and vectors without components have the product 0.  floor(scale * x) is cut to the
    range of a long, as is a product beyond it; everything else is exact.

    Rows are hashed into blocks of about ``block`` queries and vectors; a cell of both is one task's unit and returns
    k rows per query, which are limited again per partition before the last shuffle.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "segment-search")
    a = F.col(vector_col).cast("array<double>")
    able = F.coalesce(F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = scratch.store(
        vectors.filter(able).select(
            F.col(id_col).alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("_q"),
            F.transform(a, lambda x: F.floor(x * scale)).alias("v"))
        .withColumn("dims", F.size("v")).withColumn("_row", F.monotonically_increasing_id()))
    counts = rows.groupBy("dims").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nv"), F.ceil(F.count_if("_q") / block).cast("int").alias("_nq")).filter("_nq > 0")
    placed = rows.join(counts, "dims")

    def deal(df: DataFrame, mine: str, n_mine: str, other: str, n_other: str) -> DataFrame:
        dealt = df.withColumn(mine, F.pmod(F.xxhash64("_row", F.lit(12)), F.col(n_mine)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        columns = ["dims", "_a", "_b", "_row", "vec_id", "v"]
        return dealt.select(*columns).toDF(*columns)  # new names, as both sides come from one table

    asked = deal(placed.filter("_q"), "_a", "_nq", "_b", "_nv")
    held = deal(placed, "_b", "_nv", "_a", "_nq")
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": left["vec_id"].slice(0, 0), "vec_id": left["vec_id"].slice(0, 0), "score": pa.array([], pa.int64())})
        dims = left["dims"][0].as_py()
        q, v = _rows(left, dims), _rows(right, dims)
        row_of = {r: p for p, r in enumerate(right["_row"].to_pylist())}
        own = np.array([row_of.get(r, -1) for r in left["_row"].to_pylist()])
        ids = right["vec_id"].combine_chunks()
        order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        ties = np.empty(len(order), np.int64)
        ties[order] = np.arange(len(order))
        largest = [float(np.abs(x.astype(float)).max(initial=0.0)) for x in (q, v)]
        if dims and dims * largest[0] * largest[1] < EXACT:
            places, scores, _ = search_block(q.astype(float), v.astype(float), ties, own, k, levels)
        else:
            places, scores = _search_whole(q.astype(object), v.astype(object), ties, own, k)
        at = np.repeat(np.arange(len(q)), [len(p) for p in places])
        score = pa.array(np.concatenate(scores).astype(np.int64), pa.int64())
        return pa.Table.from_arrays([
            left["_row"].take(at), left["vec_id"].take(at), ids.take(np.concatenate(places).astype(np.int64)), score], names)

    cells = ["dims", "_a", "_b"]
    found = asked.groupBy(*cells).cogroup(held.groupBy(*cells)).applyInArrow(run, f"query bigint, query_id {kind}, vec_id {kind}, score bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
