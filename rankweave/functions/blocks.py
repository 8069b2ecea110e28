"""Block-wise exact top-k of dot products.

Queries and candidates are hashed into buckets of bounded size.  Every (query bucket, candidate bucket) cell is
one small numpy product inside a task and returns only the best k per query, so neither all pairs nor a whole
table is ever materialised, and nothing is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(column: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    if not np.isfinite(matrix).all():
        raise ValueError("vector with a non-finite value")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cell_top_k(
    queries: DataFrame,
    candidates: DataFrame,
    query_key: list[str],
    group: list[str],
    k: int,
    query_bucket: int = 4096,
    candidate_bucket: int = 2048,
) -> DataFrame:
    """Best ``k`` candidates per query inside each cell, with the cosine rounded to 4 digits.

    ``queries``: query_key + vector; ``candidates``: group + candidate + vector (``group`` is part of query_key).
    """
    def buckets(df: DataFrame, size: int) -> Column:
        # a scalar subquery: the number of buckets follows the measured rows without an action while planning
        return df.select(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("n")).scalar()

    n_q, n_c = buckets(queries, query_bucket), buckets(candidates, candidate_bucket)

    def place(df: DataFrame, own: str, key: list[str], n_own: Column, other: str, n_other: Column) -> DataFrame:
        return (
            df.withColumn(own, F.pmod(F.xxhash64(*key), n_own).cast("int"))
            .withColumn("_last", n_other - 1)
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_last"))))
            .drop("_last")
        )

    cells_q = place(queries, "_qb", query_key, n_q, "_cb", n_c)
    cells_c = place(candidates, "_cb", ["candidate"], n_c, "_qb", n_q)
    keys = group + ["_qb", "_cb"]
    types = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    out = ", ".join(f"{c} {types[c]}" for c in query_key) + ", candidate string, score double"

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in query_key + ["candidate", "score"]})
        right = right.sort_values("candidate", kind="stable")
        scores = np.round(_matrix(left["vector"]) @ _matrix(right["vector"]).T, 4) + 0.0
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(left)), order.shape[1])
        result = left[query_key].iloc[rows].reset_index(drop=True)
        result["candidate"] = right["candidate"].to_numpy()[order.ravel()]
        result["score"] = scores[rows, order.ravel()]
        return result

    return cells_q.groupBy(*keys).cogroup(cells_c.groupBy(*keys)).applyInPandas(product, out)
