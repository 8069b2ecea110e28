"""Embedding near-dedup by an exact metric range join.

On unit vectors a cosine of c is the Euclidean distance sqrt(2 - 2c) = r.  Pivots divide the vectors of a label into
cells, each vector at home with its nearest pivot.  By the triangle inequality a partner of x that is at home with
pivot q lies so that d(x, q) <= d(x, p) + 2r and d(x, q) <= R(q) + r, with p the pivot of x and R(q) the radius of the
cell, so x visits just those cells, and only of pivots before its own: the pair is found in the earlier cell.  Cells
join on their own, in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from rankweave.llm.common import Scratch, block_pairs
from rankweave.llm.components import components

COSINE = 0.93
CELL = 4096  # vectors for which a label gets one more pivot
MOST_PIVOTS = 4096  # of all labels together, so that every task can hold them; beyond it cells grow and are cut into more blocks
BLOCK = 1024
DOUBT = 1e-9  # cosines so close to the threshold are computed again in the plain way
BLUR = 1e-7  # a distance near 0 is the root of a difference of cosines, so it is computed with about 3e-8 of error


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and has only finite components."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _links(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least ``least``, in double precision."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    cosine = (x @ y.T) / (nx[:, None] * ny[None, :])
    near = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < DOUBT)):
        near[i, j] = float((x[i] * y[j]).sum()) / float(nx[i] * ny[j]) >= least
    return near


def _joined(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """One pair of blocks of a cell -> per vector: the copies that it links with, and a smaller vector of its component (if any).

    Only rows at home or of an earlier step meet: home with home, home with visitor.
    """
    side, home, ids, copies = (frame[c].to_numpy() for c in ("_side", "home", "node", "copies"))
    rows, columns = np.nonzero(side <= 0)[0], np.nonzero(side != 0)[0]
    if not len(rows) or not len(columns):
        return pd.DataFrame({"node": ids[:0], "links": ids[:0], "root": ids[:0]})
    v = _matrix(frame["v"])
    near = _links(v[rows], v[columns], least) & (home[rows][:, None] | home[columns][None, :])
    if side[0] < 0:  # one block with itself
        np.fill_diagonal(near, False)
    links = np.zeros(len(frame), np.int64)
    links[rows] += near @ copies[columns]
    if side[0] >= 0:
        links[columns] += near.T @ copies[rows]
    root = ids.copy()
    while True:  # smallest id of the component within the block
        low = np.where(near, root[columns][None, :], np.iinfo(np.int64).max).min(axis=1)
        after = root.copy()
        after[rows] = np.minimum(after[rows], low)
        low = np.where(near, after[rows][:, None], np.iinfo(np.int64).max).min(axis=0)
        after[columns] = np.minimum(after[columns], low)
        if (after == root).all():
            break
        root = after
    some = links > 0
    return pd.DataFrame({"node": ids[some], "links": links[some], "root": root[some]})


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ pivots.T))


def _pivots(nodes: DataFrame, cell: int, most: int) -> dict:
    """(label, dims) -> unit vectors of its pivots, for labels of more than one cell; at most ``most`` and one per label."""
    counts = {(r["label"], r["dims"]): r["n"] for r in nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > cell).orderBy(F.desc("n")).limit(most).collect()}
    total = sum(counts.values())
    cell = max(cell, -(-total // most))
    wanted = {k: -(-n // cell) for k, n in counts.items() if n > cell}
    if not wanted:
        return {}
    asked = nodes.sparkSession.createDataFrame([(*k, n) for k, n in wanted.items()], StructType([
        nodes.schema["label"], nodes.schema["dims"], StructField("wanted", IntegerType())]))
    rate = min(1.0, 8 / cell)  # about eight candidates for a pivot; the first by a hash are taken, without their vectors
    draw = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30))
    likely = nodes.withColumn("draw", draw).filter(F.col("draw") < int(rate * (1 << 30)) + 1)
    taken = likely.join(F.broadcast(asked), ["label", "dims"]).groupBy("label", "dims").agg(
        F.array_sort(F.collect_list(F.struct("draw", "node"))).alias("c"), F.first("wanted").alias("wanted")).select(
        F.explode(F.slice("c", F.lit(1), F.col("wanted"))["node"]).alias("node"))
    drawn = likely.join(taken, "node", "left_semi").select("label", "dims", "v", "draw", "node").collect()
    out: dict = {}
    for r in sorted(drawn, key=lambda r: (r["draw"], r["node"])):
        v = np.frombuffer(r["v"], np.float64)
        out.setdefault((r["label"], r["dims"]), []).append(v / np.sqrt((v * v).sum()))
    return {k: np.stack(v) for k, v in out.items() if len(v) > 1}


def _housed(nodes: DataFrame, pivots: dict) -> DataFrame:
    """Adds each vector's home cell and its distance to that pivot; -1 in labels without pivots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(cell=0, distance=-1.0)
            for key, rows in frame.groupby(["label", "dims"]).groups.items():
                if key in pivots:
                    d = _distances(_matrix(frame.loc[rows, "v"]), pivots[key])
                    frame.loc[rows, "cell"], frame.loc[rows, "distance"] = d.argmin(axis=1), d.min(axis=1)
            yield frame

    return nodes.mapInPandas(run, StructType([*nodes.schema.fields, StructField("cell", IntegerType()), StructField("distance", DoubleType())]))


def _visits(housed: DataFrame, pivots: dict, radii: dict, reach: float) -> DataFrame:
    """The rows at home, and their copies in the earlier cells where a partner may be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(home=True)
            for key, rows in frame.groupby(["label", "dims"]).groups.items():
                if key in pivots:
                    own, near = frame.loc[rows, "cell"].to_numpy(), frame.loc[rows, "distance"].to_numpy()
                    d = _distances(_matrix(frame.loc[rows, "v"]), pivots[key])
                    radius = np.array([radii.get((*key, q), -np.inf) for q in range(d.shape[1])])
                    may = (d <= near[:, None] + 2 * reach + BLUR) & (d <= radius + reach + BLUR) & (np.arange(d.shape[1]) < own[:, None])
                    which, cell = np.nonzero(may)
                    yield frame.loc[rows].iloc[which].assign(cell=cell, home=False)

    return housed.mapInPandas(run, StructType([*housed.schema.fields, StructField("home", BooleanType())]))


def link_vectors(
    vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, most_pivots: int = MOST_PIVOTS, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    Equal vectors of a label are one node, so copies are counted and never paired.  Null labels, and vectors that are
    null, zero or not finite, link with nothing; vectors of other lengths do not meet.  Rows with equal vec_id are rows
    of their own.  A null vec_id counts as larger than any other.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    scratch = Scratch(vectors.sparkSession, "metric-join")
    able = rows.filter(usable(F.col("v")) & F.col("label").isNotNull()).withColumns({"vh": F.xxhash64("v"), "dims": F.size("v")})

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, np.float64).tobytes() for x in v], dtype=object)

    nodes = scratch.store(
        able.groupBy("label", "dims", "vh", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()))
    slim = nodes.select("label", "dims", "node", "copies", packed("v").alias("v"))
    pivots = _pivots(slim, cell, most_pivots)
    housed = scratch.store(_housed(slim, pivots))
    radii = {(r["label"], r["dims"], r["cell"]): r["r"] for r in housed.filter("distance >= 0").groupBy("label", "dims", "cell").agg(
        F.max("distance").alias("r")).collect()} if pivots else {}
    placed = _visits(housed, pivots, radii, float(np.sqrt(max(0.0, 2 - 2 * cosine))))
    keys = ["label", "dims", "cell"]
    met = block_pairs(placed, keys, F.col("node"), block).groupBy(*keys, "_i", "_j").applyInPandas(
        lambda frame: _joined(frame, cosine), "node long, links long, root long")
    met = scratch.store(met)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    known = (
        nodes.join(links, "node", "left").join(classes.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("component", F.coalesce("component", "node")))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "component").select(
        "label", "vh", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    linked = able.join(known, ["label", "vh", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~(usable(F.col("v")) & F.col("label").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))
