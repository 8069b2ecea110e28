"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features approximate a Gaussian kernel.  Each task sums its part of the normal equations; only the sums, whose
size depends on the number of features, reach the driver.  Calibration uses leave-one-out scores, which a ridge fit has
in closed form, summed in bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch

STATISTICS = 20
FEATURES = 256
RIDGE = 1e-3  # times the number of rows
BINS = 2048
SEED = 20
THRESHOLD = 0.7

# Classes of the first code points: 0 other symbol, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark.
_CLASS = np.zeros(0x250, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s.isspace() else 5 if _s in ".,;:?'\"-()" else 0


def statistics(text: str) -> np.ndarray:
    """Statistics of one whole text, all of them ratios or logarithms; zeros for the empty text."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(points)
    kinds = np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], 1)
    out[0] = np.log1p(n)
    out[1:7] = np.bincount(kinds, minlength=6) / n
    out[7] = (points > 127).mean()
    low = np.bincount(np.minimum(points, 127), minlength=128)
    out[8], out[9] = low[ord("!")] / n, low[ord("|")] / n
    share = low[low > 0] / n
    out[10] = -(share * np.log(share)).sum()
    out[11] = (points[1:] == points[:-1]).mean() if n > 1 else 0
    words = text.split()
    if words:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out[12], out[13] = np.log(lengths.mean()), np.log1p(lengths.std())
        out[14] = len(set(words)) / len(words)
        out[15] = sum(map(str.isalpha, words)) / len(words)
        out[16] = sum(map(str.isupper, words)) / len(words)
    lines = [line for line in text.split("\n") if line]
    if lines:
        out[17] = np.log1p(n / len(lines))
        out[18] = len(set(lines)) / len(lines)
        out[19] = sum(line[-1] in ".?:;,\"" for line in lines) / len(lines)
    return out


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])

    return run(text)


@dataclass(frozen=True)
class QualityModel:
    """mean, scale: of the statistics; frequencies, phases: of the features; weights; steps: raw score to probability."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(rows), 1))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(rows) @ self.weights, *self.steps), 0, 1)


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression of y in the given order."""
    values, weights, counts = [], [], []
    for value, weight in zip(y, w):
        values.append(value), weights.append(weight), counts.append(1)
        while len(values) > 1 and values[-2] >= values[-1]:
            total = weights[-2] + weights[-1]
            values[-2:] = [(values[-2] * weights[-2] + values[-1] * weights[-1]) / total]
            weights[-2:] = [total]
            counts[-2:] = [counts[-2] + counts[-1]]
    return np.repeat(values, counts)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix by elimination; no threaded library call in the driver."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for k in range(n):
        both[k] /= both[k, k]
        column = both[:, k].copy()
        column[k] = 0
        both -= column[:, None] * both[k]
    return both[:, n:]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, STATISTICS))


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS) -> QualityModel:
    """rows: ``stats`` (array of double) and ``y`` (0 or 1).  All rows count; a row with a null is left out.

    Without rows nothing is known against any text, and the model scores 1.0.
    """
    rows = rows.select("stats", F.col("y").cast("double").alias("y")).dropna()
    stats = range(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("stats")[i]) for i in stats], *[F.stddev_pop(F.col("stats")[i]) for i in stats]).first()
    n = moments[0]
    draw = np.random.default_rng(SEED)
    frequencies = draw.normal(size=(STATISTICS, features)) * np.sqrt(2 / STATISTICS)
    phases = draw.uniform(0, 2 * np.pi, features)
    if not n:
        zeros = np.zeros(STATISTICS)
        return QualityModel(zeros, zeros + 1, frequencies, phases, np.zeros(features + 1), (np.zeros(1), np.ones(1)))
    mean, scale = np.array(moments[1:1 + STATISTICS]), np.maximum(np.array(moments[1 + STATISTICS:]), 1e-6)
    plain = QualityModel(mean, scale, frequencies, phases, np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    size = features + 1

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for frame in frames:
            if len(frame):
                phi = plain.features(_stack(frame["stats"]))
                total += phi.T @ np.hstack([phi, frame["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": range(size), "sums": list(total)})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"][:1], "sums": [np.sum(np.stack(frame["sums"].to_numpy()), axis=0)]})

    kind = "i int, sums array<double>"
    parts = rows.mapInPandas(summed, kind).groupBy("i").applyInPandas(joined, kind)
    table = np.stack([r["sums"] for r in sorted(parts.collect(), key=lambda r: r["i"])])  # features x (features + 1)
    inverse = _inverse(table[:, :size] + ridge * n * np.eye(size))
    weights = (inverse * table[:, size]).sum(axis=1)

    def left_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                phi, y = plain.features(_stack(frame["stats"])), frame["y"].to_numpy()
                lever = np.minimum(np.einsum("ij,jk,ik->i", phi, inverse, phi, optimize=True), 0.999)
                s = (phi @ weights - lever * y) / (1 - lever)
                yield pd.DataFrame({"bin": (np.clip(s + 0.5, 0, 1.9999) / 2 * bins).astype(int), "s": s, "y": y})

    curve = (
        rows.mapInPandas(left_out, "bin int, s double, y double")
        .groupBy("bin").agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
        .collect()  # at most one row per bin
    )
    curve.sort(key=lambda r: r["s"])
    level = pool_adjacent(np.array([r["y"] for r in curve]), np.array([r["n"] for r in curve], float))
    return QualityModel(mean, scale, frequencies, phases, weights, (np.array([r["s"] for r in curve]), level))


def score_column(stats: Column, model: QualityModel) -> Column:
    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_stack(column)))

    return run(stats)


def held_out(doc_id: Column) -> Column:
    """Rows that the classifier never learns from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """stats: doc_id and ``stats``.  Learns from the labelled rows that are not held out; labels without a value, and labels
    of documents that are not there, are left out; repeated rows count once each."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("y")).dropna().filter(~held_out(F.col("_id")))
    return fit(stats.join(known, stats["doc_id"] == known["_id"]).select("stats", "y"))


def score(stats: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of stats."""
    return stats.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("stats"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    stats = statistics_column(F.col("text"))
    known = Scratch(docs.sparkSession, "quality").store(docs.select("doc_id", stats.alias("stats")))
    return docs.filter(score_column(stats, train(known, labels)) >= threshold)
