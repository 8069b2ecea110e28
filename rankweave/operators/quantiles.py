"""Exact quantiles of large groups in bounded memory: histograms refined around each wanted order statistic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.session import stage

BUCKETS = 1024
FINISH = 4096  # a range of at most this many rows is sorted
_MAX = 1.7976931348623157e308


def _bucket(buckets: int) -> Column:
    """Number of v's bucket in its range, never falling with v.

    The ends of the range have buckets of their own, so each round leaves out at least two distinct values.
    """
    low, high = F.greatest("lo", F.lit(-_MAX)), F.least("hi", F.lit(_MAX))
    share = F.try_divide(F.col("v") / 2 - low / 2, high / 2 - low / 2)  # halves: the width may exceed the largest double
    inner = F.least(F.lit(buckets - 1), F.floor(share * buckets))
    return F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), buckets).otherwise(inner).cast("int")


def _inside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows within the ranges of the state.  Ranges of a group are equal or apart, so each row is met at most once."""
    ranges = state.select("_g", "lo", "hi").distinct()
    return rows.join(ranges, "_g").filter(F.col("v").between(F.col("lo"), F.col("hi")))


def _refined(rows: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    bars = (
        _inside(rows, state).groupBy("_g", "lo", "hi", _bucket(buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    )
    upto = F.sum("c").over(Window.partitionBy("_g", "lo", "hi").orderBy("bucket"))  # over the bars, not the rows
    bars = bars.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    met = state.drop("n").join(bars, ["_g", "lo", "hi"]).filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("upto")))
    return met.select(
        "_g", "rank", (F.col("at") - F.col("before")).alias("at"), F.col("c").alias("n"), F.col("least").alias("lo"), F.col("most").alias("hi"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], col: str, quantiles: Mapping[str, float], buckets: int = BUCKETS, finish: int = FINISH,
) -> DataFrame:
    """Per group: ``n`` and, under each name, the exact quantile (linear between the two neighbouring order statistics).

    A round counts each range's rows in ``buckets`` parts and goes on in the part that holds the wanted rank; ranges of at
    most ``finish`` rows are sorted.  No task holds a group's values, whatever their number.  Nulls and NaN do not count; a
    group without other values has no row, nor has an empty table.  Null keys are a group.  Infinite values are ordered.
    """
    by, names = list(by), list(quantiles)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    value = F.col(col).cast("double") + 0.0  # -0.0 becomes 0.0
    rows = stage(df.select(group.alias("_g"), value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    sizes = stage(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))

    place = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ends = [end(place[name]).cast("long") for name in names for end in (F.floor, F.ceil)]
    wanted = sizes.withColumn("rank", F.explode(F.array_distinct(F.array(*ends))))
    state = stage(wanted.select("_g", "rank", F.col("rank").alias("at"), "n", "lo", "hi"))
    wide = (F.col("lo") < F.col("hi")) & (F.col("n") > finish)
    while not (todo := state.filter(wide)).isEmpty():
        state = stage(state.filter(~wide).unionByName(_refined(rows, todo, buckets)))

    few = state.filter("lo < hi")
    order = Window.partitionBy("_g", "lo", "hi").orderBy("v")  # at most ``finish`` rows
    sorted_rows = _inside(rows, few).withColumn("at", F.row_number().over(order).cast("long") - 1)
    found = state.filter("lo = hi").select("_g", "rank", F.col("lo").alias("v")).unionByName(
        few.join(sorted_rows, ["_g", "lo", "hi", "at"]).select("_g", "rank", "v"))
    held = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))

    def between(name: str) -> Column:
        low = F.element_at("_at", F.floor(place[name]).cast("long"))
        high = F.element_at("_at", F.ceil(place[name]).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (place[name] - F.floor(place[name])))

    return sizes.join(held, "_g").select(
        *[F.col("_g")[c].alias(c) for c in by], "n", *[between(name).alias(name) for name in names])
