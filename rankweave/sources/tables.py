"""Table writers: one table per product, partitioned by its key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save(
    df: DataFrame, name: str, keys: Sequence[str] = (), fmt: str = "parquet", path: str | None = None
) -> DataFrame:
    """Overwrite a table (schema included), partitioned by ``keys``; returns the stored table.

    The files lie in the warehouse, or at ``path`` when given.

    Rows are clustered by the keys before the write when there are keys, without a fixed number of partitions: the
    adaptive rebalance splits a key that holds a large share of the rows and merges small ones.
    """
    rows = df.hint("rebalance", *keys) if keys else df
    writer = rows.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    writer = writer.option("path", path) if path else writer
    (writer.partitionBy(*keys) if keys else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, fmt: str = "parquet") -> DataFrame:
    """Overwrite a table bucketed and sorted by ``keys``; joins and groupings on exactly these keys read it without a shuffle.

    The rows are dealt out by the keys first, so each bucket is one file and not one per task.  As many buckets as the
    shuffles of the later joins have partitions, or more, keep this side in place.
    """
    rows = df.repartition(buckets, *keys)
    rows.write.format(fmt).mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def load(spark: SparkSession, name: str, view: str | None = None) -> DataFrame:
    """A stored table, optionally also registered as a temporary view."""
    df = spark.table(name)
    if view:
        df.createOrReplaceTempView(view)
    return df


def save_json(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """JSON files below ``path``, one directory per key value."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).json(path)


def save_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """CSV files with a header below ``path``, one directory per key value."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)
