"""Incremental runs: only keys the target does not hold yet are processed and appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, StructField, StructType,
    TimestampNTZType, TimestampType,
)

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}


def new_rows(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return df.join(done.select(*key), list(key), "left_anti")


def append_new(df: DataFrame, table: str, key: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Append the new rows to a table, creating it when absent; running it again adds nothing.

    One distributed job; duplicates of a key inside ``df`` are all kept, as in a first write.  Columns may come, be missing
    or get wider types: see :func:`evolve`.
    """
    spark = df.sparkSession
    finish_swap(spark, table)
    if not spark.catalog.tableExists(table):
        writer = df.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
        return spark.table(table)
    evolve(spark, table, df.schema)
    target = spark.table(table)
    fresh = new_rows(df, target, key)
    columns = [(F.col(f.name) if _like(df.schema, f.name) else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema]
    fresh.select(*columns).write.insertInto(table)
    return spark.table(table)


def wider(old: DataType, new: DataType) -> DataType:
    """The smallest type that holds all values of both without loss; text where there is no other."""
    if old == new or isinstance(new, NullType):
        return old
    if isinstance(old, NullType):
        return new
    pair = (type(old), type(new))
    if all(t in _WHOLE for t in pair):
        return max(old, new, key=lambda t: _WHOLE.index(type(t)))
    if set(pair) <= {FloatType, DoubleType, ByteType, ShortType, IntegerType}:  # doubles hold every int, floats only shorts
        return FloatType() if IntegerType not in pair and DoubleType not in pair else DoubleType()
    if DecimalType in pair and set(pair) <= {DecimalType, *_WHOLE}:
        whole, scale = 0, 0
        for t in (old, new):
            digits, places = (t.precision, t.scale) if isinstance(t, DecimalType) else (_DIGITS[type(t)], 0)
            whole, scale = max(whole, digits - places), max(scale, places)
        return DecimalType(whole + scale, scale) if whole + scale <= 38 else StringType()
    if set(pair) == {DateType, TimestampNTZType} or set(pair) == {DateType, TimestampType}:
        return old if isinstance(new, DateType) else new
    return StringType()


def evolve(spark: SparkSession, table: str, schema: StructType) -> StructType:
    """Give a table every column of ``schema``, and types wide enough for both; returns its schema.

    New columns alone change the catalog only: the stored files stay and have nulls there.  A wider type rewrites the table
    beside itself and swaps the two; partition columns are kept as such.
    """
    old = spark.table(table).schema
    names = {f.name.lower(): f for f in old}
    merged = [StructField(f.name, wider(f.dataType, schema[g].dataType) if (g := _like(schema, f.name)) else f.dataType) for f in old]
    added = [StructField(f.name, StringType() if isinstance(f.dataType, NullType) else f.dataType) for f in schema if f.name.lower() not in names]
    widened = any(m.dataType != f.dataType for m, f in zip(merged, old))
    partitions = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if widened:
        rows = spark.table(table).select(*[F.col(m.name).cast(m.dataType).alias(m.name) for m in merged],
                                         *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(f"{table}__next")
        spark.sql(f"ALTER TABLE {table}__next SET TBLPROPERTIES ('complete' = 'true')")
        finish_swap(spark, table)
    elif added:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in added)})")
    return spark.table(table).schema


def _like(schema: StructType, name: str) -> str | None:
    return next((f.name for f in schema if f.name.lower() == name.lower()), None)


def finish_swap(spark: SparkSession, table: str) -> None:
    """Put a completely written ``<table>__next`` in the table's place, also where an earlier run ended half way.

    The old table is renamed and dropped only when the new one stands under its name, so at every moment one of them is
    whole; a partitioned one is copied, and ``__next`` is dropped after that.  A ``__next`` that was not written to its end
    is dropped.
    """
    following, old = f"{table}__next", f"{table}__old"
    if spark.catalog.tableExists(following):
        if "complete" in {r["key"] for r in spark.sql(f"SHOW TBLPROPERTIES {following}").collect()}:
            partitions = [c.name for c in spark.catalog.listColumns(following) if c.isPartition]
            if partitions:  # a catalog may keep the old places of renamed partitions; a copy can be made again until it is whole
                spark.table(following).write.mode("overwrite").partitionBy(*partitions).saveAsTable(table)
                spark.sql(f"DROP TABLE {following}")
                return
            if spark.catalog.tableExists(table):
                spark.sql(f"DROP TABLE IF EXISTS {old}")
                spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
            spark.sql(f"ALTER TABLE {following} RENAME TO {table}")
            spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES ('complete')")
        else:
            spark.sql(f"DROP TABLE {following}")
    if spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
