"""What several operators of this folder share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import remember_staged, staging_dir


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so other columns cannot clash; a null text is the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, _rh, _text): the row with all its columns in one struct, so that none clashes with a working column."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct("*").alias("row"), "doc_id", row_hash(text).alias("_rh"), text.alias("_text"))


def with_text(row: Column, text: Column, columns: list[str]) -> Column:
    """The row with another text, and its n_chars where it has one."""
    row = row.withField("text", text)
    return row.withField("n_chars", F.length(text).cast("long")) if "n_chars" in columns else row


def row_hash(text: Column) -> Column:
    """With the id it names a row by content: rows equal in both are the same document and get the same result."""
    return F.xxhash64(text)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, row hash); a null id equals a null id.

    The hash is a plain equality key, so rows with null ids are spread by their text.
    """
    return (left["_rh"] == right["_rh"]) & left["doc_id"].eqNullSafe(right["doc_id"])


class Scratch:
    """Tables that one operator call writes below the shared folder (``spark.checkpoint.dir``) and reads again.

    A stored table cuts the lineage: what comes later reads files and survives lost executors.  ``drop`` removes a
    table as soon as a later one replaces it; ``rankweave.session.drop_staged`` removes the others.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        if spark.conf.get(BATCH) == "10000":  # Spark's default: ten thousand whole texts at once in a Python worker
            spark.conf.set(BATCH, "2000")
        self.root = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self) -> str:
        """Place of a new table."""
        self.count += 1
        return remember_staged(f"{self.root}/{self.count}")

    def store(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def block_pairs(df: DataFrame, keys: list[str], order: Column, block: int, copies: str | None = None) -> DataFrame:
    """Deals each group out over pairs of blocks of about ``block`` rows, so that no task ever holds a whole group.

    Every row gets a block number in 0..n-1 (n from the group's count, by a hash of ``order``) and goes to the n pairs
    (i, j), i <= j, that contain its block.  Two rows of a group meet in exactly the pair of their block numbers.
    Adds ``_i``, ``_j`` and ``_side`` (-1: in both, 0: the row is of block i, 1: of block j).
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64(order, F.lit(17)), F.col("_n")).cast("int")
    return (
        df.join(sizes, keys)
        .withColumn("_b", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_i", F.least("_b", "_o"))
        .withColumn("_j", F.greatest("_b", "_o"))
        .withColumn("_side", F.when(F.col("_i") == F.col("_j"), -1).when(F.col("_b") == F.col("_i"), 0).otherwise(1))
        .drop("_n", "_b", "_o")
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
