"""Readers for the file layouts of the workflow: typed CSV, pipe files, JSON documents, keys in the path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header.  With a ``schema`` the columns are typed; without, Spark infers them in one extra pass.

    Large files are split at line ends.  ``multi_line`` is for fields that hold line breaks; such a file is one split.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_pipe(spark: SparkSession, path: str, n_columns: int = 18) -> DataFrame:
    """Header-less '|' file as ``_c0.._cN`` text columns; rows are split on line ends, so big files are splittable."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n_columns)])
    return spark.read.option("sep", "|").option("quote", "").schema(schema).csv(path)


def read_json_documents(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One JSON document per file, a single object or a list of objects; both are read as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_path_keys(df: DataFrame, names: Sequence[str], depth: int = 1) -> DataFrame:
    """Key columns from the directories above each file: for ``root/a/b/file`` names (a, b) with depth 1."""
    parts = F.split(F.input_file_name(), "/")
    out = df
    for i, name in enumerate(names):
        back = depth + len(names) - i
        out = out.withColumn(name, F.url_decode(F.get(parts, F.size(parts) - back)))
    return out


def read_lines(spark: SparkSession, path: str | list[str], header: str | None = None) -> DataFrame:
    """(file, line): the lines of text files, without blank ones and those equal to ``header``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    kept = lines.filter(F.trim("line") != "")
    return kept if header is None else kept.filter(F.col("line") != header)


def split_bad_lines(lines: DataFrame, schema: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows typed by ``schema`` (DDL), and the lines that do not fit it, unchanged; together all lines.

    A line is bad when it has fewer or more fields than the schema or a value that is not of its type.  Every line is
    judged by all of its fields, whichever columns are read later; a scan that reads few columns would judge by these alone.
    Other columns of ``lines``, such as ``file``, stay.  An empty field is a null; fields that hold line breaks are not supported.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "sep": sep, "escape": '"'}
    read = lines.withColumn("_row", F.from_csv("line", f"{schema}, _bad STRING", options))
    fields = [F.col(f"_row.`{f.name}`") for f in read.schema["_row"].dataType if f.name != "_bad"]
    kept = [c for c in lines.columns if c != "line"]
    is_bad = F.col("_row._bad").isNotNull()
    return read.filter(~is_bad).select(*kept, *fields), read.filter(is_bad).select(*kept, "line")
