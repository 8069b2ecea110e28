"""A BM25 index that grows by batches of new diseases without reading old mentions.

A concept's weight depends on how many diseases hold it and on the mean length of all diseases, so a new disease changes
the weights of old ones.  Stored are therefore no weights but what they are made of: each batch keeps its own term counts
with the lengths of its diseases, and its changes of the model-wide counts.  Reading the index sums the changes, one
short row per concept and batch, and puts the weights together.

A batch is a folder, visible from the moment its marker file lies in it; a run that ended before that is written anew.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.retrieval import concept_table, looked_up, term_table, weighted

DONE = "_done"
TERMS, CONCEPTS, DISEASES = "terms", "concepts", "diseases"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished batches, sorted."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{DONE}")))


def _part(spark: SparkSession, path: str, names: list[str], part: str) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{n}/{part}" for n in names])


def add_batch(mentions: DataFrame, path: str, batch: str) -> list[str]:
    """Add the diseases of ``mentions`` that the index does not hold yet; returns the finished batches.

    ``mentions``: model, disease, CUI, UMLS_name, semantic_type_name, as for ``bm25_index``; rows without a model, disease
    or concept are left out.  A disease that an earlier batch brought is not changed.  A batch that is there already is left as
    it is, so a repeated run adds nothing.  Of the old batches only the names of the diseases are read.
    """
    if not re.fullmatch(r"[\w.-]+", batch) or batch.startswith(("_", ".")):
        raise ValueError("a batch name holds letters, digits, '-', '.' or '_' and begins with a letter or digit")
    spark = mentions.sparkSession
    known = batches(spark, path)
    if batch in known:
        return known
    keys = ["model", "disease"]
    rows = mentions.select(*keys, "CUI", "UMLS_name", "semantic_type_name").dropna(subset=[*keys, "CUI"])
    if known:  # the names are hashed by partition, so that the mentions are not sorted for them
        rows = rows.join(_part(spark, path, known, DISEASES).select(*keys).hint("shuffle_hash"), keys, "left_anti")
    at = f"{path}/{batch}"
    # one pass over the mentions; the other two tables are made of this one
    terms = term_table(rows, lengths=True)
    terms.write.mode("overwrite").parquet(f"{at}/{TERMS}")
    terms = spark.read.schema(terms.schema).parquet(f"{at}/{TERMS}")
    terms.select(*keys, "doc_len").distinct().write.mode("overwrite").parquet(f"{at}/{DISEASES}")
    concept_table(terms).write.mode("overwrite").parquet(f"{at}/{CONCEPTS}")
    mark, files = _files(spark, f"{at}/{DONE}")
    files.create(mark, True).close()
    return batches(spark, path)


def read_index(spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75, upto: str | None = None) -> DataFrame:
    """The columns of ``bm25_index`` over all finished batches, or over those up to the name ``upto``; the same rows as an index
    built at once over all their mentions."""
    names = [n for n in batches(spark, path) if upto is None or n <= upto]
    if not names:
        raise ValueError(f"no finished batch in {path}")
    totals = _part(spark, path, names, DISEASES).groupBy("model").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_doc_len"))
    concepts = _part(spark, path, names, CONCEPTS).groupBy(F.xxhash64("model", "CUI").alias("_concept"), "model", "CUI").agg(
        F.sum("df").alias("df"), F.min("UMLS_name").alias("UMLS_name"), F.min("semantic_type_name").alias("semantic_type_name"))
    terms = _part(spark, path, names, TERMS).select("model", "disease", "CUI", "tf", "doc_len")
    return weighted(looked_up(terms, concepts.drop("_concept"), ["model", "CUI"]).join(F.broadcast(totals), "model"), k1, b)  # one row per model
