"""Folders of response files as a stream: each run takes the files that came since the last one and ends."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.streaming.incremental import append_new


def append_files(
    spark: SparkSession, path: str, schema: str, table: str, key: Sequence[str], checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None, partition_by: Sequence[str] = (), files_per_batch: int = 1000,
    multi_line: bool = False,
) -> DataFrame:
    """Append the rows of the JSON files below ``path`` that no earlier run with this ``checkpoint`` took; returns the table.

    The checkpoint holds the names of the files taken, so a run lists the folder but reads new files only.  Files are taken
    in batches, oldest first, and a batch counts as taken when its rows stand in the table.  A run that ended in between
    repeats its last batch; the rows' ``key`` keeps out those that are there, so each key stands once.  Of rows with equal
    keys in a batch the smallest by its other columns stays, so a batch that is repeated chooses alike.  Rows with a null in
    the key have no name to be known by and are left out; so are lines that are no JSON.

    ``prepare`` maps each batch before it is appended.  ``multi_line``: a file is one document, not one per line.
    """
    rows = (
        spark.readStream.schema(schema).option("multiLine", multi_line).option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )

    def add(batch: DataFrame, _: int) -> None:
        batch = batch.dropna(subset=list(key)) if prepare is None else prepare(batch).dropna(subset=list(key))
        others = [c for c in batch.columns if c not in key]
        first = batch.groupBy(*key).agg(F.min(F.struct(*others)).alias("_first")).select(*key, "_first.*") if others else batch.distinct()
        append_new(first.select(*batch.columns), table, key, partition_by)

    run = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    spark.catalog.refreshTable(table)  # batches are written in a session of the stream's own
    return spark.table(table)
