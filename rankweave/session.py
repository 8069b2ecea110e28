"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "rankweave") -> SparkSession:
    """Local session for tests and benchmarks.  On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def staging_dir(spark: SparkSession) -> str:
    """Folder for stored intermediate tables: the shared one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes when the program ends.  On a cluster
    each executor would write to its own disk there, so a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="rankweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_staged: list[str] = []


def remember_staged(path: str) -> str:
    """Have :func:`drop_staged` remove this path too."""
    _staged.append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, as an explicit step, and go on from the stored table.

    Cuts the lineage like a reliable checkpoint and survives lost executors, but is columnar: later steps read only
    the columns they need, and Spark plans their joins with the real size.  ``drop_staged`` removes the tables.
    """
    spark = df.sparkSession
    path = remember_staged(f"{staging_dir(spark)}/rankweave/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table stored on the way; to be called when the results that read them are done."""
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
