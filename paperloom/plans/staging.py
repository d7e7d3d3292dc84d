"""Intermediate tables in the folder that all executors share.

``stage`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back: it cuts lineage, survives
the loss of any executor, and lets a costly pass over texts be read more than once. ``discard`` deletes staged tables
that nothing reads any more; what a returned DataFrame reads stays until its owner discards it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, a folder of our own, but only if driver
    and executors are one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back, with its schema kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables. Other DataFrames, and None, are passed over."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
