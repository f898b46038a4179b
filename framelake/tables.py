"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and all
    tasks run on this machine, as in tests, a temporary folder of our own is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.conf.get("spark.master", "").startswith("local"):
        base = _own_folder()
    if not base:
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.table_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialise`` that later tables have replaced."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
