"""Intermediate tables in the shared folder that the session names.

A staged table cuts the lineage of an iterative plan and survives lost executors: it is plain
Parquet under ``spark.checkpoint.dir``, which the driver and all executors can read.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one (local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged_path = path
    return read


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps have left: Spark deletes shuffle files once the driver has collected their handles."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)  # Python tells the JVM what it has dropped from a thread of its own
        spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
