"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one is set only where there is none and all runs on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that this library wrote and nothing reads any more, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; later steps start from there, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The same rows, cut; dealt out anew where they lie in so few partitions that tasks would wait for the largest, as rows made from a small table do."""
    held, least = cut(df), 4 * df.sparkSession.sparkContext.defaultParallelism
    return cut(held.repartition(least)) if held._jdf.queryExecution().toRdd().getNumPartitions() < least else held


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, of which later steps read the columns they need, where cut() keeps whole rows."""
    path = f"{shared_dir(df.sparkSession)}/loomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
