"""Cutting the lineage of iterative plans in the shared folder of the session."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="almanac-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; for a local session without that setting, a temporary folder."""
    at, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not at and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or _own_folder()).rstrip("/")


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables of ``cut`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back; a local session without that setting uses a temporary folder.

    A written table is computed once, where a checkpoint computes its rows to count them and again to write them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/almanac-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
