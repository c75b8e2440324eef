"""Saved pages as a table: what fetching leaves, and what readers take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def saved_pages(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(adapter, strategy, source, url, body) of files ``path``/adapter/strategy/source/page, whole; ``base`` begins their urls.

    The page number orders the pages of a source, as tokens or counters gave them. A strategy named ``-`` is none.
    """
    files = spark.read.text(f"{path}/*/*/*/*", wholetext=True).withColumn("_file", F.input_file_name())
    part = lambda k: F.url_decode(F.try_element_at(F.split("_file", "/"), F.lit(k)))
    return files.select(part(-4).alias("adapter"), F.when(part(-3) != "-", part(-3)).otherwise("").alias("strategy"), part(-2).alias("source"), F.concat(F.lit(f"{base.rstrip('/')}/"), part(-2), F.lit("/"), part(-1)).alias("url"), F.col("value").alias("body"))
