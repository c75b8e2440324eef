"""Results that are kept with the fingerprint of what they were made from, and made again only where it has changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.core import first_per_key
from almanac.operators.lineage import cut, drop


def changes(stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint, change) of what is new, changed or gone between two tables (key, fingerprint); a null fingerprint is a value."""
    old = stored.select(key, F.col("fingerprint").alias("_old"), F.lit(True).alias("_held"))
    new = now.select(key, "fingerprint", F.lit(True).alias("_here"))
    change = F.when(F.col("_held").isNull(), "new").when(F.col("_here").isNull(), "gone").when(~F.col("fingerprint").eqNullSafe(F.col("_old")), "changed")
    return new.join(old, key, "full").select(key, "fingerprint", change.alias("change")).filter("change IS NOT NULL")


def folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """The folders ``name=N`` under ``path`` whose write was finished, by N."""
    fs = spark._jvm.org.apache.hadoop.fs
    top = fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return {}
    found = [x.getPath() for x in files.listStatus(top) if x.getPath().getName().startswith(f"{name}=")]
    return {int(x.getName().partition("=")[2]): x.toString() for x in found if files.exists(fs.Path(x, "_SUCCESS"))}


@dataclass(frozen=True)
class Kept:
    """A table of results under ``path``: parts, each written at once with its fingerprints; of a key the newest part holds."""

    path: str
    key: str

    def current(self, spark: SparkSession) -> DataFrame | None:
        """(key, fingerprint, results...) as they hold; None before the first refresh."""
        parts = folders(spark, self.path, "part")
        if not parts:
            return None
        rows = spark.read.option("basePath", self.path).parquet(*parts.values())
        return first_per_key(rows, [self.key], [F.desc("part")]).filter("NOT gone").drop("place", "part", "gone")

    def refresh(self, rows: DataFrame, fingerprint: Column, compute: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Compute the rows that are new or changed, mark those that are gone, and say how many of each there were.

        ``compute`` gets such rows of ``rows`` and gives (key, results...); a row for which it gives nothing has null
        results and is not asked for again until it changes. Where nothing changed nothing is computed or written.
        """
        spark, key = rows.sparkSession, self.key
        marked = rows.withColumn("fingerprint", fingerprint)
        held = self.current(spark)
        stored = held.select(key, "fingerprint") if held is not None else marked.select(key, "fingerprint").limit(0)
        feed = cut(changes(stored, marked, key))
        counts = {x["change"]: x["count"] for x in feed.groupBy("change").count().collect()}
        if counts:
            todo = feed.filter("change <> 'gone'").select(key, "fingerprint")
            done = todo.join(compute(rows.join(todo.select(key), key, "left_semi")), key, "left").withColumn("gone", F.lit(False))
            gone = feed.filter("change = 'gone'").select(key, "fingerprint", F.lit(True).alias("gone"))
            number = max(folders(spark, self.path, "part"), default=-1) + 1
            done.unionByName(gone, allowMissingColumns=True).write.parquet(f"{self.path}/part={number}")
        drop(feed)
        return {k: counts.get(k, 0) for k in ("new", "changed", "gone")}
