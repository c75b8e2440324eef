"""Exact nearest vectors by clusters: those that the triangle bound keeps away from the query are not read.

Vectors are scaled to length 1, where cosine distance is half the squared distance. Each lies in the cluster of its
nearest centre, at a known distance from it; a cluster's radius is the largest. No vector of a cluster is nearer to a
query than the query's distance from the centre less the radius, and none than the difference of the two distances
from the centre. Clusters are read from the nearest on until they hold as many vectors as asked for; then all those
follow that can hold a nearer one. What is left is ranked by the exact expression of ``scoring.cosine_distance``.

How much is read depends on the vectors: the more they crowd, the less. Vectors without any structure in many dimensions lie
as far from each other as from their centre, and are all read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions.scoring import cosine_distance

#: Centres at most, and rows of the sample that they are found in for each: those of the least hashed keys.
MAX_CLUSTERS, SAMPLE = 4096, 16
ROUNDS = 6
#: More than the error of distances in double precision.
SLACK = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _centres(sample: np.ndarray, many: int) -> np.ndarray:
    """Centres of ``sample`` by a few rounds of nearest means; the first are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, many).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        held = np.bincount(own, minlength=many) > 0
        centres = np.where(held[:, None], _unit(sums), centres)
    return centres


class Vectors:
    """The vectors under ``path`` (key, embedding), by cluster."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def build(self, rows: DataFrame, embedding: str = "embedding", clusters: int | None = None) -> None:
        """Write ``rows`` by cluster; null and zero vectors are kept apart. Equally many numbers in each vector."""
        size = rows.filter(F.col(embedding).isNotNull()).count()
        many = min(MAX_CLUSTERS, clusters or int(np.sqrt(size)) or 1, size or 1)
        first = rows.filter(F.col(embedding).isNotNull()).orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE * many)
        held = [x[0] for x in first.select(embedding).collect()]
        centres, key = _centres(_unit(np.array(held, np.float64)), many) if held else np.zeros((1, 1)), self.key

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = batch.column("embedding").to_pylist()
                own, away = np.full(len(given), -1, np.int32), np.zeros(len(given))
                there = np.array([i for i, x in enumerate(given) if x is not None and any(x)], int)
                if len(there):
                    unit = _unit(np.array([given[i] for i in there], np.float64))
                    near = unit @ centres.T
                    own[there] = np.argmax(near, axis=1)
                    away[there] = np.linalg.norm(unit - centres[own[there]], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("embedding"), pa.array(own), pa.array(away)], names=[key, "embedding", "cluster", "away"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        placed = rows.select(self.key, F.col(embedding).alias("embedding")).mapInArrow(assign, f"{self.key} {kinds[self.key]}, embedding {kinds[embedding]}, cluster int, away double")
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed.repartitionByRange(ranges, "cluster", self.key).sortWithinPartitions("cluster").write.mode("overwrite").parquet(f"{self.path}/rows")
        stats = self.spark.read.parquet(f"{self.path}/rows").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        named = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "cluster int, centre array<double>")
        stats.join(F.broadcast(named), "cluster", "left").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clusters")

    def _scored(self, vector: Sequence[float], clusters: list[int]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("cluster").isin(clusters))
        return rows.select(self.key, "cluster", "away", cosine_distance(F.col("embedding"), F.array(*map(F.lit, vector))).alias("_far"))

    def chosen(self, vector: Sequence[float], k: int) -> tuple[list[int], dict[int, float], float, float]:
        """The clusters that can hold one of the ``k`` nearest, the query's distance from their centres, the distance
        that the k-th does not exceed, and the share of all vectors that these clusters hold."""
        stats = self.spark.read.parquet(f"{self.path}/clusters").collect()  # MAX_CLUSTERS + 1 rows at most
        held = [x for x in stats if x["cluster"] >= 0]
        total = sum(x["n"] for x in stats)
        query = _unit(np.array(vector, np.float64))
        if not held or not query.any() or sum(x["n"] for x in held) < k:
            return [x["cluster"] for x in stats], {}, float("inf"), 1.0
        gap = {x["cluster"]: float(np.linalg.norm(query - np.array(x["centre"]))) for x in held}
        low = {x["cluster"]: gap[x["cluster"]] - x["radius"] - SLACK for x in held}
        size = {x["cluster"]: x["n"] for x in held}
        first, rows = [], 0
        for c in sorted(low, key=lambda c: (low[c], gap[c])):
            first.append(c)
            rows += size[c]
            if rows >= k:
                break
        far = [x["_far"] for x in self._scored(vector, first).select("_far").orderBy(F.asc_nulls_last("_far")).limit(k).collect()]
        reach = float(np.sqrt(max(0.0, 2 * far[-1]))) + SLACK
        some = [c for c in low if low[c] <= reach]
        return some, gap, reach, sum(size[c] for c in some) / total

    def top(self, vector: Sequence[float], k: int) -> DataFrame:
        """(key, rank) of the ``k`` nearest, ties by key; rows without a direction come last, and may fill the list."""
        some, gap, reach, _ = self.chosen(vector, k)
        rows = self._scored(vector, some)
        if gap:
            gaps = self.spark.createDataFrame([(c, gap[c]) for c in some], "cluster int, _gap double")
            rows = rows.join(F.broadcast(gaps), "cluster").filter(F.abs(F.col("away") - F.col("_gap")) <= reach + SLACK)
        order = [F.asc_nulls_last("_far"), F.col(self.key)]
        return rows.select(self.key, "_far").orderBy(*order).limit(k).select(self.key, F.row_number().over(Window.orderBy(*order)).alias("rank"))
