"""Connected components of link tables by alternating large-star and small-star rounds, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import drop_tables, materialize

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one only, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def _downwards(pairs: DataFrame) -> DataFrame:
    """Distinct links from the larger end a to the smaller end b."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); a component is named by its smallest node.

    Each round replaces links by links to smaller nodes until every node hangs on its component's smallest one. No
    node's neighbours are ever gathered: minima are aggregated and joined back. The result is a written table, which
    the caller may drop.
    """
    edges = materialize(_downwards(links), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, edges = edges, materialize(_downwards(small), "edges")
        drop_tables(before)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    up = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = materialize(up.unionByName(up.select(F.col("component").alias("node"), "component").distinct()), "components")
    drop_tables(edges)
    return found
