"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Every (key, shard) pair hashes to a uniform u in (0, 1); the record goes to the shard with the largest
``weight / -ln(u)``. A new shard can only win records for itself, and it wins a share in proportion to its weight.

Edge cases: a null key hashes like any other value (all null keys share a shard); equal rows get equal shards and
distinct slots; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import materialize

#: Rows, of some 20 bytes, of the broadcast table of first slots.
MAX_RANGES = 1 << 20


def _strength(key: Column, shard: int, weight: float) -> Column:
    # 52 bits and a half: exact in a double, and never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (an index of ``weights``) that wins ``key``; equal strengths go to the lower index."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    runs = [F.struct(_strength(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*runs))["i"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, range_rows: int = 1 << 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs`` (doc_id, text).

    Slots number a shard's records from 0 without gaps. A shard's rows are dealt, whatever their keys, over ranges of
    about ``range_rows`` that sort apart from each other, so neither a whole shard nor the rows of a hot key meet in a
    task. A table of the ranges' counts gives each range its first slot; it has at most MAX_RANGES rows, beyond which
    ranges grow.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or shards > MAX_RANGES:
        raise ValueError(f"one weight a shard, and at most {MAX_RANGES} shards")
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        key,
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, sum(weights) / shards]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "shards")  # written, so that counts and slots see the same deal
    ranges = max(1, min(MAX_RANGES // shards, -(-rows.count() // (shards * range_rows)) * 4))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int"))
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "range").orderBy("row")
    rows = rows.withColumn("rank", F.row_number().over(within) - 1)
    return rows.join(F.broadcast(first), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )
