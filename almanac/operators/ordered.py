"""Ordinals, running sums and running maxima within keys of any size.

A window over a key sorts the whole key in one task. Here rows are dealt by ranges of (key, order), so that a large key
spans many tasks; each range works on its own rows, and a key's later ranges get what its earlier ones hold. That table has
one row at most for each range, since a range has one key at most that began before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.lineage import cut

_RANGE = "__range"
#: How a value of rows is gathered, and how that of earlier ranges joins it.
_HOW = {"sum": (F.sum, lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))), "max": (F.max, F.greatest)}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], how: str, ranges: int | None = None) -> DataFrame:
    """``df`` with running sums or maxima of whole numbers, own row included, within ``keys`` in ``order``.

    ``order`` holds sort expressions over columns of ``df``. Null keys are a key. Rows that tie in ``order`` come in any
    sequence and share a range; give a unique last column where that matters. The dealt rows are written, so that what
    ranges hold and what rows get come from the same ranges.
    """
    spark = df.sparkSession
    gather, joined = _HOW[how]
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = {f"__{name}": value.cast("long") for name, value in values.items()}
    dealt = df.withColumns(held).repartitionByRange(ranges, *(F.col(k).asc_nulls_first() for k in keys), *order)
    dealt = cut(dealt.withColumn(_RANGE, F.spark_partition_id()))
    totals = dealt.groupBy(_RANGE, *keys).agg(*[gather(v).alias(v) for v in held])
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(_RANGE, *keys, *[gather(v).over(before).alias(f"{v}_before") for v in held])
    carried = carried.filter(" OR ".join(f"{v}_before IS NOT NULL" for v in held))
    within = Window.partitionBy(_RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"{v}_own": gather(v).over(within) for v in held}).alias("d")
    c = F.broadcast(carried).alias("c")
    same = [F.col(f"d.{_RANGE}") == F.col(f"c.{_RANGE}"), *(F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys)]
    found = [joined(F.col(f"d.{v}_own"), F.col(f"c.{v}_before")).alias(n) for n, v in zip(values, held)]
    return summed.join(c, same, "left").select(*[F.col(f"d.`{x}`") for x in df.columns], *found)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    return running(df, keys, order, sums, "sum", ranges)


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """``df`` with the place, from 1, of each row within ``keys`` in ``order``."""
    return running_sums(df, keys, order, {name: F.lit(1)}, ranges)
