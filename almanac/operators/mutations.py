"""Changes of tables as pure functions from snapshots to snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unless_locked(locks: str, field: str, old: Column, new: Column) -> Column:
    """``old`` where the array column ``locks`` names ``field``, else ``new``."""
    return F.when(F.array_contains(locks, field), old).otherwise(new)


def supersede(stored: DataFrame, batch: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``stored`` without the other ``value`` rows of keys that occur just once in ``batch``."""
    single = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_kept")).filter("_n = 1")
    rows = stored.join(single, list(keys), "left").filter(F.col("_kept").isNull() | (F.col(value) == F.col("_kept")))
    return rows.select(*stored.columns)


def cascade_delete(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose parent is not among ``gone``."""
    return rows.join(gone.select(*keys), list(keys), "left_anti")


def field_diffs(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, old, new) of each field that differs between two snapshots; nulls are equal to nulls.

    Rows of only one snapshot are in ``added_removed``."""
    rows = old.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields]).join(new.select(key, *fields), key)
    each = [F.struct(F.lit(f).alias("field"), F.col(f"_old_{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new")) for f in fields]
    return rows.select(key, F.inline(F.array(*each))).filter(~F.col("old").eqNullSafe(F.col("new")))


def added_removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state) of the rows that only one of two snapshots has: ``added`` or ``removed``."""
    both = old.select(key, F.lit(True).alias("_old")).join(new.select(key, F.lit(True).alias("_new")), key, "full")
    return both.filter("_old IS NULL OR _new IS NULL").select(key, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("state"))


def curated_report(rows: DataFrame, curated: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): the curated value, ``unmapped`` for keys without one, ``stale`` for entries without a row."""
    both = rows.select(key, F.lit(True).alias("_here")).join(curated.select(key, value), key, "full")
    return both.select(key, F.when(F.col("_here").isNull(), "stale").otherwise(F.coalesce(value, F.lit("unmapped"))).alias("state"))
