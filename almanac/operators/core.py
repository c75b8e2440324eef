"""Relational operators: set-similarity pairs, keyed picks, upserts, anti joins, rank fusion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import set_similarity, trigrams

RRF_K = 60
#: Rows of a list in ``listed``.
LIST = 1024


def similar_texts(rows: DataFrame, floor: float, top: float = 1.0, block: str | None = None, sides: bool = False) -> DataFrame:
    """(ta, tb, similarity), and ``block``, of the distinct texts of ``rows`` (t) whose trigram similarity lies in [floor, top]; ta <= tb.

    With ``sides``, rows have a ``side``, 1 or 2, and only texts of different sides meet.

    A pair is compared only if it shares a gram within both prefixes that the floor leaves (rarest grams first, so
    that common ones are hardly ever joined on), if lengths allow the floor, and if enough grams follow the shared one.
    """
    keys = [block] if block else []
    side = F.bit_or("side" if sides else F.lit(3)).alias("s")
    texts = rows.groupBy(*keys, "t").agg(side).withColumn("g", trigrams(F.col("t"))).filter(F.size("g") > 0)
    grams = texts.select(*keys, "t", "s", F.size("g").alias("n"), F.explode("g").alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy(*keys, "t").orderBy("often", "gram")  # a text's own grams
    ranked = grams.join(often, "gram").withColumn("p", F.row_number().over(order) - 1)
    prefix = ranked.filter(F.col("p") <= F.col("n") - F.ceil(F.lit(floor) * F.col("n") - 1e-9)).select(*keys, "gram", "t", "s", "n", "p")
    one, two = (prefix.select(*keys, "gram", *[F.col(c).alias(f"{c}{x}") for c in "tsnp"]) for x in "ab")
    apart = F.expr("(sa & 1 > 0 AND sb & 2 > 0) OR (sa & 2 > 0 AND sb & 1 > 0)")
    need = F.lit(floor / (1 + floor)) * (F.col("na") + F.col("nb")) - 1e-9
    met = one.join(two, [*keys, "gram"]).filter("ta < tb").filter(apart).filter((F.least("na", "nb") >= F.lit(floor) * F.greatest("na", "nb") - 1e-9) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need))
    pairs = met.select(*keys, "ta", "tb").distinct()
    of = lambda x: texts.select(*keys, F.col("t").alias(f"t{x}"), F.col("g").alias(f"g{x}"))
    near = pairs.join(of("a"), [*keys, "ta"]).join(of("b"), [*keys, "tb"]).withColumn("similarity", set_similarity(F.col("ga"), F.col("gb")))
    same = texts.filter("s = 3").select(*keys, F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(1.0).alias("similarity"))
    return near.select(*keys, "ta", "tb", "similarity").unionByName(same).filter(F.col("similarity").between(floor, top))


def listed(rows: DataFrame, keys: Sequence[str], key: str, size: int | None = None) -> DataFrame:
    """(``keys``..., lists): the values of ``key`` of each of ``keys`` in lists of some ``LIST``; null ``keys`` are keys.

    Rows to be paired meet as lists, so that what is shuffled for pairs is some ``LIST``-th of them.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (size or LIST)).alias("_parts")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    dealt = rows.join(counts, same).withColumn("_part", F.pmod(F.xxhash64(key), "_parts"))
    return dealt.groupBy(*keys, "_part").agg(F.collect_list(key).alias("list")).drop("_part")


def expanded(met: DataFrame, same: Column, *columns: str) -> DataFrame:
    """(a, b, ``columns``...) of the lists ``x`` and ``y`` of each row; a < b. Where ``same``, both are of one kind and a pair comes once."""
    left = met.select(F.explode("x").alias("_x"), "y", same.alias("_same"), *columns)
    pairs = left.select("_x", F.explode("y").alias("_y"), "_same", *columns)
    pairs = pairs.filter(F.when(F.col("_same"), F.col("_x") < F.col("_y")).otherwise(F.col("_x") != F.col("_y")))
    return pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *columns)


def paired(lists: DataFrame, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """(x, y, same, and ``columns`` of both with _x and _y) of ``listed`` rows of equal ``keys``, each two lists once; ids are unique."""
    side = lambda k: lists.select(*keys, F.col("list").alias(k), F.array_min("list").alias(f"_first{k}"), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return side("x").join(side("y"), list(keys)).filter("_firstx <= _firsty").withColumn("same", F.col("_firstx") == F.col("_firsty"))


def similar_pairs(rows: DataFrame, key: str, text: str, block: str | None, floor: float, top: float = 1.0, digits: int | None = None) -> DataFrame:
    """(a, b, similarity) of rows, of one block if there are blocks, whose trigram similarity lies in [floor, top]; a < b.

    Distinct texts are compared, not rows; lists of keys are joined back after. With ``digits`` the similarity is
    rounded, before there are pairs.
    """
    keys = ["k"] if block else []
    named = rows.select(*([F.col(block).alias("k")] if block else []), F.col(text).alias("t"), F.col(key).alias("id"))
    near = similar_texts(named, floor, top, "k" if block else None)
    near = near if digits is None else near.withColumn("similarity", F.round("similarity", digits))
    lists = listed(named, [*keys, "t"], "id")
    met = near.join(lists.withColumnsRenamed({"t": "ta", "list": "x"}), [*keys, "ta"]).join(lists.withColumnsRenamed({"t": "tb", "list": "y"}), [*keys, "tb"])
    return expanded(met, F.col("ta") == F.col("tb"), "similarity")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; ``order`` must be total."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(at)).filter(F.col("place") <= k)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` put in place of those with their keys; null new values keep the old."""
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in stored.columns if c not in keys])
    values = [c for c in stored.columns if c not in keys]
    return new.join(old, list(keys), "full").select(*keys, *[F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in values])


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(new.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def reciprocal_rank_fusion(legs: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ``legs`` (key, rank); a missing leg adds nothing."""
    scored = [leg.select(key, (F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("part")) for leg in legs]
    every = scored[0]
    for other in scored[1:]:
        every = every.unionByName(other)
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: dict[str, float], parts: int = 256) -> DataFrame:
    """Per key the values at ceil(share x n) of its n values in order, a column for each of ``shares``; nulls do not count.

    Values are counted, each key's are cut at approximate quantiles into ``parts`` ranges, and only the ranges that hold
    a wanted place are put in order. No task has all values of a key, and the result is exact.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts).alias("_cuts")
    bounds = counts.groupBy(key).agg(cuts, F.sum("_n").alias("_all"))
    # a value's range is found in two steps: among every ``step``-th cut, then among those up to the next
    step = max(1, math.isqrt(parts))
    below = lambda c: c < F.col(value)
    placed = counts.join(bounds.select(key, "_cuts", F.filter("_cuts", lambda c, i: (i + 1) % step == 0).alias("_coarse")), key)
    placed = placed.withColumn("_i", F.size(F.filter("_coarse", below)) * step)
    placed = placed.select(key, value, "_n", (F.col("_i") + F.size(F.filter(F.slice("_cuts", F.col("_i") + 1, F.lit(step - 1)), below))).alias("_part"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(key, "_part").agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    wanted = F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1)).alias("_at")) for name, p in shares.items()]))
    found = sums.join(bounds.select(key, wanted), key).filter("_at > _before AND _at <= _before + _sum").select(key, "_part", "_before", "_name", "_at")
    within = Window.partitionBy(key, "_part", "_name").orderBy(value)
    upto = placed.join(found, [key, "_part"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    hit = upto.filter("_at <= _upto AND _at > _upto - _n")
    return hit.groupBy(key).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in shares])


def trailing_count(rows: DataFrame, key: str, ts: str, minutes: int, out: str) -> DataFrame:
    """How many rows of the same key lie in the ``minutes`` before each row, itself and those of its instant excluded.

    A key's time is cut in slices as long as the frame, so that no frame reaches beyond the slice before its own; each
    slice gets that one's times along, and a task has two slices of a key, not the key. Rows without a time count none.
    """
    span = minutes * 60_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = rows.withColumns({"_micros": at, "_slice": F.floor(at / span)})
    before = timed.filter("_micros IS NOT NULL").select(key, F.col("_micros"), (F.col("_slice") + 1).alias("_slice"), F.lit(True).alias("_before"))
    both = timed.withColumn("_before", F.lit(False)).unionByName(before, allowMissingColumns=True)
    frame = Window.partitionBy(key, "_slice").orderBy("_micros").rangeBetween(-span, -1)
    counted = both.withColumn(out, F.when(F.col("_micros").isNotNull(), F.count("_micros").over(frame)).otherwise(F.lit(0)))
    return counted.filter("NOT _before").drop("_micros", "_slice", "_before")


def union_distinct(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys of all ``tables`` once, with the place (from 1) of the first table that holds each."""
    marked = [t.select(*keys, F.lit(i).alias("priority")) for i, t in enumerate(tables, 1)]
    every = marked[0]
    for other in marked[1:]:
        every = every.unionByName(other)
    return every.groupBy(*keys).agg(F.min("priority").alias("priority"))
