"""Venue records: pairs that may be one place, registry matches, merges, slugs.

``venues``: id, normalized_name, address, neighborhood, lat, lng, slug, registry_id, matched_at, created_at.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import scoring
from almanac.functions.names import address_token, disambiguated, venue_slug
from almanac.functions.text import street_number, trigram_similarity
from almanac.operators import core
from almanac.operators.lineage import cut
from almanac.operators.resolution import without_reviewed

# The band of name similarity, registry floors, distance in metres, and batch sizes.
BAND = (0.45, 0.92)
REGISTRY_FLOOR, REGISTRY_TOP = 0.55, 5
NAME_ACCEPT, NAME_WITH_STREET, NAME_WITH_DISTANCE, NEAR_M = 0.92, 0.75, 0.6, 100.0
BATCH, GEOCODES = 50, 25


def same_registry_possible(a: Column, b: Column) -> Column:
    """False for two records that different registry entries claim."""
    return F.coalesce(a == b, F.lit(True))


def _free(venues: DataFrame, aliases: DataFrame) -> DataFrame:
    return venues.join(aliases.select("normalized_name"), "normalized_name", "left_anti")


def _open_pairs(met: DataFrame, same: Column, suggestions: DataFrame) -> DataFrame:
    """Pairs (a, b, similarity) of the lists ``x`` and ``y`` of ``met`` without those of different registry entries, and suggested ones."""
    lists = met.filter(same_registry_possible(F.col("registry_id_x"), F.col("registry_id_y")))
    rows = core.expanded(lists, same, "similarity")
    return without_reviewed(rows, suggestions.select(F.col("keep_id").alias("x"), F.col("absorb_id").alias("y")))


def name_pairs(venues: DataFrame, suggestions: DataFrame, aliases: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Pairs (a, b, similarity) of similar, but not nearly equal, names."""
    free = _free(venues, aliases)
    near = core.similar_texts(free.select(F.col("normalized_name").alias("t")), *band)
    lists = core.listed(free.select("normalized_name", "registry_id", "id"), ["normalized_name", "registry_id"], "id")
    side = lambda k, t: lists.select(F.col("normalized_name").alias(t), F.col("registry_id").alias(f"registry_id_{k}"), F.col("list").alias(k))
    met = near.join(side("x", "ta"), "ta").join(side("y", "tb"), "tb")
    return _open_pairs(met, F.col("ta") == F.col("tb"), suggestions)


def address_pairs(venues: DataFrame, suggestions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of one house number and one third word of the address; names are compared once for all venues that have them."""
    numbered = _free(venues, aliases).filter(F.col("address").rlike("^[0-9]+ "))
    rows = numbered.select(address_token(F.col("address"), 1).alias("_number"), address_token(F.col("address"), 3).alias("_street"), "normalized_name", "registry_id", "id")
    place, kind = ["_number", "_street"], ["normalized_name", "registry_id"]
    met = core.paired(core.listed(rows, [*place, *kind], "id"), place, kind)
    met = met.withColumn("similarity", trigram_similarity(F.col("normalized_name_x"), F.col("normalized_name_y")))
    return _open_pairs(met, F.col("same"), suggestions)


def proposals(venues: DataFrame, suggestions: DataFrame, aliases: DataFrame, limit: int = BATCH) -> DataFrame:
    """(a, b, similarity, evidence), address pairs first, then by similarity; a pair of both kinds counts as one by address."""
    best = [F.desc("similarity"), "a", "b"]
    by_address = cut(address_pairs(venues, suggestions, aliases).orderBy(*best).limit(limit)).withColumn("evidence", F.lit("address-pair"))
    by_name = name_pairs(venues, suggestions, aliases).orderBy(*best).limit(limit).withColumn("evidence", F.lit(None).cast("string"))
    both = by_address.unionByName(by_name.join(by_address, ["a", "b"], "left_anti"))
    return both.orderBy(F.asc_nulls_last("evidence"), *best).limit(limit)


def accepted(similarity: Column, registry_address: Column, address: Column, metres: Column) -> Column:
    """By name alone, by name and house number, or by name and distance."""
    one, other = street_number(registry_address), street_number(address)
    street = (similarity >= NAME_WITH_STREET) & F.coalesce(one == other, F.lit(False))
    return (similarity >= NAME_ACCEPT) | street | ((similarity >= NAME_WITH_DISTANCE) & F.coalesce(metres <= NEAR_M, F.lit(False)))


def registry_matches(venues: DataFrame, registry: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """(id, registry_id, similarity): the first accepted of the five entries with the most similar names.

    ``registry``: id, name, address, lon, lat; ``coordinates``: id, lat, lng of venues whose place is known.
    """
    names = venues.select(F.col("normalized_name").alias("t"), F.lit(1).alias("side")).unionByName(registry.select(F.lower("name").alias("t"), F.lit(2).alias("side")))
    near = core.similar_texts(names, REGISTRY_FLOOR, sides=True)
    both = near.unionByName(near.filter("ta <> tb").select(F.col("tb").alias("ta"), F.col("ta").alias("tb"), "similarity"))
    known = venues.select("id", "normalized_name", "address")
    known = known.join(coordinates.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), "id", "left") if coordinates is not None else known.withColumns({"_lat": F.lit(None).cast("double"), "_lng": F.lit(None).cast("double")})
    entries = registry.select(F.col("id").alias("registry_id"), F.lower("name").alias("tb"), F.col("address").alias("registry_address"), "lon", "lat")
    # the order of entries is the same for all venues of a name, and has five at most of those of one name
    few = core.first_per_key(entries, ["tb"], [F.asc("registry_id")], REGISTRY_TOP).drop("place")
    order = Window.partitionBy("ta").orderBy(F.desc("similarity"), "registry_id")
    best = both.join(few, "tb").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= REGISTRY_TOP)
    top = known.join(best, F.col("normalized_name") == F.col("ta"))
    metres = scoring.haversine_m(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lon"))
    good = top.filter(accepted(F.col("similarity"), F.col("registry_address"), F.col("address"), metres))
    return good.groupBy("id").agg(F.min_by(F.struct("registry_id", "similarity"), "_n").alias("x")).select("id", "x.*")


def resolve(venues: DataFrame, registry: DataFrame, as_of: datetime, coordinates: DataFrame | None = None, limit: int = BATCH, geocodes: int = GEOCODES) -> tuple[DataFrame, DataFrame]:
    """``venues`` after one sweep, and (id, outcome) of the ``limit`` oldest that no sweep has matched before.

    First by name and address; then, for the first ``geocodes`` of the rest that have an address, with ``coordinates``
    (id, lat, lng). Each venue is tried once: ``matched_at`` is set whatever the outcome.
    """
    batch = cut(venues.filter("matched_at IS NULL").orderBy("created_at", "id").limit(limit))
    first = registry_matches(batch, registry)
    rest = batch.join(first, "id", "left_anti")
    found = first
    if coordinates is not None:
        tried = rest.filter("address IS NOT NULL").orderBy("created_at", "id").limit(geocodes)
        found = first.unionByName(registry_matches(tried.join(coordinates.select("id"), "id", "left_semi"), registry, coordinates))
    found = found.select("id", F.col("registry_id").alias("_registry"))
    outcome = batch.select("id").join(found, "id", "left").select("id", "_registry", F.when(F.col("_registry").isNotNull(), "annotated").otherwise("unmatched").alias("outcome"))
    changed = venues.join(outcome, "id", "left")
    columns = {"registry_id": F.coalesce("_registry", "registry_id"), "matched_at": F.when(F.col("outcome").isNotNull(), F.lit(as_of).cast(venues.schema["matched_at"].dataType)).otherwise(F.col("matched_at"))}
    return changed.select(*[columns.get(c, F.col(c)).alias(c) for c in venues.columns]), outcome.select("id", "outcome")


def registry_duplicates(venues: DataFrame, registry: DataFrame, events: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(keep_id, absorb_id, registry_id) for records of one registry entry.

    The one to keep has the name nearest to the entry's, of equals the most events, of those the smallest id; suggested
    pairs, in either order, are left out.
    """
    shared = Window.partitionBy("registry_id")
    counts = events.groupBy(F.col("venue_id").alias("id")).agg(F.count(F.lit(1)).alias("_events"))
    rows = venues.filter("registry_id IS NOT NULL").withColumn("_n", F.count(F.lit(1)).over(shared)).filter("_n > 1")
    rows = rows.join(registry.select(F.col("id").alias("registry_id"), F.lower("name").alias("_name")), "registry_id").join(counts, "id", "left")
    rows = rows.withColumn("_like", trigram_similarity(F.lower("normalized_name"), F.col("_name"))).withColumn("_events", F.coalesce("_events", F.lit(0)))
    keep = rows.groupBy("registry_id").agg(F.min_by("id", F.struct(-F.col("_like"), -F.col("_events"), "id")).alias("keep_id"))
    pairs = rows.join(keep, "registry_id").filter("id <> keep_id").select(F.col("keep_id").alias("a"), F.col("id").alias("b"), "registry_id")
    open_ = without_reviewed(pairs, suggestions.select(F.col("keep_id").alias("x"), F.col("absorb_id").alias("y")))
    return open_.select(F.col("a").alias("keep_id"), F.col("b").alias("absorb_id"), "registry_id")


def merge_venues(venues: DataFrame, events: DataFrame, aliases: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``venues``, ``events`` and ``aliases`` (normalized_name, venue_id) after ``pairs`` (keep_id, absorb_id).

    Each absorbed record has one that keeps it, which is itself not absorbed. Its place fills what the other lacks (of
    several, the smallest id's first), its events and aliases move, and its name becomes an alias unless it is one.
    """
    fields = ("address", "lat", "lng", "neighborhood")
    given = pairs.join(venues, F.col("absorb_id") == F.col("id"))
    fill = given.groupBy("keep_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("absorb_id"))).alias(f"_{c}") for c in fields]).withColumnRenamed("keep_id", "id")
    stay = venues.join(pairs.select(F.col("absorb_id").alias("id")), "id", "left_anti").join(fill, "id", "left")
    stay = stay.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in venues.columns])
    to = pairs.select(F.col("absorb_id").alias("venue_id"), "keep_id")
    moved = lambda rows: rows.join(to, "venue_id", "left").withColumn("venue_id", F.coalesce("keep_id", "venue_id")).select(*rows.columns)
    new = given.select("normalized_name", F.col("keep_id").alias("venue_id"))
    return stay, moved(events), core.insert_if_absent(moved(aliases), new, ["normalized_name"])


def slugs(venues: DataFrame) -> DataFrame:
    """(id, slug) for the records without one, taken in the order of ids; a slug that is taken gets a hash of the name."""
    plain = venues.filter("slug IS NULL").select("id", "normalized_name", venue_slug(F.col("normalized_name")).alias("plain"))
    taken = venues.filter("slug IS NOT NULL").select(F.col("slug").alias("plain"), F.lit(True).alias("_taken")).distinct()
    first = F.row_number().over(Window.partitionBy("plain").orderBy("id")) == 1
    rows = plain.join(taken, "plain", "left").withColumn("_free", F.col("_taken").isNull() & first)
    return rows.select("id", F.when(F.col("_free"), F.col("plain")).otherwise(disambiguated(F.col("plain"), F.col("normalized_name"))).alias("slug"))


def curated_neighborhoods(venues: DataFrame, curated: DataFrame) -> DataFrame:
    """(id, neighborhood) by ``curated`` (slug, neighborhood)."""
    return venues.join(curated, "slug").select("id", curated["neighborhood"])
