"""Scores and schedules: pair evidence, verdicts, retry delays, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of title, venue, time and link; verdict bounds; earth radius in metres.
W_TITLE, W_VENUE, W_TIME, W_URL = 0.55, 0.15, 0.15, 0.15
MERGE_AT, REVIEW_AT = 0.80, 0.55
TIME_WINDOW_MINUTES = 180
EARTH_M = 6_371_000.0


def time_proximity(minutes: Column) -> Column:
    near = F.lit(1.0) - F.least(F.abs(minutes), F.lit(float(TIME_WINDOW_MINUTES))) / TIME_WINDOW_MINUTES
    return F.when(minutes.isNull(), 0.5).otherwise(near)


def pair_score(title: Column, venue: Column, minutes: Column, same_url: Column) -> Column:
    return W_TITLE * title + W_VENUE * venue + W_TIME * time_proximity(minutes) + W_URL * F.when(same_url, 1.0).otherwise(0.0)


SAME_SHOW_AFFINITY, SAME_SHOW_MINUTES = 0.9, 15
UNSURE_BELOW = 0.7
UNKNOWN_AFFINITY = 0.5


def venue_affinity(id_a: Column, id_b: Column, similarity: Column) -> Column:
    """1 for one venue, the similarity of both names where known, else a half."""
    return F.when(id_a == id_b, 1.0).otherwise(F.coalesce(similarity, F.lit(UNKNOWN_AFFINITY)))


def same_show(affinity: Column, minutes: Column) -> Column:
    return (affinity >= SAME_SHOW_AFFINITY) & F.coalesce(F.abs(minutes) <= SAME_SHOW_MINUTES, F.lit(False))


def first_survives(rank_a: Column, rank_b: Column, created_a: Column, created_b: Column) -> Column:
    """Whether the first of a pair stays: by rank, then by age; the first of equals."""
    return F.when(rank_a != rank_b, rank_a > rank_b).otherwise(created_a <= created_b)


def first_survives_same_show(owned_a: Column, owned_b: Column, by_rank: Column) -> Column:
    """A venue's own listing stays against another's; else as by rank."""
    return F.when(owned_a != owned_b, owned_a).otherwise(by_rank)


def judged(same: Column, confidence: Column) -> Column:
    return F.when(confidence < UNSURE_BELOW, "unsure").when(same, "same").otherwise("different")


def verdict(score: Column) -> Column:
    return F.when(score >= MERGE_AT, "merge").when(score >= REVIEW_AT, "review").otherwise("ignore")


def backoff_hours(failures: Column) -> Column:
    """None before the third failure in a row; then 24 hours, doubling up to a week."""
    return F.when(failures < 3, 0.0).otherwise(F.least(F.lit(24.0) * F.pow(F.lit(2.0), failures - 3), F.lit(168.0)))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # null where a place is unknown


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two equally long arrays; null where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)
