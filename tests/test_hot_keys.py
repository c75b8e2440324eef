"""Operators whose keys may hold most rows: against plain Python, with all rows on one key, over many ranges."""

import random
from bisect import bisect_left
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from almanac.operators import core, listing, ordered, resolution

START = datetime(2026, 3, 7, 12)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    at = lambda: START + timedelta(seconds=r.randrange(3 * 86_400))
    times = [at() for _ in range(1500)]
    times += times[:40]  # ties
    return [(k, "hot" if r.random() < 0.9 else r.choice(["a", None]), t, r.choice("xyz")) for k, t in enumerate(times)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, kind string").repartition(5)


def test_ordinals_and_sums_over_ranges(frame, rows):
    got = ordered.ordinals(frame, ["key"], [F.asc("ts"), F.asc("id")], ranges=16).collect()
    want = {}
    for key in ("hot", "a", None):
        for n, x in enumerate(sorted((x for x in rows if x[1] == key), key=lambda x: (x[2], x[0])), 1):
            want[x[0]] = n
    assert {x.id: x.ordinal for x in got} == want
    sums = ordered.running_sums(frame, ["key"], [F.desc("ts"), F.asc("id")], {"s": F.col("id")}, ranges=16)
    total = {}
    for x in sorted(sums.collect(), key=lambda x: (-x.ts.timestamp(), x.id)):
        total[x.key] = total.get(x.key, 0) + x.id
        assert x.s == total[x.key]
    assert sums.count() == len(rows)
    # no range has more than a few times its share, though one key has nine tenths of the rows
    sizes = [x["count"] for x in frame.repartitionByRange(16, "key", "ts", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * len(rows) / 16


def test_trailing_counts(frame, rows):
    got = {x.id: x.n for x in core.trailing_count(frame, "key", "ts", 60, "n").collect()}
    by = {k: sorted(x[2] for x in rows if x[1] == k) for k in ("hot", "a", None)}
    assert got == {i: bisect_left(by[k], t) - bisect_left(by[k], t - timedelta(minutes=60)) for i, k, t, _ in rows}
    odd = frame.sparkSession.createDataFrame([(1, "k", None), (2, "k", START)], "id long, key string, ts timestamp_ntz")
    assert sorted(tuple(x) for x in core.trailing_count(odd, "key", "ts", 60, "n").select("id", "n").collect()) == [(1, 0), (2, 0)]


def test_nearest_delta(frame, rows):
    got = {x.key: x.minutes for x in resolution.nearest_delta(frame, ["key"], "ts", F.col("kind") == "x", F.col("kind") == "y").collect()}
    want = {}
    for key in ("hot", "a", None):
        gaps = [abs((a[2] - b[2]).total_seconds()) / 60 for a in rows if a[1] == key and a[3] == "x" for b in rows if b[1] == key and b[3] == "y"]
        if gaps:
            want[key] = min(gaps)
    assert got == pytest.approx(want)


def test_pairs_within_a_band(spark, frame, rows):
    got = {(x.a, x.b): x.minutes for x in resolution.same_day_pairs(frame, "id", "ts", ["key"], 7.5).collect()}
    # wall times count as instants of UTC, and days are those of Chicago
    day = lambda t: (t - timedelta(hours=6 if t < datetime(2026, 3, 8, 8) else 5)).date()
    want = {}
    for i, (a, key, t, _) in enumerate(rows):
        for b, other, u, _ in rows[i + 1 :]:
            if key is not None and key == other and day(t) == day(u) and abs((t - u).total_seconds()) <= 450:
                want[a, b] = abs((t - u).total_seconds()) / 60
    assert got == pytest.approx(want)
    even = spark.range(20_000).select("id", F.lit("hot").alias("key"), F.timestamp_seconds(F.lit(1_770_000_000) + F.col("id")).alias("ts"))
    assert resolution.same_day_pairs(even, "id", "ts", ["key"], 0.05).count() < 3 * 20_000


def test_a_day_of_all_rows_is_sorted(spark, rows):
    cards = spark.createDataFrame([(f"s{i}", START + timedelta(seconds=i % 977), i % 3 == 0, 43.0 + i / 1e4 if i % 5 else None, -88.0, i) for i in range(1200)], "slug string, start_at timestamp_ntz, is_station boolean, lat double, lng double, ordinal int")
    got = [x.slug for x in listing.day_sorted(cards).orderBy("place").collect()]
    want = sorted(((i % 3 != 0, i % 977, f"s{i}") for i in range(1200)))
    assert got == [x[2] for x in want]
    near = listing.day_sorted(cards, "near", (43.0, -88.0)).orderBy("place").collect()
    assert [x.ordinal for x in near] == [i for i in range(1200) if i % 5] + [i for i in range(1200) if not i % 5]
    assert [x.place for x in near] == list(range(1, 1201))
