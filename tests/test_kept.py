"""Kept structures: search index, clustered vectors, recomputed results, against what is made afresh."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import changes, index, listing, nearest, search

WORDS = "river light harbor jazz night market open stage free garden music hall dance late early".split()
SHAPE = "id long, title string, tags string, description string, venue string, next_start long"


def _rows(seed, many):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(k, text(3), r.choice(["en", None]), text(r.randrange(30)), r.choice(["Harbor Hall", "Jazz Garden", None]), k % 7) for k in range(many)]
    return rows + [(many, None, None, None, None, 0), (many + 1, "", "", "", "", 0)]


QUERIES = ["river", "river or jazz", "river light", '"open stage"', '"open stage" -jazz', "-river", "jazz -night or harbor", "Harbr hal", "the", "gardn", "zzz"]


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_equals_reading_all_texts(spark, tmp_path, stemmed):
    rows = spark.createDataFrame(_rows(1, 120), SHAPE)
    kept = index.SearchIndex(spark, str(tmp_path), "id", stemmed)
    assert kept.refresh(rows, listing.search_fingerprint()) == {"new": 122, "changed": 0, "gone": 0}
    for query in QUERIES:
        want = [tuple(x) for x in search.search(rows, "id", query, stemmed=stemmed, limit=500).collect()]
        assert [tuple(x) for x in search.search(rows, "id", query, stemmed=stemmed, limit=500, index=kept).collect()] == want, query
    few = rows.filter("id % 3 = 0")
    assert [tuple(x) for x in search.search(few, "id", "jazz or open", stemmed=stemmed, index=kept).collect()] == [tuple(x) for x in search.search(few, "id", "jazz or open", stemmed=stemmed).collect()]


def test_only_the_buckets_of_the_query_are_scanned(spark, tmp_path):
    kept = index.SearchIndex(spark, str(tmp_path), "id")
    kept.refresh(spark.createDataFrame(_rows(2, 200), SHAPE), listing.search_fingerprint())
    lists = kept.lists([(index.WORD, "river"), (index.TITLE, "riv")])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(term" in plan
    assert {x.rsplit("bucket=", 1)[1].split("/")[0] for x in lists.select("term").distinct().select(F.input_file_name()).distinct().toPandas().iloc[:, 0] if "bucket=" in x} <= {str(index.bucket_of("w", "river")), str(index.bucket_of("t", "riv"))}
    assert {(x.kind, x.term) for x in lists.select("kind", "term").distinct().collect()} <= {("w", "river"), ("t", "riv")}


def test_refresh_takes_in_what_changed_only(spark, tmp_path, monkeypatch):
    kept, rows = index.SearchIndex(spark, str(tmp_path), "id"), _rows(3, 60)
    frame = lambda x: spark.createDataFrame(x, SHAPE)
    kept.refresh(frame(rows), listing.search_fingerprint())
    assert kept.refresh(frame(rows), listing.search_fingerprint()) == {"new": 0, "changed": 0, "gone": 0}
    read = []
    plain = index.postings
    monkeypatch.setattr(index, "postings", lambda x, *a: read.append(x.count()) or plain(x, *a))
    for turn in range(3):
        rows = [(k, "river boat" if k == turn + 5 else t, *x) for k, t, *x in rows if k != turn] + [(900 + turn, "late river", "en", "new", None, 1)]
        assert kept.refresh(frame(rows), listing.search_fingerprint()) == {"new": 1, "changed": 1, "gone": 1}
        assert read[-1] == 2
        if turn == 1:
            kept.fold()
        for query in ("river", "jazz or boat", "-river", "late rivr"):
            assert [tuple(x) for x in search.search(frame(rows), "id", query, limit=500, index=kept).collect()] == [tuple(x) for x in search.search(frame(rows), "id", query, limit=500).collect()], (turn, query)


def test_results_are_recomputed_where_something_changed(spark, tmp_path):
    kept, asked = changes.Kept(str(tmp_path / "t"), "k"), []

    def work(rows):
        asked.append(sorted(x.k for x in rows.collect()))
        return rows.filter("title <> 'skip'").select("k", F.length("title").alias("size"))

    frame = lambda x: spark.createDataFrame(list(x.items()), "k long, title string")
    rows = {k: f"title {k}" for k in range(20)} | {20: None, 21: "skip"}
    assert kept.current(spark) is None
    assert kept.refresh(frame(rows), F.col("title"), work) == {"new": 22, "changed": 0, "gone": 0}
    assert kept.refresh(frame(rows), F.col("title"), work) == {"new": 0, "changed": 0, "gone": 0}
    rows[7] = "another title"
    assert kept.refresh(frame(rows), F.col("title"), work)["changed"] == 1
    del rows[8]
    assert kept.refresh(frame(rows), F.col("title"), work)["gone"] == 1
    rows[8] = "title 8"
    assert kept.refresh(frame(rows), F.col("title"), work)["new"] == 1
    assert [x for x in asked if x] == [sorted(range(22)), [7], [8]]
    assert {x.k: x["size"] for x in kept.current(spark).collect()} == {k: len(t) if t and t != "skip" else None for k, t in rows.items()}


def _crowded(r, many):
    centres = r.normal(size=(25, 12))
    return (centres[r.integers(0, 25, many)] + 0.05 * r.normal(size=(many, 12))).astype("float32")


def test_nearest_vectors(spark, tmp_path):
    r, shares = np.random.default_rng(6), []
    for many in (400, 4000):
        rows = [(k, [float(y) for y in x]) for k, x in enumerate(_crowded(r, many))] + [(many, None), (many + 1, [0.0] * 12), (many + 2, [1.0] * 12), (many + 3, [1.0] * 12)]
        frame = spark.createDataFrame(rows, "id long, embedding array<float>")
        kept = nearest.Vectors(spark, str(tmp_path / str(many)), "id")
        kept.build(frame)
        for query in (rows[3][1], [1.0] * 12, [-0.3] * 11 + [2.0]):
            want = [tuple(x) for x in search.vector_leg(frame, "id", "embedding", query).orderBy("rank").collect()]
            assert [tuple(x) for x in kept.top(query, 50).orderBy("rank").collect()] == want
        shares.append(kept.chosen(rows[3][1], 10)[3])
        assert [x.id for x in kept.top([0.0] * 12, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert shares[1] < shares[0] < 1 or shares[1] < 0.1
    few = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    kept = nearest.Vectors(spark, str(tmp_path / "few"), "id")
    kept.build(few)
    assert [x.id for x in kept.top([0.1, 1.0], 50).orderBy("rank").collect()] == [3, 2, 1]
    kept = nearest.Vectors(spark, str(tmp_path / "none"), "id")
    kept.build(few.limit(0))
    assert kept.top([1.0, 0.0], 5).count() == 0
