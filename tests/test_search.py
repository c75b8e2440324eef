"""Search and date windows on small cases."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from almanac.functions import windows
from almanac.operators import search

UTC = timezone.utc


def test_windows():
    wednesday = datetime(2026, 7, 8, 18, tzinfo=UTC)  # 13:00 in Chicago
    assert windows.preset("today", wednesday) == (wednesday, datetime(2026, 7, 9, 5, tzinfo=UTC))
    assert windows.preset("tonight", wednesday) == (datetime(2026, 7, 8, 22, tzinfo=UTC), datetime(2026, 7, 9, 8, tzinfo=UTC))
    late = datetime(2026, 7, 8, 6, tzinfo=UTC)  # one in the morning
    assert windows.preset("tonight", late) == (late, datetime(2026, 7, 8, 8, tzinfo=UTC))
    assert windows.preset("this-weekend", wednesday) == (datetime(2026, 7, 10, 22, tzinfo=UTC), datetime(2026, 7, 13, 5, tzinfo=UTC))
    sunday = datetime(2026, 7, 12, 18, tzinfo=UTC)
    assert windows.preset("this-weekend", sunday) == (sunday, datetime(2026, 7, 13, 5, tzinfo=UTC))
    assert windows.preset("this-week", wednesday)[1] == windows.preset("this-week", sunday)[1] == datetime(2026, 7, 13, 5, tzinfo=UTC)
    assert windows.weekday("friday", wednesday, True) == (datetime(2026, 7, 10, 22, tzinfo=UTC), datetime(2026, 7, 11, 8, tzinfo=UTC))
    assert windows.custom("2026-03-08", "2026-03-08") == (datetime(2026, 3, 8, 6, tzinfo=UTC), datetime(2026, 3, 9, 5, tzinfo=UTC))
    assert windows.custom("2026-03-09", "2026-03-08") is windows.custom("x", None) is None


def test_search(spark):
    rows = [(1, "Jazz night", None, None, "Hall", 5, [1.0, 0.0]), (2, "Other", None, "some jazz band", "Hall", 4, None), (3, "Quiet", "jazz", "no bands", "Bar", 3, [0.0, 1.0]), (4, "Poetry", None, "plain", "Cafe", 2, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id int, title string, tags string, description string, venue string, next_start int, embedding array<double>")
    ids = lambda **k: [r.id for r in search.search(df, "id", **k).collect()]
    assert ids(query="jazz") == [1, 3, 2]
    assert ids(query='"jazz band"') == [2, 1]  # 1 by its title's similarity of 5 / 16
    assert [r.id for r in df.filter(search.matches(F.col("description"), '"jazz band"')).collect()] == [2]
    assert sorted(ids(query="jazz -bands")) == [1, 2]
    assert ids() == [4, 3, 2, 1]
    assert ids(vector=[1.0, 0.0]) == [1, 4, 3, 2]
    assert ids(query="jazz", vector=[1.0, 0.0], facets=[F.col("next_start") > 2], limit=2) == [1, 3]
    assert abs(df.filter("id = 4").select(search.word_rank({"title": F.col("title")}, "poetry")).first()[0] - 0.6079271) < 1e-6


def test_fused_ranks_equal_those_of_all_rows(spark):
    import random

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["jazz", "rock", "folk", "night"]) for _ in range(3)), None, r.choice(["jazz", "none"]), "v", i % 7, [r.random(), r.random()]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, title string, tags string, description string, venue string, next_start int, embedding array<double>").cache()
    text = [x.id for x in search.text_leg(df, "id", "jazz").orderBy(F.desc("_score"), "id").collect()]
    score = {k: 1 / (60 + i) for i, k in enumerate(text, 1)}
    for x in search.vector_leg(df, "id", "embedding", [1.0, 0.0]).collect():
        score[x.id] = score.get(x.id, 0.0) + 1 / (60 + x.rank)
    want = sorted(score, key=lambda k: (-round(score[k], 12), k % 7, k))[:20]
    got = search.search(df, "id", "jazz", [1.0, 0.0], limit=20).collect()
    assert [x.id for x in got] == want
    assert all(abs(x.score - score[x.id]) < 1e-12 for x in got)
