"""Merging, requests, stems, upkeep and streams on small cases."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from almanac.functions import names
from almanac.functions.stemming import stem
from almanac.functions.understanding import parse_text
from almanac.operators import core, listing, merging, search
from almanac.streaming import streams

UTC = timezone.utc
WEDNESDAY = datetime(2026, 7, 8, 18, tzinfo=UTC)  # 13:00 in Chicago


def _loop(pairs, state):
    """The sweep as a plain loop."""
    state, gone, out = {k: list(v) for k, v in state.items()}, set(), set()
    for a, b, score, kind in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if kind == "ignore" or a in gone or b in gone:
            continue
        if kind == "queue":
            out.add((a, b, kind, None, None))
            continue
        x, y = state[a], state[b]  # created, rank, key, owned
        first = x[1] > y[1] if x[1] != y[1] else x[0] <= y[0]
        if kind == "same-show" and x[3] != y[3]:
            first = x[3]
        stays, goes = (a, b) if first else (b, a)
        gone.add(goes)
        best = min((-x[1], x[2], x[3]), (-y[1], y[2], y[3]))
        state[stays][1:] = [-best[0], best[1], best[2]]
        out.add((a, b, kind, stays, goes))
    return out


def test_decisions_equal_the_loop(spark, monkeypatch):
    r = random.Random(4)
    state = {i: (r.randrange(5), r.randrange(5), f"k{r.randrange(4)}", r.random() < 0.3) for i in range(40)}
    state = {i: (c, n, k, k == "k1") for i, (c, n, k, _) in state.items()}
    pairs = list({(a, b): (a, b, r.choice((0.6, 0.7, 0.8, 0.9)), r.choice(("merge", "merge", "same-show", "queue", "ignore"))) for a, b in (sorted(r.sample(range(40), 2)) for _ in range(90))}.values())
    frame = spark.createDataFrame(pairs, "a long, b long, score double, kind string")
    known = spark.createDataFrame([(i, *x) for i, x in state.items()], "id long, created_at long, rank int, key string, owned boolean")
    want = _loop(pairs, state)
    for most in (50_000, 0):  # groups in one task, and rounds over whole tables
        monkeypatch.setattr(merging, "GROUP_PAIRS", most)
        assert {(x.a, x.b, x.kind, x.survivor, x.absorbed) for x in merging.decide(frame, known).collect()} == want
    assert merging.decide(frame.filter("false"), known).count() == 0


def test_similar_texts_equal_all_pairs(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["jazz", "jazzy", "night", "nights", "club", "hall", "a"]) for _ in range(r.randrange(0, 4))) for _ in range(120)]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    distinct = sorted(set(texts))
    want = {}
    for i, x in enumerate(distinct):
        for y in distinct[i:]:
            a, b = grams(x), grams(y)
            if a and b and 0.3 <= (s := len(a & b) / len(a | b)) <= 0.9:
                want[x, y] = round(s, 9)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {(x.ta, x.tb): round(x.similarity, 9) for x in core.similar_texts(rows, 0.3, 0.9).collect()} == want


def test_similarity_floors_in_single_precision(spark):
    three, two, under = (spark.range(1).select(search.passes(F.lit(x), floor)).first()[0] for x, floor in ((3 / 10, 0.3), (2 / 5, 0.4), (0.2999, 0.3)))
    assert three and two and not under


def test_understanding():
    said = parse_text("free jazz Friday night", WEDNESDAY)
    assert (said.text, said.time_of_day, said.free) == ("jazz", "night", True)
    assert said.window == (datetime(2026, 7, 10, 22, tzinfo=UTC), datetime(2026, 7, 11, 8, tzinfo=UTC))
    assert parse_text("jazz  this weekend tonight", WEDNESDAY).text == "jazz tonight"
    assert parse_text("evening shows", WEDNESDAY) == parse_text("shows EVENING", WEDNESDAY)
    assert parse_text("freedom todays", WEDNESDAY).window is None and not parse_text("freedom", WEDNESDAY).free


def test_requests():
    asked = listing.Request.parse({"q": ["jazz tomorrow", "x"], "date": "today", "tod": "noon", "free": "1", "maxPrice": "20", "lat": "", "lng": "200", "from": "2026-02-30", "sort": "near"})
    assert asked == listing.Request(q="jazz tomorrow", date="today", free=True, max_price=20.0, sort="near")
    assert asked.active() and not listing.Request(sort="near").active()
    found = asked.resolve(WEDNESDAY)
    assert found.text == "jazz" and found.window[0] == datetime(2026, 7, 9, 5, tzinfo=UTC)
    assert listing.Request(date="today", first="2026-01-01", last="2026-01-02").resolve(WEDNESDAY).window[0] == WEDNESDAY
    assert listing.facet_link({"q": "a b", "cat": "", "free": 1}, {"free": None, "tod": "night"}) == "/events?q=a+b&tod=night"


def test_stems():
    want = {"running": "run", "ponies": "poni", "caresses": "caress", "hopping": "hop", "hoping": "hope", "relational": "relat", "generous": "generous", "skies": "sky", "argued": "argu", "national": "nation", "festivals": "festiv", "happily": "happili", "controlling": "control", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "knightly": "knight", "consistently": "consist"}
    assert {w: stem(w) for w in want} == want
    assert stem("été") == "été" and stem("a") == "a"


def test_ranks_reward_nearness_and_stems(spark):
    rows = [(1, "one", "jazz bands play", None), (2, "two", "jazz is heard where other bands of this town play", None), (3, "three", "nothing", None)]
    df = spark.createDataFrame(rows, "id int, title string, description string, tags string")
    columns = {k: F.col(k) for k in ("title", "tags", "description")}
    got = {x.id: x for x in df.select("id", search.word_rank(columns, "jazz band", True).alias("r"), search.matches(F.col("description"), "band", True).alias("m"), search.matches(F.col("description"), '"jazz bands"').alias("p")).collect()}
    assert got[1].r > got[2].r > got[3].r == search.NO_PAIR
    assert (got[1].m, got[2].m, got[3].m, got[1].p, got[2].p) == (True, True, False, True, False)


def test_names(spark):
    rows = [("Café  Ünïque!",), ("ＡＢＣ ﬁne",), ("plain Name",), ("###",), (None,)]
    df = spark.createDataFrame(rows, "n string")
    got = [tuple(x) for x in df.select(names.normalize_name(F.col("n")).alias("a"), names.venue_slug(names.normalize_name(F.col("n"))).alias("b")).collect()]
    assert [x[0] for x in got] == ["cafe unique", "abc fine", "plain name", "", None]
    assert got[0][1] == "cafe-unique" and got[3][1].startswith("venue-") and got[4][1] is None
    where = spark.createDataFrame([("Hall - 12 Main St, Town",), ("A - B, x",), (" ,x",)], "l string").select(names.location_name(F.col("l")).alias("x")).collect()
    assert [x.x for x in where] == ["Hall", "A - B", None]
    html = spark.createDataFrame([("<p>a&amp;b <b>c</b></p>\n d",), ("  x  y ",)], "h string").select(names.strip_html(F.col("h")).alias("x")).collect()
    assert [x.x for x in html] == ["a&b c d", "x y"]


def test_local_days_and_folds(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 5, 30), "a", 1), (datetime(2024, 1, 1, 7), "a", 2), (datetime(2024, 1, 2, 5, 59), "b", 3)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string, v int").write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("ts timestamp_ntz, k string, v int").parquet(f"{tmp_path}/in")
    query = streams.local_day_counts(source(), "ts").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(str(x.day), x.k) for x in spark.sql("SELECT * FROM days").collect()} == {("2023-12-31", 1), ("2024-01-01", 2)}
    streams.upsert_into(source(), f"{tmp_path}/out", ["k"], "ts", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(datetime(2024, 1, 1, 6), "b", 9), (datetime(2024, 1, 1, 7), "a", 7)], "ts timestamp_ntz, k string, v int").write.parquet(f"{tmp_path}/out/batch=1")
    read = lambda: {(x.k, x.v) for x in streams.latest(spark, f"{tmp_path}/out", ["k"], "ts").collect()}
    before = read()
    streams.compact(spark, f"{tmp_path}/out", ["k"], "ts", 1)
    assert read() == before == {("a", 7), ("b", 3)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_backoff_states(spark, tmp_path):
    rows = [("s", datetime(2024, 1, 1, h), ok) for h, ok in enumerate((False, True, False, False, False, False))] + [("t", datetime(2024, 1, 1), True)]
    spark.createDataFrame(rows, "source string, ts timestamp_ntz, ok boolean").write.parquet(f"{tmp_path}/in")
    runs = spark.readStream.schema("source string, ts timestamp_ntz, ok boolean").parquet(f"{tmp_path}/in")
    streams.backoff_states(runs).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(x) for x in spark.sql("SELECT source, failures, wait_hours FROM states").collect()} == {("s", 4, 48.0), ("t", 0, 0.0)}


def test_work_by_source(spark):
    df = spark.createDataFrame([(s, i) for i in range(20) for s in "ab"], "source string, ordinal int").repartition(5)
    found = streams.per_source(df, lambda part: part.assign(ordinal=part["ordinal"].cummax()), "source string, ordinal int").collect()
    assert sorted((x.source, x.ordinal) for x in found) == sorted((s, i) for i in range(20) for s in "ab")


def test_superseded_starts(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [(1, "e", day(1), day(1)), (1, "e", day(2), day(2)), (1, "f", day(1), day(1)), (1, "f", day(3), day(1))]
    df = spark.createDataFrame(rows, "source_id int, source_event_id string, start_at timestamp_ntz, seen_at timestamp_ntz")
    assert {(x.source_event_id, x.start_at) for x in streams.current(df).collect()} == {("e", day(2)), ("f", day(1)), ("f", day(3))}
