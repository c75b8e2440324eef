"""Rounds that settle whole tables, crawls of several hops, bounded calls and counters in streams, against plain loops."""

import random
import time
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from almanac.functions.bounded import or_none
from almanac.operators import core, listing, plug, resolution
from almanac.sources import frontier
from almanac.streaming import streams


def _loop(pairs):
    gone, out = set(), []
    for a, b, _ in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in gone and b not in gone:
            gone.add(b)
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_equal_the_loop(spark, seed):
    r = random.Random(seed)
    pairs = list({(a, b): (a, b, r.choice((0.5, 0.7, 0.9))) for a, b in (r.sample(range(25), 2) for _ in range(80))}.values())
    frame = spark.createDataFrame(pairs, "a long, b long, score double")
    assert sorted(tuple(x) for x in resolution._merge_rounds(frame).collect()) == _loop(pairs)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    pairs = [(k, k + 1, 1.0 - k / 20_000) for k in range(10_000)]
    rounds = []
    plain = resolution._settled
    monkeypatch.setattr(resolution, "_settled", lambda x: rounds.append(1) or plain(x))
    frame = spark.createDataFrame(pairs, "a long, b long, score double")
    assert sorted(tuple(x) for x in resolution._merge_rounds(frame).collect()) == _loop(pairs)
    assert len(rounds) < 20


def _site():
    """Three levels under a start, links back up, a circle, a dead end, and links that are none."""
    page = lambda *links: "".join(f'<p><a href="{x}">x</a>' for x in links)
    return {
        "http://a.org/": page("b", "/c#top", "mailto:x", "http://[bad"),
        "http://a.org/b": page("d", "/", "d"),
        "http://a.org/c": page("/b", "http://z.org/q"),
        "http://a.org/d": page("e", "b"),
        "http://a.org/e": page("f"),
        "http://z.org/q": page("http://a.org/missing", "q"),
    }


def test_crawl_equals_a_plain_walk(spark, tmp_path):
    site = _site()
    pages = spark.createDataFrame(list(site.items()), "url string, body string")
    seeds = spark.createDataFrame([("http://a.org/",)], "url string")
    links = {}
    for x in frontier.page_links(pages).collect():
        links.setdefault(x.url, []).append(x.link)
    depth, waiting = {"http://a.org/": 0}, deque(["http://a.org/"])
    while waiting:
        at = waiting.popleft()
        for x in links.get(at, []):
            if x not in depth and depth[at] < 3:
                depth[x] = depth[at] + 1
                waiting.append(x)
    got = frontier.crawl(spark, str(tmp_path / "all"), seeds, frontier.saved(pages), 3)
    assert {x.url: x.depth for x in got.collect()} == depth and depth["http://a.org/missing"] == 3 and "http://a.org/f" not in depth
    assert {x.url: x.via for x in got.collect()}["http://a.org/b"] == "http://a.org/"
    # stopped after the first hop, with an unfinished round, it goes on
    asked = []
    expand = lambda rows: asked.append(sorted(x.url for x in rows.collect())) or frontier.saved(pages)(rows)
    frontier.crawl(spark, str(tmp_path / "part"), seeds, expand, 1)
    (tmp_path / "part" / "round=2").mkdir()
    got = frontier.crawl(spark, str(tmp_path / "part"), seeds, expand, 3)
    assert {x.url: x.depth for x in got.collect()} == depth and len(asked) == 3
    assert frontier.crawl(spark, str(tmp_path / "part"), seeds, expand, 3).count() == len(depth) and len(asked) == 3
    few = frontier.crawl(spark, str(tmp_path / "few"), seeds, frontier.saved(pages), 5, per_host=2)
    assert sorted((x.url, x.depth) for x in few.collect()) == [("http://a.org/", 0), ("http://a.org/b", 1)]
    assert frontier.crawl(spark, str(tmp_path / "none"), seeds.limit(0), frontier.saved(pages), 3).count() == 0


def test_calls_are_bounded(spark):
    rows = spark.createDataFrame([(k, f"t{k}", datetime(2026, 1, 1) + timedelta(minutes=k)) for k in range(6)], "id long, title string, created_at timestamp")

    def ask(part):
        import time

        if part["id"].iloc[0] == 2:
            time.sleep(20)
        if part["id"].iloc[0] == 3:
            raise ValueError("no")
        return part[["id"]].assign(n=part["title"].str.len())

    began = time.time()
    got = {x.id: (x.n, x.error) for x in plug.answers(rows, ask, "id long, n long", 5, batch=1, seconds=1.0).collect()}
    assert time.time() - began < 15
    assert got == {0: (2, None), 1: (2, None), 2: (None, "TimeoutError: no answer within 1.0 s"), 3: (None, "ValueError: no"), 4: (2, None)}
    over = plug.answers(rows, ask, "id long, n long", 6, batch=2, budget=-1).collect()
    assert len(over) == 6 and all(x.error == "TimeoutError: the run's time was over" for x in over)
    assert or_none(lambda: [1.0], 0.15) == [1.0]
    assert or_none(lambda: time.sleep(3), 0.15) is None
    assert or_none(lambda: 1 / 0, 0.15) is None


def test_exact_counts_in_a_stream(spark, tmp_path):
    r = random.Random(9)
    times = sorted(datetime(2026, 1, 1) + timedelta(seconds=r.randrange(3 * 86_400)) for _ in range(300))
    rows = [(k, r.choice("ab"), t) for k, t in enumerate(times)] + [(900, "once", datetime(2026, 1, 1))]
    rows.sort(key=lambda x: x[2])
    rows += [(1000, "late", datetime(2026, 1, 9)), (1001, "late", datetime(2026, 1, 12))]
    shape = "id long, key string, ts timestamp"
    frame = spark.createDataFrame(rows, shape)
    want = {x.id: x.n for x in core.trailing_count(frame, "key", "ts", 60, "n").collect()}

    def feed(part, name):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        read = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = streams.trailing_counts(read, "key", "ts")
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {x.id: x.n for x in spark.read.parquet(str(tmp_path / "out")).collect()}

    feed(rows[:120], 0)
    assert run() == {x[0]: want[x[0]] for x in rows[:120]}
    feed(rows[120:301], 1)  # from the checkpoint
    run()
    feed(rows[301:302], 2)
    run()
    feed(rows[302:], 3)
    assert run() == want
    run()
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "times").load()
    held = [x[0] for x in state.select("key.key").distinct().collect()]
    assert "a" not in held and "b" not in held and "once" not in held and "late" in held


def test_a_search_does_not_wait_for_its_model(spark):
    from datetime import timezone

    rows = [(k, f"jazz night {k}", [1.0, 0.0] if k == 3 else [0.0, 1.0]) for k in range(5)]
    base = spark.createDataFrame(rows, "id long, title string, embedding array<double>")
    empty = F.array().cast("array<string>")
    events = base.withColumns({"category": F.lit("music"), "vibe_tags": empty, "audience_tags": empty, "description": F.lit(None).cast("string"), "venue_id": F.lit(1), "is_free": F.lit(True), "price_min": F.lit(None).cast("double")})
    instances = base.select(F.col("id").alias("event_id"), F.lit(datetime(2026, 7, 10)).cast("timestamp_ntz").alias("start_at"), F.lit("scheduled").alias("status"))
    venues = spark.createDataFrame([(1, "hall", "hall", "east")], "id int, slug string, normalized_name string, neighborhood string")
    now, asked = datetime(2026, 7, 8, tzinfo=timezone.utc), []
    find = lambda embed, q="jazz tonight jazz": [x.id for x in listing.search_listings(events, instances, venues, listing.Request(q=q), now, embed=embed).collect()]
    words = find(None, "jazz")
    assert find(lambda text: asked.append(text) or [1.0, 0.0], "jazz") == [0, 3, 1, 2, 4] and asked == ["jazz"]
    assert find(lambda text: time.sleep(2), "jazz") == words == find(lambda text: 1 / 0, "jazz")
    find(lambda text: asked.append(text), "")
    assert asked == ["jazz"]


def test_a_module_that_fails_leaves_the_others(spark):
    from datetime import timezone

    from almanac.plans import model

    tables = {n: model.table(spark, "/root/testdata/sf0.001", n) for n in ("events", "instances", "venues")}
    rows, errors = listing.home_rows(tables, model.NOW.astimezone(timezone.utc))
    assert not errors and set(rows) == {"tonight", "weekend", "station", "hoods"} and rows["weekend"]
    tables["venues"] = tables["venues"].withColumn("neighborhood", F.raise_error(F.lit("lost")).cast("string"))
    rows, errors = listing.home_rows(tables, model.NOW.astimezone(timezone.utc))
    assert "hoods" in errors and rows["hoods"] == [] and set(rows) == {"tonight", "weekend", "station", "hoods"}
