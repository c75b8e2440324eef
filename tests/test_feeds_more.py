"""Feeds beyond the plain ones on small documents."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from almanac.sources import feeds


def _pages(spark, *bodies, url="https://x.org/a/b"):
    return spark.createDataFrame([(url, b) for b in bodies], "url string, body string")


def test_links_never_fail(spark):
    script = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    event = {"@type": "MusicEvent", "name": "N", "url": "http://[bad", "startDate": "2026-01-01", "description": "a <b>b</b>"}
    deep = "[" * 100_000 + "]" * 100_000
    body = script({"@type": "Festival", "name": "Parent", "@graph": [event, event]}) + f'<script type="application/ld+json">{deep}</script>'
    got = feeds.linked_data(_pages(spark, body)).collect()
    assert [(x.name, x.url, x.description) for x in got] == [("Parent", None, None), ("N", None, "a b")]
    item = lambda k, link: {"id": str(k), "title": f"t{k}", "startDate": 0, "fullUrl": link, "excerpt": "<p>x</p>"}
    body = json.dumps({"upcoming": [item(k, x) for k, x in enumerate(["/p", "//h.org/p", "q", "https://z.org/", "mailto:x"])]})
    got = feeds.upcoming_pages(_pages(spark, body), "t4").collect()
    assert [x.url for x in got] == ["https://x.org/p", "https://h.org/p", "https://x.org/a/q", "https://z.org/"] and got[0].description == "x"


def test_wrapped_and_clocked(spark):
    event = lambda k, first, last, **more: {"id": k, "title": "A&#8217;s", "url": "u", "start_date": first, "end_date": last, "venue": [], "image": False, **more}
    events = [
        event(1, "2026-07-01 19:30:00", "2026-07-01 21:00:00", venue={"venue": "Hall", "address": "1 St", "city": "C"}),
        event(2, "2026-07-01 00:00:00", "2026-07-03 23:00:00"),
        event(3, "2026-07-05 00:00:00", "2026-07-05 23:00:00", all_day=True),
        event(4, "2026-07-05 00:00:00", "2026-07-04 23:00:00", all_day=True),
        event(5, "soon", "2026-07-04 23:00:00"),
    ]
    got = feeds.wrapped_pages(_pages(spark, f"<html>{json.dumps({'events': events})}</html>", "no json"), "T, ST", "Own", "2 Rd").collect()
    assert [(x.id, x.starts) for x in got] == [("1", "2026-07-02T00:30:00Z"), *[("2", f"2026-07-0{d}T05:00:00Z") for d in (1, 2, 3)], ("3", "2026-07-05T05:00:00Z")]
    assert got[0].name == "A’s" and got[0].address == "1 St, T, ST" and got[1].venue == "Own"
    show = {"id": 7, "name": "S", "event_date": "2026-07-18T00:00:00.000+00:00", "start_time": "19:00", "duration_minutes": 90, "show_on_website": True}
    body = {"events": [show, {**show, "id": 8, "show_on_website": False}, {**show, "id": 9, "start_time": "late"}], "linked": {"spots": [{"name": "P", "address": "1", "city": "C", "state": "S", "zip": "5"}]}}
    (x,) = feeds.clocked_pages(_pages(spark, json.dumps(body)), "https://l.org/e").collect()
    assert (x.id, x.url, x.starts, x.ends, x.address) == ("7", "https://l.org/e#ev7", "2026-07-19T00:00:00Z", "2026-07-19T01:30:00Z", "1, C, S, 5")


def test_cards_and_calendars(spark):
    body = '<ul><li class="card big"><a class="t" href="/x">One <i>two</i></a><br><span class="d">Jul 4</span><time>7:30 pm</time></li><li class="card"><span class="d">Jan 2</span></li></ul><a class="t" href="/no">x</a>'
    wanted = {"title": ("a.t", None), "link": ("a.t", "href"), "date": (".d", None), "time": ("time", None)}
    got = feeds.html_cards(_pages(spark, body), "li.card", wanted)
    assert [tuple(x)[1:] for x in got.collect()] == [(0, "One two", "/x", "Jul 4", "7:30 pm"), (1, None, None, "Jan 2", None)]
    parts = got.withColumns({"month": F.split_part("date", F.lit(" "), F.lit(1)), "day": F.split_part("date", F.lit(" "), F.lit(2))})
    dated = feeds.card_dates(parts, "month", "day", "time", F.lit("2026-07-05").cast("date")).collect()
    assert [x.starts for x in dated] == ["2027-07-05T00:30:00Z", None]
    grid = spark.createDataFrame([("a", "T", 2026, 9, 1, 7, 30), ("a", "T", 2026, 9, 2, 7, 30), ("b", "U", 2026, 9, 3, 0, 0)], "url string, title string, year int, month int, day int, hour int, minute int")
    details = spark.createDataFrame([("a", 9, 1, 14, 0)], "url string, month int, day int, hour int, minute int")
    assert [(x.start, x.assumed) for x in feeds.grid_listings(grid, details).orderBy("start").collect()] == [(datetime(2026, 9, 1, 14), False), (datetime(2026, 9, 2, 19, 30), True)]
    runs = spark.createDataFrame([("November 29 – December 1, 2026",), ("Dec 31 - January 1, 2027",), ("May 3-5, 2026",), ("soon",)], "run string")
    days = [x.day for x in feeds.season_listings(runs).orderBy("day").collect()]
    assert days == [date(2026, 5, d) for d in (3, 4, 5)] + [date(2026, 11, 29), date(2026, 11, 30), date(2026, 12, 1), date(2026, 12, 31), date(2027, 1, 1)]


def test_crawls_and_enrichment(spark):
    entry = lambda loc, mod="": f"<url><loc>{loc}</loc>{f'<lastmod>{mod}</lastmod>' if mod else ''}</url>"
    maps = _pages(spark, entry("https://x.org/event/1", "2026-01-01") + entry("https://x.org/event/2") + entry("https://x.org/other", "2027-01-01") + entry("https://x.org/event/3", "2026-02-01"), url="m")
    assert [x.loc[-1] for x in feeds.site_map(maps, 2, "/event/").orderBy(F.desc("lastmod")).collect()] == ["3", "1"]
    page = '<script type="application/ld+json">{"@type": "Event", "name": "N", "startDate": "2026-03-01"}</script>'
    details = spark.createDataFrame([("https://x.org/event/1", page), ("https://x.org/event/3", "nothing")], "url string, body string")
    found, missed = feeds.crawled(maps, details, 3, "/event/")
    assert [x.name for x in found.collect()] == ["N"] and {x.url[-1] for x in missed.collect()} == {"2", "3"}
    rows = spark.createDataFrame([(k, u, "old") for k, u in enumerate([None, "u1", "u2", "u3"])], "ordinal int, url string, starts string")
    more = spark.createDataFrame([("u1", "new"), ("u3", "new")], "url string, starts string")
    assert [x.starts for x in feeds.enriched(rows, more, 2).orderBy("ordinal").collect()] == ["old", "new", "old", "old"]


def test_registry_slice_and_dispatch(spark):
    shape = "id string, names struct<primary:string>, categories struct<primary:string>, addresses array<struct<freeform:string,locality:string>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, confidence double"
    rows = [("a", ("N",), ("c",), [("1 St", "M")], (-88.0, -88.0, 43.0, 43.0), 0.9), ("b", (None,), None, [], (-88.0, -88.0, 43.0, 43.0), 0.9), ("c", ("F",), None, [], (0.0, 0.0, 43.0, 43.0), 0.9)]
    assert [tuple(x) for x in feeds.registry_slice(spark.createDataFrame(rows, shape), -88.6, -87.7, 42.6, 43.45).collect()] == [("a", "N", "c", "1 St", "M", -88.0, 43.0, 0.9)]
    body = json.dumps({"upcoming": [{"id": "1", "title": "t", "startDate": 0, "fullUrl": "/p"}]})
    pages = spark.createDataFrame([("html", "upcoming", "https://x.org/", body), ("html", "jsonld", "https://x.org/", "")], "adapter string, strategy string, url string, body string")
    assert [x.id for x in feeds.read_all(pages).collect()] == ["1"]
    with pytest.raises(ValueError):
        feeds.read_all(pages.withColumn("adapter", F.lit("rss")))


def test_saved_pages(spark, tmp_path):
    from almanac.sources.saved import saved_pages

    for at, body in (("html/upcoming/s one/1", "a\nb"), ("ical/-/t/1", "c")):
        file = tmp_path / at
        file.parent.mkdir(parents=True)
        file.write_text(body)
    got = {tuple(x) for x in saved_pages(spark, str(tmp_path), "https://x.org/").collect()}
    assert got == {("html", "upcoming", "s one", "https://x.org/s one/1", "a\nb"), ("ical", "", "t", "https://x.org/t/1", "c")}


def test_adapters_follow_tokens(spark):
    from almanac.sources.adapters import Adapter, fetched

    def fetch(config, token):
        page = int(token or 0)
        if config == "bad" and page == 1:
            raise OSError("down")
        item = {"id": f"{config}{page}", "title": "t" if page else "", "startDate": 0, "fullUrl": "/p"}
        return f"https://x.org/{page}", json.dumps({"upcoming": [item]}), str(page + 1) if page < 7 else None

    sources = spark.createDataFrame([("a", "good"), ("b", "bad")], "source string, config string")
    assert sorted((x.source, x.page) for x in fetched(sources, fetch).collect()) == [("a", k) for k in range(5)] + [("b", 0), ("b", 1)]  # the last is the failure
    got = Adapter(fetch, feeds.upcoming_pages, 3).listings(sources).collect()
    assert sorted((x.id, x.valid) for x in got) == [("good0", False), ("good1", True), ("good2", True)]
