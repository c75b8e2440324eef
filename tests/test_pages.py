"""Pages that nobody checked, sources that fail, and what must not lose rows."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from almanac.functions.markup import plain_text, tree
from almanac.operators import merging, persist
from almanac.sources import adapters, feeds
from almanac.streaming import streams


def _pages(spark, *bodies, url="https://x.org/a/b"):
    return spark.createDataFrame([(url, b) for b in bodies], "url string, body string")


def test_tree_ends_what_authors_leave_open():
    root = tree('<ul id=u><li class="a b">one<p>x<p>y<li>two<ul><li>in</ul></ul><table><tr><td>1<td>2<tr><td>3</table><p>a<div>b</div></i>c')
    assert [x.text() for x in root.select("#u > li")] == ["one x y", "two in"]
    assert [x.text() for x in root.select("li.a.b p")] == ["x", "y"]
    assert [[y.text() for y in x.select("td")] for x in root.select("tr")] == [["1", "2"], ["3"]]
    assert [x.text() for x in root.select("ul li:nth-child(2)")] == ["two in"]
    assert [x.text() for x in root.select("td:last-child, td:first-child")] == ["1", "2", "3"]
    with pytest.raises(ValueError):
        root.select("p + q")
    got = tree("<a href=/x data-k='v w'>l</a><img src=i.png><script>if (a<b) x</script>t")
    assert [x.attrs["href"] for x in got.select("a[data-k~=w][href^='/']")] == ["/x"] and got.first("img[src$=png]") and got.first("a[href*=zz]") is None
    assert got.text() == "lt"


def test_markup_never_raises():
    r = random.Random(5)
    bits = ["<", ">", "</", "<![", "<!", "<!--", "-->", "<p", "<li>", "</table>", "<td>", "a", " ", '"', "=", "&amp;", "&#xD800;", "&#9999999;", "<![x", "<?", "/>", "<script>", "</script", "\x00", "]]>", "<![CDATA["]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        tree(text).select("p li, td")
        plain_text(text)
    deep = "<div>" * 50_000 + "x"
    assert tree(deep).text() == "x"


def test_malformed_pages_lose_nothing(spark):
    cards = "".join(f'<li class="card"><h3>T{k}</h3><p class="d">May {k}' for k in range(1, 4))
    got = feeds.html_cards(_pages(spark, f"<ul>{cards}</ul>", "<![x", None), "li.card", {"title": ("h3", None), "date": ("p.d", None)})
    assert [(x.place, x.title, x.date) for x in got.collect()] == [(k - 1, f"T{k}", f"May {k}") for k in (1, 2, 3)]
    nested = '<div class="card">a<div class="card">b</div></div><div class="card">c</div>'
    assert [x.t for x in feeds.html_cards(_pages(spark, nested), ".card", {"t": ("div", None), "u": ("div div", None)}).collect()] == ["a b", "c"]
    script = '<![x]> <script type="application/ld+json">{"@type": "Event", "name": "N", "startDate": "2026-01-01"}</script>'
    assert [x.name for x in feeds.linked_data(_pages(spark, script, "<![x")).collect()] == ["N"]
    assert [x[0] for x in _pages(spark, "a<![x]>b", "c &lt; d").select(feeds.strip_html(F.col("body"))).collect()] == ["ab", "c < d"]


def test_a_page_that_fails_is_counted(spark):
    def parse(url, body):
        if body == "bad":
            raise RuntimeError("no")
        yield {"id": body, "name": body, "starts": "s"}

    rows = feeds.counted(feeds._parsed(_pages(spark, "good", "bad", "fine"), parse)).collect()
    assert [(x.id, x.url, x.valid) for x in rows] == [("good", None, True), (None, "https://x.org/a/b", False), ("fine", None, True)]


#: Layouts as sites have them: a list with broken ends, a table, an agenda, nested divs, definition lists, a calendar, a run.
LAYOUTS = {
    "list": ('<ul><li class="ev"><a class="t" href="/1">One</a><span class="m">Jul</span><span class="d">4</span><em>7:30 pm<li class="ev"><a class=t href=/2>Two</a><span class=m>Aug<span class=d>5</ul>', "li.ev", {"name": ("a.t", None), "link": ("a.t", "href"), "month": (".m", None), "day": (".d", None), "time": ("em", None)}),
    "table": ('<table><tr><th>x<tr class=r><td>Jul<td>4<td>8 pm<td><a href="3">Three</a><tr class=r><td>Jul<td>5<td>noon<td><a href="4">Four</table>', "tr.r", {"name": ("td a", None), "link": ("a[href]", "href"), "month": ("td:nth-child(1)", None), "day": ("td:nth-child(2)", None), "time": ("td:nth-child(3)", None)}),
    "agenda": ('<dl><div class="e"><dt>July</dt><dd data-n="6">6</dd><dd><b>Five</b> 9pm</dd></div></dl>', "dl > div.e", {"name": ("dd b", None), "link": ("a", "href"), "month": ("dt", None), "day": ("dd[data-n]", "data-n"), "time": ("dd:last-child", None)}),
}


def test_layouts(spark):
    want = {
        "list": [("One", "https://x.org/1", "2026-07-05T00:30:00Z"), ("Two", "https://x.org/2", None)],
        "table": [("Three", "https://x.org/a/3", "2026-07-05T01:00:00Z"), ("Four", "https://x.org/a/4", None)],
        "agenda": [("Five", "https://x.org/a/b", "2026-07-07T02:00:00Z")],
    }
    for name, (body, card, wanted) in LAYOUTS.items():
        got = feeds.card_pages(_pages(spark, body), card, wanted, "2026-06-01", "Hall").collect()
        assert [(x.name, x.url, x.starts) for x in got] == want[name], name
        assert {x.venue for x in got} == {"Hall"}
    grid = '<table><tr><td class="day"><i>9</i><u>1</u><a href="/p">P</a><s>7:30</s></td><td class="day"><i>9</i><u>2</u><a href="/p">P</a><s>7:30</s></table>'
    details = spark.createDataFrame([("https://x.org/p", 9, 1, 14, 0)], "url string, month int, day int, hour int, minute int")
    wanted = {"name": ("a", None), "link": ("a", "href"), "month": ("i", None), "day": ("u", None), "time": ("s", None)}
    got = feeds.grid_pages(_pages(spark, grid), "td.day", wanted, 2026, details).collect()
    assert sorted((x.name, x.url, x.starts) for x in got) == [("P", "https://x.org/p", "2026-09-01T19:00:00Z"), ("P", "https://x.org/p", "2026-09-03T00:30:00Z")]
    season = "<section><h2>Play</h2><a href=/s>more</a><p>May 3-5, 2026</section>"
    got = feeds.season_pages(_pages(spark, season), "section", {"name": ("h2", None), "link": ("a", "href"), "run": ("p", None)}).collect()
    assert [x.starts for x in got] == [f"2026-05-0{d}T05:00:00Z" for d in (3, 4, 5)] and len({x.id for x in got}) == 3
    fields = feeds.detail_fields(_pages(spark, "<h1>T</h1><p class=w>8:15 pm<img src=i>", "<p>"), {"name": ("h1", None), "time": (".w", None), "image": ("img", "src")})
    assert [tuple(x)[1:] for x in fields.collect()] == [("T", "8:15 pm", "i"), (None, None, None)]
    timed = spark.createDataFrame([("2026-07-04T05:00:00Z", "doors 7 pm"), ("2026-07-04T05:00:00Z", "tba"), (None, "7 pm")], "s string, t string")
    assert [x[0] for x in timed.select(feeds.at_time(F.col("s"), F.col("t"))).collect()] == ["2026-07-05T00:00:00Z", "2026-07-04T05:00:00Z", None]


def test_every_strategy_has_a_reader(spark):
    body, card, wanted = LAYOUTS["list"]
    pages = spark.createDataFrame([("s1", "html", "cards", "https://x.org/a/b", body), ("s2", "html", "sitemap", "https://x.org/m", "<url><loc>https://x.org/d</loc></url>")], "source string, adapter string, strategy string, url string, body string")
    node = '<script type="application/ld+json">{"@type": "Event", "name": "N", "startDate": "2026-01-01"}</script>'
    options = {"cards": {"card": card, "wanted": wanted, "today": "2026-06-01"}, "sitemap": {"details": _pages(spark, node, url="https://x.org/d"), "most": 5}}
    assert sorted(x.name for x in feeds.read_all(pages, options).collect()) == ["N", "One", "Two"]


@pytest.fixture
def fetch():
    def get(config, token):
        """Pages 0 to n - 1 of a source whose configuration is n; 'e' fails at its second page, 'loop' goes round."""
        at = int(token or 0)
        if config == "e" and at:
            raise OSError("refused")
        last = {"e": 9, "loop": 99}.get(config) or int(config)
        after = "0" if config == "loop" and at == 2 else str(at + 1)
        return f"u{at}", f"body {config} {at}", after if config == "loop" or at + 1 < last else None

    return get


def test_failures_are_rows_and_parts_are_not_persisted(spark, fetch):
    sources = spark.createDataFrame([("a", "3"), ("b", "e"), ("c", "loop"), ("d", "99")], "source string, config string")
    pages = adapters.fetched(sources, fetch).cache()
    by = {k: [x for x in pages.orderBy("source", "page").collect() if x.source == k] for k in "abcd"}
    assert [len(by[k]) for k in "abcd"] == [3, 2, 5, 5]
    assert by["b"][1].error == "OSError: refused" and by["b"][1].body is None and "came again" in by["c"][4].error
    assert {x.source for x in adapters.whole(pages).collect()} == {"a", "d"}
    listings = adapters.whole(pages).select("source", (F.col("page") > 0).alias("valid"))
    runs = {x.source: tuple(x)[1:] for x in adapters.runs(sources, pages, listings).collect()}
    assert runs["a"] == (3, 2, 1, None) and runs["b"] == (0, 0, 0, "OSError: refused") and runs["c"][3]
    stored = spark.createDataFrame([(k, "ok", None, 0, 7, 7, 0, datetime(2026, 1, 1), datetime(2026, 1, 1)) for k in "abcd"], "id string, status string, error string, failures int, fetched long, published long, skipped long, attempted_at timestamp_ntz, fetched_at timestamp_ntz")
    health = {x.id: x for x in persist.source_health(stored, adapters.runs(sources, pages, listings).withColumnRenamed("source", "id"), datetime(2026, 2, 1)).collect()}
    assert (health["a"].status, health["a"].fetched, health["b"].status, health["b"].fetched, health["b"].failures) == ("ok", 3, "failing", 7, 1)
    pages.unpersist()


def test_data_source(spark, tmp_path, fetch):
    adapters.registered(spark, "local_pages", fetch, lambda config: (tmp_path / config).read_text())
    sources = json.dumps({"a": "3", "b": "e", "c": "7"})
    pages = spark.read.format("local_pages").option("sources", sources).load()
    assert pages.rdd.getNumPartitions() == 3
    assert sorted((x.source, x.page, x.error) for x in pages.collect()) == sorted([("a", k, None) for k in range(3)] + [("b", 0, None), ("b", 1, "OSError: refused")] + [("c", k, None) for k in range(5)])
    one = pages.filter("source = 'c'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 5
    assert pages.filter(F.col("source").isin("a", "b") & F.col("error").isNull()).count() == 4
    assert pages.filter("source = 'none'").count() == 0

    def stream():
        read = spark.readStream.format("local_pages").option("sources", json.dumps({"x": "9", "y": "8"})).load()
        read.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((x.source, x.url) for x in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "9").write_text("2"), (tmp_path / "8").write_text("1")
    assert stream() == [("x", "u0"), ("x", "u1"), ("y", "u0")]
    (tmp_path / "9").write_text("4")
    assert stream() == [("x", "u0"), ("x", "u1"), ("x", "u2"), ("x", "u3"), ("y", "u0")]


def test_folds_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(4):
        spark.range(10 * batch, 10 * batch + 20).selectExpr("id AS k", f"'{batch}' AS v", f"{batch} AS ts").write.parquet(f"{path}/batch={batch}")
    read = lambda: sorted(tuple(x) for x in streams.latest(spark, path, ["k"], "ts").select("k", "v").collect())
    want = read()
    for upto in (2, 2, 2, 3, 3):
        streams.compact(spark, path, ["k"], "ts", upto)
        assert read() == want
    assert len(list((tmp_path / "t").glob("batch=*"))) == 1
    # a fold that stopped before it deleted what it was made of
    spark.range(0, 5).selectExpr("id AS k", "'new' AS v", "9 AS ts").write.parquet(f"{path}/batch=4")
    spark.range(0, 5).selectExpr("id AS k", "'new' AS v", "9 AS ts").write.parquet(f"{path}/batch=-50")
    want = read()
    streams.compact(spark, path, ["k"], "ts", 4)
    assert read() == want and len(list((tmp_path / "t").glob("batch=*"))) == 1


def test_chains_of_any_length(spark):
    merges = spark.createDataFrame([(k, k + 1, k) for k in range(300)], "survivor long, absorbed long, step long")
    locks = spark.createDataFrame([(200, ["time"])], "id long, locked array<string>")
    got = {x.id: x for x in merging.merge_paths(merges, locks).collect()}
    assert len(got) == 300 and {x.root for x in got.values()} == {0} and got[300].path == list(range(300))
    assert [got[k].time_locked for k in (200, 201, 300)] == [False, True, True]
    circle = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (3, 1, 2)], "survivor long, absorbed long, step long")
    with pytest.raises(ValueError):
        merging.merge_paths(circle, locks)


def test_the_box_reaches_the_scan(spark, tmp_path):
    shape = "id string, names struct<primary:string>, categories struct<primary:string>, addresses array<struct<freeform:string,locality:string>>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, confidence double"
    rows = [(str(k), (f"n{k}",), ("c",), [("1 st", "t")], (float(k), float(k), 1.0, 1.0), 0.9) for k in range(100)]
    spark.createDataFrame(rows, shape).repartitionByRange(10, "bbox.xmin").write.parquet(str(tmp_path / "p"))
    found = feeds.registry_slice(spark.read.parquet(str(tmp_path / "p")), 20.5, 29.5, 0.0, 2.0)
    assert sorted(x.id for x in found.collect()) == [str(k) for k in range(21, 30)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = feeds.registry_slice(spark.read.parquet(str(tmp_path / "p")), 20.5, 29.5, 0.0, 2.0)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(bbox.xmin,20.5)" in plan and "LessThan(bbox.xmax,29.5)" in plan  # files and row groups are left out by their statistics


def test_schedule_windows():
    from datetime import timezone

    from almanac.functions import windows

    assert windows.schedule(datetime(2026, 7, 9, 3, tzinfo=timezone.utc), 14) == ("2026-07-08", "2026-07-22")


def test_moved_starts_are_gone(spark, tmp_path):
    rows = [(1, "e", "x", "2026-01-01", 1), (1, "e", "x", "2026-01-02", 2), (1, "e", "x", "2026-01-02", 2), (2, "f", "y", "2026-01-03", 1)]
    shape = "source_id long, source_event_id string, event_id string, start_at string, seen_at long"
    for k, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.superseded_upserts(read, str(tmp_path / "t"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(3):
        got = streams.current(spark.read.parquet(str(tmp_path / "t")))
        assert sorted((x.source_event_id, x.start_at) for x in got.dropDuplicates(["source_event_id", "start_at"]).collect()) == [("e", "2026-01-02"), ("f", "2026-01-03")]
        streams.compact_current(spark, str(tmp_path / "t"), 10)
    assert len(list((tmp_path / "t").glob("batch=*"))) == 1
