"""Queries of readers, crawls and streams over pages and files that Spark makes of the driver's tables, each with SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from almanac.operators import listing
from almanac.operators.lineage import shared_folder
from almanac.plans.model import AS_OF, NOW, ctes, table
from almanac.plans.queries import _SQL, _query, _t
from almanac.plans.third import _all, _cards
from almanac.sources import feeds, frontier
from almanac.streaming import streams

_ISO = "'%Y-%m-%dT%H:%M:%SZ'"
_LISTED = f"""{ctes("events", "instances", "venues")}, n AS (SELECT event_id, min(start_at) AS began FROM instances GROUP BY event_id),
    l AS (SELECT e.id, e.title, e.is_free, e.canonical_url, e.price_min, v.name AS venue, v.address, v.lat, v.lng, n.began FROM events e JOIN n ON n.event_id = e.id LEFT JOIN venues v ON v.id = e.venue_id)"""


def _listed(spark, sf_dir):
    """Listings (id, title, is_free, canonical_url, price_min, venue, address, lat, lng, at) with their first start."""
    events, instances, venues = _all(spark, sf_dir, "events", "instances", "venues")
    first = instances.groupBy(F.col("event_id").alias("id")).agg(F.min("start_at").alias("at"))
    places = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), "address", "lat", "lng")
    rows = events.join(first, "id").join(places, "venue_id", "left")
    return rows.select("id", "title", "is_free", "canonical_url", "price_min", "venue", "address", "lat", "lng", "at")


def _pages(rows, name, item, url="https://feed.org/list"):
    """Pages (url, body) of a JSON service: 40 items each under ``name``, a path."""
    listed = rows.groupBy(F.floor(F.col("id") / 40).alias("page")).agg(F.collect_list(item).alias("x"))
    body = F.col("x")
    for part in reversed(name.split(".")):
        body = F.struct(body.alias(part))
    return listed.select(F.lit(url).alias("url"), F.to_json(body).alias("body"))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@_query(f"""{_LISTED} SELECT id::VARCHAR AS id, title AS name, canonical_url AS url, strftime(began, {_ISO}) AS starts, CASE id % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'postponed' ELSE 'scheduled' END AS status, venue, address, round(lat, 6) AS lat, round(CASE WHEN id % 3 <> 0 THEN lng END, 6) AS lng FROM l""")
def ticket_feed(spark, sf_dir):
    c = F.col
    state = F.when(c("id") % 5 == 0, "canceled").when(c("id") % 5 == 1, "postponed").otherwise("onsale")
    spot = F.struct(c("venue").alias("name"), F.struct(c("address").alias("line1")).alias("address"), F.struct(c("lat").cast("string").alias("latitude"), F.when(c("id") % 3 == 0, "NaN").otherwise(c("lng").cast("string")).alias("longitude")).alias("location"))
    item = F.struct(c("id").cast("string").alias("id"), c("title").alias("name"), c("canonical_url").alias("url"), F.struct(F.struct(_iso(c("at")).alias("dateTime")).alias("start"), F.struct(state.alias("code")).alias("status")).alias("dates"), F.struct(F.array(spot).alias("venues")).alias("_embedded"))
    found = feeds.ticket_pages(_pages(_listed(spark, sf_dir), "_embedded.events", item))
    return found.select("id", "name", "url", "starts", "status", "venue", "address", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@_query(f"""{_LISTED} SELECT id::VARCHAR AS id, title AS name, strftime(began, {_ISO}) AS starts, strftime(began + INTERVAL 90 MINUTE, {_ISO}) AS ends, CASE WHEN id % 4 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, venue, address, is_free FROM l""")
def organizer_feed(spark, sf_dir):
    c = F.col
    spot = F.struct(c("venue").alias("name"), F.struct(c("address").alias("localized_address_display")).alias("address"))
    item = F.struct(c("id").cast("string").alias("id"), F.struct(c("title").alias("text")).alias("name"), F.when(c("id") % 4 == 0, "canceled").otherwise("live").alias("status"), F.struct(_iso(c("at")).alias("utc")).alias("start"), F.struct(_iso(c("at") + F.expr("INTERVAL 90 MINUTES")).alias("utc")).alias("end"), "is_free", spot.alias("venue"))
    return feeds.organizer_pages(_pages(_listed(spark, sf_dir), "events", item)).select("id", "name", "starts", "ends", "status", "venue", "address", "is_free")


@_query(f"""{_LISTED} SELECT id::VARCHAR AS id, concat('club ', id % 6, ' vs. ', title) AS name, strftime(began, {_ISO}) AS starts, CASE WHEN id % 7 = 0 THEN 'postponed' ELSE 'scheduled' END AS status, venue FROM l WHERE id % 6 = 2""")
def schedule_feed(spark, sf_dir):
    c = F.col
    side = lambda k, n: F.struct(F.struct(k.alias("id"), n.alias("name")).alias("team"))
    teams = F.struct(side(c("id") % 6, F.concat(F.lit("club "), c("id") % 6)).alias("home"), side(F.lit(99).cast("long"), c("title")).alias("away"))
    game = F.struct(c("id").cast("long").alias("gamePk"), _iso(c("at")).alias("gameDate"), F.struct(F.when(c("id") % 7 == 0, "Postponed").otherwise("Scheduled").alias("detailedState")).alias("status"), teams.alias("teams"), F.struct(c("venue").alias("name")).alias("venue"))
    item = F.struct(F.array(game).alias("games"))
    return feeds.schedule_pages(_pages(_listed(spark, sf_dir), "dates", item), 2).select("id", "name", "starts", "status", "venue")


@_query(f"""{_LISTED} SELECT id::VARCHAR AS id, title AS name, concat('https://feed.org/', CASE WHEN id % 2 = 0 THEN '' ELSE 'a/' END, id) AS url, strftime(began, {_ISO}) AS starts, venue, address FROM l WHERE title NOT LIKE '%night%'""")
def upcoming_feed(spark, sf_dir):
    c = F.col
    link = F.concat(F.when(c("id") % 2 == 0, "/").otherwise(""), c("id"))
    item = F.struct(c("id").cast("string").alias("id"), "title", F.unix_millis(c("at").cast("timestamp")).alias("startDate"), link.alias("fullUrl"), F.struct(c("venue").alias("addressTitle"), c("address").alias("addressLine1")).alias("location"))
    return feeds.upcoming_pages(_pages(_listed(spark, sf_dir), "upcoming", item, "https://feed.org/a/list"), "night").select("id", "name", "url", "starts", "venue", "address")


_WALL = "timezone('UTC', timezone('America/Chicago', {0}))"


@_query(f"""{_LISTED}, x AS (SELECT *, date_trunc('day', began) + INTERVAL 1 HOUR * (12 + id % 10) + INTERVAL 15 MINUTE AS w FROM l WHERE id % 3 <> 0) SELECT id::VARCHAR AS id, title AS name, concat('https://list.org/#ev', id) AS url, strftime({_WALL.format("w")}, {_ISO}) AS starts,
    strftime({_WALL.format("w + INTERVAL 1 MINUTE * (30 + id % 60)")}, {_ISO}) AS ends FROM x""")
def clocked_feed(spark, sf_dir):
    c = F.col
    shown = F.struct(c("id").cast("string").alias("id"), c("title").alias("name"), F.date_format("at", "yyyy-MM-dd'T'00:00:00.000+00:00").alias("event_date"), F.concat(12 + c("id") % 10, F.lit(":15")).alias("start_time"), (30 + c("id") % 60).cast("double").alias("duration_minutes"), (c("id") % 3 != 0).alias("show_on_website"))
    listed = _listed(spark, sf_dir).groupBy(F.floor(c("id") / 40)).agg(F.collect_list(shown).alias("events"))
    spots = F.struct(F.array(F.struct(F.lit("Hall").alias("name"), F.lit("1 St").alias("address"))).alias("spots"))
    pages = listed.select(F.lit("https://list.org/x").alias("url"), F.to_json(F.struct("events", spots.alias("linked"))).alias("body"))
    return feeds.clocked_pages(pages, "https://list.org/").select("id", "name", "url", "starts", "ends")


@_query(f"""{_LISTED}, x AS (SELECT *, unnest(CASE WHEN id % 4 = 0 THEN range(0, 4) ELSE [0] END) AS k FROM l) SELECT id::VARCHAR AS id, title AS name, strftime({_WALL.format("CASE WHEN id % 4 = 0 THEN date_trunc('day', began) + INTERVAL 1 DAY * k ELSE date_trunc('minute', began) END")}, {_ISO}) AS starts, 'Own' AS venue, '2 Rd' AS address FROM x""")
def wrapped_feed(spark, sf_dir):
    c = F.col
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    item = F.struct(c("id").cast("string").alias("id"), F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), text(c("at")).alias("start_date"), text(F.when(c("id") % 4 == 0, c("at") + F.expr("INTERVAL 3 DAYS")).otherwise(c("at"))).alias("end_date"), F.lit(False).alias("all_day"))
    pages = _pages(_listed(spark, sf_dir), "events", item).select("url", F.concat(F.lit("<html>"), "body", F.lit("</html>")).alias("body"))
    return feeds.wrapped_pages(pages, "T, ST", "Own", "2 Rd").select("id", "name", "starts", "venue", "address")


@_query(f"""{_LISTED} SELECT concat('u', id) AS id, title AS name, strftime(began, {_ISO}) AS starts, strftime(began + INTERVAL 2 HOUR, {_ISO}) AS ends, CASE WHEN venue IS NULL THEN NULL ELSE venue END AS venue FROM l""")
def calendar_feed(spark, sf_dir):
    from almanac.sources import sinks

    c = F.col
    none = F.lit(None).cast("timestamp_ntz")
    bodies = _listed(spark, sf_dir).select(F.lit("https://feed.org/c").alias("url"), sinks.calendar_text(F.concat(F.lit("u"), c("id")), F.lit(AS_OF).cast("timestamp_ntz"), c("at"), none, c("title"), F.coalesce(c("venue"), F.lit("")), F.lit(None).cast("string"), F.lit("https://s"), "x").alias("body"))
    return feeds.calendars(bodies).select("id", "name", "starts", "ends", "venue")


@_query(f"""{_LISTED} SELECT title AS name, strftime(began, {_ISO}) AS starts, venue, address, round(lat, 6) AS lat, CASE WHEN coalesce(is_free, false) THEN true WHEN price_min IS NULL THEN NULL ELSE price_min = 0 END AS is_free FROM l""")
def linked_feed(spark, sf_dir):
    c = F.col
    price = F.when(c("is_free"), "0").otherwise(c("price_min").cast("string"))
    node = F.struct(F.lit("MusicEvent").alias("@type"), c("title").alias("name"), _iso(c("at")).alias("startDate"), F.concat(F.lit("/e/"), c("id")).alias("url"), F.struct(c("venue").alias("name"), F.struct(c("address").alias("streetAddress")).alias("address"), F.struct("lat").withField("latitude", c("lat")).alias("geo")).alias("location"), F.struct(price.alias("price")).alias("offers"))
    body = F.concat(F.lit("<![x]><p>broken<script type='application/ld+json'>{bad</script><script type='application/ld+json'>"), F.to_json(F.struct(F.array(node).alias("@graph"))), F.lit("</script>"))
    found = feeds.linked_data(_listed(spark, sf_dir).select(F.lit("https://feed.org/l").alias("url"), body.alias("body")))
    return found.select("name", "starts", "venue", "address", F.round("lat", 6).alias("lat"), "is_free")


@_query(f"""{_LISTED}, x AS (SELECT *, row_number() OVER (PARTITION BY id // 40 ORDER BY strftime(began, {_ISO}) DESC, id) AS n FROM l WHERE id % 2 = 0) SELECT concat('m', id // 40) AS url, concat('https://s/e?i=', id, '&x') AS loc, strftime(began, {_ISO}) AS lastmod FROM x WHERE n <= 7""")
def site_map_feed(spark, sf_dir):
    c = F.col
    entry = F.concat(F.lit("<url><loc>https://s/"), F.when(c("id") % 2 == 0, "e").otherwise("o"), F.lit("?i="), c("id"), F.lit("&amp;x</loc><lastmod>"), _iso(c("at")), F.lit("</lastmod></url>"))
    maps = _listed(spark, sf_dir).groupBy(F.concat(F.lit("m"), F.floor(c("id") / 40)).alias("url")).agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("id", entry.alias("e"))))["e"]).alias("body"))
    return feeds.site_map(maps, 7, "/e?")


@_query(f"""{_LISTED}, x AS (SELECT *, date_trunc('day', began) AS d, id % 11 + 1 AS h FROM l), y AS (SELECT *, CASE WHEN make_date(2001, month(d), day(d)) < DATE '2001-05-15' THEN make_date(2002, month(d), day(d)) ELSE make_date(2001, month(d), day(d)) END AS day FROM x WHERE NOT (month(d) = 2 AND day(d) = 29))
    SELECT title AS name, concat('https://feed.org/e/', id) AS url, strftime({_WALL.format("day::TIMESTAMP + INTERVAL 1 HOUR * (12 + h) + INTERVAL 30 MINUTE")}, {_ISO}) AS starts, 'Hall' AS venue FROM y""")
def card_feed(spark, sf_dir):
    c = F.col
    cell = lambda x: F.concat(F.lit("<td>"), x)  # noqa: E731  left open, as authors do
    row = F.concat(F.lit("<tr class=r>"), cell(F.date_format("at", "MMM")), cell(F.dayofmonth("at")), cell(F.concat(c("id") % 11 + 1, F.lit(":30 pm"))), cell(F.concat(F.lit('<a href="/e/'), c("id"), F.lit('">'), c("title"), F.lit("</a>"))))
    listed = _listed(spark, sf_dir).filter(F.date_format("at", "MM-dd") != "02-29").groupBy(F.floor(c("id") / 40)).agg(F.concat_ws("", F.collect_list(row)).alias("x"))
    pages = listed.select(F.lit("https://feed.org/cards").alias("url"), F.concat(F.lit("<table><tr><th>when"), "x", F.lit("</table><p>end")).alias("body"))
    wanted = {"name": ("td a", None), "link": ("a[href]", "href"), "month": ("td:nth-child(1)", None), "day": ("td:nth-child(2)", None), "time": ("td:nth-child(3)", None)}
    return feeds.card_pages(pages, "tr.r", wanted, "2001-05-15", "Hall").select("name", "url", "starts", "venue")


@_query(f"""{_LISTED}, x AS (SELECT *, row_number() OVER (ORDER BY canonical_url IS NULL, id) AS n FROM l) SELECT id, CASE WHEN canonical_url IS NOT NULL AND n <= 60 AND id % 3 = 0 THEN concat('detail ', id) ELSE title END AS name FROM x""")
def detail_enrichment(spark, sf_dir):
    c = F.col
    own = F.when(c("canonical_url").isNotNull(), F.concat(F.lit("https://d/"), c("id")))
    rows = _listed(spark, sf_dir).select(c("id").alias("ordinal"), own.alias("url"), c("title").alias("name"))
    pages = rows.filter("url IS NOT NULL").select("url", F.when(c("ordinal") % 3 == 0, F.concat(F.lit("<article><h1>detail <i>"), "ordinal", F.lit("</i>"))).otherwise("<p>none").alias("body"))
    found = feeds.enriched(rows, feeds.detail_fields(pages, {"name": ("article h1", None)}), 60)
    return found.select(c("ordinal").alias("id"), "name")


@_query("""SELECT p_partkey::VARCHAR AS id, p_name AS name, p_type AS category, concat(p_size, ' st') AS address, round(p_size * 1.0::DOUBLE, 6) AS lon, round(p_retailprice::DOUBLE, 6) AS lat FROM part WHERE p_size > 10 AND p_size < 30 AND p_retailprice > 905 AND p_retailprice < 980""")
def registry_box(spark, sf_dir):
    c = F.col
    side = c("p_size").cast("double")
    up = c("p_retailprice").cast("double")
    box = F.struct(side.alias("xmin"), side.alias("xmax"), up.alias("ymin"), up.alias("ymax"))
    places = _t(spark, sf_dir, "part").select(c("p_partkey").cast("string").alias("id"), F.struct(c("p_name").alias("primary")).alias("names"), F.struct(c("p_type").alias("primary")).alias("categories"), F.array(F.struct(F.concat("p_size", F.lit(" st")).alias("freeform"), F.lit("T").alias("locality"))).alias("addresses"), box.alias("bbox"), F.lit(0.9).alias("confidence"))
    found = feeds.registry_slice(places, 10, 30, 905, 980)
    return found.select("id", "name", "category", "address", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


#: A link's path names another page by its length and second letter.
_TARGET = "(length(l) * 37 + ascii(substr(l, 2, 1)) * 11) % (SELECT count(*) FROM pages)"


@_query(f"""WITH RECURSIVE e AS (SELECT DISTINCT page_id AS a, {_TARGET} AS b FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[a-zA-Z]+)"', 1)) AS l FROM pages)),
    r AS (SELECT 0::BIGINT AS page, 0 AS depth UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.page WHERE depth < 3)
    SELECT page, min(depth) AS depth FROM r GROUP BY page""")
def crawled_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    many = pages.count()
    named = F.concat(F.lit("https://p.org/"), F.col("page_id"))
    saved = pages.select(named.alias("url"), F.regexp_replace("html", '<a href="(?!/[a-zA-Z]+")[^"]*"', "<a").alias("body"))
    target = (F.length("path") * 37 + F.ascii(F.substring("path", 2, 1)) * 11) % many

    def expand(rows):
        found = frontier.saved(saved)(rows).withColumn("path", F.regexp_extract("link", "^https://p.org(/.*)$", 1))
        return found.select("url", F.concat(F.lit("https://p.org/"), target).alias("link"))

    seeds = spark.createDataFrame([("https://p.org/0",)], "url string")
    found = frontier.crawl(spark, f"{shared_folder(spark)}/almanac-crawl-{uuid.uuid4().hex}", seeds, expand, 3)
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("page"), "depth")


@_query(f"""{ctes("events", "instances", "venues")}, n AS (SELECT event_id, min(start_at) AS next_start FROM instances WHERE start_at >= TIMESTAMP '2001-05-15 12:00:00' GROUP BY event_id)
    SELECT e.id, n.next_start FROM events e JOIN n ON n.event_id = e.id WHERE e.is_free ORDER BY n.next_start, e.id LIMIT 50""")
def preset_free(spark, sf_dir):
    found = listing.search_listings(*_all(spark, sf_dir, "events", "instances", "venues"), listing.PRESETS["free"], NOW)
    return found.select("id", "next_start")


# Streams


def _streamed(spark, frame, start, mode="append"):
    """What a stream over the rows of ``frame``, which are written as files in ``start``'s order, gives when all are read."""
    at = f"{shared_folder(spark)}/almanac-stream-{uuid.uuid4().hex}"
    frame.write.parquet(f"{at}/in")
    found = start(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in"))
    write = found.writeStream.option("checkpointLocation", f"{at}/cp").trigger(availableNow=True)
    if mode == "append":
        write.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    else:
        write.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).start().awaitTermination()
    return spark.read.parquet(f"{at}/out") if mode != "append" else spark.read.schema(found.schema).parquet(f"{at}/out")


def _timed(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@_query(_SQL["trailing_60m_throttle"])
def streamed_trailing(spark, sf_dir):
    """As ``trailing_60m_throttle``, by state; the file holds the rows in order of time."""
    rows = _timed(spark, sf_dir).select("event_id", "user_id", "ts").coalesce(1).sortWithinPartitions("ts")
    return _streamed(spark, rows, lambda s: streams.trailing_counts(s, "user_id", "ts")).select("event_id", "n")


@_query("""SELECT DISTINCT user_id, event_type AS kind FROM events""")
def streamed_payloads(spark, sf_dir):
    rows = _timed(spark, sf_dir).select("user_id", "ts", F.to_json(F.struct("event_type")).alias("payload"))
    found = _streamed(spark, rows, lambda s: streams.new_payloads(s, ["user_id"], "ts", "4000 days"))
    return found.select("user_id", F.get_json_object("payload", "$.event_type").alias("kind"))


@_query("""SELECT CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day, count(*) AS k FROM events GROUP BY 1""")
def streamed_days(spark, sf_dir):
    found = _streamed(spark, _timed(spark, sf_dir).select("ts"), lambda s: streams.local_day_counts(s, "ts"), "complete")
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch").select("day", "k")


@_query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok FROM events), l AS (SELECT user_id, max((epoch_us(ts), event_id)) FILTER (WHERE ok) AS last FROM e GROUP BY user_id)
    SELECT concat('u', e.user_id) AS source, count(*) FILTER (WHERE last IS NULL OR (epoch_us(ts), event_id) > last)::INTEGER AS failures FROM e JOIN l ON l.user_id = e.user_id GROUP BY e.user_id""")
def streamed_backoff(spark, sf_dir):
    rows = _timed(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("source"), "ts", "event_id", (F.col("event_type") == "purchase").alias("ok")).coalesce(1).sortWithinPartitions("ts", "event_id")
    found = _streamed(spark, rows, streams.backoff_states, "update")
    return found.groupBy("source").agg(F.max_by("failures", "batch").alias("failures"))


@_query("""SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY user_id""")
def streamed_upserts(spark, sf_dir):
    """The newest event of each user, upserted batch by batch and folded twice."""
    at = f"{shared_folder(spark)}/almanac-upserts-{uuid.uuid4().hex}"
    rows = _timed(spark, sf_dir).select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    rows.write.parquet(f"{at}/in")
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    streams.upsert_into(read, f"{at}/t", ["user_id"], "at", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        streams.compact(spark, f"{at}/t", ["user_id"], "at", 10**6)
    return streams.latest(spark, f"{at}/t", ["user_id"], "at").select("user_id", "event_id")


@_query("""SELECT concat('u', user_id) AS source, count(*) AS n, sum(value) IS NOT NULL AS valued FROM events GROUP BY user_id""")
def per_source_work(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_id").alias("ordinal"), "value")

    def work(mine):
        return mine.groupby("source", as_index=False).agg(n=("ordinal", "size"), valued=("value", lambda v: bool(v.notna().any())))

    parts = streams.per_source(rows, work, "source string, n long, valued boolean")
    return parts.groupBy("source").agg(F.sum("n").alias("n"), F.bool_or("valued").alias("valued"))
