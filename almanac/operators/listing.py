"""Filters, orders and read models of listings.

Tables: ``events`` (id, slug, title, normalized_title, category, is_free, price_min, is_station, vibe_tags, audience_tags,
venue_id, ...), ``instances`` (event_id, start_at, status), ``venues`` (id, name, neighborhood, lat, lng, ...), ``picks`` (id,
week_of, sort_order, event_id, curator, blurb). ``as_of`` is the instant that counts as now.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import scoring, timefn, windows
from almanac.functions.bounded import or_none
from almanac.functions.names import normalize_name
from almanac.functions.understanding import parse_text
from almanac.operators.index import SearchIndex
from almanac.operators.ordered import ordinals
from almanac.operators.search import search

# How many rows modules, listings and reports show.
MODULE, WEEKEND, LISTING, RELATED, VENUE_ROWS, REPORT, OVERFETCH, HIGHLIGHTS = 6, 8, 100, 3, 60, 50, 200, 5
SITEMAP_READ, SITEMAP_ROWS = 15_000, 5_000
LOW_ADAPTERS = ("html", "firecrawl")
#: Seconds that a search waits for the vector of its text.
EMBED_WAIT = 0.15


# Filters


def _at(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def upcoming(as_of: datetime, column: str = "start_at") -> Column:
    return F.col(column) >= _at(as_of)


def free_only() -> Column:
    """Listings known to be free; unknown ones are not."""
    return F.coalesce(F.col("is_free"), F.lit(False))


def title_contains(query: str | Column) -> Column:
    """Whether the normalized title holds the normalized query anywhere."""
    return F.col("normalized_title").contains(normalize_name(F.lit(query) if isinstance(query, str) else query))


def station_like(venue: Column, address: Column, title: Column, names: Sequence[str], street: str, titles: Sequence[str]) -> Column:
    """Listings that look like the station's own: by venue name (as written), by address or by words of the title."""
    own = venue.rlike("|".join(names))
    return F.coalesce(own, F.lit(False)) | F.coalesce(address.rlike(f"(?i){street}"), F.lit(False)) | F.coalesce(title.rlike(rf"(?i)\b({'|'.join(titles)})\b"), F.lit(False))


def low_confidence(adapter: Column, category: Column) -> Column:
    return F.coalesce(adapter.isin(*LOW_ADAPTERS), F.lit(False)) | category.isNull()


def fresh(ts: Column, as_of: datetime, minutes: int = 20) -> Column:
    """Not older than ``minutes`` at ``as_of``."""
    return ts >= _at(as_of) - F.expr(f"INTERVAL {minutes} MINUTES")


def stale_fingerprints(events: DataFrame, fingerprint: Column) -> DataFrame:
    """Listings to work on again: without a vector, or whose text has changed since."""
    return events.filter(F.col("embedding").isNull() | ~F.coalesce(F.col("fingerprint") == fingerprint, F.lit(False)))


# Requests


@dataclass(frozen=True)
class Request:
    """A search as its address gives it; what is not valid is left out."""

    q: str | None = None
    date: str | None = None
    cat: str | None = None
    venue: str | None = None
    neighborhood: str | None = None
    free: bool = False
    vibe: str | None = None
    audience: str | None = None
    tod: str | None = None
    max_price: float | None = None
    first: str | None = None
    last: str | None = None
    sort: str | None = None
    lat: float | None = None
    lng: float | None = None

    @classmethod
    def parse(cls, raw: dict[str, str | list[str]]) -> Request:
        """Of a repeated key the first counts."""
        one = {k: (v[0] if v else None) if isinstance(v, list) else v for k, v in raw.items()}
        given = {}
        for key, allowed in (("date", windows.PRESETS), ("tod", windows.TIMES_OF_DAY), ("sort", ("recommended", "near"))):
            given[key] = one.get(key) if one.get(key) in allowed and one.get(key) != "tomorrow" else None
        number = lambda k, lo, hi: (lambda n: n if n is not None and lo <= n <= hi else None)(_number(one.get(k)))
        text = {k: one.get(k) for k in ("q", "cat", "venue", "neighborhood", "vibe", "audience")}
        day = lambda k: one.get(k) if one.get(k) and len(one[k]) == 10 and windows.day_or_none(one[k]) else None
        bounds = float("inf")
        return cls(**text, **given, free=one.get("free") == "1", max_price=number("maxPrice", -bounds, bounds), first=day("from"), last=day("to"), lat=number("lat", -90, 90), lng=number("lng", -180, 180))

    def active(self) -> bool:
        """Whether anything beyond the order of rows is asked for."""
        return any(getattr(self, f.name) not in (None, False, "") for f in fields(self) if f.name not in ("sort", "lat", "lng"))

    def resolve(self, now: datetime) -> Resolved:
        """What the text says about dates, time of day and price goes first."""
        said = parse_text(self.q or "", now)
        preset = windows.preset(self.date, now) if self.date else None
        return Resolved(said.text, windows.choose(said.window, preset, windows.custom(self.first, self.last)), said.time_of_day or self.tod, self.free or said.free, self)


@dataclass(frozen=True)
class Resolved:
    text: str
    window: windows.Window | None
    time_of_day: str | None
    free: bool
    request: Request


def _number(value: str | None) -> float | None:
    try:
        n = float(value) if value and value.strip() else None
    except ValueError:
        return None
    return n if n == n else None


#: Requests that pages stand for.
PRESETS = {"tonight": Request(date="tonight"), "today": Request(date="today"), "weekend": Request(date="this-weekend"), "free": Request(free=True), "live-music": Request(cat="music")}


def facet_link(current: dict[str, str | float], patch: dict[str, str | None]) -> str:
    """The address of a listing with ``patch`` put over ``current``; None takes a key away."""
    merged = {k: str(v) for k, v in current.items() if v not in (None, "")}
    for k, v in patch.items():
        merged.pop(k, None) if v is None else merged.__setitem__(k, v)
    return "/events" + (f"?{urlencode(merged)}" if merged else "")


def base_rows(events: DataFrame, instances: DataFrame, venues: DataFrame, asked: Resolved, as_of: datetime) -> DataFrame:
    """Listings (with venue and next_start) that have an instance which meets all that was asked for.

    Filters of instances and listings come before the join; a window holds both its ends.
    """
    r = asked.request
    times = [upcoming(as_of)]
    if asked.window:
        lo, hi = (F.lit(x.replace(tzinfo=None)).cast("timestamp_ntz") for x in asked.window)
        times.append(F.col("start_at").between(lo, hi))
    if asked.time_of_day:
        times.append(F.coalesce(timefn.time_of_day(F.col("start_at")) == asked.time_of_day, F.lit(False)))
    of: list[Column] = []
    if r.cat:
        of.append(F.col("category") == r.cat)
    if asked.free:
        of.append(free_only())
    if r.vibe:
        of.append(F.array_contains("vibe_tags", r.vibe))
    if r.audience:
        of.append(F.array_contains("audience_tags", r.audience))
    if r.max_price is not None:
        of.append(F.col("price_min") <= r.max_price)
    place: list[Column] = []
    if r.venue:
        place.append(F.col("venue_slug") == r.venue)
    if r.neighborhood:
        place.append(F.col("neighborhood") == r.neighborhood)
    both = lambda x: reduce(lambda a, b: a & b, x, F.lit(True))
    next_start = instances.filter(both(times)).groupBy(F.col("event_id").alias("id")).agg(F.min("start_at").alias("next_start"))
    where = venues.select(F.col("id").alias("venue_id"), F.col("slug").alias("venue_slug"), F.col("normalized_name").alias("venue"), "neighborhood")
    return events.filter(both(of)).join(next_start, "id").join(where, "venue_id", "left").filter(both(place))


def search_listings(events: DataFrame, instances: DataFrame, venues: DataFrame, request: Request, now: datetime, vector: Sequence[float] | None = None, limit: int = 50, stemmed: bool = True, index: SearchIndex | None = None, embed: Callable[[str], Sequence[float]] | None = None, wait: float = EMBED_WAIT) -> DataFrame:
    """(id, score, next_start) of the listings that a request finds at the aware instant ``now``, best first.

    ``vector`` is what the caller's model made of the text, or ``embed`` makes it of what is left of the text once dates
    are understood. Without it, or when ``embed`` fails or takes more than ``wait`` seconds, words alone rank. An
    ``index`` of ``search_texts`` spares reading the texts.
    """
    asked = request.resolve(now)
    if vector is None and embed is not None and asked.text.strip():
        vector = or_none(lambda: embed(asked.text), wait)
    base = base_rows(events, instances, venues, asked, now.replace(tzinfo=None))
    rows = base.select("id", "title", _tags().alias("tags"), "description", "venue", "next_start", *(["embedding"] if "embedding" in base.columns else []))
    return search(rows, "id", asked.text, list(vector) if vector is not None else None, None, limit, stemmed, index)


def _tags() -> Column:
    return F.concat_ws(" ", "category", F.array_join("vibe_tags", " "), F.array_join("audience_tags", " "))


def search_texts(events: DataFrame, venues: DataFrame) -> DataFrame:
    """(id, title, tags, description, venue): what a search index of listings is made of."""
    where = venues.select(F.col("id").alias("venue_id"), F.col("normalized_name").alias("venue"))
    return events.join(where, "venue_id", "left").select("id", "title", _tags().alias("tags"), "description", "venue")


def search_fingerprint() -> Column:
    return F.xxhash64("title", "tags", "description", "venue")


# Orders


def by_time(card: str = "") -> list[Column]:
    """The station's own first, then by start, then by slug."""
    return [F.desc_nulls_last("is_station"), F.asc("start_at"), F.asc("slug")]


def day_sorted(cards: DataFrame, mode: str = "default", point: tuple[float, float] | None = None) -> DataFrame:
    """``cards`` with their ``place`` within their local day.

    ``recommended`` puts picked cards first; ``near`` goes by distance from ``point``, those of unknown place last in
    their given order (``ordinal``). A day lies in as many ranges as it needs.
    """
    rows = cards.withColumn("day", timefn.local_day(F.col("start_at")))
    if mode == "recommended":
        order = [F.desc_nulls_last("picked"), *by_time()]
    elif mode == "near" and point:
        rows = rows.withColumn("metres", scoring.haversine_m(F.lit(point[0]), F.lit(point[1]), F.col("lat"), F.col("lng")))
        order = [F.asc_nulls_last("metres"), F.asc("_then"), F.asc("ordinal")]
    else:
        order = by_time()
    if mode == "near" and point:
        rows = rows.withColumn("_then", F.when(F.col("metres").isNotNull(), F.col("start_at")))
    return ordinals(rows, ["day"], order, "place").drop("_then")


def day_groups(hits: DataFrame) -> DataFrame:
    """``hits`` (ordinal, start_at, ...) with their local day and its ``group``, from 1: days come as their first hit does.

    Hits of a search are in score order, and so are their days; those of a listing come in time order.
    """
    rows = hits.withColumn("day", timefn.local_day(F.col("start_at")))
    first = rows.groupBy("day").agg(F.min("ordinal").alias("_first"))
    ranked = first.withColumn("group", F.row_number().over(Window.orderBy("_first")))  # a row a day
    return rows.join(F.broadcast(ranked.select("day", "group")), "day")


def pins(cards_: DataFrame, places: DataFrame) -> DataFrame:
    """(venue_id, lat, lng, n, slug): a pin for each venue of known place, with how many listings it has and the slug of the first."""
    order = F.struct("start_at", "ordinal")
    rows = cards_.groupBy("venue_id").agg(F.count_distinct("event_id").alias("n"), F.min_by("slug", order).alias("slug"))
    return rows.join(places.select(F.col("id").alias("venue_id"), "lat", "lng"), "venue_id")


def highlights(cards: DataFrame, many: int = HIGHLIGHTS) -> DataFrame:
    """The first cards, the station's own before the others, each kind in its given order (``ordinal``)."""
    return cards.orderBy(F.desc_nulls_last("is_station"), "ordinal").limit(many)


def oldest(rows: DataFrame, many: int, created: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.asc_nulls_last(created), key).limit(many)


def others(rows: DataFrame, order: Sequence[Column], key: str, own: object, many: int = RELATED) -> DataFrame:
    """The first ``many`` of the first ``many`` + 1 rows, itself left out."""
    return rows.orderBy(*order).limit(many + 1).filter(F.col(key) != F.lit(own)).orderBy(*order).limit(many)


def site_rows(instances: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    """(slug, start_at): of the first SITEMAP_READ instances to come, each listing's last, at most SITEMAP_ROWS by slug."""
    first = instances.filter(upcoming(as_of)).orderBy("start_at", "event_id").limit(SITEMAP_READ)
    last = first.groupBy(F.col("event_id").alias("id")).agg(F.max("start_at").alias("start_at"))
    return last.join(events.select("id", "slug"), "id").select("slug", "start_at").orderBy("slug").limit(SITEMAP_ROWS)


# Read models


def cards(rows: DataFrame, events: DataFrame, venues: DataFrame) -> DataFrame:
    """``rows`` (event_id, start_at, ...) with what a card shows; rows of listings that are gone are left out."""
    shown = events.select(F.col("id").alias("event_id"), "slug", "title", "category", "is_free", "is_station", "venue_id")
    place = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), "neighborhood")
    return rows.join(shown, "event_id").join(place, "venue_id", "left")


def window_items(instances: DataFrame, events: DataFrame, venues: DataFrame, window: windows.Window, many: int) -> DataFrame:
    """Cards of the first ``many`` instances from the window's start to, but not at, its end."""
    lo, hi = (F.lit(x.replace(tzinfo=None)).cast("timestamp_ntz") for x in window)
    rows = instances.filter((F.col("start_at") >= lo) & (F.col("start_at") < hi)).select("event_id", "start_at")
    return cards(rows.orderBy("start_at", "event_id").limit(many), events, venues)


def station_items(instances: DataFrame, events: DataFrame, venues: DataFrame, as_of: datetime, many: int = MODULE) -> DataFrame:
    """Cards of the station's next listings, each at its next start."""
    own = events.filter("is_station").select(F.col("id").alias("event_id"))
    rows = instances.filter(upcoming(as_of)).join(own, "event_id", "left_semi").groupBy("event_id").agg(F.min("start_at").alias("start_at"))
    return cards(rows.orderBy("start_at", "event_id").limit(many), events, venues)


def neighborhood_counts(instances: DataFrame, events: DataFrame, venues: DataFrame, as_of: datetime, tiles: Sequence[str] = ()) -> DataFrame:
    """(name, n) of listings to come in each neighborhood; ``tiles`` are there with 0 where they have none."""
    soon = instances.filter(upcoming(as_of)).select(F.col("event_id").alias("id")).distinct()
    rows = events.join(soon, "id", "left_semi").join(venues.filter("neighborhood IS NOT NULL").select(F.col("id").alias("venue_id"), F.col("neighborhood").alias("name")), "venue_id")
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    if not tiles:
        return counts
    given = counts.sparkSession.createDataFrame([(t,) for t in tiles], "name string")
    return counts.join(given, "name", "full").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def week_picks(picks: DataFrame, events: DataFrame, venues: DataFrame, instances: DataFrame, as_of: datetime) -> DataFrame:
    """Picks of the local week of ``as_of`` with their card and next start, if there is one, in their order."""
    monday = timefn.week_monday(F.lit(as_of).cast("timestamp_ntz"))
    soon = instances.filter(upcoming(as_of)).groupBy("event_id").agg(F.min("start_at").alias("start_at"))
    rows = picks.filter(F.col("week_of") == monday).join(soon, "event_id", "left")
    return cards(rows, events, venues).orderBy("sort_order", "id")


def default_listing(instances: DataFrame, events: DataFrame, venues: DataFrame, as_of: datetime, many: int = LISTING) -> DataFrame:
    rows = instances.filter(upcoming(as_of)).select("event_id", "start_at").orderBy("start_at", "event_id").limit(many)
    return day_sorted(cards(rows, events, venues))


def event_detail(events: DataFrame, instances: DataFrame, venues: DataFrame, links: DataFrame, sources: DataFrame, slug: str, as_of: datetime) -> DataFrame:
    """The listing with its venue, its starts to come in order, and the name of its canonical source."""
    one = events.filter(F.col("slug") == slug)
    soon = instances.filter(upcoming(as_of)).groupBy(F.col("event_id").alias("id")).agg(F.sort_array(F.collect_list("start_at")).alias("starts"))
    source = links.filter("is_canonical").join(sources.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id").groupBy(F.col("event_id").alias("id")).agg(F.min("source").alias("source"))
    place = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), "neighborhood")
    rows = one.join(place, "venue_id", "left").join(soon, "id", "left").join(source, "id", "left")
    return rows.withColumn("starts", F.coalesce("starts", F.array().cast("array<timestamp_ntz>")))


def related(base: DataFrame, own: object, category: str | None, neighborhood: str | None) -> DataFrame:
    """Other listings to come of the category, or, for a listing without one, of the neighborhood."""
    if category:
        base = base.filter(F.col("category") == category)
    elif neighborhood:
        base = base.filter(F.col("neighborhood") == neighborhood)
    return others(base, [F.asc("next_start"), F.asc("slug")], "id", own)


def venue_rows(instances: DataFrame, events: DataFrame, venues: DataFrame, slug: str, as_of: datetime) -> DataFrame:
    """Of the first VENUE_ROWS instances to come, those at the venue: the limit comes first."""
    rows = instances.filter(upcoming(as_of)).select("event_id", "start_at").orderBy("start_at", "event_id").limit(VENUE_ROWS)
    here = venues.filter(F.col("slug") == slug)
    return cards(rows, events, here).filter("venue_name IS NOT NULL")


def home(tables: dict[str, DataFrame], as_of: datetime, tiles: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The modules of the first page; a module that cannot be planned is left out."""
    e, i, v = tables["events"], tables["instances"], tables["venues"]
    made = {
        "tonight": lambda: window_items(i, e, v, windows.preset("tonight", as_of), MODULE),
        "weekend": lambda: window_items(i, e, v, windows.preset("this-weekend", as_of), WEEKEND),
        "station": lambda: station_items(i, e, v, as_of.replace(tzinfo=None)),
        "picks": lambda: week_picks(tables["picks"], e, v, i, as_of.replace(tzinfo=None)),
        "hoods": lambda: neighborhood_counts(i, e, v, as_of.replace(tzinfo=None), tiles),
    }
    return {name: make() for name, make in made.items() if name != "picks" or "picks" in tables}


def home_rows(tables: dict[str, DataFrame], as_of: datetime, tiles: Sequence[str] = ()) -> tuple[dict[str, list], dict[str, str]]:
    """The rows of the modules of ``home``, a few each, and the errors of those that could not be read, which are empty."""
    rows: dict[str, list] = {}
    errors: dict[str, str] = {}
    for name, module in home(tables, as_of, tiles).items():
        try:
            rows[name] = module.collect()
        except Exception as problem:  # noqa: BLE001  the other modules are shown
            rows[name], errors[name] = [], str(problem).split("\n")[0]
    return rows, errors


def digest(tables: dict[str, DataFrame], as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """The week's picks, and highlights of its weekend."""
    modules = home(tables, as_of)
    weekend = modules["weekend"].withColumn("ordinal", F.struct("start_at", "event_id"))
    return modules["picks"], highlights(weekend)


def event_report(events: DataFrame, links: DataFrame, sources: DataFrame, instances: DataFrame, query: str = "", low_only: bool = False) -> DataFrame:
    """The first REPORT listings by title, of OVERFETCH read, with their canonical source and earliest start of all."""
    rows = events.filter(title_contains(query)) if query else events
    rows = rows.orderBy("normalized_title", "id").limit(OVERFETCH)
    of = links.filter("is_canonical").join(sources.select(F.col("id").alias("source_id"), "key", "adapter_type"), "source_id")
    of = of.groupBy(F.col("event_id").alias("id")).agg(F.min(F.struct("key", "adapter_type")).alias("x"))
    first = instances.groupBy(F.col("event_id").alias("id")).agg(F.min("start_at").alias("next_start"))
    rows = rows.join(of, "id", "left").join(first, "id", "left").withColumn("low", low_confidence(F.col("x.adapter_type"), F.col("category")))
    if low_only:
        rows = rows.filter("low")
    return rows.orderBy("normalized_title", "id").limit(REPORT).select("id", "title", "category", F.col("x.key").alias("source"), "next_start", "low")


def review_report(reviews: DataFrame, events: DataFrame, as_of: datetime) -> DataFrame:
    """Pending reviews with both titles, best first."""
    side = lambda k: events.select(F.col("id").alias(f"event_{k}"), F.col("title").alias(f"title_{k}"))
    return reviews.filter("status = 'pending'").join(side("a"), "event_a").join(side("b"), "event_b").orderBy(F.desc("score"), "event_a", "event_b")


def source_report(sources: DataFrame) -> DataFrame:
    """Sources, the failing first, then those of unknown health."""
    rank = F.when(F.col("status") == "failing", 0).when(F.col("status") == "ok", 2).otherwise(1)
    return sources.orderBy(rank, "key")


def venue_report(venues: DataFrame, events: DataFrame) -> DataFrame:
    """Venues with how many listings each has, most first."""
    counts = events.groupBy(F.col("venue_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = venues.join(counts, "id", "left").select("id", "name", "neighborhood", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return rows.orderBy(F.desc("n"), "name", "id")


def pick_weeks(picks: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The weeks that have picks, and ``extra`` ones, latest first."""
    weeks = picks.select("week_of")
    if extra:
        weeks = weeks.unionByName(picks.sparkSession.createDataFrame([(w,) for w in extra], "week_of string").select(F.col("week_of").cast("date").alias("week_of")))
    return weeks.distinct().orderBy(F.desc("week_of"))


def with_picked(cards_: DataFrame, picks: DataFrame, as_of: datetime) -> DataFrame:
    """``cards_`` with whether this week's picks have them."""
    week = picks.filter(F.col("week_of") == timefn.week_monday(F.lit(as_of).cast("timestamp_ntz"))).select("event_id", F.lit(True).alias("picked")).distinct()
    return cards_.join(week, "event_id", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))


def place_of(venues: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, lat, lng): the venue's own place if both its numbers are known, else that of its registry entry."""
    other = registry.select(F.col("id").alias("registry_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lng"))
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    rows = venues.join(other, "registry_id", "left")
    return rows.select("id", F.when(own, F.col("lat")).otherwise(F.col("_lat")).alias("lat"), F.when(own, F.col("lng")).otherwise(F.col("_lng")).alias("lng")).filter("lat IS NOT NULL AND lng IS NOT NULL")


