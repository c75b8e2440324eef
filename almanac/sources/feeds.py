"""Feeds in JSON, calendar text, embedded linked data and site maps.

Every reader takes a DataFrame of whole documents (``url``, ``body``) and gives LISTING columns, so that fetching, which
needs a network, stays apart from parsing. JSON feeds use ``from_json`` and ``inline``; the others are Arrow functions.
Broken documents give no rows; listings without an id, a name or a start are left out by ``valid``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from urllib.parse import urljoin
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.markup import Markup, plain_text, tree
from almanac.functions.names import assumed_hour, clock24, occurrence_date, strip_html
from almanac.functions.timefn import ZONE

LISTING = "id string, name string, url string, starts string, ends string, status string, venue string, address string, lat double, lng double, image string, is_free boolean, description string"
FIELDS = [x.split()[0] for x in LISTING.split(", ")]


def valid(rows: DataFrame) -> DataFrame:
    named = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return rows.filter(named("id") & named("name") & named("starts"))


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with whether each is ``valid``: what a run counts as published and skipped."""
    named = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return rows.withColumn("valid", named("id") & named("name") & named("starts"))


def keep_first(rows: DataFrame, ordinal: str) -> DataFrame:
    """The first row of each (id, starts) by ``ordinal``."""
    at = Window.partitionBy("id", "starts").orderBy(ordinal)
    return rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def finite(value: Column) -> Column:
    """A number, or null for text that is none, NaN and infinities."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def status_of(raw: Column) -> Column:
    """cancelled, postponed or scheduled, from the spellings that feeds use."""
    word = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(word.rlike("cancell?ed"), "cancelled").when(word.rlike("postponed|rescheduled"), "postponed").otherwise("scheduled")


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def _listing(rows: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict(x.split() for x in LISTING.split(", "))
    return rows.select(*[columns.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in FIELDS])


_PLACES = "venues array<struct<name:string,address:struct<line1:string>,city:struct<name:string>,location:struct<latitude:string,longitude:string>>>"
_TICKETS = f"_embedded struct<events:array<struct<id:string,name:string,url:string,images:array<struct<url:string>>,dates:struct<start:struct<dateTime:string>,status:struct<code:string>>,_embedded:struct<{_PLACES.replace(' ', ':', 1)}>>>>"


def ticket_pages(pages: DataFrame) -> DataFrame:
    """Pages of a ticket service: the first venue and image of each nested event."""
    rows = pages.select(F.explode(F.from_json("body", _TICKETS)["_embedded"]["events"]).alias("e"))
    place = F.get(F.col("e._embedded.venues"), F.lit(0))
    return _listing(
        rows, id=F.col("e.id"), name=F.col("e.name"), url=F.col("e.url"), starts=F.col("e.dates.start.dateTime"), status=status_of(F.col("e.dates.status.code")),
        venue=place["name"], address=_joined(place["address"]["line1"], place["city"]["name"]), lat=finite(place["location"]["latitude"]), lng=finite(place["location"]["longitude"]),
        image=F.get(F.col("e.images"), F.lit(0))["url"],
    )


_ORGANIZED = "events array<struct<id:string,name:struct<text:string>,url:string,status:string,start:struct<utc:string>,end:struct<utc:string>,is_free:boolean,venue:struct<name:string,address:struct<localized_address_display:string>,latitude:string,longitude:string>,logo:struct<url:string>>>"


def organizer_pages(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode(F.from_json("body", _ORGANIZED)["events"]).alias("e"))
    return _listing(
        rows, id=F.col("e.id"), name=F.col("e.name.text"), url=F.col("e.url"), starts=F.col("e.start.utc"), ends=F.col("e.end.utc"), status=status_of(F.col("e.status")), venue=F.col("e.venue.name"),
        address=F.col("e.venue.address.localized_address_display"), lat=finite(F.col("e.venue.latitude")), lng=finite(F.col("e.venue.longitude")), image=F.col("e.logo.url"), is_free=F.col("e.is_free"),
    )


_SIDE = "struct<team:struct<id:bigint,name:string>>"
_SCHEDULE = f"dates array<struct<games:array<struct<gamePk:bigint,gameDate:string,status:struct<detailedState:string>,teams:struct<home:{_SIDE},away:{_SIDE}>,venue:struct<name:string>>>>>"


def schedule_pages(pages: DataFrame, home_team: int) -> DataFrame:
    """Home games of one team."""
    days = pages.select(F.explode(F.from_json("body", _SCHEDULE)["dates"]).alias("d"))
    rows = days.select(F.explode("d.games").alias("g")).filter(F.col("g.teams.home.team.id") == home_team)
    title = F.concat(F.col("g.teams.home.team.name"), F.lit(" vs. "), F.col("g.teams.away.team.name"))
    return _listing(rows, id=F.col("g.gamePk").cast("string"), name=title, starts=F.col("g.gameDate"), status=status_of(F.col("g.status.detailedState")), venue=F.col("g.venue.name"))


_UPCOMING = "upcoming array<struct<id:string,title:string,excerpt:string,startDate:bigint,endDate:bigint,fullUrl:string,assetUrl:string,location:struct<addressTitle:string,addressLine1:string,addressLine2:string>>>"


def upcoming_pages(pages: DataFrame, skip_title: str | None = None) -> DataFrame:
    """Feeds whose instants are milliseconds since the epoch; titles that match ``skip_title`` are left out."""
    rows = pages.select("url", F.explode(F.from_json("body", _UPCOMING)["upcoming"]).alias("e"))
    if skip_title:
        rows = rows.filter(~F.coalesce(F.col("e.title").rlike(skip_title), F.lit(False)))
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    place = F.col("e.location")
    return _listing(
        rows, id=F.col("e.id"), name=F.col("e.title"), url=_resolved(F.col("url"), F.col("e.fullUrl")), starts=iso(F.col("e.startDate")), ends=iso(F.col("e.endDate")), status=F.lit("scheduled"),
        venue=F.nullif(place["addressTitle"], F.lit("")), address=_joined(place["addressLine1"], place["addressLine2"]), image=F.col("e.assetUrl"), description=strip_html(F.col("e.excerpt")),
    )


def _resolved(base: Column, link: Column) -> Column:
    """Links with a scheme, from the root, from the scheme (``//``) or beside the page; others than http(s) give null."""
    scheme, root = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    beside = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(base, r"^https?://[^/?#]+(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")), link)
    found = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
    return F.when(link.rlike("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"), None).otherwise(F.coalesce(found, F.when(link != "", beside)))


def resolved(base: str, link: object) -> str | None:
    """``link`` on the page ``base``; None, never an error, for what is no link."""
    try:
        return urljoin(base, link) if isinstance(link, str) and link else None
    except ValueError:
        return None


def _parsed(pages: DataFrame, parse: Callable[[str, str], Iterator[dict]], shape: str = LISTING) -> DataFrame:
    """What ``parse`` gives for each page; one that it fails on gives a row of its url alone, which counts as skipped."""
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        for batch in batches:
            found: list[dict] = []
            for url, body in zip(batch["url"], batch["body"]):
                try:
                    found += list(parse(url or "", body or ""))
                except Exception:  # noqa: BLE001  a page is whatever its site sends
                    found.append({"url": url})
            yield pd.DataFrame([[row.get(f) for f in names] for row in found], columns=names, dtype=object)

    return pages.select("url", "body").mapInPandas(run, shape)


def _instant(value: str, params: dict[str, str]) -> str | None:
    """UTC text of a calendar stamp: with Z, in a named zone, or a day, which begins at local midnight."""
    try:
        zone = ZoneInfo(params.get("TZID", ZONE))
        if len(value) == 8:
            at = datetime.strptime(value, "%Y%m%d").replace(tzinfo=zone)
        else:
            at = datetime.strptime(value.rstrip("Z"), "%Y%m%dT%H%M%S").replace(tzinfo=timezone.utc if value.endswith("Z") else zone)
        return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (ValueError, KeyError):
        return None


def _unescaped(value: str) -> str:
    out, chars = [], iter(value)
    for c in chars:
        out.append({"n": "\n", "N": "\n"}.get(d := next(chars, ""), d) if c == "\\" else c)
    return "".join(out)


def _calendar(url: str, body: str) -> Iterator[dict]:
    lines = body.replace("\r\n", "\n").replace("\n ", "").replace("\n\t", "").split("\n")
    event, stack = None, []
    for line in lines:
        head, _, value = line.partition(":")
        name, *params = head.split(";")
        name = name.upper()
        if name == "BEGIN":
            stack.append(value.upper())
            event = {} if stack[-1] == "VEVENT" else event
        elif name == "END" and stack:
            if stack.pop() == "VEVENT" and event is not None:
                starts, ends = event.get("DTSTART"), event.get("DTEND")
                if event.get("UID") and event.get("SUMMARY") and starts:
                    state = "cancelled" if event.get("STATUS", "").upper() == "CANCELLED" else "scheduled"
                    venue, _, address = event.get("LOCATION", "").partition(",")
                    yield {"id": event["UID"], "name": event["SUMMARY"], "url": event.get("URL"), "starts": starts, "ends": None if ends == starts else ends, "status": state, "venue": venue.strip() or None, "address": address.strip() or None}
                event = None
        elif event is not None and stack[-1] == "VEVENT":
            event[name] = _instant(value, dict(p.split("=", 1) for p in params if "=" in p)) if name in ("DTSTART", "DTEND") else _unescaped(value)


def calendars(pages: DataFrame) -> DataFrame:
    """Events of calendar text; one that ends when it starts has no end."""
    return _parsed(pages, _calendar)


class _Scripts(Markup):
    def __init__(self):
        super().__init__()
        self.inside, self.found = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "script" and dict(attrs).get("type") == "application/ld+json"
        if self.inside:
            self.found.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def _nodes(value) -> Iterator[dict]:
    """Objects in document order, those with a graph before its members; lists of any depth, without recursion."""
    waiting = [value]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            yield node
            if "@graph" in node:
                waiting.append(node["@graph"])


def _first(value) -> object:
    return (value[0] if value else None) if isinstance(value, list) else value


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _number(value) -> float | None:
    try:
        n = float(value) if isinstance(value, (str, int, float)) and not isinstance(value, bool) else None
    except ValueError:
        return None
    return n if n is not None and abs(n) < float("inf") else None


def _linked(url: str, body: str) -> Iterator[dict]:
    reader = _Scripts().read(body)
    seen = set()
    for block in reader.found:
        try:
            nodes = list(_nodes(json.loads(block)))
        except (ValueError, RecursionError):
            continue
        for node in nodes:
            kinds = node.get("@type")
            kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
            name = _text(node.get("name"))
            if not name or not any(k == "Festival" or k.endswith("Event") for k in kinds):
                continue
            place = node.get("location")
            spot = place if isinstance(place, dict) else {}
            where, geo = spot.get("address"), spot.get("geo") if isinstance(spot.get("geo"), dict) else {}
            parts = [where.get(k) for k in ("streetAddress", "addressLocality", "addressRegion")] if isinstance(where, dict) else [where]
            venue = _text(place) or _text(spot.get("name"))
            offer, image, state = _first(node.get("offers")), _first(node.get("image")), str(node.get("eventStatus"))
            price = _number(offer.get("price", offer.get("lowPrice"))) if isinstance(offer, dict) else None
            link = resolved(url, node.get("url"))
            key = link or _text(node.get("@id")) or f"{name}|{node.get('startDate') or ''}|{venue or ''}"
            if (key, _text(node.get("startDate"))) in seen:
                continue
            seen.add((key, _text(node.get("startDate"))))
            yield {
                "id": key, "description": plain_text(_text(node.get("description"))), 
                "name": name, "url": link, "starts": _text(node.get("startDate")), "ends": _text(node.get("endDate")),
                "status": "cancelled" if "Cancelled" in state else "postponed" if "Postponed" in state or "Rescheduled" in state else "scheduled",
                "venue": venue, "address": ", ".join(p for p in parts if isinstance(p, str) and p) or None, "lat": _number(geo.get("latitude")), "lng": _number(geo.get("longitude")),
                "image": _text(image) or (_text(image.get("url")) if isinstance(image, dict) else None), "is_free": None if price is None else price == 0,
            }


def linked_data(pages: DataFrame) -> DataFrame:
    """Event nodes of linked data in pages, each (id, start) once; a script that is no JSON is skipped.

    Where ``pages`` has a column ``page``, the result has it too: the url of the page.
    """
    if "page" not in pages.columns:
        return _parsed(pages, _linked)
    return _parsed(pages, lambda url, body: ({**row, "page": url} for row in _linked(url, body)), f"{LISTING}, page string")


def site_map(pages: DataFrame, most: int, holding: str = "") -> DataFrame:
    """(url, loc, lastmod) of each site map's entries that hold ``holding``: latest first, undated ones last in document
    order, at most ``most`` a map."""
    entries = F.regexp_extract_all("body", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    rows = pages.select("url", F.posexplode(entries).alias("place", "entry"))
    part = lambda tag: F.nullif(F.trim(F.regexp_extract("entry", rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    found = rows.select("url", "place", F.replace(part("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), part("lastmod").alias("lastmod")).filter(F.col("loc").contains(holding))
    order = Window.partitionBy("url").orderBy(F.desc_nulls_last("lastmod"), "place")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("url", "loc", "lastmod")


def crawled(maps: DataFrame, details: DataFrame, most: int, holding: str = "") -> tuple[DataFrame, DataFrame]:
    """Listings of the detail pages (url, body) that site maps name, and (url) of those pages that gave none."""
    wanted = site_map(maps, most, holding).select(F.col("loc").alias("url")).distinct()
    pages = wanted.join(details, "url", "left")
    found = linked_data(pages.filter("body IS NOT NULL").select("url", "body").withColumn("page", F.col("url")))
    return found, wanted.join(found.select(F.col("page").alias("url")), "url", "left_anti")


def enriched(rows: DataFrame, details: DataFrame, most: int, ordinal: str = "ordinal") -> DataFrame:
    """``rows`` whose columns the detail pages (url, and any of FIELDS) override, for the first ``most`` that have a url.

    Rows without a page, or beyond ``most``, stay as they are.
    """
    given = [c for c in details.columns if c in FIELDS and c != "url"]
    order = Window.orderBy(F.col("url").isNull(), ordinal)
    first = rows.select(ordinal, "url").orderBy(F.col("url").isNull(), ordinal).limit(most).filter("url IS NOT NULL").select(ordinal, F.row_number().over(order).alias("_n"))
    joined = rows.join(F.broadcast(first), ordinal, "left").join(details.select("url", *[F.col(c).alias(f"_{c}") for c in given]), "url", "left")
    take = F.col("_n").isNotNull()
    return joined.select(*[F.coalesce(F.when(take, F.col(f"_{c}")), F.col(c)).alias(c) if c in given else F.col(c) for c in rows.columns])


_WRAPPED = "events array<struct<id:string,title:string,url:string,excerpt:string,start_date:string,end_date:string,all_day:boolean,venue:string,image:string>>"
_PLACE = "venue string, address string, city string, state string"
MAX_RANGE_DAYS = 120


def wrapped_pages(pages: DataFrame, town: str, venue: str | None = None, address: str | None = None, most: int = MAX_RANGE_DAYS) -> DataFrame:
    """JSON within other text, with local times: one start, or one for each day of an all-day event or a run of three days.

    Events without a place take ``venue`` and ``address``; without those too they are left out. ``town`` stands for a
    city or state that is missing.
    """
    body = F.regexp_extract("body", r"(?s)(\{.*\})", 1)
    e = pages.select(F.explode(F.from_json(body, _WRAPPED)["events"]).alias("e")).select("e.*")
    place = F.from_json(F.when(F.col("venue").startswith("{"), F.col("venue")), _PLACE)
    both = F.when(place["city"].isNotNull() & place["state"].isNotNull(), F.concat_ws(", ", place["city"], place["state"])).otherwise(town)
    known = place["venue"].isNotNull() & place["address"].isNotNull()
    rows = e.withColumns({
        "place_name": F.when(known, place["venue"]).otherwise(F.lit(venue)), "place_address": F.when(known, F.concat_ws(", ", place["address"], both)).otherwise(F.lit(address)),
        "first": F.try_to_timestamp(F.substring("start_date", 1, 16), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"), "last": F.try_to_timestamp(F.substring("end_date", 1, 16), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"),
        "picture": F.get_json_object("image", "$.url"),
    }).filter("first IS NOT NULL AND last IS NOT NULL AND place_name IS NOT NULL AND place_address IS NOT NULL")
    run = F.coalesce("all_day", F.lit(False)) | (F.datediff("last", "first") >= 2)
    days = F.transform(day_range(F.to_date("first"), F.to_date("last"), most), lambda d: d.cast("timestamp_ntz"))
    rows = rows.withColumn("local", F.explode(F.when(run, days).otherwise(F.array("first"))))
    return _listing(rows, id=F.col("id"), name=strip_html(F.col("title")), url=F.col("url"), starts=utc_text(F.col("local")), status=F.lit("scheduled"), venue=F.col("place_name"), address=F.col("place_address"), image=F.col("picture"), description=strip_html(F.col("excerpt")))


def day_range(first: Column, last: Column, most: int) -> Column:
    """The days from ``first`` to ``last``, ``most`` at most; none if they are in the wrong order or missing."""
    none = F.array().cast("array<date>")
    return F.when(first <= last, F.sequence(first, F.least(last, F.date_add(first, most - 1)))).otherwise(none)


def utc_text(local: Column, zone: str = ZONE) -> Column:
    """ISO text in UTC of a local wall time."""
    return F.date_format(F.to_utc_timestamp(local.cast("timestamp"), zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_CLOCKED = "events array<struct<id:string,name:string,text:string,event_date:string,start_time:string,duration_minutes:double,show_on_website:boolean>>, linked struct<spots:array<struct<name:string,address:string,city:string,state:string,zip:string>>>"


def clocked_pages(pages: DataFrame, listing: str) -> DataFrame:
    """Feeds of days with a local clock time and a length; all events link to ``listing``, told apart by a fragment."""
    rows = pages.select(F.from_json("body", _CLOCKED).alias("x")).select(F.explode("x.events").alias("e"), F.get("x.linked.spots", F.lit(0)).alias("p"))
    rows = rows.filter("e.show_on_website AND p IS NOT NULL")
    clock = F.regexp_extract("e.start_time", r"^(\d{1,2}:\d{2})$", 1)
    at = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("e.event_date", r"^(\d{4}-\d{2}-\d{2})T", 1), F.lpad(clock, 5, "0")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    end = at + F.make_dt_interval(mins=F.col("e.duration_minutes").cast("int"))
    link = F.concat(F.lit(f"{listing}#ev"), F.col("e.id"))
    return _listing(rows.filter(at.isNotNull()), id=F.col("e.id"), name=F.col("e.name"), url=link, starts=utc_text(at), ends=utc_text(end), status=F.lit("scheduled"), venue=F.col("p.name"), address=_joined(F.col("p.address"), F.col("p.city"), F.col("p.state"), F.col("p.zip")), description=F.col("e.text"))


def html_cards(pages: DataFrame, card: str, wanted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(url, place, fields...) of each card of pages (url, body); a card within a card is part of it.

    ``card`` and those of ``wanted`` (field: selector, attribute or None for its text) are selectors of
    ``functions.markup``; of several elements in a card the first counts. What differs between sites is these
    arguments only. A field may be the card itself. Missing fields are null; text has single spaces.
    """
    shape = ", ".join(["url string", "place int", *[f"{f} string" for f in wanted]])

    def parse(url: str, body: str) -> Iterator[dict]:
        inside, place = set(), 0
        for found in tree(body).select(card):
            if id(found) in inside:
                continue
            inside.update(map(id, found.walk()))
            row: dict = {"url": url, "place": place}
            for field, (selector, attribute) in wanted.items():
                at = found.first(selector, own=True)
                value = None if at is None else at.text() if attribute is None else at.attrs.get(attribute)
                row[field] = " ".join(value.split()) if value is not None else None
            yield row
            place += 1

    return _parsed(pages, parse, shape)


def detail_fields(pages: DataFrame, wanted: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(url, fields...) of detail pages, a row each, for ``enriched``; ``wanted`` as for ``html_cards``."""
    shape = ", ".join(["url string", *[f"{f} string" for f in wanted]])

    def parse(url: str, body: str) -> Iterator[dict]:
        root = tree(body)
        found = {f: root.first(selector) for f, (selector, _) in wanted.items()}
        yield {"url": url, **{f: (x.attrs.get(wanted[f][1]) if wanted[f][1] else x.text()) or None for f, x in found.items() if x is not None}}

    return _parsed(pages, parse, shape)


def at_time(starts: Column, clock: Column) -> Column:
    """``starts``, UTC text of a local day, at the clock time in the text ``clock``; unchanged where it has none."""
    minutes = clock_text(clock)
    day = F.from_utc_timestamp(F.try_to_timestamp(starts), ZONE).cast("date").cast("timestamp_ntz")
    return F.when(minutes.isNotNull() & day.isNotNull(), utc_text(day + F.make_dt_interval(mins=minutes))).otherwise(starts)


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters of a month's name; else null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(F.trim(name), 1, 3))).cast("int"), F.lit(0))


def clock_text(text: Column) -> Column:
    """Minutes after midnight of the first clock time in ``text``, such as 7 pm or 7:30PM; else null."""
    pattern = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\b"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(0))
    return F.when(hour.between(1, 12) & (minute < 60), clock24(hour, F.lower(F.regexp_extract(text, pattern, 3)) == "p") * 60 + minute)


def card_dates(rows: DataFrame, month: str, day: str, time: str, today: Column) -> DataFrame:
    """``rows`` with ``starts``: the next such day from ``today`` on, at the clock time of ``time``."""
    on = occurrence_date(month_number(F.col(month)), F.col(day).try_cast("int"), today)
    return rows.withColumn("starts", utc_text(on.cast("timestamp_ntz") + F.make_dt_interval(mins=clock_text(F.col(time)))))


def grid_listings(grid: DataFrame, details: DataFrame) -> DataFrame:
    """``grid`` (url, title, year, month, day, hour, minute; hours without am or pm) with the local ``start``.

    ``details`` (url, month, day, hour, minute) has the times that detail pages give, without a year: a calendar shows less
    than twelve months. Where they have none the likely hour is taken, and ``assumed`` says so; rows without either go.
    """
    known = details.groupBy("url", "month", "day").agg(F.min(F.struct("hour", "minute")).alias("known"))
    rows = grid.join(known, ["url", "month", "day"], "left")
    hour = F.coalesce(F.col("known.hour"), assumed_hour(F.col("hour")))
    minute = F.when(F.col("known").isNotNull(), F.col("known.minute")).otherwise(F.col("minute"))
    found = rows.withColumn("start", F.try_make_timestamp_ntz(F.col("year"), F.col("month"), F.col("day"), hour, minute, F.lit(0)))
    return found.withColumn("assumed", F.col("known").isNull()).filter("start IS NOT NULL").drop("known")


def season_listings(rows: DataFrame, most: int = MAX_RANGE_DAYS) -> DataFrame:
    """``rows`` (run: "Month d - Month d, yyyy", ...) once for each day of the run; one that ends before it starts began a year earlier."""
    pattern = r"^\s*([A-Za-z]+)\.?\s+(\d{1,2})\s*[-\u2013]\s*(?:([A-Za-z]+)\.?\s+)?(\d{1,2}),?\s+(\d{4})\s*$"
    part = lambda k: F.regexp_extract("run", pattern, k)
    date = lambda year, month, day: F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    year, first_month = part(5).try_cast("int"), month_number(part(1))
    last_month = F.coalesce(month_number(part(3)), first_month)
    last = date(year, last_month, part(4).try_cast("int"))
    first = date(F.when(first_month > last_month, year - 1).otherwise(year), first_month, part(2).try_cast("int"))
    return rows.withColumn("day", F.explode(day_range(first, last, most)))


def registry_slice(places: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """(id, name, category, address, locality, lon, lat, confidence) of named places within the box.

    ``places`` has id, names.primary, categories.primary, addresses (freeform, locality), bbox (xmin, xmax, ymin, ymax) and
    confidence; the box's conditions reach the scan.
    """
    b = F.col("bbox")
    inside = (b["xmin"] > west) & (b["xmax"] < east) & (b["ymin"] > south) & (b["ymax"] < north)
    first = F.get("addresses", F.lit(0))
    rows = places.filter(inside & F.col("names.primary").isNotNull())
    return rows.select("id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), first["freeform"].alias("address"), first["locality"].alias("locality"), b["xmin"].alias("lon"), b["ymin"].alias("lat"), "confidence")


def _linked_cards(rows: DataFrame, **more: Column) -> DataFrame:
    """Listings of rows with name, link and starts: links are resolved, and a card without one is named by page and place."""
    link = _resolved(F.col("url"), F.col("link"))
    key = F.coalesce(F.concat_ws("@", link, F.to_date("starts")), F.concat_ws("#", "url", "place"))
    return _listing(rows, id=key, name=F.col("name"), url=F.coalesce(link, F.col("url")), starts=F.col("starts"), status=F.lit("scheduled"), **more)


def card_pages(pages: DataFrame, card: str, wanted: dict[str, tuple[str, str | None]], today: str, venue: str | None = None, address: str | None = None) -> DataFrame:
    """Listings of cards with name, link, month, day and time; the day is the next such from ``today`` on."""
    found = card_dates(html_cards(pages, card, wanted), "month", "day", "time", F.lit(today).cast("date"))
    return _linked_cards(found, venue=F.lit(venue), address=F.lit(address))


def grid_pages(pages: DataFrame, card: str, wanted: dict[str, tuple[str, str | None]], year: int, details: DataFrame, venue: str | None = None) -> DataFrame:
    """Listings of a calendar's cells with name, link, month, day and time, at the times that ``details`` (of ``grid_listings``) give."""
    cells = html_cards(pages, card, wanted).withColumn("_clock", clock_text(F.concat(F.col("time"), F.lit(" am"))))
    cells = cells.withColumns({"page": F.col("url"), "url": _resolved(F.col("url"), F.col("link")), "year": F.lit(year), "month": F.coalesce(month_number(F.col("month")), F.col("month").try_cast("int")), "day": F.col("day").try_cast("int"), "hour": (F.col("_clock") / 60).cast("int"), "minute": (F.col("_clock") % 60).cast("int")})
    found = grid_listings(cells, details).withColumns({"starts": utc_text(F.col("start")), "url": F.col("page")})
    return _linked_cards(found, venue=F.lit(venue))


def season_pages(pages: DataFrame, card: str, wanted: dict[str, tuple[str, str | None]], venue: str | None = None, most: int = MAX_RANGE_DAYS) -> DataFrame:
    """Listings, one a day, of cards with name, link and run, the days between which something is on."""
    found = season_listings(html_cards(pages, card, wanted), most)
    return _linked_cards(found.withColumn("starts", utc_text(F.col("day").cast("timestamp_ntz"))), venue=F.lit(venue))


def map_pages(pages: DataFrame, details: DataFrame, most: int, holding: str = "") -> DataFrame:
    """Listings of the detail pages (url, body) that site maps name."""
    return crawled(pages, details, most, holding)[0].select(*FIELDS)


#: Reader by adapter type and, for services and layouts, by name.
READERS: dict[tuple[str, str], Callable[..., DataFrame]] = {
    ("api", "tickets"): ticket_pages,
    ("api", "organizers"): organizer_pages,
    ("api", "schedule"): schedule_pages,
    ("ical", ""): calendars,
    ("html", "jsonld"): linked_data,
    ("html", "upcoming"): upcoming_pages,
    ("html", "wrapped"): wrapped_pages,
    ("html", "clocked"): clocked_pages,
    ("html", "cards"): card_pages,
    ("html", "grid"): grid_pages,
    ("html", "season"): season_pages,
    ("html", "sitemap"): map_pages,
}


def read_all(pages: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """Listings of ``pages`` (source, adapter, strategy, url, body) of several sources, each by its reader.

    Options are a reader's arguments by strategy. Pages of a pair without a reader raise before anything is read.
    """
    asked = {(r.adapter, r.strategy or "") for r in pages.select("adapter", "strategy").distinct().collect()}  # as many as readers
    if missing := sorted(asked - READERS.keys()):
        raise ValueError(f"no reader for {missing}")
    parts = []
    for adapter, strategy in sorted(asked):
        mine = pages.filter((F.col("adapter") == adapter) & (F.coalesce("strategy", F.lit("")) == strategy))
        parts.append(READERS[adapter, strategy](mine.select("url", "body"), **(options or {}).get(strategy, {})))
    found = parts[0] if parts else pages.sparkSession.createDataFrame([], LISTING)
    for part in parts[1:]:
        found = found.unionByName(part.select(*found.columns))
    return found


def registry_lines(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken lines) of a registry of one JSON object a line."""
    shape = "id string, name string, category string, address string, locality string, lon double, lat double, confidence double, _broken string"
    rows = spark.read.text(path).select(F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"), "value").select("r.*", "value")
    good = F.col("_broken").isNull() & F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return rows.filter(good).drop("_broken", "value"), rows.filter(~good).select("value")
