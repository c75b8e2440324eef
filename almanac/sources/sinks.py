"""What listings are written as: calendar text, calendar links, linked data and site maps, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import calendar_escape
from almanac.functions.timefn import ZONE

# Length of an event whose end is unknown, starts that linked data lists, public vocabulary.
HOURS = 2
MOST_STARTS = 10
STATES = {"cancelled": "https://schema.org/EventCancelled", "postponed": "https://schema.org/EventPostponed"}
SCHEDULED = "https://schema.org/EventScheduled"


def stamp(at: Column) -> Column:
    """An instant in UTC as calendars write it."""
    return F.date_format(at.cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")


def end_or_later(start: Column, end: Column) -> Column:
    return F.coalesce(end, start + F.expr(f"INTERVAL {HOURS} HOURS"))


def place(venue: Column, address: Column, town: str) -> Column:
    return F.concat_ws(", ", F.nullif(venue, F.lit("")), F.coalesce(address, F.lit(town)))


def calendar_text(uid: Column, made: Column, start: Column, end: Column, title: Column, where: Column, description: Column, url: Column, product: str) -> Column:
    """A calendar of one event, its lines ended as the format asks."""
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), stamp(made)), F.concat(F.lit("DTSTART:"), stamp(start)),
        F.concat(F.lit("DTEND:"), stamp(end_or_later(start, end))), F.concat(F.lit("SUMMARY:"), calendar_escape(title)), F.concat(F.lit("LOCATION:"), calendar_escape(where)),
        F.concat(F.lit("DESCRIPTION:"), calendar_escape(F.coalesce(description, F.lit("")))), F.concat(F.lit("URL:"), url), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    ]
    return F.concat_ws("\r\n", *lines)


def calendar_link(base: str, start: Column, end: Column, title: Column, where: Column, description: Column, url: Column, zone: str = ZONE) -> Column:
    """The address that offers the event to a calendar service."""
    details = F.regexp_replace(F.concat(F.coalesce(description, F.lit("")), F.lit("\n\n"), url), r"^\s+|\s+$", "")
    dates = F.concat_ws("/", stamp(start), stamp(end_or_later(start, end)))
    fields = {"text": title, "dates": dates, "details": details, "location": where, "ctz": F.lit(zone)}
    return F.concat(F.lit(f"{base}?action=TEMPLATE"), *[F.concat(F.lit(f"&{k}="), F.url_encode(v)) for k, v in fields.items()])


def linked_events(rows: DataFrame, town: str, organizer: tuple[str, str]) -> DataFrame:
    """(id, body): the linked data of a listing, an object for each of its first MOST_STARTS starts; safe within a page.

    ``rows``: id, title, description, status, image, is_free, price_min, canonical_url, url, is_station, venue_name, address and
    starts, an array of instants in order.
    """
    state = F.lit(SCHEDULED)
    for name, value in STATES.items():
        state = F.when(F.col("status") == name, value).otherwise(state)
    price = F.when(F.col("is_free"), "0").otherwise(F.col("price_min").cast("string"))
    offer = F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.lit("USD").alias("priceCurrency"), F.coalesce("canonical_url", "url").alias("url"), F.lit("https://schema.org/InStock").alias("availability"))
    spot = F.struct(F.lit("Place").alias("@type"), F.coalesce("venue_name", F.lit(town)).alias("name"), F.coalesce("address", F.lit(town)).alias("address"))
    own = F.struct(F.lit("Organization").alias("@type"), F.lit(organizer[0]).alias("name"), F.lit(organizer[1]).alias("url"))

    def one(at: Column) -> Column:
        return F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), F.col("description"), F.col("image"), state.alias("eventStatus"), spot.alias("location"), F.col("url"),
            F.when(price.isNotNull(), offer).alias("offers"), F.when(F.col("is_station"), own).alias("organizer"), F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startDate"),
        )

    body = F.to_json(F.transform(F.slice("starts", 1, MOST_STARTS), one))
    for plain, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        body = F.replace(body, F.lit(plain), F.lit(safe))
    return rows.select("id", body.alias("body"))


def site_map_lines(rows: DataFrame) -> DataFrame:
    """(value): an entry a row of ``rows`` (loc, lastmod), for ``write.text`` between the head and the foot of a site map."""
    loc = F.col("loc")
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        loc = F.replace(loc, F.lit(plain), F.lit(safe))
    dated = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format(F.col("lastmod").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</lastmod>")))
    return rows.select(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), F.coalesce(dated, F.lit("")), F.lit("</url>")).alias("value"))
