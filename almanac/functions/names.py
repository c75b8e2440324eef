"""Names, slugs, addresses, hashes and labels of listings."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from almanac.functions.markup import plain_text
from almanac.functions.text import normalize_ascii

# Lengths of slugs, adapter ranks, ages and the least certain confidence.
VENUE_SLUG, COLLIDING_SLUG, HASH_DIGITS = 48, 39, 8
ADAPTER_RANKS = {"api": 4, "ical": 3, "rss": 3, "html": 2, "firecrawl": 1}
ADULTS, FAMILIES = "21-plus", "family-friendly"


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    """Lower case in compatibility decomposition, without combining accents."""
    return names.map(lambda x: x and "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not 0x300 <= ord(c) <= 0x36F), na_action="ignore")


def normalize_name(name: Column) -> Column:
    """Lower case without accents, other characters than a-z and 0-9 as single spaces.

    Only names beyond ASCII go through Python; the others reach it as nulls.
    """
    plain = name.rlike(r"^[\x00-\x7F]*$")
    return normalize_ascii(F.when(plain, name).otherwise(_decomposed(F.when(~plain, name))))


def _hash8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_DIGITS)


def venue_slug(normalized: Column) -> Column:
    """The normalized name with hyphens, 48 characters at most; one without letters and digits is named by its hash."""
    body = F.regexp_replace(F.regexp_replace(normalized, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    body = F.regexp_replace(F.substring(body, 1, VENUE_SLUG), "-+$", "")
    return F.when(body != "", body).otherwise(F.concat(F.lit("venue-"), _hash8(normalized)))


def disambiguated(slug: Column, normalized: Column) -> Column:
    return F.concat(F.substring(slug, 1, COLLIDING_SLUG), F.lit("-"), _hash8(normalized))


def location_name(location: Column) -> Column:
    """What stands before the first comma, and before a hyphen between spaces that a digit follows."""
    head = F.split_part(location, F.lit(","), F.lit(1))
    return F.nullif(F.trim(F.get(F.split(head, r"\s-\s(?=\d)"), F.lit(0))), F.lit(""))


def address_token(address: Column, place: int) -> Column:
    """A word of the address by its place from 1, in lower case; empty beyond the last."""
    return F.lower(F.split_part(address, F.lit(" "), F.lit(place)))


def canonical_json(payload: Column) -> Column:
    """The JSON text with the keys of all its objects in order; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(payload))


def content_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


def embedding_text(title: Column, venue: Column, category: Column, description: Column, vibes: Column, audiences: Column) -> Column:
    """What is present of the arguments, a line each; tags are joined by commas."""
    tags = lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))
    return F.concat_ws("\n", title, *[F.nullif(c, F.lit("")) for c in (venue, category, description)], tags(vibes), tags(audiences))


def clock24(hour: Column, afternoon: Column) -> Column:
    """The hour of a twelve-hour clock."""
    return hour % 12 + F.when(afternoon, 12).otherwise(0)


def assumed_hour(hour: Column) -> Column:
    """The likely hour of a show without am or pm: 1 to 7 in the afternoon, 8 to 12 as they stand; else null."""
    return F.when(hour.between(1, 7), hour + 12).when(hour.between(8, 12), hour)


def occurrence_date(month: Column, day: Column, today: Column) -> Column:
    """The next such day from ``today`` on; null for a day that the year lacks."""
    this = F.try_make_timestamp(F.year(today), month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    later = F.try_make_timestamp(F.year(today) + 1, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(this < today, later).otherwise(this)


@F.pandas_udf(StringType())
def _stripped(markup: pd.Series) -> pd.Series:
    return markup.map(plain_text, na_action="ignore")


def strip_html(markup: Column) -> Column:
    """As ``plain_text``; only text with tags or entities goes through Python."""
    rich = markup.rlike("[<&]")
    return F.when(rich, _stripped(F.when(rich, markup))).otherwise(F.trim(F.regexp_replace(markup, r"\s+", " ")))


def adapter_rank(adapter: Column) -> Column:
    rank = F.lit(0)
    for name, n in ADAPTER_RANKS.items():
        rank = F.when(adapter == name, n).otherwise(rank)
    return rank


def fixed4(score: Column) -> Column:
    return score.cast("decimal(12,4)").cast("string")


def hash_address(address: Column) -> Column:
    return F.sha2(address, 256)


def price_label(is_free: Column, price_min: Column) -> Column:
    """Free, the least price (whole amounts without cents), or where to look."""
    whole = F.concat(F.lit("From $"), F.when(price_min == F.floor(price_min), F.floor(price_min).cast("string")).otherwise(price_min.cast("decimal(12,2)").cast("string")))
    return F.when(F.coalesce(is_free, F.lit(False)), "Free").when(price_min.isNotNull(), whole).otherwise("See tickets")


def audience_label(tags: Column) -> Column:
    return F.when(F.array_contains(tags, ADULTS), "21+").when(F.array_contains(tags, FAMILIES), "Family").otherwise("All ages")


def card_badges(status: Column, is_free: Column, is_station: Column, tags: Column, station: str) -> Column:
    """Labels of a card in their order."""
    audience = audience_label(tags)
    shown = [F.when(status == "cancelled", "Cancelled"), F.when(is_free, "Free"), F.when(is_station, station), F.when(audience != "All ages", audience)]
    return F.array_compact(F.array(*shown))


def accent(category: Column, is_station: Column, accents: dict[str, str], station: str, other: str) -> Column:
    found = F.lit(other)
    for name, colour in accents.items():
        found = F.when(category == name, colour).otherwise(found)
    return F.when(is_station, station).otherwise(found)


def mail_rules(raw: str | None) -> list[str]:
    """Well-formed entries of a list: addresses, and domains that begin with @."""
    import re

    domain = re.compile(r"@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+")
    entries = [x.strip().lower() for x in (raw or "").split(",")]
    return [x for x in entries if x and (domain.fullmatch(x) if x[0] == "@" else x.rfind("@") > 0)]


def mail_role(email: Column, rules: Sequence[tuple[str, str | None]]) -> Column:
    """The first of ``rules`` (role, list of entries) that the address, or its domain, stands in; else null."""
    address = F.lower(F.trim(email))
    domain = F.concat(F.lit("@"), F.substring_index(address, "@", -1))
    role = F.lit(None).cast("string")
    for name, raw in reversed(rules):
        entries = mail_rules(raw)
        if entries:
            role = F.when(address.isin(entries) | domain.isin([x for x in entries if x[0] == "@"]), name).otherwise(role)
    return role
