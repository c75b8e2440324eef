"""Text functions: trigram similarity, slugs, addresses and fingerprints, all in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct three-letter grams of the lower-cased words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    )
    return F.array_distinct(F.flatten(grams))


def text_grams(text: str) -> list[str]:
    """``trigrams`` of one text, on the driver."""
    found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return list(dict.fromkeys(f"  {w} "[i : i + 3] for w in found for i in range(len(w) + 1)))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 where either is empty, null where either is null.

    Both arrays are put in one struct, so that each is evaluated once for all its uses.
    """

    def ratio(x: Column) -> Column:
        common = F.size(F.array_intersect(x["a"], x["b"])).cast("double")
        return F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), common / (F.size(x["a"]) + F.size(x["b"]) - common)).otherwise(0.0)

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), ratio(x))), F.lit(0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def normalize_ascii(name: Column) -> Column:
    """Lower case, other characters than letters and digits as single spaces; for names without accents."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+", " "))


def slugify(title: Column, source_id: Column) -> Column:
    """Up to 60 characters of the name, cut before outer hyphens go, and 8 hex digits of the id's hash."""
    body = F.substring(F.regexp_replace(normalize_ascii(title), " ", "-"), 1, 60)
    return F.concat(F.regexp_replace(body, "^-+|-+$", ""), F.lit("-"), F.substring(F.sha2(source_id, 256), 1, 8))


def street_number(address: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(address), r"^(\d+)", 1), F.lit(""))


def content_fingerprint(title: Column, description: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), F.coalesce(description, F.lit("<none>"))), 256)


def calendar_escape(value: Column) -> Column:
    """Backslash, comma, semicolon and line break as calendar text has them; the backslash goes first."""
    for plain, escaped in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value
