"""A kept inverted index for the text leg of searches.

A segment holds, for the rows that were new or changed when it was written, postings of three kinds: words with their
places and weights, and the trigrams of titles and venues. Postings lie in folders of BUCKETS term hashes, in order of
term, so a search reads the folders, and within them the row groups, of its own terms only. A list may be of any
length: it is dealt over tasks by ranges of (term, key).

Rows are told apart by fingerprints: a later segment has the rows that changed, and its table of keys says which older
postings no longer hold. ``fold`` makes one segment of all.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.text import text_grams, trigrams
from almanac.operators import search
from almanac.operators.changes import changes, folders
from almanac.operators.core import first_per_key
from almanac.operators.lineage import cut, drop

BUCKETS = 64
#: The kinds of postings and the columns they come from.
WORD, TITLE, VENUE = "w", "t", "v"
_HIT = "array<struct<p:int,v:double>>"


def bucket(kind: Column, term: Column) -> Column:
    return (F.crc32(F.concat(kind, term).cast("binary")) % BUCKETS).cast("int")


def bucket_of(kind: str, term: str) -> int:
    """``bucket``, on the driver."""
    return zlib.crc32((kind + term).encode()) % BUCKETS


def postings(rows: DataFrame, key: str, stemmed: bool = False) -> DataFrame:
    """(kind, term, key, hits, n) of ``rows`` (key, title, tags, description, venue, and lexemes if kept).

    ``hits`` are the places and weights of a word; ``n`` is how many trigrams the text of a gram has.
    """
    words = rows.select(key, F.explode("lexemes").alias("x")).select(key, "x.*") if "lexemes" in rows.columns else search.exploded(rows, key, stemmed)
    hit = F.struct(F.col("p").cast("int").alias("p"), F.col("v").cast("double").alias("v"))
    words = words.groupBy(key, F.col("w").alias("term")).agg(F.sort_array(F.collect_list(hit)).alias("hits"))  # of one row
    parts = [words.select(F.lit(WORD).alias("kind"), "term", key, F.col("hits").cast(_HIT).alias("hits"), F.lit(0).alias("n"))]
    for kind, column in ((TITLE, "title"), (VENUE, "venue")):
        grams = rows.select(key, trigrams(F.coalesce(column, F.lit(""))).alias("g"))
        parts.append(grams.select(F.lit(kind).alias("kind"), F.explode("g").alias("term"), key, F.lit(None).cast(_HIT).alias("hits"), F.size("g").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), parts)


class SearchIndex:
    """The index under ``path`` of rows (key, title, tags, description, venue)."""

    def __init__(self, spark: SparkSession, path: str, key: str, stemmed: bool = False):
        self.spark, self.path, self.key, self.stemmed = spark, path.rstrip("/"), key, stemmed
        self._read: tuple[list[int], DataFrame] | None = None  # segments and their postings, listed once

    def _segments(self) -> dict[int, str]:
        """The newest fold and the segments after it; a segment counts once its keys, which come last, are written."""
        keys = folders(self.spark, f"{self.path}/keys", "segment")
        folds = [n for n in keys if n % 2]
        return {n: x for n, x in keys.items() if n >= max(folds, default=0)}

    def _keys(self) -> DataFrame | None:
        """(key, fingerprint, gone, segment): the newest entry of each key."""
        found = self._segments()
        if not found:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/keys").parquet(*found.values())
        return first_per_key(rows, [self.key], [F.desc("segment")]).drop("place")

    def _write(self, number: int, rows: DataFrame, keys: DataFrame) -> None:
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["bucket", "kind", "term", self.key]
        made = cut(rows.withColumn("bucket", bucket(F.col("kind"), F.col("term"))))  # read twice, for ranges and for rows
        dealt = made.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        drop(made)
        keys.write.mode("overwrite").parquet(f"{self.path}/keys/segment={number}")

    def refresh(self, rows: DataFrame, fingerprint: Column) -> dict[str, int]:
        """Take in what is new, changed or gone in ``rows``, and say how many of each; other rows are not read again."""
        marked = rows.withColumn("fingerprint", fingerprint)
        held = self._keys()
        stored = held.filter("NOT gone").select(self.key, "fingerprint") if held is not None else marked.select(self.key, "fingerprint").limit(0)
        feed = cut(changes(stored, marked, self.key))
        counts = {x["change"]: x["count"] for x in feed.groupBy("change").count().collect()}
        if counts or held is None:
            todo = rows.join(feed.filter("change <> 'gone'").select(self.key), self.key, "left_semi")
            number = (max(folders(self.spark, f"{self.path}/keys", "segment"), default=-2) // 2 + 1) * 2
            self._write(number, postings(todo, self.key, self.stemmed), feed.select(self.key, "fingerprint", (F.col("change") == "gone").alias("gone")))
        drop(feed)
        return {k: counts.get(k, 0) for k in ("new", "changed", "gone")}

    def fold(self) -> None:
        """One segment, of an odd number, of all that holds; older ones are left for readers that have begun."""
        found = self._segments()
        if len(found) > 1:
            self._write(max(found) // 2 * 2 + 1, self.lists(None).drop("segment", "bucket"), self._keys().filter("NOT gone").drop("segment"))

    def lists(self, terms: list[tuple[str, str]] | None) -> DataFrame:
        """The postings that hold of ``terms`` (kind, term), read from their buckets alone; of all terms for None."""
        found = self._segments()
        if self._read is None or self._read[0] != list(found):
            kind = self.spark.read.parquet(next(iter(found.values()))).schema[self.key].dataType.simpleString()
            shape = f"kind string, term string, {self.key} {kind}, hits {_HIT}, n int, segment int, bucket int"
            listed = self.spark.read.schema(shape).option("basePath", f"{self.path}/postings")
            self._read = list(found), listed.parquet(*[f"{self.path}/postings/segment={n}" for n in found])
        rows = self._read[1]
        if terms is not None:
            held = [(k, t, bucket_of(k, t)) for k, t in terms]
            rows = rows.filter(F.col("bucket").isin(sorted({b for *_, b in held})) & F.col("term").isin(sorted({t for _, t, _ in held})))
            by_kind = {k: [t for x, t, _ in held if x == k] for k in {x for x, *_ in held}}
            rows = rows.filter(reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("term").isin(t) for k, t in by_kind.items()], F.lit(False)))
        if len(found) > 1:
            later = self._keys().filter(F.col("segment") > min(found)).select(self.key, F.col("segment").alias("_alive"), "gone")
            rows = rows.join(later, self.key, "left").filter("_alive IS NULL OR (segment = _alive AND NOT gone)").drop("_alive", "gone")
        return rows

    def text_leg(self, query: str) -> DataFrame:
        """As ``search.text_leg`` over the indexed rows: (key, _score) of those that meet the query or resemble it.

        An alternative that only denies words is met by rows without postings of the query, so it reads all keys.
        """
        parsed, grams = search.parse(query, self.stemmed), text_grams(query)
        words = search._terms(parsed)
        lists = self.lists([(WORD, w) for w in words] + [(k, g) for k in (TITLE, VENUE) for g in grams])
        hit = F.transform("hits", lambda h: F.struct(F.col("term").alias("w"), h["p"].alias("p"), h["v"].alias("v")))
        of = lambda kind: F.when(F.col("kind") == kind, F.col("n"))
        rows = lists.groupBy(self.key).agg(
            F.flatten(F.collect_list(F.when(F.col("kind") == WORD, hit))).alias("hits"),  # of one row
            *[f(of(k)).alias(f"{name}_{k}") for k in (TITLE, VENUE) for f, name in ((F.count, "common"), (F.max, "size"))],
        )
        if any(not any(wanted for wanted, _ in terms) for terms in parsed):
            every = self._keys().filter("NOT gone").select(self.key)
            rows = every.join(rows, self.key, "left").na.fill(0, [f"common_{TITLE}", f"common_{VENUE}"])
        none = F.array().cast("array<struct<w:string,p:int,v:double>>")
        rows = rows.withColumn("hits", F.array_sort(F.coalesce("hits", none), lambda a, b: a["p"] - b["p"]))
        alike = {k: F.coalesce(F.col(f"common_{k}") / (F.col(f"size_{k}") + len(grams) - F.col(f"common_{k}")), F.lit(0.0)) for k in (TITLE, VENUE)}
        rows = rows.select(self.key, "hits", *[a.alias(k) for k, a in alike.items()])
        met = search._meets(F.col("hits"), parsed) | search.passes(F.col(TITLE), search.TITLE_FLOOR) | search.passes(F.col(VENUE), search.VENUE_FLOOR)
        score = search._rank(F.col("hits"), parsed) + search.TITLE_SHARE * F.col(TITLE) + search.VENUE_SHARE * F.col(VENUE)
        return rows.filter(met).select(self.key, score.alias("_score"))
