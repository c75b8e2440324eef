"""Crawls of several hops: rounds of links that no round before had, each written before the next begins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.markup import tree
from almanac.operators.changes import folders
from almanac.operators.ordered import ordinals
from almanac.sources.feeds import _parsed, resolved

#: Links of pages to visit: (url, depth) to (url, link).
Expand = Callable[[DataFrame], DataFrame]


def page_links(pages: DataFrame, within: str = "a") -> DataFrame:
    """(url, link) of the links that ``within`` selects in pages (url, body): resolved, without fragments, each once a page."""

    def parse(url: str, body: str) -> Iterator[dict]:
        seen = set()
        for x in tree(body).select(within):
            link = resolved(url, x.attrs.get("href"))
            link = urldefrag(link).url if link else None
            if link and urlsplit(link).scheme in ("http", "https") and link not in seen:
                seen.add(link)
                yield {"url": url, "link": link}

    return _parsed(pages, parse, "url string, link string").filter("link IS NOT NULL")


def saved(pages: DataFrame, within: str = "a") -> Expand:
    """The links of pages that are already there."""
    return lambda frontier: page_links(pages.join(frontier.select("url"), "url", "left_semi"), within)


def _visits(spark: SparkSession, path: str) -> DataFrame | None:
    rounds = folders(spark, path, "round")
    return spark.read.option("basePath", path).parquet(*rounds.values()) if rounds else None


def crawl(spark: SparkSession, path: str, seeds: DataFrame, expand: Expand, depth: int, per_host: int | None = None) -> DataFrame:
    """(url, host, depth, via) of the pages within ``depth`` links of ``seeds`` (url), ``per_host`` of a host at most.

    ``depth`` of a page is that of the shortest way to it, ``via`` the least page that leads there at that depth; of a
    host's links beyond its bound the first in order of depth and url stay. A crawl that was stopped goes on from the
    last round whose write was finished; a crawl that was done reads what is there.
    """
    host = F.lower(F.parse_url("url", F.lit("HOST"))).alias("host")

    def write(number: int, links: DataFrame) -> int:
        """The next round: ``links`` (url, via) that are new."""
        rows = links.groupBy("url").agg(F.min("via").alias("via")).select("url", host, F.lit(number).alias("depth"), "via")
        seen = _visits(spark, path)
        if seen is not None:
            rows = rows.join(seen.select("url"), "url", "left_anti")
        if per_host is not None:
            rows = ordinals(rows, ["host"], [F.asc("url")], "_n")
            if seen is not None:
                rows = rows.join(seen.groupBy("host").agg(F.count(F.lit(1)).alias("_held")), "host", "left")
            rows = rows.filter(F.col("_n") + (F.coalesce("_held", F.lit(0)) if seen is not None else F.lit(0)) <= per_host)
        rows.select("url", "host", "depth", "via").write.mode("overwrite").parquet(f"{path}/round={number}")
        return spark.read.parquet(f"{path}/round={number}").limit(1).count()

    last = max(folders(spark, path, "round"), default=-1)
    more = 1 if last < 0 else spark.read.parquet(f"{path}/round={last}").limit(1).count()
    while more and last < depth:
        if last < 0:
            found = seeds.select("url", F.lit(None).cast("string").alias("via"))
        else:
            frontier = spark.read.parquet(f"{path}/round={last}").select("url", "depth")
            found = expand(frontier).select(F.col("link").alias("url"), F.col("url").alias("via"))
        last += 1
        more = write(last, found)
    return _visits(spark, path).select("url", "host", "depth", "via")
