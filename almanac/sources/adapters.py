"""Sources as a fetch, which the caller gives, and a reader: pages come first, and parsing them is pure.

``fetched`` and the data source of ``registered`` give the same rows, failures among them: a fetch that raises, or a
token that comes again, ends its source's pages with a row that has an error and no body. ``whole`` leaves out the
sources with such rows, so that what is persisted and superseded is never a part of a source; ``runs`` makes of them
what ``persist.source_health`` takes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from almanac.sources.feeds import counted

#: (url, body, token of the next page or None) of the page that a token names; the first token is None.
Fetch = Callable[[str, str | None], tuple[str, str, str | None]]
#: The token behind the last page that a source has now.
Latest = Callable[[str], str]
MOST_PAGES = 5
PAGE = "source string, page int, url string, body string, error string"
_NAMES = [x.split()[0] for x in PAGE.split(", ")]


def _pages(source: str, config: str, fetch: Fetch, most: int | None, token: str | None = None, until: str | None = None) -> Iterator[tuple]:
    """The pages of a source from ``token`` on: ``most``, or up to the page that ``until`` names."""
    seen, page = {token}, 0
    while most is None or page < most:
        try:
            url, body, token = fetch(config, token)
        except Exception as problem:  # noqa: BLE001  whatever a network gives
            yield source, page, None, None, f"{type(problem).__name__}: {problem}"
            return
        yield source, page, url, body, None
        page += 1
        if token is None or token == until:
            return
        if token in seen:
            yield source, page, None, None, f"the token {token} came again"
            return
        seen.add(token)


def fetched(sources: DataFrame, fetch: Fetch, most: int = MOST_PAGES) -> DataFrame:
    """(source, page, url, body, error) of the pages of ``sources`` (source, config), ``most`` a source at most.

    A token is known only once the page before it is there, so a source's pages are fetched in turn, and sources apart
    from each other.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, config in zip(part["source"], part["config"]):
                yield pd.DataFrame(list(_pages(source, config, fetch, most)), columns=_NAMES, dtype=object)

    return sources.select("source", "config").repartition("source").mapInPandas(run, PAGE)


def failures(pages: DataFrame) -> DataFrame:
    """(source, error) of the sources whose pages are not all there."""
    return pages.filter("error IS NOT NULL").groupBy("source").agg(F.min("error").alias("error"))


def whole(pages: DataFrame) -> DataFrame:
    """The pages of sources without a failure."""
    return pages.join(failures(pages), "source", "left_anti")


def runs(sources: DataFrame, pages: DataFrame, listings: DataFrame) -> DataFrame:
    """(source, fetched, published, skipped, error) of each of ``sources`` (source); ``listings``: source, valid."""
    counts = listings.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("valid").alias("published"))
    rows = sources.select("source").join(counts, "source", "left").join(failures(pages), "source", "left").na.fill(0, ["fetched", "published"])
    return rows.select("source", "fetched", "published", (F.col("fetched") - F.col("published")).alias("skipped"), "error")


@dataclass(frozen=True)
class Adapter:
    """A kind of source: how its pages are fetched, and how listings are read from them."""

    fetch: Fetch
    read: Callable[[DataFrame], DataFrame]
    most: int = MOST_PAGES

    def listings(self, sources: DataFrame) -> DataFrame:
        """Listings of all pages of sources without a failure, with whether each is valid."""
        return counted(self.read(whole(fetched(sources, self.fetch, self.most)).select("url", "body")))


class _Source(InputPartition):
    def __init__(self, source: str, config: str, token: str | None = None, until: str | None = None):
        self.source, self.config, self.token, self.until = source, config, token, until


class _Reader(DataSourceReader):
    """One partition a source; conditions on the source choose partitions before anything is fetched."""

    def __init__(self, sources: dict[str, str], fetch: Fetch, most: int):
        self.sources, self.fetch, self.most = sources, fetch, most

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.sources = {k: v for k, v in self.sources.items() if k == f.value}
            elif isinstance(f, In) and f.attribute == ("source",):
                self.sources = {k: v for k, v in self.sources.items() if k in f.value}
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [_Source(k, v) for k, v in self.sources.items()] or [_Source("", "", until="")]

    def read(self, partition: _Source) -> Iterator[tuple]:
        return iter(()) if partition.until == "" else _pages(partition.source, partition.config, self.fetch, self.most)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the token of each source's next page; a batch has the pages between two offsets of each source."""

    def __init__(self, sources: dict[str, str], fetch: Fetch, latest: Latest):
        self.sources, self.fetch, self.latest = sources, fetch, latest

    def initialOffset(self) -> dict:
        return {k: None for k in self.sources}

    def latestOffset(self) -> dict:
        return {k: self.latest(v) for k, v in self.sources.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Source(k, v, start.get(k), end[k]) for k, v in self.sources.items() if k in end and start.get(k) != end[k]]

    def read(self, partition: _Source) -> Iterator[tuple]:
        return _pages(partition.source, partition.config, self.fetch, None, partition.token, partition.until)


def registered(spark: SparkSession, name: str, fetch: Fetch, latest: Latest | None = None) -> None:
    """Make ``fetch`` the data source ``name``: ``spark.read.format(name).option("sources", ...)``, and ``readStream`` with ``latest``.

    The option ``sources`` is a JSON object of configurations by source; ``most`` bounds the pages of a source in a batch
    read. A stream reads each page once: its offset is the token behind the last page, which ``latest`` gives.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(json.loads(self.options["sources"]), fetch, int(self.options.get("most", MOST_PAGES)))

        def streamReader(self, schema) -> DataSourceStreamReader:
            if latest is None:
                raise ValueError(f"{name} has no latest token and is no stream")
            return _StreamReader(json.loads(self.options["sources"]), fetch, latest)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
