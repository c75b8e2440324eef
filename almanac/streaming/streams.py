"""Streams: landing of new payloads, trailing counts with bounded state, upserts of late rows, local-day windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from almanac.functions.scoring import backoff_hours
from almanac.functions.timefn import ZONE
from almanac.operators.core import first_per_key


def new_payloads(stream: DataFrame, keys: Sequence[str], ts: str, keep: str = "24 hours") -> DataFrame:
    """Each (keys, content hash) once within ``keep``; the state of older ones is dropped."""
    hashed = stream.withColumn("content_hash", F.sha2(F.to_json(F.parse_json("payload")), 256))
    return hashed.withWatermark(ts, keep).dropDuplicatesWithinWatermark([*keys, "content_hash"])


def sliding_counts(stream: DataFrame, key: str, ts: str, width: str = "60 minutes", step: str = "5 minutes", late: str = "24 hours") -> DataFrame:
    """(key, window start and end, n): rows of each key in sliding windows."""
    found = stream.withWatermark(ts, late).groupBy(key, F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), "n")


class _Trailing(StatefulProcessor):
    """The times of a key's last ``keep`` as a list; a timer takes them away once nothing came for so long."""

    def __init__(self, ts: str, span: int, keep: int):
        self.ts, self.span, self.keep = ts, span, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        at = new[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        held = np.sort(np.concatenate([np.array([x[0] for x in self.times.get()], np.int64), at]))
        yield new.assign(n=np.searchsorted(held, at) - np.searchsorted(held, at - self.span))
        left = held[held >= held[-1] - self.keep]
        self.times.put([(int(x),) for x in left])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(held[-1] + self.keep) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trailing_counts(stream: DataFrame, key: str, ts: str, minutes: int = 60, keep: str = "24 hours") -> DataFrame:
    """``stream`` with ``n``: how many rows of the same key lie in the ``minutes`` before each row, as ``core.trailing_count``.

    Exact for rows that come in order or within one batch; a row that comes late counts those that are held, and
    changes no count that was given out. A key's times are held for ``keep`` before its newest and go when the watermark,
    ``keep`` behind, has passed it by as much. Rows without a time are left out. The session's ``STATE_STORE`` must be RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    micros = int(pd.Timedelta(keep).total_seconds() * 1e6)
    if micros < minutes * 60_000_000:
        raise ValueError("times are held for the span of the count at least")
    shape = StructType([*stream.schema.fields, StructField("n", LongType())])
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, keep).groupBy(key)
    return rows.transformWithStateInPandas(_Trailing(ts, minutes * 60_000_000, micros), shape, "append", "eventTime")


def local_day_counts(stream: DataFrame, ts: str, zone: str = ZONE, late: str = "24 hours") -> DataFrame:
    """(day, k): rows of each local day.

    Days are windows of wall time: a window of a day of instants would be a day of UTC. The watermark is on wall time.
    """
    wall = stream.withColumn("_wall", F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    found = wall.withWatermark("_wall", late).groupBy(F.window("_wall", "1 day")).agg(F.count(F.lit(1)).alias("k"))
    return found.select(F.to_date("window.start").alias("day"), "k")


def upsert_into(stream: DataFrame, path: str, keys: Sequence[str], newest: str, checkpoint: str) -> DataStreamWriter:
    """Each batch's newest row of a key is written under ``path/batch=N``; ``latest`` reads the newest of all.

    A batch that is run again after a failure replaces its own folder only. ``compact`` folds batches together.
    """

    def write(rows: DataFrame, batch: int) -> None:
        order = [F.desc(newest), F.xxhash64(*rows.columns)]
        first_per_key(rows, keys, order).drop("place").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark, path: str, keys: Sequence[str], newest: str) -> DataFrame:
    """The newest row of each key in a table of ``upsert_into``; later batches win ties."""
    rows = spark.read.parquet(path)
    return first_per_key(rows, keys, [F.desc(newest), F.desc("batch")]).drop("place", "batch")


def _folded(spark, path: str, upto: int, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Put ``fold`` of the batches up to ``upto``, none of which is still written, in place of them.

    The fold is written beside the table, renamed into it under a negative number that no folder has, by which later
    batches win ties, and only then are the folders that it was made of deleted. Cut short at any point, the table reads
    the same, and a fold can be run again; where one fold is all there is, nothing is done.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    held = {int(x.getPath().getName()[6:]): x.getPath() for x in files.listStatus(hadoop.Path(path)) if x.getPath().getName().startswith("batch=")}
    old = {n: at for n, at in held.items() if n <= upto}
    if len(old) < 2 and all(n < 0 for n in old):
        return
    beside, target = f"{path.rstrip('/')}-fold-{uuid.uuid4().hex}", hadoop.Path(f"{path}/batch={min(*held, 0) - 1}")
    fold(spark.read.parquet(path).filter(F.col("batch").isin(list(old)))).drop("batch").write.parquet(beside)
    if files.exists(target) or not files.rename(hadoop.Path(beside), target):
        raise RuntimeError(f"{target} was made by another fold; this one is in {beside}")
    for at in old.values():
        files.delete(at, True)


def compact(spark, path: str, keys: Sequence[str], newest: str, upto: int) -> None:
    """Fold the batches of ``upsert_into`` up to ``upto`` into one folder; ``latest`` reads the same before and after."""
    _folded(spark, path, upto, lambda rows: first_per_key(rows, keys, [F.desc(newest), F.desc("batch")]).drop("place"))


def compact_current(spark, path: str, upto: int) -> None:
    """Fold the batches of ``superseded_upserts`` up to ``upto`` into one folder; ``current`` reads the same before and after."""
    _folded(spark, path, upto, lambda rows: current(rows).dropDuplicates(["source_id", "source_event_id", "start_at"]))


def superseded_upserts(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Instances (source_id, source_event_id, event_id, start_at, seen_at) under ``path/batch=N``, late ones too; ``current`` reads those that hold."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.dropDuplicates(["source_id", "source_event_id", "start_at"]).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(rows: DataFrame) -> DataFrame:
    """What holds of ``superseded_upserts``: of an id, the starts of its newest sighting, so moved starts are gone."""
    newest = F.max("seen_at").over(Window.partitionBy("source_id", "source_event_id"))
    return rows.withColumn("_newest", newest).filter("seen_at = _newest").drop("_newest")


_HEALTH = StructType([StructField("failures", IntegerType())])


def backoff_states(stream: DataFrame) -> DataFrame:
    """(source, failures, wait_hours) after each batch of runs (source, ts, ok): failures in a row, and the hours to wait.

    A source's runs of a batch are taken in the order of ts. The state of a source is one number.
    """

    def step(key, parts, state):
        failures = state.get[0] if state.exists else 0
        runs = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for ok in runs["ok"]:
            failures = 0 if ok else failures + 1
        state.update((failures,))
        yield pd.DataFrame({"source": [key[0]], "failures": [failures]})

    found = stream.groupBy("source").applyInPandasWithState(step, "source string, failures int", _HEALTH, "update", "NoTimeout")
    return found.withColumn("wait_hours", backoff_hours(F.col("failures")))


def per_source(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], shape: str, order: str = "ordinal") -> DataFrame:
    """``work`` on each source's batches in order, sources apart from each other.

    A source's rows are sorted within one task and reach ``work`` in Arrow batches, so that no source is held whole.
    """

    def run(parts):
        for part in parts:
            for _, mine in part.groupby("source", sort=False):
                yield work(mine)

    return rows.repartition("source").sortWithinPartitions("source", order).mapInPandas(run, shape)
