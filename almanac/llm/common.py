"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where tests and single-machine sessions keep written tables when the session names no shared folder.
_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; on a local master without that setting, a temporary one."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="almanac-")
    return _own_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts; Spark's own bound lets a whole partition be one batch, in the JVM and the worker.
TEXT_BATCH_BYTES = 4 << 20
#: Texts taken out of an Arrow batch together.
SLICE_ROWS = 256


def materialize(df: DataFrame, name: str, codec: str = "snappy", batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The exchanges of the write are freed when it is done, since nothing reads them again. ``batch_bytes``: where the
    Arrow batches of the write end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/almanac-{name}-{uuid.uuid4().hex}"
    during = {_CLEANUP: "true"} | ({_BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def by_slices(batches: Iterator[pa.RecordBatch], function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``function`` of each slice of ``rows`` rows, so that only these are held as Python objects and sent back together.

    At the end Arrow's pool gives back what it kept of the batches: the worker goes on to other work.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield function(batch.slice(lo, rows))
        del batch
    pa.default_memory_pool().release_unused()


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of tables of ``materialize`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def query_blocks(queries: DataFrame, size: str, most: int) -> Iterator[list]:
    """The rows of a query set in blocks whose column ``size`` adds up to ``most`` at most, but for a single larger row.

    One block is on the driver at a time, beside the input partition that it comes from.
    """
    block, held = [], 0
    for row in queries.toLocalIterator():
        if block and held + row[size] > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += row[size]
    if block:
        yield block
