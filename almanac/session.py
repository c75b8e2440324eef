"""Session settings that the operators expect."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


ROOT = str(Path(__file__).resolve().parents[1])


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    # Python workers import this package from wherever the session was started
    known = os.environ.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return (
        SparkSession.builder.master(master)
        .appName("almanac")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.executorEnv.PYTHONPATH", os.environ["PYTHONPATH"])
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
