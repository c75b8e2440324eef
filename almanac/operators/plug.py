"""Functions of the caller's, such as models, over rows: asked in batches, oldest first, within bounds of time.

A call that raises or takes too long leaves a row with its error for each row that it was asked about, so that failures
can be counted and those rows asked again; an answer that comes late is dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from almanac.functions.bounded import within
from almanac.operators.listing import oldest

def answers(rows: DataFrame, ask: Callable[[pd.DataFrame], pd.DataFrame], shape: str, limit: int, batch: int = 64, created: str = "created_at", key: str = "id", seconds: float | None = None, budget: float | None = None) -> DataFrame:
    """What ``ask`` gives, in ``shape`` (which has ``key``) with ``error``, for the ``limit`` oldest of ``rows``, ``batch`` at a time.

    A call may take ``seconds``; calls begin until ``budget`` seconds after the job was put together. Rows of calls that fail,
    come late or do not begin have an error and, but for the key, no answer. Rows are spread over tasks in whole
    batches, so a slow function is asked by several at once.
    """
    names = [x.split()[0] for x in shape.split(",")]
    until = None if budget is None else time.time() + budget

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch]
                left = None if until is None else until - time.time()
                try:
                    if left is not None and left <= 0:
                        raise TimeoutError("the run's time was over")
                    bound = min((x for x in (seconds, left) if x is not None), default=None)
                    yield within(lambda: ask(some), bound)[names].assign(error=None)  # noqa: B023
                except Exception as problem:  # noqa: BLE001  whatever the function raises
                    failed = pd.DataFrame({n: some[key].to_numpy() if n == key else pd.Series([None] * len(some), dtype=object) for n in names})
                    yield failed.assign(error=f"{type(problem).__name__}: {problem}")

    return oldest(rows, limit, created, key).repartition(max(1, -(-limit // batch))).mapInPandas(run, f"{shape}, error string")
