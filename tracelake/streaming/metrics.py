"""Metrics of streaming queries as a table: what each batch observed, appended when it ends.

A query declares its counts with ``DataFrame.observe`` (they are taken while the batch runs, in the same pass). A listener
gets every batch's progress and appends it, one small JSON file a batch, to a folder; Spark itself keeps only the last hundred.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import scratch_path
from .commitlog import create_file


class MetricsTable(StreamingQueryListener):
    """Appends each progress that has the observation ``name`` to the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.running: set[str] = set()
        self.failed: list[str] = []
        self.idle = threading.Event()
        self.idle.set()

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.runId))
        self.idle.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is None:
            return
        values = {"run_id": str(p.runId), "batch_id": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows,
                  "duration_ms": p.batchDuration, **{k: v for k, v in row.asDict().items() if v is not None}}
        try:  # the same batch of the same run is one file
            create_file(self.spark, f"{self.path}/{p.runId}-{p.batchId:012d}.json", json.dumps(values))
        except Exception as e:  # a listener's own errors are swallowed by Spark
            self.failed.append(str(e))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running.discard(str(event.runId))
        if not self.running:
            self.idle.set()


@contextmanager
def recorded(spark: SparkSession, name: str, timeout_s: float = 60.0) -> Iterator[str]:
    """Record the observation ``name`` of all queries that run inside of the block; gives the folder of the table, which
    is complete after the block (progress comes on a queue, the end of a query last)."""
    listener = MetricsTable(spark, scratch_path(spark, f"metrics-{name}"), name)
    spark.streams.addListener(listener)
    try:
        yield listener.path
        if not listener.idle.wait(timeout_s):
            raise TimeoutError("a query inside of the block still runs")
    finally:
        spark.streams.removeListener(listener)
    if listener.failed:
        raise RuntimeError(f"{len(listener.failed)} batches were not recorded: {listener.failed[0]}")


def read_metrics(spark: SparkSession, path: str, values: dict[str, str]) -> DataFrame:
    """``run_id``, ``batch_id``, ``at``, ``input_rows``, ``duration_ms``, the observed ``values`` (0 in a batch without rows)
    and ``<value>_per_sec`` over the batch's own duration."""
    schema = "run_id string, batch_id long, at timestamp, input_rows long, duration_ms long, " + ", ".join(
        f"{n} {t}" for n, t in values.items())
    rows = spark.read.schema(schema).json(path).withColumns({n: F.coalesce(n, F.lit(0)) for n in values})
    return rows.withColumns({f"{n}_per_sec": F.round(F.col(n) * 1000 / F.when(F.col("duration_ms") > 0, F.col("duration_ms")), 3)
                             for n in values})
