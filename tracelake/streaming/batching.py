"""Batches of a stream by number of rows or by time, whichever comes first.

Rows are dealt to slices, and each slice has one open batch. A batch is flushed when it has ``rows`` rows (a larger
arrival is cut into batches of at most ``cap`` rows), or ``seconds`` after its first row, by a processing-time timer. The
state of a slice is three numbers: rows pass on at once with the batch that they belong to, and a batch is complete when its
flush record is there. So no row waits in state, however large batches are.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path
from .streams import idempotent_writer

_STATE = "batch_no long, rows long, opened_ms long"


def sizes(held: int, arrived: int, rows: int, cap: int) -> tuple[list[int], int]:
    """How many of ``arrived`` rows go to the batch open (with ``held`` rows) and to each next one, and whether the last is
    still open afterwards (its rows) or not (0)."""
    out = []
    while arrived:
        total = held + arrived
        take = arrived if total <= cap else cap - held
        out.append(take)
        arrived -= take
        held = 0 if held + take >= rows else held + take
    return out, held


def batched(spans: DataFrame, rows: int = 10_000, cap: int = 20_000, seconds: float = 5.0, slices: int = 8,
            key: str = "TraceId") -> DataFrame:
    """The columns of ``spans`` with ``slice``, ``batch_no``; and flush records, in which those are null: ``slice``,
    ``batch_no``, ``rows``, ``reason`` (size or timer)."""
    if not 0 < rows <= cap:
        raise ValueError("a batch's rows must be positive and within the cap")
    names = spans.columns
    schema = spans.schema.add("slice", "integer").add("batch_no", "long").add("rows", "long").add("reason", "string")

    def records(slice_no: int, done: list[tuple[int, int, str]]) -> pd.DataFrame:
        out = pd.DataFrame({n: pd.Series([None] * len(done), dtype=object) for n in names})
        return out.assign(slice=slice_no, batch_no=[d[0] for d in done], rows=pd.array([d[1] for d in done], "Int64"),
                          reason=[d[2] for d in done])

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slice_no = int(keys[0])
        number, held, opened = state.get if state.exists else (0, 0, 0)
        now = state.getCurrentProcessingTimeMs()
        done = []
        for part in parts:
            cuts, left = sizes(held, len(part), rows, cap)
            at = []
            for take in cuts:
                opened = opened if held else now
                held += take
                at += [number] * take
                if held >= rows:
                    done.append((number, held, "size"))
                    number, held = number + 1, 0
            assert held == left
            if len(part):
                yield part[names].assign(slice=slice_no, batch_no=at, rows=pd.array([None] * len(part), "Int64"), reason=None)
        if held and now >= opened + seconds * 1000:
            done.append((number, held, "timer"))
            number, held = number + 1, 0
        if done:
            yield records(slice_no, done)
        state.update((number, held, opened))
        if held:
            state.setTimeoutDuration(max(1, int(opened + seconds * 1000 - now)))

    return (spans.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).groupBy("slice")
            .applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout))


def run_until_flushed(df: DataFrame, name: str, timeout_s: float = 300.0) -> str:
    """Run over everything there is now and until the last batch was flushed; returns the table's path."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    q = (df.writeStream.outputMode("append").option("checkpointLocation", f"{out}/_checkpoint")
         .foreachBatch(idempotent_writer(f"{out}/data")).trigger(processingTime="1 second").start())
    until, seen = time.monotonic() + timeout_s, -1
    try:
        while time.monotonic() < until and q.isActive:
            # Batches go on without input, by timers alone: all is flushed when the source has nothing left and
            # rows and flush records agree.
            last = q.lastProgress
            if last and last["batchId"] != seen and not last["numInputRows"] and last["batchId"] > 0:
                seen = last["batchId"]
                rows = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
                open_ = rows.agg(F.count(F.when(F.col("reason").isNull(), 1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
                if open_[0] == open_[1] > 0:
                    return f"{out}/data"
            time.sleep(0.5)
    finally:
        q.stop()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    raise TimeoutError(f"streaming query {name} did not flush its batches in {timeout_s}s")


def flushed(spark: SparkSession, path: str) -> DataFrame:
    """``slice``, ``batch_no``, ``reason``, ``rows``: batches that were flushed, with the rows that really are in them."""
    rows = spark.read.option("basePath", path).parquet(path)
    return (rows.groupBy("slice", "batch_no").agg(F.max("reason").alias("reason"), F.count(F.when(F.col("reason").isNull(), 1)).alias("rows"))
            .where(F.col("reason").isNotNull()))
