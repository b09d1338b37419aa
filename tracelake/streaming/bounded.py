"""Streaming runs that stop after a number of rows or a time, and go on later where they stopped.

The limit may fall inside of a micro-batch. Then the batch's first rows, by a total order, are committed as its first
part, and the run ends before the batch counts as done in the checkpoint. The next run is given the same batch again, finds
in the log how many rows were taken, and takes those after them. So a run appends exactly ``max_rows`` rows, and no
row is lost or written twice however often runs stop.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import group_scan
from .commitlog import _fs, create_file


class _Stop(RuntimeError):
    pass


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id``, ``part``, ``attempt``, ``rows``, ``last`` (the batch is complete): a row for each committed part."""
    return spark.read.schema("batch_id long, part int, attempt string, rows long, last boolean").json(f"{path}/log")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were committed."""
    folders = [f"{path}/data/attempt={r['attempt']}" for r in read_log(spark, path).collect()]  # a short row a part
    return spark.read.parquet(*folders)


def run(df: DataFrame, path: str, order: list[str], max_rows: int | None = None, max_seconds: float | None = None) -> int:
    """Append rows of the stream ``df`` to the table at ``path`` until ``max_rows`` rows of this run are committed, or
    ``max_seconds`` have passed at the end of a batch, or there is nothing more. Returns the run's rows. ``order`` must be a total
    order of the rows of a batch."""
    spark = df.sparkSession
    done, began = 0, time.monotonic()

    def taken_before(batch_id: int) -> tuple[int, int, bool]:
        """Rows and parts of this batch that earlier runs committed, and whether that was all."""
        fs, log = _fs(spark, f"{path}/log")
        if not fs.exists(log):
            return 0, 0, False
        rows = read_log(spark, path).where(F.col("batch_id") == batch_id).agg(
            F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.bool_or("last"), F.lit(False))).first()
        return rows[0], rows[1], rows[2]

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        if (max_rows is not None and done >= max_rows) or (max_seconds is not None and time.monotonic() - began >= max_seconds):
            raise _Stop("the run's bound is reached")
        taken, part, complete = taken_before(batch_id)
        if complete:
            return
        rows = batch
        size = batch.count()
        take = size - taken if max_rows is None else min(size - taken, max_rows - done)
        if taken or take < size:
            ranked = group_scan(batch.withColumn("_one", F.lit(0).cast("bigint")), ["_one"], order, "_one")
            rows = ranked.where(F.col("rank").between(taken + 1, taken + take)).select(*batch.columns)
        last = taken + take == size
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{path}/data/attempt={attempt}")
        create_file(spark, f"{path}/log/{batch_id:012d}-{part:04d}.json", json.dumps(
            {"batch_id": batch_id, "part": part, "attempt": attempt, "rows": take, "last": last}))
        done += take
        if not last:
            raise _Stop("the run's bound is reached")

    try:
        (df.writeStream.option("checkpointLocation", f"{path}/_checkpoint").foreachBatch(write)
         .trigger(availableNow=True).start().awaitTermination())
    except Exception as e:
        if "the run's bound is reached" not in str(e):
            raise
    return done
