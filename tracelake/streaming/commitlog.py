"""Streaming tables with a commit log: a batch counts once its manifest is written, and not before.

A micro-batch goes to a folder of its own attempt, ``data/attempt=<id>``, and only when all its files are there is
the manifest ``log/<batch>.json`` created, which names that folder. Readers follow the log, so files of an attempt that
failed (an executor or the driver was lost in the middle) are never read. A batch that is replayed after a restart finds
its manifest and writes nothing, or finds none and writes another attempt: each row is read once.
The manifest is created without overwriting, so that of two attempts at once one wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _manifest(path: str, batch_id: int) -> str:
    return f"{path}/log/{batch_id:012d}.json"


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False if there is one (it is left as it is)."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as e:  # another writer was faster
        if fs.exists(at):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def committed_writer(path: str, before_commit: Callable[[int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that appends each batch to the table at ``path`` exactly once. ``before_commit`` is called
    between the data and the manifest (tests fail there)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, manifest = _fs(spark, _manifest(path, batch_id))
        if fs.exists(manifest):
            return
        attempt = uuid.uuid4().hex
        batch.write.parquet(f"{path}/data/attempt={attempt}")
        if before_commit:
            before_commit(batch_id, attempt)
        create_file(spark, _manifest(path, batch_id), json.dumps({"batch_id": batch_id, "attempt": attempt}))

    return write


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id``, ``attempt`` of all committed batches."""
    return spark.read.schema("batch_id long, attempt string").json(f"{path}/log")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, with ``batch_id``: the folders that the log names, and no others."""
    attempts = {r["attempt"]: r["batch_id"] for r in read_log(spark, path).collect()}  # a short row a batch
    if not attempts:
        raise ValueError(f"nothing was committed to {path}")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/attempt={a}" for a in sorted(attempts)))
    log = read_log(spark, path).select(F.col("attempt"), "batch_id")
    return rows.join(F.broadcast(log) if len(attempts) < 100_000 else log, "attempt").drop("attempt")


def drop_aborted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of attempts that were never committed; returns their names. Not while a query writes."""
    kept = {r["attempt"] for r in read_log(spark, path).collect()}
    fs, data = _fs(spark, f"{path}/data")
    gone = []
    for status in fs.listStatus(data):
        name = status.getPath().getName()
        if name.startswith("attempt=") and name[len("attempt="):] not in kept:
            fs.delete(status.getPath(), True)
            gone.append(name[len("attempt="):])
    return gone


class Abort(RuntimeError):
    """Raised between data and manifest."""


def start(df: DataFrame, path: str, before_commit: Callable[[int, str], None] | None = None):
    """Start a query that appends ``df`` to the table at ``path``; its checkpoint lies beside the table."""
    return (df.writeStream.option("checkpointLocation", f"{path}/_checkpoint")
            .foreachBatch(committed_writer(path, before_commit)).trigger(availableNow=True).start())


def run_with_failure(df: DataFrame, name: str, fail_at: int) -> str:
    """Run over everything there is; the first attempt of batch ``fail_at`` is lost after its data was written, which
    ends the query, and a second one goes on from the checkpoint. Returns the table's path."""
    path = scratch_path(df.sparkSession, f"stream-{name}")

    def fail(batch_id: int, attempt: str) -> None:
        if batch_id == fail_at:
            raise Abort(f"attempt {attempt} of batch {batch_id} is given up")

    try:
        start(df, path, fail).awaitTermination()
    except Exception as e:
        if "is given up" not in str(e):
            raise
    start(df, path).awaitTermination()
    return path
