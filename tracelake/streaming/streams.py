"""Structured Streaming over span files.

Sources are file streams of span Parquet (``maxFilesPerTrigger`` is the
back-pressure knob). Stateful operators bound their state with an event-time
watermark; sinks are ``foreachBatch`` writers keyed by the micro-batch id,
so a replayed batch (after a failure) overwrites its own output instead of
appending a second copy. Checkpoints live in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import drop_path, move_files, scratch_path


def stream_spans(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """Continuous arrival of span files (``maxFilesPerTrigger`` files per micro-batch)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def ingest_rate(spans: DataFrame, watermark: str = "10 minutes", every: str = "1 minute",
                window: str | None = None) -> DataFrame:
    """Per-window span counts and spans/second (tumbling, or sliding when
    ``window`` is longer than ``every``)."""
    length = window or every
    seconds = _seconds(length)
    w = F.window("Timestamp", length, every)
    return (spans.withWatermark("Timestamp", watermark).groupBy(w.alias("w"))
            .agg(F.count(F.lit(1)).alias("spans"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "spans",
                    F.round(F.col("spans") / F.lit(float(seconds)), 6).alias("spans_per_sec")))


def service_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("ServiceName", "SpanKind", "StatusCode").agg(F.count(F.lit(1)).alias("n"))


def dedup(spans: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Drop retry duplicates: the first copy of (TraceId, SpanId) within the watermark wins."""
    return spans.withWatermark("Timestamp", watermark).dropDuplicatesWithinWatermark(["TraceId", "SpanId"])


def trace_assembly(spans: DataFrame, gap: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Emit one summary per trace once no span of it arrived for ``gap``
    (event time) and the watermark has passed: spans, errors, start, end."""
    end = F.col("StartUnixNano") + F.col("Duration")
    return (spans.withWatermark("Timestamp", watermark)
            .groupBy(F.session_window("Timestamp", gap).alias("session"), "TraceId")
            .agg(F.count(F.lit(1)).alias("spans"),
                 F.sum(F.when(F.col("StatusCode") == "Error", 1).otherwise(0)).cast("bigint").alias("errors"),
                 F.min("StartUnixNano").alias("start_ns"), F.max(end).alias("end_ns"))
            .select("TraceId", "spans", "errors", "start_ns", "end_ns"))


def idempotent_writer(path: str, fmt: str = "parquet", complete: bool = False) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: batch ``b`` goes to ``path/batch_id=b`` with
    overwrite, so re-running a batch replaces rather than duplicates it.
    ``complete`` output replaces the whole table each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if complete:
            batch.write.mode("overwrite").format(fmt).save(f"{path}/current")
        else:
            batch.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")

    return write


def run_available_now(df: DataFrame, name: str, output_mode: str = "append",
                      timeout_s: float | None = None) -> tuple[str, StreamingQuery]:
    """Run a streaming query over everything available now into an
    idempotent Parquet table in the shared folder; returns (path, query).
    With ``timeout_s`` the run is stopped then and raises; by default it has no limit."""
    spark = df.sparkSession
    out = scratch_path(spark, f"stream-{name}")
    q = (df.writeStream.outputMode(output_mode)
         .option("checkpointLocation", f"{out}/_checkpoint")
         .foreachBatch(idempotent_writer(f"{out}/data", complete=output_mode == "complete"))
         .trigger(availableNow=True).start())
    finished = q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if finished is False:
        q.stop()
        raise TimeoutError(f"streaming query {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return f"{out}/data", q


def read_result(spark: SparkSession, path: str, complete: bool = False) -> DataFrame:
    if complete:
        return spark.read.parquet(f"{path}/current")
    return spark.read.option("basePath", path).parquet(path).drop("batch_id")


def _seconds(length: str) -> int:
    n, unit = length.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return int(n) * mult


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key from an update-mode table: a batch wrote only the
    keys that it changed."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
            .select(*keys, "_v.*"))


def batch_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that each micro-batch wrote (``batch_id``, ``rows``), counted in the table itself,
    so no batch is forgotten however long the query ran."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("rows"))


def write_arrival_files(df: DataFrame, path: str, n_ranges: int = 16, order_col: str = "Timestamp",
                        closing: Callable[[DataFrame], DataFrame] | None = None, files: int = 2) -> str:
    """Test/replay input for a file stream: ``df`` split into ``n_ranges`` time ranges of
    ``files`` files, written one after another (so file order is arrival order), then an
    optional far-later batch that moves the watermark past every real event: ``closing`` of one of the rows.

    The tasks that make the rows write them, packed, to a folder for each file, cut at quantiles of ``order_col``; no shuffle is
    added. A file is a copy of its folder, which is deleted then: the rows lie on disk once, and some ranges of them twice. Copies
    of ranges are made at the same time, and shown one range after another."""
    from ..plans.packing import dropped_shuffles, pack, unpack

    spark, ranges = df.sparkSession, scratch_path(df.sparkSession, "arrivals")
    n, at = n_ranges * files, F.col(order_col).cast("double")
    with dropped_shuffles(spark):
        cuts = df.select(F.percentile_approx(at, [i / n for i in range(1, n)])).first()[0] or []
        part = sum((F.coalesce((at > F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
        packed = pack(df, ids=True).withColumn("_part", part)
        packed.write.partitionBy("_part").parquet(ranges)
    rows = spark.read.schema(packed.schema).parquet(ranges)

    def copy(i: int) -> str:
        parts = [rows.filter(F.col("_part") == k).drop("_part").coalesce(1) for k in range(i * files, (i + 1) * files)]
        made = f"{ranges}/_copies/{i}"
        unpack(reduce(DataFrame.union, parts), df).select(*df.columns).write.parquet(made)
        return made

    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # a union of single partitions has one task for each
    try:
        with ThreadPoolExecutor(max(1, min(n_ranges, spark.sparkContext.defaultParallelism // files))) as pool:
            for i, made in enumerate(pool.map(inheritable_thread_target(spark)(copy), range(n_ranges))):
                move_files(spark, made, path)
                for k in range(i * files, (i + 1) * files):
                    drop_path(spark, f"{ranges}/_part={k}")
    finally:
        spark.conf.unset("spark.sql.unionOutputPartitioning")
    drop_path(spark, ranges)
    if closing is not None:
        closing(spark.read.parquet(path).limit(1)).write.mode("append").parquet(path)
    return path
