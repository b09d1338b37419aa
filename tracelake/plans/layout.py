"""Physical layout of span tables: partitioned, clustered and sharded Parquet.

Writers range-partition on the clustering key before ``partitionBy``: each
task then covers a contiguous key range (few output directories per task,
sorted row groups with selective min/max), and a day or shard holding a
third of all rows is still split over many tasks. ``maxRecordsPerFile``
bounds file size. Range bounds come from a pass over the key columns; the rows are made once
and travel packed (``plans.packing``), in as many ranges as keep each sort in memory. Directory-level operations (retention, compaction) act on
whole partitions, like part-level TTL drops.
"""

from __future__ import annotations

import datetime as dt
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import readable_size, shard_of
from ..operators.encode import encode_json_layout
from .packing import ROWS_PER_TASK, deal_sorted, dropped_shuffles, fold, pack, unfold, unpack
from .scan import group_scan

MAX_RECORDS_PER_FILE = 2_000_000


def bloom_options(columns: dict[str, tuple[float, int]]) -> dict[str, str]:
    """Parquet Bloom-filter writer options: {column: (fpp, expected_ndv)}."""
    opts = {}
    for c, (fpp, ndv) in columns.items():
        opts[f"parquet.bloom.filter.enabled#{c}"] = "true"
        opts[f"parquet.bloom.filter.fpp#{c}"] = str(fpp)
        opts[f"parquet.bloom.filter.expected.ndv#{c}"] = str(ndv)
    return opts


# TraceId at fpp 0.001 and SpanName at 0.01, as the reference table's skip indexes.
# Expected distinct values of a full file (traces have some ten spans); a filter's size is set by
# them, so that a table of many small files wants smaller numbers.
DEFAULT_BLOOM = {"TraceId": (0.001, 200_000), "SpanName": (0.01, 5_000)}


def _writer(df: DataFrame, mode: str, bloom: dict | None, max_records: int):
    w = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", max_records)
    for k, v in bloom_options(bloom or {}).items():
        w = w.option(k, v)
    return w


def _save(w, path: str, *keys: str) -> str:
    """Write the table; the shuffles that made its rows are deleted then."""
    with dropped_shuffles(w._spark):
        w.partitionBy(*keys).parquet(path)
    return path


def partition_keys(granularity: str | None) -> dict[str, F.Column]:
    """Partition columns of a granularity. Their names tell readers what a directory covers:
    ``dt`` a day (the table default), ``dt`` and ``hour`` an hour, ``month`` (its first
    day) a month, for sparse data spread over years; None: no directories."""
    day = F.to_date("Timestamp")
    return {None: {}, "day": {"dt": day}, "hour": {"dt": day, "hour": F.hour("Timestamp")},
            "month": {"month": F.to_date(F.date_trunc("month", "Timestamp"))}}[granularity]


def write_spans_map(spans: DataFrame, path: str, n_tasks: int | None = None, bloom: dict | None = None,
                    mode: str = "overwrite", max_records: int = MAX_RECORDS_PER_FILE,
                    granularity: str | None = "day") -> str:
    """Daily partitions (``dt``), clustered by (ServiceName, SpanName, Timestamp)."""
    keys = partition_keys(granularity)
    src = spans.withColumns(keys) if keys else spans
    order = [*keys, "ServiceName", "SpanName", "Timestamp"]
    out = deal_sorted(src, n_tasks, order, order)
    return _save(_writer(out, mode, DEFAULT_BLOOM if bloom is None else bloom, max_records), path, *keys)


def write_spans_json(spans: DataFrame, path: str, n_tasks: int | None = None, granularity: str = "hour",
                     bloom: dict | None = None, mode: str = "overwrite",
                     max_records: int = MAX_RECORDS_PER_FILE) -> str:
    """JSON layout (VARIANT attributes) partitioned by day and hour (or day
    only), ordered by Timestamp."""
    keys = partition_keys(granularity)
    out = encode_json_layout(deal_sorted(spans, n_tasks, ["Timestamp"], ["Timestamp"])).withColumns(keys)
    return _save(_writer(out, mode, DEFAULT_BLOOM if bloom is None else bloom, max_records), path, *keys)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a span table (map or JSON layout); partition columns are discovered."""
    return spark.read.parquet(path)


def write_sharded_hash(spans: DataFrame, n_shards: int, path: str, method: str = "xxhash64",
                       n_tasks: int | None = None, mode: str = "overwrite", granularity: str | None = None) -> str:
    """Shard by a hash of TraceId: balanced shards, every trace on one shard. With a
    ``granularity`` each shard is partitioned by time, too."""
    keys = partition_keys(granularity)
    src = spans.withColumns({"shard": shard_of("TraceId", n_shards, method), **keys})
    out = deal_sorted(src, n_tasks, ["shard", *keys, "TraceId", "SpanId"], ["shard", *keys, "TraceId"])
    return _save(_writer(out, mode, {"TraceId": DEFAULT_BLOOM["TraceId"]}, MAX_RECORDS_PER_FILE), path, "shard", *keys)


def write_sharded_rr(spans: DataFrame, n_shards: int, replica: int, batch_size: int, path: str,
                     slices: int = 8, n_tasks: int | None = None, mode: str = "overwrite") -> str:
    """Whole batches rotate over shards, starting after the replica's own
    offset: shard = (replica % n + 1 + batch) % n, batch counted per slice."""
    from ..operators.windows import assign_batches

    b = assign_batches(spans, batch_size, slices).select("TraceId", "slice", "batch_no")
    shard = F.pmod(F.lit(replica % n_shards + 1) + F.col("slice") + F.col("batch_no"), F.lit(n_shards)).cast("int")
    # spans travel once, folded: the tasks of the join write their traces' rows to the shards
    src = fold(pack(spans, ids=True), spans).join(pack(b, ids=True), "TraceId").withColumn("shard", shard)
    src = unpack(unfold(src.drop("slice", "batch_no"), spans), spans)
    out = src.repartition(n_tasks, "shard", "TraceId") if n_tasks else src
    return _save(_writer(out, mode, None, MAX_RECORDS_PER_FILE), path, "shard")


def write_attr_index(spans: DataFrame, path: str, n_tasks: int | None = None, mode: str = "overwrite") -> str:
    """A side table for attribute search: one row per (span, scope, key, value), a directory
    per scope and key, ordered by value. A search by key reads one directory, and one by
    value only the row groups whose range holds it. Ranges on (key, value, span) spread a
    key that every span has over many tasks."""
    from ..operators.profile import explode_attributes

    rows = explode_attributes(spans)
    order = ["scope", "key", "value", "TraceId", "SpanId"]
    out = deal_sorted(rows, n_tasks, order, order, 4 * ROWS_PER_TASK)  # narrow rows
    return _save(_writer(out, mode, {"value": (0.01, 100_000)}, MAX_RECORDS_PER_FILE), path, "scope", "key")


def find_by_attr(spark: SparkSession, path: str, key: str, value: str | None = None, scope: str = "span") -> DataFrame:
    """(TraceId, SpanId, value) of the spans that have the attribute (with that value)."""
    rows = spark.read.parquet(path).filter((F.col("scope") == scope) & (F.col("key") == key))
    return (rows if value is None else rows.filter(F.col("value") == value)).select("TraceId", "SpanId", "value")


def read_all_shards(spark: SparkSession, base: str) -> DataFrame:
    """One logical table over ``shard=N`` directories, with a ``host`` column."""
    df = spark.read.parquet(base)
    return df.withColumn("host", F.concat(F.lit("shard-"), F.col("shard").cast("string")))


def read_shard(spark: SparkSession, base: str, shard: int) -> DataFrame:
    return spark.read.parquet(f"{base}/shard={shard}").withColumn("shard", F.lit(shard))


def write_both_layouts(spans: DataFrame, map_path: str, json_path: str, n_tasks: int | None = None,
                       json_granularity: str = "hour") -> tuple[str, str]:
    """The same spans to both targets: the JSON table is made from the map table just
    written, so the input is computed once and both hold the same rows."""
    write_spans_map(spans, map_path, n_tasks)
    write_spans_json(read_spans(spans.sparkSession, map_path).select(*spans.columns), json_path, n_tasks,
                     granularity=json_granularity)
    return map_path, json_path


def files_per_partition(spark: SparkSession, path: str, partition_cols: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Parts (files), rows and bytes per partition (and shard, when present)."""
    df = spark.read.parquet(path)
    keys = [c for c in ("shard", *partition_cols) if c in df.columns]
    per_file = df.select(*keys, F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_size").alias("bytes")) \
        .groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))
    return (per_file.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
            .withColumn("size", readable_size("bytes"))
            .orderBy(*keys))


def _partition_dirs(spark: SparkSession, path: str, depth: int):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    glob = "/".join(["*"] * depth)
    stats = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{glob}"))
    return fs, [s.getPath() for s in (stats or []) if s.isDirectory()]


def _partition_end(p) -> dt.datetime | None:
    """End of a dt=YYYY-MM-DD[/hour=H] or month=YYYY-MM-01 partition directory."""
    parts = {}
    node = p
    while node is not None and "=" in node.getName():
        k, v = node.getName().split("=", 1)
        parts[k] = v
        node = node.getParent()
    if "month" in parts:
        first = dt.datetime.strptime(parts["month"], "%Y-%m-%d")
        return (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    if "dt" not in parts:
        return None
    day = dt.datetime.strptime(parts["dt"], "%Y-%m-%d")
    if "hour" in parts:
        return day + dt.timedelta(hours=int(parts["hour"]) + 1)
    return day + dt.timedelta(days=1)


def retention_drop(spark: SparkSession, path: str, ttl: dt.timedelta, now: dt.datetime,
                   hourly: bool = False) -> list[str]:
    """Delete whole partitions whose every row is past ``ttl`` (partition
    end + ttl <= now), the way a TTL drops only complete parts. Returns the
    dropped directories. Only the file system's directory listing is
    touched; no data passes through the driver."""
    fs, dirs = _partition_dirs(spark, path, 2 if hourly else 1)
    dropped = []
    for d in dirs:
        end = _partition_end(d)
        if end is not None and end + ttl <= now:
            fs.delete(d, True)
            dropped.append(d.toString())
    return dropped


def compact_partitions(spark: SparkSession, path: str, out_path: str, target_rows: int = 1_000_000,
                       sort_cols: tuple[str, ...] = ("ServiceName", "SpanName", "Timestamp"),
                       bloom: dict | None = None, n_tasks: int | None = None) -> str:
    """Rewrite a partitioned table with as few files as ``target_rows`` rows per file allow.

    The partition columns (``dt``, ``hour``, ``month``, ``shard``), the clustering order and
    the Bloom filters are kept. Each partition is cut by exact row numbers into slices of
    ``target_rows`` rows, and a slice goes to one task: a huge partition is spread over many
    tasks. Only partitions of several slices are ranked, by their rows' keys and places in their files; the rows themselves
    travel once, folded, and find their slice among the first keys of their partition's slices. Raises if the copy's row count differs."""
    df = spark.read.parquet(path)
    parts = [c for c in ("shard", "dt", "hour", "month") if c in df.columns]
    sort = [c for c in sort_cols if c in df.columns]
    names = [f"_c{i}" if "." in c else c for i, c in enumerate(df.columns)]  # names with dots read as fields
    rows = df.select("*", F.col("_metadata.file_name"), F.col("_metadata.row_index")).toDF(*names, "_file", "_row").withColumn("_all", F.lit(0))
    before = df.count()
    if n_tasks:  # no task sorts more than some rows, however large the table is
        n_tasks = max(n_tasks, ceil(before / ROWS_PER_TASK))
    part, key = F.struct("_all", *parts).alias("_part"), [*sort, "_file", "_row"]
    large = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows).select("_part")
    ranked = rows.select("_all", *parts, *key, part).join(F.broadcast(large), "_part", "left_semi").drop("_part")
    placed = group_scan(ranked, ["_all", *parts], key, "_all", n_tasks)
    firsts = (placed.filter((F.col("rank") > 1) & ((F.col("rank") - 1) % target_rows == 0)).select(part, F.struct(*key).alias("_first"))
              .groupBy("_part").agg(F.collect_list("_first").alias("_firsts")))  # a key for each file that is written
    known = rows.withColumn("_part", part).join(F.broadcast(firsts), "_part", "left")
    slice_no = F.size(F.filter("_firsts", lambda first: first <= F.struct(*key)))
    plain = rows.select(*(c for c in names if c not in parts))
    cut = known.select(*names, F.when(F.col("_firsts").isNull(), 0).otherwise(slice_no).alias("_cut"))
    folded = fold(pack(cut, ids=True), plain)
    dealt = folded.repartition(n_tasks, *parts, "_cut") if n_tasks else folded.repartition(*parts, "_cut")
    out = unfold(dealt, plain).sortWithinPartitions(*parts, "_cut", *sort).select(*names)
    out = unpack(out, rows).toDF(*df.columns)
    _save(_writer(out, "overwrite", DEFAULT_BLOOM if bloom is None else bloom, target_rows), out_path, *parts)
    after = spark.read.parquet(out_path).count()
    if before != after:
        raise RuntimeError(f"{out_path} has {after} rows, {path} has {before}")
    return out_path
