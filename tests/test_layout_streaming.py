"""Layouts written and read back; streaming runs equal batch results."""

import datetime as dt

from pyspark.sql import functions as F

from tracelake.operators import encode, setops, verify
from tracelake.plans import layout
from tracelake.session import scratch_path
from tracelake.streaming import streams


def test_map_json_roundtrip(spark, spans_small):
    m = scratch_path(spark, "t-map")
    j = scratch_path(spark, "t-json")
    layout.write_both_layouts(spans_small, m, j, json_granularity="day")
    back_map = layout.read_spans(spark, m)
    back_json = encode.json_to_map_layout(layout.read_spans(spark, j))
    r = setops.parity(back_map, back_json).first()
    assert (r.left_only, r.right_only, r.rows) == (0, 0, 10948)
    assert len(encode.JSON_LAYOUT) == 23 and len(encode.MAP_LAYOUT) == 22


def test_a_path_of_the_json_layout_reads_its_subcolumn(spark, spans_small):
    import pathlib

    import pyarrow.parquet as pq

    from tracelake.operators import filters

    p = scratch_path(spark, "t-shredded")
    layout.write_spans_json(spans_small, p, n_tasks=2, granularity=None)
    table = layout.read_spans(spark, p)
    found = filters.filter_attr_equals(table, "http.request.method", "POST").select("TraceId", "SpanId")
    want = filters.filter_attr_equals(spans_small, "http.request.method", "POST").select("TraceId", "SpanId")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SpanAttributes:struct<0:string>" in plan and "EqualTo(SpanAttributes.`0`,POST)" in plan
    one = whole = 0
    for name in pathlib.Path(p.removeprefix("file:")).rglob("*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                if col.path_in_schema.startswith("SpanAttributes."):
                    whole += col.total_compressed_size
                    one += col.total_compressed_size * ("http.request.method" in col.path_in_schema)
    print(f"bytes of the subcolumn {one}, of all attributes {whole}")
    assert 0 < one < 0.1 * whole


def test_sharding(spark, spans_small):
    p = scratch_path(spark, "t-shard")
    layout.write_sharded_hash(spans_small, 3, p)
    t = layout.read_all_shards(spark, p)
    per = {r.host: r.rows_on_node for r in verify.rows_per_shard(t).collect()}
    assert sum(per.values()) == 10948 and len(per) == 3
    split = t.groupBy("TraceId").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert split == 0


def test_retention(spark, spans_small):
    p = scratch_path(spark, "t-ret")
    layout.write_spans_map(spans_small, p)
    now = dt.datetime(1999, 1, 1)
    dropped = layout.retention_drop(spark, p, dt.timedelta(hours=5), now)
    kept = layout.read_spans(spark, p)
    assert dropped and kept.filter(F.col("dt") < F.lit("1998-12-31").cast("date")).count() == 0
    assert kept.count() == spans_small.filter(F.col("Timestamp") >= F.lit("1998-12-31").cast("timestamp")).count()


def test_month_retention_deletes_no_live_row(spark, spans_small):
    p = scratch_path(spark, "t-ret-month")
    layout.write_spans_map(spans_small, p, granularity="month")
    now, ttl = dt.datetime(1997, 6, 10, 12), dt.timedelta(days=100)
    dropped = layout.retention_drop(spark, p, ttl, now)
    live = F.col("Timestamp") > F.lit(now - ttl)
    kept = layout.read_spans(spark, p)
    assert dropped and kept.filter(live).count() == spans_small.filter(live).count()


def test_compaction_keeps_rows_order_and_partitions(spark, spans_small):
    p, out = scratch_path(spark, "t-hourly"), scratch_path(spark, "t-compact")
    layout.write_spans_json(spans_small.filter(F.col("Timestamp") >= F.lit("1998-07-01").cast("timestamp")), p)
    layout.compact_partitions(spark, p, out, sort_cols=("Timestamp",))
    assert {"dt", "hour"} <= set(layout.read_spans(spark, out).columns)
    assert layout.read_spans(spark, out).count() == layout.read_spans(spark, p).count()


def test_compaction_leaves_as_few_files_as_rows_allow(spark, spans_small):
    p, out = scratch_path(spark, "t-parts"), scratch_path(spark, "t-parts-compact")
    layout.write_spans_map(spans_small.filter("Timestamp >= '1998-07-15'").withColumn(
        "Timestamp", F.when(F.col("Timestamp") < "1998-07-25", F.lit("1998-07-20").cast("timestamp")).otherwise(F.col("Timestamp"))), p)
    rows = {r["dt"]: r["rows"] for r in layout.files_per_partition(spark, p).collect()}
    layout.compact_partitions(spark, p, out, target_rows=20, n_tasks=7)
    got = layout.files_per_partition(spark, out).collect()
    assert max(rows.values()) > 40 and {r["dt"]: r["rows"] for r in got} == rows
    assert all(r["parts"] == -(-r["rows"] // 20) for r in got)


def test_replayed_batch_is_written_once(spark, spans_small):
    """A sink that gets a batch again, as after a restart, holds its rows once."""
    out = scratch_path(spark, "t-replay")
    write = streams.idempotent_writer(out)
    first, second = spans_small.limit(100), spans_small.limit(40)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write(batch, number)
    assert streams.read_result(spark, out).count() == 140
    assert sorted((r["batch_id"], r["rows"]) for r in streams.batch_rows(spark, out).collect()) == [(0, 100), (1, 40)]


def test_stream_counts_equal_batch(spark, spans_small):
    src_path = scratch_path(spark, "t-stream-in")
    streams.write_arrival_files(spans_small, src_path, 4)
    src = streams.stream_spans(spark, src_path, spark.read.parquet(src_path).schema, files_per_trigger=1)
    out, q = streams.run_available_now(streams.service_counts(src), "t-counts", "update")
    got = {(r.ServiceName, r.SpanKind, r.StatusCode): r.n
           for r in streams.read_latest(spark, out, ["ServiceName", "SpanKind", "StatusCode"]).collect()}
    want = {(r.ServiceName, r.SpanKind, r.StatusCode): r["count"]
            for r in spans_small.groupBy("ServiceName", "SpanKind", "StatusCode").count().collect()}
    assert got == want
    assert len(q.recentProgress) >= 4


def test_stream_dedup(spark, spans_small):
    dup = spans_small.unionByName(spans_small.filter(F.col("TraceId").startswith("0")))
    src_path = scratch_path(spark, "t-stream-dup")
    streams.write_arrival_files(dup, src_path, 4)
    src = streams.stream_spans(spark, src_path, spark.read.parquet(src_path).schema, files_per_trigger=2)
    out, _ = streams.run_available_now(streams.dedup(src).select("TraceId", "SpanId"), "t-dedup")
    assert streams.read_result(spark, out).count() == 10948
