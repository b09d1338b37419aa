"""Counter rates with idle windows, batches by size or time, committed tables, recorded metrics."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracelake.operators import counters
from tracelake.session import scratch_path
from tracelake.streaming import batching, bounded, commitlog, metrics, streams

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return EPOCH + dt.timedelta(seconds=seconds)


def test_counter_rates_equal_a_plain_loop(spark):
    rng = random.Random(4)
    times = sorted({round(rng.choice([rng.uniform(0, 20), rng.uniform(300, 310), 77.0, 4.0]), 3) for _ in range(60)})
    samples, value = [], {"a": 0, "b": 0}
    for t in times:
        for name in ("a", "b"):
            value[name] += rng.randrange(3)
            samples.append((name, at(t), value[name]))
    df = spark.createDataFrame([*samples, ("a", None, 9), ("b", at(1), None)], "counter string, ts timestamp, value long").repartition(5)
    got = {r["window_start"]: r for r in counters.counter_rates(df, 2, ["a", "b"]).collect()}
    first, last = times[0], times[-1]
    n = -(-round((last - first) * 1000) // 2000)
    assert len(got) == n
    before = {"a": 0, "b": 0}
    for k in range(n):
        start, end = first + 2 * k, first + 2 * (k + 1)
        r = got[at(start).replace(tzinfo=None)]
        assert r["elapsed_us"] == round((min(end, last) - start) * 1e6)
        for name in ("a", "b"):
            known = [v for c, t, v in samples if c == name and t <= at(end + 1e-7)]
            assert (r[name], r[f"{name}_delta"]) == (known[-1], known[-1] - before[name])
            before[name] = known[-1]
    runs = counters.idle_runs(counters.counter_rates(df, 2, ["a", "b"]), ["a_delta", "b_delta"]).collect()
    assert sum(r["windows"] for r in runs) == n and max(r["windows"] for r in runs) > 100
    assert all((r["a_delta"] or r["b_delta"]) if r["windows"] == 1 and (r["a_delta"], r["b_delta"]) != (0, 0) else
               not r["a_delta"] and not r["b_delta"] for r in runs)
    assert counters.counter_rates(df.limit(0), 2, ["a"]).collect() == []
    one = counters.counter_rates(spark.createDataFrame(samples[:1], df.schema), 2, ["a"]).withColumn("r", counters.per_second("a_delta")).first()
    assert (one["elapsed_us"], one["a"], one["r"]) == (0, samples[0][2], None)


def test_resets_count_in_full(spark):
    values = [5, 9, 9, 2, 4, 0, 7]
    df = spark.createDataFrame([("a", at(i), v) for i, v in enumerate(values)], "counter string, ts timestamp, value long").repartition(3)
    got = [r["value"] for r in counters.without_resets(df).orderBy("ts").collect()]
    assert got == [5, 9, 9, 11, 13, 13, 20]


def test_sizes_of_batches():
    rng = random.Random(1)
    for _ in range(300):
        rows = rng.randrange(1, 20)
        cap, held, arrived = rows + rng.randrange(20), rng.randrange(rows), rng.randrange(100)
        cuts, left = batching.sizes(held, arrived, rows, cap)
        assert sum(cuts) == arrived and left < rows
        for i, take in enumerate(cuts):
            size = take + (held if i == 0 else 0)
            assert size <= cap and (size >= rows or i == len(cuts) - 1)


def test_batches_are_flushed_by_size_and_by_timer(spark, spans_small):
    path = scratch_path(spark, "t-batching")
    given = spans_small.select("TraceId", "SpanId", "StartUnixNano", "Timestamp").limit(900)
    streams.write_arrival_files(given, path, 2, files=1)
    src = streams.stream_spans(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = batching.run_until_flushed(batching.batched(src, rows=40, cap=60, seconds=2, slices=3), "t-batching")
    done = batching.flushed(spark, out).collect()
    assert sum(r["rows"] for r in done) == 900 and max(r["rows"] for r in done) <= 60
    assert all(r["rows"] >= 40 if r["reason"] == "size" else r["rows"] < 40 for r in done)
    assert {r["reason"] for r in done} == {"size", "timer"}
    table = spark.read.option("basePath", out).parquet(out)
    records = {(r["slice"], r["batch_no"]): r["rows"] for r in table.where("reason IS NOT NULL").collect()}
    assert records == {(r["slice"], r["batch_no"]): r["rows"] for r in done}
    assert table.where("reason IS NULL").select("TraceId", "SpanId").distinct().count() == 900
    with pytest.raises(ValueError):
        batching.batched(src, rows=10, cap=5)


def test_a_batch_given_up_in_the_middle_is_written_once(spark, spans_small):
    path = scratch_path(spark, "t-commit-in")
    streams.write_arrival_files(spans_small, path, 3, files=1)
    src = streams.stream_spans(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    table = commitlog.run_with_failure(src, "t-commit", fail_at=1)
    rows = commitlog.read_committed(spark, table)
    assert rows.count() == rows.select("TraceId", "SpanId").distinct().count() == spans_small.count()
    assert sorted(r["batch_id"] for r in commitlog.read_log(spark, table).collect()) == [0, 1, 2]
    everything = spark.read.parquet(f"{table}/data")
    assert everything.count() > rows.count()  # the attempt's files are there, and aren't read
    commitlog.committed_writer(table)(spans_small, 1)  # a replay of a committed batch writes nothing
    assert commitlog.read_committed(spark, table).count() == spans_small.count()
    assert len(commitlog.drop_aborted(spark, table)) == 1 and commitlog.drop_aborted(spark, table) == []
    assert spark.read.parquet(f"{table}/data").count() == spans_small.count()


def test_only_one_of_two_attempts_commits(spark):
    path = scratch_path(spark, "t-create")
    assert commitlog.create_file(spark, f"{path}/x.json", "one") and not commitlog.create_file(spark, f"{path}/x.json", "two")
    assert spark.read.text(f"{path}/x.json").first()["value"] == "one"
    with pytest.raises(Exception):
        commitlog.read_committed(spark, path)


def test_metrics_of_all_batches_are_kept(spark, spans_small):
    path = scratch_path(spark, "t-metrics-in")
    streams.write_arrival_files(spans_small, path, 4, files=1)
    src = streams.stream_spans(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    failed = F.when(F.col("StatusCode") == "Error", 1).otherwise(0)
    with metrics.recorded(spark, "spans") as table:
        streams.run_available_now(src.observe("spans", F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed")), "t-metrics")
    got = metrics.read_metrics(spark, table, {"n": "bigint", "failed": "bigint"})
    total = got.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.when(F.col("n") > 0, 1)).alias("batches")).first()
    assert (total["n"], total["f"], total["batches"]) == (spans_small.count(), spans_small.where("StatusCode = 'Error'").count(), 4)
    assert got.where("n > 0 AND n_per_sec <= 0").count() == 0
    # Far more batches than Spark keeps, one of them told twice.
    listener = metrics.MetricsTable(spark, scratch_path(spark, "t-metrics"), "m")
    observed = {"m": SimpleNamespace(asDict=lambda: {"n": 2})}
    for i in [*range(130), 7]:
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(
            runId="r", batchId=i, timestamp="2024-01-01T00:00:00.000Z", numInputRows=2, batchDuration=10, observedMetrics=observed)))
    listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(observedMetrics={})))
    rows = metrics.read_metrics(spark, listener.path, {"n": "bigint"})
    assert not listener.failed and rows.agg(F.count("*"), F.sum("n"), F.max("n_per_sec")).first()[:] == (130, 260, 200.0)


def test_a_bounded_run_stops_exactly_and_goes_on(spark, spans_small):
    path = scratch_path(spark, "t-bounded-in")
    given = spans_small.select("TraceId", "SpanId", "Timestamp").limit(500)
    streams.write_arrival_files(given, path, 3, files=1)
    src = streams.stream_spans(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    table = scratch_path(spark, "t-bounded")
    assert bounded.run(src, table, ["TraceId", "SpanId"], max_rows=210) == 210
    first = bounded.read_table(spark, table)
    assert first.count() == 210
    assert bounded.run(src, table, ["TraceId", "SpanId"], max_rows=7) == 7
    assert bounded.run(src, table, ["TraceId", "SpanId"], max_seconds=0) == 0
    assert bounded.run(src, table, ["TraceId", "SpanId"]) == 283
    assert bounded.run(src, table, ["TraceId", "SpanId"]) == 0
    rows = bounded.read_table(spark, table)
    assert rows.count() == rows.distinct().count() == 500 and rows.exceptAll(given).count() == 0
