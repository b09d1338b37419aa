"""Rows travel packed and come back the same; sorts keep small as tables grow."""

from pyspark.sql import functions as F

from tracelake.operators import setops
from tracelake.plans import layout, packing
from tracelake.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_maps_come_back_as_they_were(spark):
    maps = [None, {}, {"a": "1"}, {"b": "", "a": "2"}, {"a": None}, {"a": None, "b": "x\x1fy"}, {"a\x1fb": "1", "c": "2"}, {"": ""}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    packed = packing.pack(df)
    back = [r["m"] for r in packing.unpack(packed, df).orderBy("i").collect()]
    assert back == maps
    keys = lambda rows: [r[0] for r in rows.select(F.map_keys("m")).orderBy("i").collect()]
    assert keys(packing.unpack(packed, df)) == keys(df)
    assert packed.filter("m.map IS NULL AND m.keys IS NOT NULL").count() == 3  # only plain ones became texts


def test_writers_have_more_ranges_for_more_rows(spark, spans_small, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 1000)
    path = scratch_path(spark, "t-ranges")
    layout.write_spans_map(spans_small, path, n_tasks=2, granularity=None)
    assert len(spark.read.parquet(path).inputFiles()) >= 8
    assert setops.parity(spans_small, spark.read.parquet(path)).first()[:3] == (0, 0, spans_small.count())


def test_compaction_has_more_slices_for_more_rows(spark, spans_small, monkeypatch):
    seen = []
    monkeypatch.setattr(layout, "ROWS_PER_TASK", 1000)
    scan = layout.group_scan
    monkeypatch.setattr(layout, "group_scan", lambda *a: seen.append(a[-1]) or scan(*a))
    src, out = scratch_path(spark, "t-src"), scratch_path(spark, "t-compacted")
    layout.write_spans_map(spans_small, src, granularity="month")
    layout.compact_partitions(spark, src, out, n_tasks=2)
    assert seen == [11]
    assert setops.parity(layout.read_spans(spark, src), layout.read_spans(spark, out)).first()[:2] == (0, 0)


def test_round_robin_shards_travel_once(spark, spans_small, monkeypatch):
    plans = []
    writer = layout._writer
    monkeypatch.setattr(layout, "_writer", lambda out, *a: plans.append(plan(out)) or writer(out, *a))
    layout.write_sharded_rr(spans_small, 3, 0, 100, scratch_path(spark, "t-rr"))
    assert plans[0].count("rangepartitioning") == 0 and "shard" in plans[0]
