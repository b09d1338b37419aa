"""Steps that touch keys alone, make copies at once, or need no text between."""

import threading

from pyspark.sql import functions as F

from tracelake.functions.scalars import canonical_json
from tracelake.operators import encode, setops
from tracelake.plans import layout, packing
from tracelake.session import scratch_path
from tracelake.streaming import streams


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_compaction_ranks_keys_alone(spark, spans_small, monkeypatch):
    seen = []
    scan = layout.group_scan
    monkeypatch.setattr(layout, "group_scan", lambda df, *a: seen.append((df.columns, df.count())) or scan(df, *a))
    p, out = scratch_path(spark, "t-keys"), scratch_path(spark, "t-keys-compact")
    same = spans_small.withColumns({"ServiceName": F.lit("one"), "SpanName": F.lit("op"), "Timestamp": F.lit("2020-01-01").cast("timestamp"),
                                    "StartUnixNano": F.col("StartUnixNano")})  # one day, and no row's key tells it
    layout.write_spans_map(same.unionByName(spans_small.limit(50)), p)
    layout.compact_partitions(spark, p, out, target_rows=3000, n_tasks=4)
    (columns, ranked), = seen
    assert "SpanAttributes" not in columns and ranked == same.count()
    assert setops.parity(layout.read_spans(spark, p), layout.read_spans(spark, out)).first()[:2] == (0, 0)
    assert all(r["parts"] == -(-r["rows"] // 3000) for r in layout.files_per_partition(spark, out).collect())


def test_copies_of_arrival_files_are_made_at_once(spark, monkeypatch):
    both, unpack = threading.Barrier(2), packing.unpack
    monkeypatch.setattr(packing, "unpack", lambda *a: both.wait(60) is not None and unpack(*a))
    given = spark.range(100).selectExpr("id AS n", "timestamp_seconds(id) AS Timestamp")
    path = streams.write_arrival_files(given, scratch_path(spark, "t-at-once"), 2, files=1)
    assert spark.read.parquet(path).count() == 100 and len(spark.read.parquet(path).inputFiles()) == 2


def test_variants_become_maps_without_text(spark):
    docs = ['{}', '{"b":"x","a":"y"}', '{"a":null}', '{"a":1,"b":1.50,"c":true,"e":{"z":[1,"q"],"y":null},"g":"\\u00e9\\n"}', '"a"', '[1]', 'null', None]
    v = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").withColumn("v", F.parse_json("d"))
    got = v.select("i", encode.variant_to_map(F.col("v")).alias("m"), F.from_json(F.to_json("v"), "map<string,string>").alias("old"))
    assert "to_json" not in plan(got.select("m")) and all(r.m == r.old for r in got.collect())


def test_maps_are_sorted_by_compiled_code(spark):
    maps = [None, {}, {"b": "1", "a": None}, {"é": "x", "Z": "", "a": '"'}]
    m = spark.createDataFrame([(x,) for x in maps], "m map<string,string>").select(canonical_json("m").alias("t"))
    assert [r.t for r in m.collect()] == ["{}", "{}", '{"a":null,"b":"1"}', '{"Z":"","a":"\\"","é":"x"}']
    assert "lambdafunction" not in plan(m)


def test_writers_delete_their_shuffles_and_keep_like_rows_together(spark, spans_small):
    with packing.dropped_shuffles(spark):
        p = plan(packing.deal_sorted(spans_small, 2, ["Timestamp"], ["Timestamp"]))
    assert "_like" in p and p.count("Sort [") >= 2
    assert spark.conf.get("spark.sql.optimizer.excludedRules", None) is None
