"""Walks by tasks that hold whole traces, and by joined pointers, give the same rows."""

import random

from conftest import make_spans
from pyspark.sql import functions as F

from tracelake.operators import traces, walks
from tracelake.plans.packing import pack_id, unpack_id


def forest(seed: int) -> list[tuple]:
    """Traces with several roots, orphans, cycles, repeated rows, missing ids and parents, ids of all lengths, equal starts."""
    rnd, rows = random.Random(seed), []
    for t in range(30):
        trace = rnd.choice([f"{t:032x}", f"{t:032X}g", f"t{t}", "é" * 16 + str(t)])
        ids = [rnd.choice([f"{i:016x}", f"s{i}", f"{i:016X}"]) for i in range(rnd.randint(1, 25))]
        for i, span in enumerate(ids):
            parent = rnd.choice(["", None, "gone", rnd.choice(ids), *ids[:i][-3:], *ids[:i][-3:]])
            row = (None if rnd.random() < 0.02 else trace, None if rnd.random() < 0.03 else span, parent, f"op{i % 4}", "Internal", "cart",
                   None if rnd.random() < 0.05 else rnd.randint(0, 5), rnd.randint(1, 4))
            rows += [row] * rnd.choice([1, 1, 1, 2])
    return rows


def results(spans) -> list:
    return [sorted(map(str, df.collect())) for df in (
        traces.span_depths(spans), traces.trace_depth(spans), traces.unreached_spans(spans), traces.preorder_ranks(spans),
        traces.critical_path(spans))]


def test_whole_traces_and_pointers_agree(spark, monkeypatch):
    spans = make_spans(spark, forest(1)).cache()
    monkeypatch.setattr(walks, "MOST_NODES", 0)
    by_pointers = results(spans)
    assert all(by_pointers)
    for most in (10, 100_000):  # some traces by either way; all but those without an id in tasks
        monkeypatch.setattr(walks, "MOST_NODES", most)
        assert results(spans) == by_pointers


def test_batches_are_cut_between_traces(spark, monkeypatch):
    spans = make_spans(spark, [(f"t{t:03d}", f"s{i}", f"s{i - 1}" if i else "", "op", "Internal", "cart", i, 1)
                               for t in range(200) for i in range(9)])
    monkeypatch.setattr(walks, "BATCH_NODES", 1)  # a batch of rows is solved as it comes
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = traces.trace_depth(spans).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.TraceId, r.max_depth, r.spans_reached) for r in found} == {(f"t{t:03d}", 9, 9) for t in range(200)}


def test_usual_traces_take_one_shuffle(spark):
    spans = make_spans(spark, forest(2)).filter("TraceId IS NOT NULL")
    for df in (traces.preorder_ranks(spans), traces.critical_path(spans), traces.unreached_spans(spans)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_ids_come_back(spark):
    ids = [None, "", "a", "0" * 15, "0123456789abcdef", "0123456789ABCDEF", "x" * 8, "x" * 7, "é" * 4, "0" * 17, "01234567", "\x00" * 8]
    df = spark.createDataFrame([(i,) for i in ids], "SpanId string")
    packed = df.select("SpanId", pack_id("SpanId").alias("_s"))
    assert packed.select("_s").distinct().count() == len(ids)
    assert packed.filter(~F.col("SpanId").eqNullSafe(unpack_id("_s"))).count() == 0
    assert packed.filter("SpanId = '0123456789abcdef' AND octet_length(_s) = 8").count() == 1
