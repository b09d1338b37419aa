"""Physical-plan properties: pushdown, pruning, partial aggregation, no cross joins."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import filters, profile, setops, traces, verify
from tracelake.plans import layout
from tracelake.session import scratch_path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, spans_small):
    p = scratch_path(spark, "t-plans")
    layout.write_spans_map(spans_small, p)
    return layout.read_spans(spark, p)


def test_point_lookup_pushed_and_pruned(table, spans_small):
    tid = filters.trace_id_for_order(7)
    q = filters.lean(filters.lookup_trace(table, tid))
    p = plan(q)
    assert "EqualTo(TraceId," in p
    assert "SpanAttributes" not in p.split("ReadSchema")[-1].split("\n")[0]
    assert q.count() == filters.lookup_trace(spans_small, tid).count() > 0


def test_time_range_prunes_partitions(table):
    q = filters.filter_time_range(table, "1998-01-01", "1998-02-01")
    p = plan(q)
    assert "PartitionFilters: [isnotnull(dt" in p and "dt#" in p
    assert "GreaterThanOrEqual(Timestamp," in p


def scan_of(df) -> str:
    return [x for x in plan(df).split("\n") if "PartitionFilters" in x][0]


def test_recent_and_expired_prune_partitions(spark, table):
    now = F.lit("1998-03-01 12:00:00").cast("timestamp")
    for df in (filters.filter_recent(table, 5, now), filters.filter_expired(table, 5, now),
               verify.ingest_rate_minute(table, 5, now), verify.ingest_rate_minute(table)):
        text = scan_of(df)
        assert "PartitionFilters: []" not in text and "dt#" in text.split("PartitionFilters")[1]
    assert "LessThanOrEqual(Timestamp," in scan_of(filters.filter_expired(table, 5, now))


def test_month_and_hour_tables_keep_all_rows(spark, spans_small):
    start, end = "1998-01-10 03:30:00", "1998-02-20 17:10:00"
    want = filters.filter_time_range(spans_small, start, end).count()
    for granularity, write in (("month", layout.write_spans_map), ("day", layout.write_spans_map),
                               ("hour", layout.write_spans_json)):
        p = scratch_path(spark, f"t-{granularity}")
        write(spans_small, p, granularity=granularity)
        df = filters.filter_time_range(layout.read_spans(spark, p), start, end)
        assert df.count() == want > 0
        assert "PartitionFilters: []" not in scan_of(df)


def test_a_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from tracelake.session import checkpoint_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None,
                         getConf=lambda: SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_partial_aggregation(table):
    p = plan(verify.spans_per_service(table))
    assert p.count("HashAggregate") >= 2 and "TakeOrderedAndProject" in p


def test_no_cartesian_products(table, spans_small):
    for df in (traces.service_edges(table), traces.containment_violations(table), profile.trace_summary(table),
               setops.parity(table.drop("dt"), table.drop("dt")), spans_small):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_parity_is_one_aggregation(table):
    p = plan(setops.parity(table.drop("dt"), table.drop("dt")))
    assert "Join" not in p


def test_dimension_is_broadcast(spans_small):
    assert "BroadcastExchange" in plan(spans_small)


def test_attribute_index_is_pruned(spark, spans_small):
    p = layout.write_attr_index(spans_small, scratch_path(spark, "t-attr"))
    df = layout.find_by_attr(spark, p, "http.request.method", "POST")
    text = scan_of(df)
    assert "key#" in text.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(value,POST)" in text
    assert df.count() == filters.filter_attr_equals(spans_small, "http.request.method", "POST").count() > 0
