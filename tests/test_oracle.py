"""A sample of registered queries against their DuckDB oracles at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SAMPLE = ["spans_from_tables", "total_spans", "rows_per_shard", "spans_per_service", "kind_status_mix",
          "ingest_rate_minute", "count_by_attribute", "latency_by_operation", "service_edges", "self_time",
          "trace_depth", "critical_path", "schema_conformance_corrupted", "group_by_resource", "achieved_rate",
          "encode_json_layout", "filter_attr_equals", "slowest_spans"]


@pytest.fixture(scope="module")
def duck():
    from check_oracle import duck as make

    return make("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as entry
    from check_oracle import norm

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    rows = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    idx = [cols.index(c) for c in df.columns]
    drows = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert rows == drows


def test_every_query_has_name_and_oracle_columns():
    import __spark_entry__ as entry

    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 24 and rows[0].spans >= rows[-1].spans
