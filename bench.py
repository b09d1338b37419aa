"""Benchmark: build the span table from a driver data directory, write it in
the map layout, then run the headline queries over the written table.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 1: runs per query, the median is reported).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from pyspark.sql import functions as F

    from tracelake.operators import profile, quality, traces, verify, windows
    from tracelake.plans import layout
    from tracelake.session import checkpoint_dir, local_session, scratch_path
    from tracelake.sources import fixtures

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="tracelake-bench")
    # the shared folder named by spark.checkpoint.dir (a local one only when unset)
    checkpoint_dir(spark)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    def timed(name, fn):
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)

    spans_src = fixtures.load_spans(spark, sf_dir)
    timed("spans_build", lambda: run(spans_src))
    table = scratch_path(spark, "bench-spans-map")
    # The fixture spreads ~2,400 days over six years with few spans per day, so
    # the bench table is partitioned by month (the day layout is exercised by
    # the registered write_spans_map query).
    timed("write_spans_map", lambda: layout.write_spans_map(spans_src, table, n_tasks=int(cpus) * 2,
                                                            granularity="month"))
    spans = spark.read.parquet(table)
    n_spans = spans.count()

    headline = {
        "total_spans": lambda: verify.total_spans(spans),
        "rows_per_shard": lambda: verify.rows_per_shard(spans),
        "spans_per_service": lambda: verify.spans_per_service(spans),
        "kind_status_mix": lambda: verify.kind_status_mix(spans),
        "ingest_rate_minute": lambda: verify.ingest_rate_minute(spans, minutes=None),
        "count_by_attribute": lambda: verify.count_by_attribute(spans),
        "latency_by_operation": lambda: profile.latency_by_operation(spans),
        "trace_summary": lambda: profile.trace_summary(spans),
        "attr_cardinality": lambda: profile.attr_cardinality(spans),
        "service_edges": lambda: traces.service_edges(spans),
        "containment_violations": lambda: traces.containment_violations(spans),
        "self_time": lambda: traces.self_time(spans),
        "slowest_spans": lambda: windows.slowest_spans(spans),
        "schema_conformance": lambda: quality.schema_conformance(spans),
        "duplicate_spans": lambda: quality.duplicate_spans(spans),
        "trace_depth": lambda: traces.trace_depth(spans),
        "critical_path": lambda: traces.critical_path(spans),
    }
    for name, make in headline.items():
        timed(name, lambda make=make: run(make()))

    query_total = round(sum(v for k, v in times.items() if k not in ("spans_build", "write_spans_map")), 3)
    out = {
        "metric": "headline_queries_total_sec",
        "value": query_total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "spans": n_spans,
        "spans_per_sec_build": round(n_spans / times["spans_build"], 1) if times["spans_build"] else None,
        "cpus": int(cpus),
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()
    _ = F  # keep import for interactive use


if __name__ == "__main__":
    main()
