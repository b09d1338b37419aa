"""Registered queries (Spark) and their DuckDB oracles.

Every query takes ``(spark, sf_dir)``, reads the driver tables of that
directory (``orders``/``lineitem`` → spans, ``events`` → attempts) and returns
a DataFrame. ``ORACLES[name]`` is the equivalent DuckDB SQL over the
pre-registered views; queries without an exact SQL form have no entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import pools
from .operators import profile, verify
from .session import configure
from .sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return fixtures.load_spans(spark, sf_dir)


def attempts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return fixtures.attempts_from_events(fixtures.read_table(spark, sf_dir, "events"))


S = O.with_spans
SHARD = "'shard-' || ((('0x' || substr(TraceId, 1, 8))::BIGINT) % 3)::VARCHAR"
SHARD_NO = "((('0x' || substr(TraceId, 1, 8))::BIGINT) % 3)::INTEGER"


# --------------------------------------------------------------------------
# scans / sources
# --------------------------------------------------------------------------
@register("spans_from_tables", S(f"""
SELECT TraceId, SpanId, ParentSpanId, TraceState, SpanName, SpanKind, ServiceName, ScopeName, ScopeVersion,
       Duration, StatusCode, StatusMessage, StartUnixNano,
       {O.canon_json('SpanAttributes')} AS span_attrs, {O.canon_json('ResourceAttributes')} AS resource_attrs,
       n_events, coalesce(ev_name, '') AS event_name, ev_us AS event_us,
       {O.canon_json('ev_attrs')} AS event_attrs
FROM spans"""))
def q_spans_from_tables(spark, sf_dir):
    from .functions.scalars import canonical_json

    s = spans_of(spark, sf_dir)
    ev = F.try_element_at("Events", F.lit(1))
    return s.select(
        "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind", "ServiceName",
        "ScopeName", "ScopeVersion", "Duration", "StatusCode", "StatusMessage", "StartUnixNano",
        canonical_json("SpanAttributes").alias("span_attrs"),
        canonical_json("ResourceAttributes").alias("resource_attrs"),
        F.size("Events").alias("n_events"),
        F.coalesce(ev.getField("Name"), F.lit("")).alias("event_name"),
        F.unix_micros(ev.getField("Timestamp")).alias("event_us"),
        F.coalesce(canonical_json(ev.getField("Attributes")), F.lit("{}")).alias("event_attrs"),
    )


# --------------------------------------------------------------------------
# verification queries
# --------------------------------------------------------------------------
@register("total_spans", S("SELECT count(*) AS total_spans FROM spans"))
def q_total_spans(spark, sf_dir):
    return verify.total_spans(spans_of(spark, sf_dir))


@register("rows_per_shard", S(f"SELECT {SHARD} AS host, count(*) AS rows_on_node FROM spans GROUP BY 1 ORDER BY 1"))
def q_rows_per_shard(spark, sf_dir):
    return verify.rows_per_shard(spans_of(spark, sf_dir))


@register("spans_per_service", S("""
SELECT ServiceName, count(*) AS spans FROM spans GROUP BY ServiceName ORDER BY spans DESC, ServiceName LIMIT 50"""))
def q_spans_per_service(spark, sf_dir):
    return verify.spans_per_service(spans_of(spark, sf_dir))


@register("top_services", S("""
SELECT ServiceName, count(*) AS spans FROM spans GROUP BY ServiceName ORDER BY spans DESC, ServiceName LIMIT 10"""))
def q_top_services(spark, sf_dir):
    return verify.spans_per_service(spans_of(spark, sf_dir), k=10)


@register("kind_status_mix", S("""
SELECT SpanKind, StatusCode, count(*) AS n FROM spans GROUP BY SpanKind, StatusCode ORDER BY n DESC"""))
def q_kind_status_mix(spark, sf_dir):
    return verify.kind_status_mix(spans_of(spark, sf_dir))


@register("ingest_rate_minute", S("""
SELECT date_trunc('minute', Timestamp) AS minute, count(*) AS spans, round(count(*) / 60.0::DOUBLE, 6) AS spans_per_sec
FROM spans WHERE Timestamp > (SELECT max(Timestamp) FROM spans) - INTERVAL 5 MINUTE
GROUP BY 1 ORDER BY 1"""))
def q_ingest_rate_minute(spark, sf_dir):
    return verify.ingest_rate_minute(spans_of(spark, sf_dir))


@register("spans_per_minute", S("""
SELECT date_trunc('minute', Timestamp) AS minute, count(*) AS spans, round(count(*) / 60.0::DOUBLE, 6) AS spans_per_sec
FROM spans GROUP BY 1 ORDER BY 1"""))
def q_spans_per_minute(spark, sf_dir):
    return verify.ingest_rate_minute(spans_of(spark, sf_dir), minutes=None)


@register("count_by_attribute", S("""
SELECT coalesce(SpanAttributes['http.request.method'], '') AS method, count(*) AS n FROM spans GROUP BY 1"""))
def q_count_by_attribute(spark, sf_dir):
    return verify.count_by_attribute(spans_of(spark, sf_dir))


# --------------------------------------------------------------------------
# profile aggregations
# --------------------------------------------------------------------------
@register("shard_skew", S(f"""
SELECT count(*) AS shards, min(r) AS min_rows, max(r) AS max_rows, round(avg(r), 6) AS mean_rows,
       round(max(r) / min(r), 6) AS max_over_min,
       round(greatest(max(r) - avg(r), avg(r) - min(r)) / avg(r) * 100, 6) AS max_dev_pct,
       round(stddev_pop(r), 6) AS stddev_rows
FROM (SELECT {SHARD_NO} AS shard, count(*) AS r FROM spans GROUP BY 1)"""))
def q_shard_skew(spark, sf_dir):
    return profile.shard_skew(spans_of(spark, sf_dir))


@register("trace_colocation", S(f"""
SELECT count(*) AS traces, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS traces_on_one_shard,
       sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS traces_split
FROM (SELECT TraceId, count(DISTINCT {SHARD_NO}) AS n FROM spans GROUP BY TraceId)"""))
def q_trace_colocation(spark, sf_dir):
    return profile.trace_colocation(spans_of(spark, sf_dir))


@register("trace_colocation_by_span", S("""
SELECT count(*) AS traces, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS traces_on_one_shard,
       sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS traces_split
FROM (SELECT TraceId, count(DISTINCT ('0x' || substr(SpanId, 1, 8))::BIGINT % 3) AS n FROM spans GROUP BY TraceId)"""))
def q_trace_colocation_by_span(spark, sf_dir):
    """The same test on spans that were dealt to shards one by one, which splits traces."""
    shard = F.pmod(F.conv(F.substring("SpanId", 1, 8), 16, 10).cast("bigint"), F.lit(3))
    return profile.trace_colocation(spans_of(spark, sf_dir).withColumn("shard", shard))


@register("service_uniformity", S("""
SELECT count(*) AS services, sum(n)::BIGINT AS total,
       round(sum(n * n) / (sum(n) / count(*)) - sum(n), 4) AS chi_square,
       round(max(n) / sum(n), 6) AS max_share, round(min(n) / sum(n), 6) AS min_share,
       round(max(n) / (sum(n) / count(*)), 6) AS max_over_mean
FROM (SELECT ServiceName, count(*) AS n FROM spans GROUP BY 1)"""))
def q_service_uniformity(spark, sf_dir):
    return profile.service_uniformity(spans_of(spark, sf_dir))


@register("distinct_ids", S("""
SELECT count(*) AS spans, count(DISTINCT TraceId) AS traces, count(DISTINCT (TraceId, SpanId)) AS distinct_spans
FROM spans"""))
def q_distinct_ids(spark, sf_dir):
    return profile.distinct_ids(spans_of(spark, sf_dir))


@register("distinct_ids_approx", S("SELECT count(*) AS spans, true AS traces_close, true AS spans_close FROM spans"))
def q_distinct_ids_approx(spark, sf_dir):
    """The sketches' estimates against the exact counts: within five standard errors of 1 %."""
    s = spans_of(spark, sf_dir)
    exact = profile.distinct_ids(s).select(F.col("traces").alias("t"), F.col("distinct_spans").alias("d"), "spans")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * 0.05
    return profile.distinct_ids_approx(s).join(exact, "spans").select(
        "spans", close("traces_approx", "t").alias("traces_close"), close("spans_approx", "d").alias("spans_close"))


@register("explode_attributes", S("""
SELECT TraceId, SpanId, 'span' AS scope, e.key AS key, e.value AS value
FROM (SELECT TraceId, SpanId, unnest(map_entries(SpanAttributes)) AS e FROM spans)
UNION ALL
SELECT TraceId, SpanId, 'resource' AS scope, e.key AS key, e.value AS value
FROM (SELECT TraceId, SpanId, unnest(map_entries(ResourceAttributes)) AS e FROM spans)"""))
def q_explode_attributes(spark, sf_dir):
    return profile.explode_attributes(spans_of(spark, sf_dir))


@register("attr_cardinality", S("""
SELECT scope, key, count(DISTINCT value) AS n_values, count(*) AS n_spans FROM (
  SELECT 'span' AS scope, e.key AS key, e.value AS value FROM (SELECT unnest(map_entries(SpanAttributes)) AS e FROM spans)
  UNION ALL
  SELECT 'resource', e.key, e.value FROM (SELECT unnest(map_entries(ResourceAttributes)) AS e FROM spans))
GROUP BY scope, key"""))
def q_attr_cardinality(spark, sf_dir):
    return profile.attr_cardinality(spans_of(spark, sf_dir))


@register("error_event_rates", S(f"""
SELECT count(*) AS spans, round(avg(CASE WHEN StatusCode = 'Error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
       round(avg(CASE WHEN n_events > 0 THEN 1.0 ELSE 0.0 END), 6) AS event_rate,
       {pools.ERROR_RATE}::DOUBLE AS expected_error_rate,
       {round(profile.EXPECTED_EVENT_FRACTION, 6)}::DOUBLE AS expected_event_rate
FROM spans"""))
def q_error_event_rates(spark, sf_dir):
    return profile.error_event_rates(spans_of(spark, sf_dir))


@register("explode_events", S("""
SELECT TraceId, SpanId, ServiceName, make_timestamp(ev_us) AS Timestamp, ev_name AS Name,
       """ + O.canon_json("ev_attrs") + """ AS attrs
FROM spans WHERE n_events > 0"""))
def q_explode_events(spark, sf_dir):
    from .functions.scalars import canonical_json, ntz

    ev = profile.explode_events(spans_of(spark, sf_dir))
    return ev.select("TraceId", "SpanId", "ServiceName", ntz("Timestamp").alias("Timestamp"), "Name",
                     canonical_json("Attributes").alias("attrs"))


@register("exception_counts", S("""
SELECT ev_attrs['exception.type'] AS exception_type, ServiceName, count(*) AS n
FROM spans WHERE ev_name = 'exception' GROUP BY 1, 2"""))
def q_exception_counts(spark, sf_dir):
    return profile.exception_counts(spans_of(spark, sf_dir))


@register("latency_by_operation", S("""
SELECT ServiceName, SpanName, count(*) AS n, round(avg(Duration), 3) AS mean_ns, min(Duration) AS min_ns,
       max(Duration) AS max_ns,
       round(quantile_cont(Duration::DOUBLE, 0.5), 3) AS p50_ns, round(quantile_cont(Duration::DOUBLE, 0.9), 3) AS p90_ns,
       round(quantile_cont(Duration::DOUBLE, 0.95), 3) AS p95_ns, round(quantile_cont(Duration::DOUBLE, 0.99), 3) AS p99_ns
FROM spans GROUP BY ServiceName, SpanName"""))
def q_latency_by_operation(spark, sf_dir):
    return profile.latency_by_operation(spans_of(spark, sf_dir))


_FAMILY = """CASE WHEN SpanAttributes['db.system'] IS NOT NULL THEN 'db_client'
  WHEN SpanAttributes['rpc.system'] IS NOT NULL AND SpanKind = 'Server' THEN 'rpc_server'
  WHEN SpanAttributes['rpc.system'] IS NOT NULL THEN 'rpc_client'
  WHEN SpanAttributes['messaging.system'] IS NOT NULL THEN 'msg_consumer'
  WHEN SpanAttributes['http.request.method'] IS NOT NULL AND SpanKind = 'Server' THEN 'http_server'
  WHEN SpanAttributes['http.request.method'] IS NOT NULL THEN 'http_client'
  ELSE 'internal' END"""
_CAT_MU = "CASE " + " ".join(f"WHEN op_type = '{k}' THEN {v[0]}" for k, v in pools.LATENCY_PARAMS.items()) + " END"
_CAT_SIGMA = "CASE " + " ".join(f"WHEN op_type = '{k}' THEN {v[1]}" for k, v in pools.LATENCY_PARAMS.items()) + " END"


@register("lognormal_fit", S(f"""
SELECT op_type, count(*) AS n, round(avg(ln(Duration::DOUBLE)), 6) AS mu,
       round(stddev_pop(ln(Duration::DOUBLE)), 6) AS sigma,
       ({_CAT_MU})::DOUBLE AS catalog_mu, ({_CAT_SIGMA})::DOUBLE AS catalog_sigma
FROM (SELECT *, {_FAMILY} AS op_type FROM spans) GROUP BY op_type"""))
def q_lognormal_fit(spark, sf_dir):
    return profile.lognormal_fit(spans_of(spark, sf_dir))


@register("trace_summary", S("""
SELECT TraceId, count(*) AS spans, count(DISTINCT ServiceName) AS services,
       sum(CASE WHEN StatusCode = 'Error' THEN 1 ELSE 0 END)::BIGINT AS errors,
       min(StartUnixNano) AS start_ns, max(StartUnixNano + Duration) AS end_ns,
       max(StartUnixNano + Duration) - min(StartUnixNano) AS duration_ns,
       min(CASE WHEN ParentSpanId = '' THEN SpanName END) AS root_name
FROM spans GROUP BY TraceId"""))
def q_trace_summary(spark, sf_dir):
    return profile.trace_summary(spans_of(spark, sf_dir))


@register("trace_size_histogram", S("""
SELECT spans, count(*) AS traces FROM (SELECT TraceId, count(*) AS spans FROM spans GROUP BY TraceId)
GROUP BY spans ORDER BY spans"""))
def q_trace_size_histogram(spark, sf_dir):
    return profile.trace_size_histogram(spans_of(spark, sf_dir))


@register("http_status_classes", S("""
SELECT substr(SpanAttributes['http.response.status_code'], 1, 1) || 'xx' AS status_class, StatusCode, count(*) AS n
FROM spans WHERE SpanAttributes['http.response.status_code'] IS NOT NULL GROUP BY 1, 2"""))
def q_http_status_classes(spark, sf_dir):
    return profile.http_status_classes(spans_of(spark, sf_dir))


@register("rpc_status_counts", S("""
SELECT ServiceName, SpanAttributes['rpc.grpc.status_code']::INTEGER AS grpc_status, count(*) AS n
FROM spans WHERE SpanAttributes['rpc.grpc.status_code'] IS NOT NULL GROUP BY 1, 2"""))
def q_rpc_status_counts(spark, sf_dir):
    return profile.rpc_status_counts(spans_of(spark, sf_dir))


@register("db_usage", S("""
SELECT SpanAttributes['db.system'] AS db_system, SpanAttributes['db.operation.name'] AS db_operation,
       SpanAttributes['db.collection.name'] AS db_collection, count(*) AS calls, round(avg(Duration), 3) AS mean_ns,
       max(Duration) AS max_ns, sum(CASE WHEN StatusCode = 'Error' THEN 1 ELSE 0 END)::BIGINT AS errors
FROM spans WHERE SpanAttributes['db.system'] IS NOT NULL GROUP BY 1, 2, 3"""))
def q_db_usage(spark, sf_dir):
    return profile.db_usage(spans_of(spark, sf_dir))


@register("send_outcomes", O.with_ctes("""
SELECT sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS batches_ok, sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS batches_failed,
       sum(errors)::BIGINT AS send_errors, sum(CASE WHEN ok THEN spans ELSE 0 END)::BIGINT AS spans_sent,
       sum(CASE WHEN ok THEN 0 ELSE spans END)::BIGINT AS spans_dropped
FROM (SELECT batch_id, bool_or(ok) AS ok, max(spans) AS spans, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS errors
      FROM attempts GROUP BY batch_id)""", O.attempts_cte()))
def q_send_outcomes(spark, sf_dir):
    return profile.send_outcomes(attempts_of(spark, sf_dir))


_LE = " UNION ALL ".join(
    f"SELECT '{b}' AS le, sum(CASE WHEN seconds <= {b} THEN 1 ELSE 0 END)::BIGINT AS bucket_count FROM attempts"
    for b in pools.LATENCY_BUCKETS) + " UNION ALL SELECT '+Inf', count(*) FROM attempts"


@register("latency_histogram", O.with_ctes(f"""
SELECT le, bucket_count, (SELECT round(sum(seconds), 6) FROM attempts) AS total_seconds,
       (SELECT count(*) FROM attempts) AS total_count
FROM ({_LE})""", O.attempts_cte()))
def q_latency_histogram(spark, sf_dir):
    return profile.latency_histogram(attempts_of(spark, sf_dir))


# --------------------------------------------------------------------------
# joins and trace structure
# --------------------------------------------------------------------------
from .operators import counters, filters, traces, windows  # noqa: E402
from .sources import catalog  # noqa: E402

PC = "spans c JOIN spans p ON c.TraceId = p.TraceId AND c.ParentSpanId = p.SpanId"
CS = PC + " WHERE p.SpanKind = 'Client' AND c.SpanKind = 'Server'"


@register("join_parent_child", S(f"""
SELECT c.TraceId, c.SpanId, c.ParentSpanId, p.ServiceName AS parent_service, c.ServiceName AS child_service,
       p.SpanName AS parent_name, c.SpanName AS child_name, c.StartUnixNano - p.StartUnixNano AS start_offset_ns
FROM {PC} WHERE c.ParentSpanId <> ''"""))
def q_join_parent_child(spark, sf_dir):
    return traces.parent_child_pairs(spans_of(spark, sf_dir))


@register("service_edges", S(f"""
SELECT p.ServiceName AS caller, c.ServiceName AS callee, count(*) AS calls,
       sum(CASE WHEN p.StatusCode = 'Error' THEN 1 ELSE 0 END)::BIGINT AS client_errors,
       sum(CASE WHEN c.StatusCode = 'Error' THEN 1 ELSE 0 END)::BIGINT AS server_errors,
       round(avg(p.Duration), 3) AS mean_client_ns, round(avg(c.Duration), 3) AS mean_server_ns
FROM {CS} GROUP BY 1, 2"""))
def q_service_edges(spark, sf_dir):
    return traces.service_edges(spans_of(spark, sf_dir))


@register("network_gap", S(f"""
SELECT p.ServiceName AS caller, c.ServiceName AS callee, count(*) AS calls,
       round(avg(p.Duration - c.Duration), 3) AS mean_gap_ns, min(p.Duration - c.Duration) AS min_gap_ns,
       max(p.Duration - c.Duration) AS max_gap_ns
FROM {CS} GROUP BY 1, 2"""))
def q_network_gap(spark, sf_dir):
    return traces.network_gap(spans_of(spark, sf_dir))


@register("orphans", S("""
SELECT c.TraceId, c.SpanId, c.ParentSpanId FROM spans c
WHERE c.ParentSpanId <> '' AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.TraceId = c.TraceId AND p.SpanId = c.ParentSpanId)"""))
def q_orphans(spark, sf_dir):
    return traces.orphans(spans_of(spark, sf_dir))


@register("error_traces", S("""
SELECT TraceId, SpanId, ServiceName, StatusCode FROM spans
WHERE TraceId IN (SELECT TraceId FROM spans WHERE StatusCode = 'Error')"""))
def q_error_traces(spark, sf_dir):
    return traces.error_traces(spans_of(spark, sf_dir))


@register("containment_violations", S(f"""
SELECT c.TraceId, c.SpanId, c.ParentSpanId, c.StartUnixNano AS child_start_ns, c.StartUnixNano + c.Duration AS child_end_ns,
       p.StartUnixNano AS parent_start_ns, p.StartUnixNano + p.Duration AS parent_end_ns
FROM {PC} WHERE c.ParentSpanId <> ''
  AND (c.StartUnixNano < p.StartUnixNano OR c.StartUnixNano + c.Duration > p.StartUnixNano + p.Duration)"""))
def q_containment_violations(spark, sf_dir):
    return traces.containment_violations(spans_of(spark, sf_dir))


@register("dag_violations", S(f"""
SELECT e.caller, e.callee, a.service_idx AS caller_idx, b.service_idx AS callee_idx, e.calls
FROM (SELECT p.ServiceName AS caller, c.ServiceName AS callee, count(*) AS calls FROM {CS} GROUP BY 1, 2) e
LEFT JOIN services a ON a.name = e.caller LEFT JOIN services b ON b.name = e.callee
WHERE a.service_idx IS NULL OR b.service_idx IS NULL OR b.service_idx <= a.service_idx"""))
def q_dag_violations(spark, sf_dir):
    svc = catalog.services(spark, fixtures.N_FIXTURE_SERVICES)
    return traces.dag_violations(spans_of(spark, sf_dir), svc)


_TREE = [("tree", f"""
SELECT TraceId, SpanId, 1 AS depth, lpad(StartUnixNano::VARCHAR, 20, '0') || SpanId AS path
FROM spans WHERE ParentSpanId = ''
UNION ALL
SELECT s.TraceId, s.SpanId, t.depth + 1, t.path || '/' || lpad(s.StartUnixNano::VARCHAR, 20, '0') || s.SpanId
FROM spans s JOIN tree t ON s.TraceId = t.TraceId AND s.ParentSpanId = t.SpanId
WHERE s.ParentSpanId <> ''""")]


@register("trace_depth", S("""
SELECT TraceId, max(depth) AS max_depth, count(*) AS spans_reached FROM tree GROUP BY TraceId""",
                           extra=_TREE, recursive=True))
def q_trace_depth(spark, sf_dir):
    return traces.trace_depth(spans_of(spark, sf_dir))


@register("preorder_cap", S("""
SELECT TraceId, SpanId, preorder_rank::INTEGER AS preorder_rank FROM (
  SELECT TraceId, SpanId, row_number() OVER (PARTITION BY TraceId ORDER BY path) AS preorder_rank,
         5 + (('0x' || substr(TraceId, 9, 4))::INTEGER % 16) AS budget
  FROM tree) WHERE preorder_rank <= budget""", extra=_TREE, recursive=True))
def q_preorder_cap(spark, sf_dir):
    return traces.preorder_cap(spans_of(spark, sf_dir))


@register("self_time", S("""
SELECT s.TraceId, s.SpanId, (s.Duration - coalesce(cov.child_ns, 0))::BIGINT AS self_ns
FROM spans s LEFT JOIN cov ON s.TraceId = cov.TraceId AND s.SpanId = cov.SpanId""", extra=[
    ("iv", f"""SELECT c.TraceId, c.ParentSpanId AS SpanId, greatest(c.StartUnixNano, p.StartUnixNano) AS s,
        least(c.StartUnixNano + c.Duration, p.StartUnixNano + p.Duration) AS e FROM {PC} WHERE c.ParentSpanId <> ''"""),
    ("iv3", """SELECT *, max(e) OVER (PARTITION BY TraceId, SpanId ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM iv WHERE e > s"""),
    ("iv4", """SELECT *, sum(CASE WHEN prev_end IS NULL OR s > prev_end THEN 1 ELSE 0 END) OVER (
        PARTITION BY TraceId, SpanId ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM iv3"""),
    ("cov", """SELECT TraceId, SpanId, sum(len) AS child_ns FROM (
        SELECT TraceId, SpanId, island, max(e) - min(s) AS len FROM iv4 GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
]))
def q_self_time(spark, sf_dir):
    return traces.self_time(spans_of(spark, sf_dir))


@register("critical_path", S("""
SELECT TraceId, len AS cp_spans, SpanId AS cp_leaf_span_id, SpanName AS cp_leaf_name
FROM cp WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.TraceId = cp.TraceId AND lc.ParentSpanId = cp.SpanId)""", extra=[
    ("lc", """SELECT TraceId, ParentSpanId, SpanId, SpanName FROM (
        SELECT *, row_number() OVER (PARTITION BY TraceId, ParentSpanId
                                     ORDER BY StartUnixNano + Duration DESC, SpanId DESC) AS rn
        FROM spans WHERE ParentSpanId <> '') WHERE rn = 1"""),
    ("cp", f"""SELECT TraceId, SpanId, SpanName, 1 AS len FROM spans WHERE ParentSpanId = ''
        UNION ALL
        SELECT lc.TraceId, lc.SpanId, lc.SpanName, cp.len + 1 FROM cp JOIN lc ON lc.TraceId = cp.TraceId
        AND lc.ParentSpanId = cp.SpanId"""),
], recursive=True))
def q_critical_path(spark, sf_dir):
    return traces.critical_path(spans_of(spark, sf_dir))


# --------------------------------------------------------------------------
# windows
# --------------------------------------------------------------------------
@register("service_rank", S("""
SELECT ServiceName, spans, (rank() OVER (ORDER BY spans DESC))::INTEGER AS rank,
       (dense_rank() OVER (ORDER BY spans DESC))::INTEGER AS dense_rank,
       (row_number() OVER (ORDER BY spans DESC, ServiceName))::INTEGER AS position, round(spans / sum(spans) OVER (), 6) AS share
FROM (SELECT ServiceName, count(*) AS spans FROM spans GROUP BY 1)"""))
def q_service_rank(spark, sf_dir):
    return windows.service_rank(spans_of(spark, sf_dir))


@register("sibling_order", S("""
SELECT TraceId, SpanId, ParentSpanId,
       (row_number() OVER w)::INTEGER AS sibling_no, StartUnixNano - lag(StartUnixNano + Duration) OVER w AS gap_ns
FROM spans WHERE ParentSpanId <> ''
WINDOW w AS (PARTITION BY TraceId, ParentSpanId ORDER BY StartUnixNano, SpanId)"""))
def q_sibling_order(spark, sf_dir):
    return windows.sibling_order(spans_of(spark, sf_dir))


@register("slowest_spans", S("""
SELECT ServiceName, rank::INTEGER AS rank, TraceId, SpanId, SpanName, Duration FROM (
  SELECT *, row_number() OVER (PARTITION BY ServiceName ORDER BY Duration DESC, SpanId) AS rank FROM spans)
WHERE rank <= 5"""))
def q_slowest_spans(spark, sf_dir):
    return windows.slowest_spans(spans_of(spark, sf_dir))


@register("limit_spans", S("SELECT TraceId, SpanId, StartUnixNano FROM spans ORDER BY StartUnixNano, SpanId LIMIT 1000"))
def q_limit_spans(spark, sf_dir):
    return windows.limit_spans(spans_of(spark, sf_dir))


_BATCH = """SELECT TraceId, slice, spans, (sum(spans) OVER (PARTITION BY slice ORDER BY TraceId
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - spans) // 5000 AS batch_no
  FROM (SELECT TraceId, count(*) AS spans, ('0x' || substr(TraceId, 13, 4))::INTEGER % 8 AS slice
        FROM spans GROUP BY TraceId)"""


@register("limit_spans_half", S("""
SELECT TraceId, SpanId, StartUnixNano FROM spans ORDER BY StartUnixNano, SpanId LIMIT (SELECT count(*) // 2 FROM spans)"""))
def q_limit_spans_half(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    return windows.limit_spans(s, s.count() // 2)


@register("assign_batches", S(f"SELECT TraceId, slice, spans, batch_no::BIGINT AS batch_no FROM ({_BATCH})"))
def q_assign_batches(spark, sf_dir):
    return windows.assign_batches(spans_of(spark, sf_dir))


@register("batch_sizes", S(f"""
SELECT slice, batch_no::BIGINT AS batch_no, count(*) AS traces, sum(spans)::BIGINT AS spans FROM ({_BATCH}) GROUP BY 1, 2"""))
def q_batch_sizes(spark, sf_dir):
    return windows.batch_sizes(spans_of(spark, sf_dir))


def _bucket_sql(seconds: int) -> str:
    return f"make_timestamp((epoch_us(ts) // {seconds * 1000000}) * {seconds * 1000000})"


_ACH = f"""SELECT {_bucket_sql(2)} AS window_start, sum(spans)::BIGINT AS spans, round(sum(spans) / 2.0::DOUBLE, 6) AS rate
  FROM attempts WHERE ok GROUP BY 1"""


def _rates_sql(seconds: int, columns: str) -> str:
    """Windows from the first attempt to the last in which something moved, and the runs of idle ones between them."""
    w = seconds * 1_000_000
    return f"""SELECT make_timestamp(t0 + (k - 1) * {w}) AS window_start, windows, {columns}
FROM (SELECT *, least((k + windows - 1) * {w}, t1 - t0) - (k - 1) * {w} AS elapsed FROM (
  SELECT k, 1 AS windows, spans, sent, errors FROM active
  UNION ALL
  SELECT k + 1, after - k - 1, 0, sent, errors FROM (
    SELECT k, sent, errors, lead(k, 1, (SELECT greatest(1, (t1 - t0 + {w} - 1) // {w}) + 1 FROM ends)) OVER (ORDER BY k) AS after
    FROM (SELECT k, sent, errors FROM active UNION ALL SELECT 0, 0, 0)) WHERE after > k + 1), ends)"""


def _active(seconds: int, moved: str) -> tuple[str, str]:
    """Windows in which something moved, with the counters at their ends."""
    w = seconds * 1_000_000
    return ("active", f"""SELECT k, spans, sum(spans) OVER (ORDER BY k)::BIGINT AS sent, sum(failed) OVER (ORDER BY k)::BIGINT AS errors
FROM (SELECT greatest(1, (epoch_us(ts) - t0 + {w} - 1) // {w}) AS k, sum(CASE WHEN ok THEN spans ELSE 0 END)::BIGINT AS spans,
             sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS failed FROM attempts, ends GROUP BY 1) WHERE {moved}""")


_ENDS = [("ends", "SELECT epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM attempts")]
_PER_SECOND = "round(spans * 1000000::DOUBLE / nullif(elapsed, 0), 6) AS rate"


@register("achieved_rate", O.with_ctes(_rates_sql(2, f"spans, {_PER_SECOND}"), O.attempts_cte(),
                                       extra=[*_ENDS, _active(2, "spans > 0")]))
def q_achieved_rate(spark, sf_dir):
    return counters.achieved_rate(attempts_of(spark, sf_dir))


@register("status_rate", O.with_ctes(_rates_sql(5, f"sent, spans, errors, {_PER_SECOND}"), O.attempts_cte(),
                                     extra=[*_ENDS, _active(5, "spans > 0 OR failed > 0")]))
def q_status_rate(spark, sf_dir):
    return counters.status_rate(attempts_of(spark, sf_dir))


@register("target_vs_achieved", O.with_ctes("""
SELECT window_start,
       round(CASE WHEN el < 30000000 THEN 100000.0::DOUBLE * greatest(0.01::DOUBLE, el::DOUBLE / 30000000.0::DOUBLE)
                  ELSE 100000.0::DOUBLE END, 3) AS target_rate,
       rate AS achieved_rate
FROM (SELECT *, epoch_us(window_start) - (SELECT epoch_us(min(ts)) FROM attempts) AS el FROM ach)""",
                                              O.attempts_cte(), extra=[("ach", _ACH)]))
def q_target_vs_achieved(spark, sf_dir):
    return windows.target_vs_achieved(attempts_of(spark, sf_dir))


# --------------------------------------------------------------------------
# filters
# --------------------------------------------------------------------------
_LEAN = "SELECT TraceId, SpanId, SpanName, ServiceName, Duration, StartUnixNano FROM spans WHERE "
_TRACE7 = filters.trace_id_for_order(7)


def _lean_q(name: str, where: str, fn):
    @register(name, S(_LEAN + where))
    def q(spark, sf_dir):
        return filters.lean(fn(map_table(spark, sf_dir)))  # the written table: predicates reach its files

    return q


_lean_q("filter_time_range", "Timestamp >= TIMESTAMP '1998-01-01' AND Timestamp < TIMESTAMP '1998-02-01'",
        lambda s: filters.filter_time_range(s, "1998-01-01", "1998-02-01"))
_lean_q("lookup_trace", f"TraceId = '{_TRACE7}'", lambda s: filters.lookup_trace(s, _TRACE7))
_lean_q("filter_attr_key", "map_contains(SpanAttributes, 'db.system')",
        lambda s: filters.filter_attr_key(s, "db.system"))
_lean_q("filter_attr_value", "list_contains(map_values(SpanAttributes), 'redis')",
        lambda s: filters.filter_attr_value(s, "redis"))
_lean_q("filter_attr_equals", "SpanAttributes['http.request.method'] = 'POST'",
        lambda s: filters.filter_attr_equals(s, "http.request.method", "POST"))
_lean_q("filter_duration", "Duration BETWEEN 1000000 AND 50000000",
        lambda s: filters.filter_duration(s, 1_000_000, 50_000_000))
_lean_q("filter_status", "StatusCode = 'Error'", lambda s: filters.filter_status(s, "Error"))
_lean_q("filter_span_name", "SpanName = 'GET /api/cart'", lambda s: filters.filter_span_name(s, "GET /api/cart"))
_lean_q("filter_recent", "Timestamp > (SELECT max(Timestamp) FROM spans) - INTERVAL 5 MINUTE",
        lambda s: filters.filter_recent(s, 5))
_lean_q("filter_expired", "Timestamp + INTERVAL 5 HOUR <= (SELECT max(Timestamp) FROM spans)",
        lambda s: filters.filter_expired(s, 5))


@register("filter_attr_equals_json", S(_LEAN + "SpanAttributes['http.request.method'] = 'POST'"))
def q_filter_attr_equals_json(spark, sf_dir):
    return filters.lean(filters.filter_attr_equals(json_table(spark, sf_dir), "http.request.method", "POST"))


# --------------------------------------------------------------------------
# data quality (clean table and a deliberately corrupted copy)
# --------------------------------------------------------------------------
from .operators import encode, nested, quality, setops  # noqa: E402

_CORRUPT = [
    ("corrupted_base", """SELECT * REPLACE (
        CASE WHEN SpanId LIKE 'a1%' THEN upper(SpanId) WHEN SpanId LIKE 'b2%' THEN substr(SpanId, 1, 15)
             ELSE SpanId END AS SpanId,
        CASE WHEN ParentSpanId <> '' AND SpanId LIKE '0f%' THEN 'deadbeefdeadbeef' ELSE ParentSpanId END AS ParentSpanId,
        CASE WHEN ParentSpanId <> '' AND SpanId LIKE '1f%' THEN StartUnixNano - 1000000000 ELSE StartUnixNano END AS StartUnixNano,
        CASE WHEN ParentSpanId <> '' AND SpanId LIKE '1f%' THEN Timestamp - INTERVAL 1 SECOND ELSE Timestamp END AS Timestamp,
        CASE WHEN ParentSpanId <> '' AND SpanKind = 'Server' AND SpanId LIKE 'c%' THEN 'frontend' ELSE ServiceName END AS ServiceName,
        CASE WHEN SpanId LIKE 'dd%' THEN 'SERVER' ELSE SpanKind END AS SpanKind,
        CASE WHEN StatusCode = 'Error' AND SpanId LIKE '3%' THEN 0 ELSE n_events END AS n_events,
        CASE WHEN StatusCode = 'Error' AND SpanId LIKE '3%' THEN NULL ELSE ev_name END AS ev_name,
        CASE WHEN StatusCode = 'Error' AND SpanId LIKE '3%' THEN NULL ELSE ev_us END AS ev_us,
        CASE WHEN StatusCode = 'Error' AND SpanId LIKE '3%' THEN NULL ELSE ev_attrs END AS ev_attrs)
      FROM spans"""),
    ("corrupted", "SELECT * FROM corrupted_base UNION ALL SELECT * FROM corrupted_base WHERE TraceId LIKE '00%'"),
]


def _conformance_sql(table: str) -> str:
    def bad(cond):
        return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)::BIGINT"

    kinds = ", ".join(f"'{k}'" for k in quality.KINDS)
    statuses = ", ".join(f"'{k}'" for k in quality.STATUSES)
    return f"""SELECT count(*) AS spans,
      {bad("NOT regexp_matches(TraceId, '^[0-9a-f]{32}$')")} AS bad_trace_id,
      {bad("NOT regexp_matches(SpanId, '^[0-9a-f]{16}$')")} AS bad_span_id,
      {bad("ParentSpanId <> '' AND NOT regexp_matches(ParentSpanId, '^[0-9a-f]{16}$')")} AS bad_parent_id,
      {bad(f"SpanKind NOT IN ({kinds})")} AS bad_kind,
      {bad(f"StatusCode NOT IN ({statuses})")} AS bad_status,
      {bad("Duration < 0")} AS negative_duration,
      {bad("n_events > 0 AND (ev_us < StartUnixNano // 1000 OR ev_us > (StartUnixNano + Duration) // 1000)")} AS event_outside_span,
      {bad("StatusCode = 'Error' AND coalesce(ev_name, '') <> 'exception'")} AS error_without_one_exception,
      {bad("StatusCode <> 'Error' AND coalesce(ev_name, '') = 'exception'")} AS exception_without_error,
      {bad(f"(StatusCode = 'Error' AND StatusMessage <> '{pools.STATUS_MESSAGE_ERROR}') OR (StatusCode <> 'Error' AND StatusMessage <> '')")} AS status_message_mismatch
    FROM {table}"""


def corrupted_of(spark, sf_dir):
    return quality.corrupt(spans_of(spark, sf_dir))


@register("schema_conformance", S(_conformance_sql("spans")))
def q_schema_conformance(spark, sf_dir):
    return quality.schema_conformance(spans_of(spark, sf_dir))


@register("schema_conformance_corrupted", S(_conformance_sql("corrupted"), extra=_CORRUPT))
def q_schema_conformance_corrupted(spark, sf_dir):
    return quality.schema_conformance(corrupted_of(spark, sf_dir))


_DUP = "SELECT TraceId, SpanId, count(*) AS copies FROM {t} GROUP BY 1, 2 HAVING count(*) > 1"


@register("duplicate_spans", S(_DUP.format(t="spans")))
def q_duplicate_spans(spark, sf_dir):
    return quality.duplicate_spans(spans_of(spark, sf_dir))


@register("duplicate_spans_corrupted", S(_DUP.format(t="corrupted"), extra=_CORRUPT))
def q_duplicate_spans_corrupted(spark, sf_dir):
    return quality.duplicate_spans(corrupted_of(spark, sf_dir))


@register("orphans_corrupted", S("""
SELECT c.TraceId, c.SpanId, c.ParentSpanId FROM corrupted c
WHERE c.ParentSpanId <> '' AND NOT EXISTS (
  SELECT 1 FROM corrupted p WHERE p.TraceId = c.TraceId AND p.SpanId = c.ParentSpanId)""", extra=_CORRUPT))
def q_orphans_corrupted(spark, sf_dir):
    return traces.orphans(corrupted_of(spark, sf_dir))


_PCC = "corrupted c JOIN corrupted p ON c.TraceId = p.TraceId AND c.ParentSpanId = p.SpanId"


@register("unreached_spans_corrupted", S("""
SELECT DISTINCT TraceId, SpanId FROM corrupted c WHERE NOT EXISTS (
  SELECT 1 FROM ctree t WHERE t.TraceId = c.TraceId AND t.SpanId = c.SpanId)""", extra=[*_CORRUPT, ("ctree", """
SELECT TraceId, SpanId FROM corrupted WHERE ParentSpanId = ''
UNION
SELECT c.TraceId, c.SpanId FROM corrupted c JOIN ctree t ON c.TraceId = t.TraceId AND c.ParentSpanId = t.SpanId
WHERE c.ParentSpanId <> ''""")], recursive=True))
def q_unreached_spans_corrupted(spark, sf_dir):
    return traces.unreached_spans(corrupted_of(spark, sf_dir))


@register("containment_violations_corrupted", S(f"""
SELECT c.TraceId, c.SpanId, c.ParentSpanId, c.StartUnixNano AS child_start_ns, c.StartUnixNano + c.Duration AS child_end_ns,
       p.StartUnixNano AS parent_start_ns, p.StartUnixNano + p.Duration AS parent_end_ns
FROM {_PCC} WHERE c.ParentSpanId <> ''
  AND (c.StartUnixNano < p.StartUnixNano OR c.StartUnixNano + c.Duration > p.StartUnixNano + p.Duration)""", extra=_CORRUPT))
def q_containment_violations_corrupted(spark, sf_dir):
    return traces.containment_violations(corrupted_of(spark, sf_dir))


@register("dag_violations_corrupted", S(f"""
SELECT e.caller, e.callee, a.service_idx AS caller_idx, b.service_idx AS callee_idx, e.calls
FROM (SELECT p.ServiceName AS caller, c.ServiceName AS callee, count(*) AS calls FROM {_PCC}
      WHERE p.SpanKind = 'Client' AND c.SpanKind = 'Server' GROUP BY 1, 2) e
LEFT JOIN services a ON a.name = e.caller LEFT JOIN services b ON b.name = e.callee
WHERE a.service_idx IS NULL OR b.service_idx IS NULL OR b.service_idx <= a.service_idx""", extra=_CORRUPT))
def q_dag_violations_corrupted(spark, sf_dir):
    svc = catalog.services(spark, fixtures.N_FIXTURE_SERVICES)
    return traces.dag_violations(corrupted_of(spark, sf_dir), svc)


# --------------------------------------------------------------------------
# encoders and layouts
# --------------------------------------------------------------------------
def _events_text_sql() -> tuple[str, str, str]:
    return ("coalesce(ev_us::VARCHAR, '')", "coalesce(ev_name, '')",
            f"CASE WHEN n_events > 0 THEN {O.canon_json('ev_attrs')} ELSE '' END")


@register("encode_map_layout", S(f"""
SELECT TraceId, SpanId, {O.canon_json('ResourceAttributes')} AS resource_json, {O.canon_json('SpanAttributes')} AS span_json,
       Duration, {_events_text_sql()[0]} AS events_ts_us, {_events_text_sql()[1]} AS events_name,
       {_events_text_sql()[2]} AS events_attrs, 0 AS n_links
FROM spans"""))
def q_encode_map_layout(spark, sf_dir):
    from .functions.scalars import canonical_json

    m = encode.encode_map_layout(spans_of(spark, sf_dir))
    return m.select(
        "TraceId", "SpanId", canonical_json("ResourceAttributes").alias("resource_json"),
        canonical_json("SpanAttributes").alias("span_json"), "Duration",
        F.array_join(F.transform(encode.q("Events.Timestamp"), lambda t: F.unix_micros(t).cast("string")), ",").alias("events_ts_us"),
        F.array_join(encode.q("Events.Name"), ",").alias("events_name"),
        F.array_join(F.transform(encode.q("Events.Attributes"), canonical_json), ",").alias("events_attrs"),
        F.size(encode.q("Links.TraceId")).alias("n_links"))


@register("encode_json_layout", S(f"""
SELECT TraceId, SpanId, {O.canon_json('ResourceAttributes')} AS resource_json, {O.canon_json('SpanAttributes')} AS span_json,
       '{{}}' AS scope_json, Duration, {_events_text_sql()[1]} AS events_name,
       {_events_text_sql()[2]} AS events_attrs, 0 AS n_links
FROM spans"""))
def q_encode_json_layout(spark, sf_dir):
    j = encode.encode_json_layout(spans_of(spark, sf_dir))
    return j.select(
        "TraceId", "SpanId", F.to_json("ResourceAttributes").alias("resource_json"),
        F.to_json("SpanAttributes").alias("span_json"), F.to_json("ScopeAttributes").alias("scope_json"), "Duration",
        F.array_join(encode.q("Events.Name"), ",").alias("events_name"),
        F.array_join(F.transform(encode.q("Events.Attributes"), lambda v: F.to_json(v)), ",").alias("events_attrs"),
        F.size(encode.q("Links.Attributes")).alias("n_links"))


@register("attrs_to_json", S(f"""
SELECT TraceId, SpanId, {O.canon_json('SpanAttributes')} AS span_attrs_json,
       {O.canon_json('ResourceAttributes')} AS resource_attrs_json FROM spans"""))
def q_attrs_to_json(spark, sf_dir):
    return encode.attrs_to_json(spans_of(spark, sf_dir))


@register("attrs_to_strings", S(f"""
SELECT TraceId, SpanId, {O.canon_json('SpanAttributes')} AS span_attrs_json,
       '{{"duration_ns":"' || Duration || '","start_ns":"' || StartUnixNano || '"}}' AS ints_json,
       '{{"error":"' || (StatusCode = 'Error') || '","root":"' || (ParentSpanId = '') || '"}}' AS bools_json FROM spans"""))
def q_attrs_to_strings(spark, sf_dir):
    """VARIANT attributes of the JSON layout, and maps of integers and booleans, to MAP<STRING,STRING>."""
    from .functions.scalars import attrs_to_strings, canonical_json

    s = spans_of(spark, sf_dir)
    j = encode.encode_json_layout(s)
    ints = F.create_map(F.lit("duration_ns"), F.col("Duration"), F.lit("start_ns"), F.col("StartUnixNano"))
    bools = F.create_map(F.lit("error"), F.col("StatusCode") == "Error", F.lit("root"), F.col("ParentSpanId") == "")
    return j.select("TraceId", "SpanId", canonical_json(encode.variant_to_map(F.col("SpanAttributes"))).alias("span_attrs_json"),
                    canonical_json(attrs_to_strings(ints)).alias("ints_json"), canonical_json(attrs_to_strings(bools)).alias("bools_json"))


@register("attrs_by_op_type", S(f"""
SELECT TraceId, SpanId, {_FAMILY} AS op_type, {O.canon_json('SpanAttributes')} AS span_attrs_json FROM spans"""))
def q_attrs_by_op_type(spark, sf_dir):
    from .functions.scalars import canonical_json

    s = profile.op_family(spans_of(spark, sf_dir))
    return s.select("TraceId", "SpanId", "op_type", canonical_json("SpanAttributes").alias("span_attrs_json"))


@register("events_to_arrays", S("""
SELECT TraceId, SpanId, n_events AS n_timestamps, n_events AS n_names, n_events AS n_attributes,
       coalesce(ev_name, '') AS names FROM spans"""))
def q_events_to_arrays(spark, sf_dir):
    m = encode.encode_map_layout(spans_of(spark, sf_dir))
    return m.select("TraceId", "SpanId", F.size(encode.q("Events.Timestamp")).alias("n_timestamps"),
                    F.size(encode.q("Events.Name")).alias("n_names"), F.size(encode.q("Events.Attributes")).alias("n_attributes"),
                    F.array_join(encode.q("Events.Name"), ",").alias("names"))


@register("links_to_arrays", S("""
SELECT TraceId, SpanId, CASE WHEN ParentSpanId = '' THEN '' ELSE TraceId END AS trace_ids, ParentSpanId AS span_ids,
       CASE WHEN ParentSpanId = '' THEN '' ELSE '{"link.kind":"parent","link.status":"' || StatusCode || '"}' END AS attributes,
       CASE WHEN ParentSpanId = '' THEN 0 ELSE 1 END AS n_states FROM spans"""))
def q_links_to_arrays(spark, sf_dir):
    """Every child linked to its parent, as the parallel arrays of the JSON layout and back."""
    from .functions.scalars import canonical_json

    s = spans_of(spark, sf_dir)
    link = F.struct("TraceId", F.col("ParentSpanId").alias("SpanId"), "TraceState", F.create_map(
        F.lit("link.kind"), F.lit("parent"), F.lit("link.status"), F.col("StatusCode")).alias("Attributes"))
    linked = s.withColumn("Links", F.when(F.col("ParentSpanId") != "", F.array(link)).otherwise(F.array()))
    j = encode.encode_json_layout(linked)
    back = F.transform(encode.q("Links.Attributes"), lambda v: canonical_json(encode.variant_to_map(v)))
    return j.select("TraceId", "SpanId", F.array_join(encode.q("Links.TraceId"), ",").alias("trace_ids"),
                    F.array_join(encode.q("Links.SpanId"), ",").alias("span_ids"), F.array_join(back, ",").alias("attributes"),
                    F.size(encode.q("Links.TraceState")).alias("n_states"))


@register("span_events_build", S("""
SELECT TraceId, SpanId, StatusCode, n_events, coalesce(ev_name, '') AS event_name, ev_us AS event_us FROM spans"""))
def q_span_events_build(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    ev = F.try_element_at("Events", F.lit(1))
    return s.select("TraceId", "SpanId", "StatusCode", F.size("Events").alias("n_events"),
                    F.coalesce(ev.getField("Name"), F.lit("")).alias("event_name"),
                    F.unix_micros(ev.getField("Timestamp")).alias("event_us"))


@register("server_counterpart", S(f"""
SELECT count(*) AS pairs,
  sum(CASE WHEN c.SpanName = (CASE WHEN p.SpanAttributes['rpc.service'] IS NOT NULL
        THEN p.SpanAttributes['rpc.service'] || '/' || p.SpanAttributes['rpc.method']
        ELSE concat_ws(' ', p.SpanAttributes['http.request.method'], p.SpanAttributes['url.path']) END) THEN 1 ELSE 0 END)::BIGINT AS name_match,
  sum(CASE WHEN c.StartUnixNano = p.StartUnixNano + p.Duration // 10 THEN 1 ELSE 0 END)::BIGINT AS start_match,
  sum(CASE WHEN c.Duration = p.Duration * 85 // 100 THEN 1 ELSE 0 END)::BIGINT AS duration_match
FROM {CS}"""))
def q_server_counterpart(spark, sf_dir):
    return encode.server_counterpart(spans_of(spark, sf_dir))


@register("server_counterpart_rows", S(f"""
SELECT p.TraceId, p.SpanId AS ParentSpanId, 'Server' AS SpanKind,
       CASE WHEN p.SpanAttributes['rpc.service'] IS NOT NULL
            THEN p.SpanAttributes['rpc.service'] || '/' || p.SpanAttributes['rpc.method']
            ELSE concat_ws(' ', p.SpanAttributes['http.request.method'], p.SpanAttributes['url.path']) END AS SpanName,
       c.ServiceName, p.StartUnixNano + p.Duration // 10 AS StartUnixNano, p.Duration * 85 // 100 AS Duration,
       c.SpanId AS found_span
FROM {CS}"""))
def q_server_counterpart_rows(spark, sf_dir):
    """The SERVER row that each call with a callee gives, beside the span that is there."""
    return encode.counterpart_rows(spans_of(spark, sf_dir))


@register("layout_parity", S("SELECT 0::BIGINT AS left_only, 0::BIGINT AS right_only, count(*) AS rows, count(*) AS right_rows FROM spans"))
def q_layout_parity(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    back = encode.json_to_map_layout(encode.map_to_json_layout(s))
    return setops.parity(s, back)


# --------------------------------------------------------------------------
# nested export payloads and the second ingest path
# --------------------------------------------------------------------------
_BATCH2K = """SELECT TraceId, slice, ((sum(spans) OVER (PARTITION BY slice ORDER BY TraceId
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - spans) // 2000)::BIGINT AS batch_no
  FROM (SELECT TraceId, count(*) AS spans, ('0x' || substr(TraceId, 13, 4))::INTEGER % 8 AS slice
        FROM spans GROUP BY TraceId)"""
_PAYLOAD = [
    ("b2k", _BATCH2K),
    ("sb", f"""SELECT s.*, b2k.slice, b2k.batch_no, {O.canon_json('ResourceAttributes')} AS res
              FROM spans s JOIN b2k ON s.TraceId = b2k.TraceId"""),
    ("sz", """SELECT slice, batch_no, ServiceName, res, ScopeName, ScopeVersion,
              greatest(1, ceil(count(*) * 2 / 2000.0))::BIGINT AS n_chunks FROM sb GROUP BY ALL"""),
    ("payload", """SELECT sb.*, ('0x' || substr(SpanId, 1, 8))::BIGINT % sz.n_chunks AS chunk
                   FROM sb JOIN sz USING (slice, batch_no, ServiceName, res, ScopeName, ScopeVersion)"""),
]


@register("group_by_resource", S("""
SELECT slice, batch_no, ServiceName, chunk, count(*) AS n_spans FROM payload GROUP BY ALL""", extra=_PAYLOAD))
def q_group_by_resource(spark, sf_dir):
    return nested.payload_sizes(nested.group_by_resource(spans_of(spark, sf_dir)))


@register("flatten_otlp", S("SELECT TraceId, SpanId, ServiceName, slice, batch_no FROM payload", extra=_PAYLOAD))
def q_flatten_otlp(spark, sf_dir):
    flat = nested.flatten_otlp(nested.group_by_resource(spans_of(spark, sf_dir)))
    return flat.select("TraceId", "SpanId", "ServiceName", "slice", "batch_no")


def _varied(spans):
    """Spans of a service under several resources and scopes, by the SpanId's first digit."""
    digit = F.substring("SpanId", 1, 1)
    return spans.withColumns({
        "ResourceAttributes": F.map_concat("ResourceAttributes", F.create_map(F.lit("process.digit"), digit)),
        "ScopeVersion": F.when(digit < "8", F.lit("2.0.0")).otherwise(F.col("ScopeVersion"))})


_EQUAL = "SELECT 0::BIGINT AS left_only, 0::BIGINT AS right_only, count(*) AS rows, count(*) AS right_rows FROM spans"


@register("path_parity", S(_EQUAL))
def q_path_parity(spark, sf_dir):
    s = _varied(spans_of(spark, sf_dir))
    flat = nested.flatten_otlp(nested.group_by_resource(s)).drop("slice", "batch_no")
    return setops.parity(s, flat)


_SHOWN = "TraceId, SpanId, ParentSpanId, SpanKind, ServiceName, StartUnixNano, Duration, StatusCode, n_events"


@register("path_parity_corrupted", S(f"""
SELECT (SELECT count(*) FROM (SELECT {_SHOWN} FROM spans EXCEPT ALL SELECT {_SHOWN} FROM corrupted)) AS left_only,
       (SELECT count(*) FROM (SELECT {_SHOWN} FROM corrupted EXCEPT ALL SELECT {_SHOWN} FROM spans)) AS right_only,
       (SELECT count(*) FROM spans) AS rows, (SELECT count(*) FROM corrupted) AS right_rows""", extra=_CORRUPT))
def q_path_parity_corrupted(spark, sf_dir):
    """Every damaged row shows up on both sides, every repeated one on the right."""
    return setops.parity(spans_of(spark, sf_dir), corrupted_of(spark, sf_dir))


@register("layout_parity_corrupted", S("""
SELECT count(*) FILTER (SpanId LIKE '7%')::BIGINT AS left_only, count(*) FILTER (SpanId LIKE '7%')::BIGINT AS right_only,
       count(*) AS rows, count(*) AS right_rows FROM spans"""))
def q_layout_parity_corrupted(spark, sf_dir):
    """One nanosecond, or one link, is a difference: the round trip of a copy where spans with
    SpanId '7...' were changed in one of the two."""
    s = spans_of(spark, sf_dir)
    seven, even = F.col("SpanId").startswith("7"), F.col("SpanId").startswith("70")
    link = F.array(F.struct(F.lit("t").alias("TraceId"), F.lit("s").alias("SpanId"), F.lit("").alias("TraceState"),
                            F.create_map().cast("map<string,string>").alias("Attributes")))
    changed = s.withColumns({
        "StartUnixNano": F.when(seven & ~even, F.col("StartUnixNano") + 1).otherwise(F.col("StartUnixNano")),
        "Links": F.when(even, link).otherwise(F.col("Links"))})
    return setops.parity(s, encode.json_to_map_layout(encode.map_to_json_layout(changed)))


@register("common_traces", S("SELECT count(DISTINCT TraceId) AS common_traces FROM spans"))
def q_common_traces(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    flat = nested.flatten_otlp(nested.group_by_resource(s))
    return setops.common_traces(s, flat)


# --------------------------------------------------------------------------
# physical layout: written tables read back (in the shared checkpoint folder)
# --------------------------------------------------------------------------
import datetime as _dt  # noqa: E402

from .plans import layout  # noqa: E402
from .session import scratch_path  # noqa: E402

_WRITTEN: dict[tuple, str] = {}


def _written(spark, sf_dir, kind: str, writer) -> str:
    key = (kind, sf_dir, spark.sparkContext.applicationId)
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, kind)
        writer(spans_of(spark, sf_dir), path)
        _WRITTEN[key] = path
    return path


def _tasks(spark) -> int:
    """Few spans in thousands of directories: the number of files, not of bytes, is what
    tasks share here, so adaptive merging of small ranges is left out."""
    return 2 * spark.sparkContext.defaultParallelism


def map_table(spark, sf_dir):
    return layout.read_spans(spark, _written(
        spark, sf_dir, "spans-map", lambda s, p: layout.write_spans_map(s, p, _tasks(spark))))


def json_table(spark, sf_dir):
    return layout.read_spans(spark, _written(
        spark, sf_dir, "spans-json", lambda s, p: layout.write_spans_json(s, p, _tasks(spark))))


def sharded_table(spark, sf_dir):
    path = _written(spark, sf_dir, "spans-sharded",
                    lambda s, p: layout.write_sharded_hash(s, 3, p, method="md5prefix"))
    return path, layout.read_all_shards(spark, path)


@register("write_spans_map", S("""
SELECT Timestamp::DATE AS dt, count(*) AS spans, sum(Duration)::BIGINT AS duration_ns FROM spans GROUP BY 1"""))
def q_write_spans_map(spark, sf_dir):
    t = map_table(spark, sf_dir)
    return t.groupBy("dt").agg(F.count(F.lit(1)).alias("spans"), F.sum("Duration").cast("bigint").alias("duration_ns"))


@register("read_spans_map", S(f"""
SELECT TraceId, SpanId, ServiceName, SpanKind, Duration, StartUnixNano, {O.canon_json('SpanAttributes')} AS span_json,
       n_events FROM spans"""))
def q_read_spans_map(spark, sf_dir):
    from .functions.scalars import canonical_json

    t = map_table(spark, sf_dir)
    return t.select("TraceId", "SpanId", "ServiceName", "SpanKind", "Duration", "StartUnixNano",
                    canonical_json("SpanAttributes").alias("span_json"), F.size("Events").alias("n_events"))


@register("write_spans_json", S("""
SELECT Timestamp::DATE AS dt, hour(Timestamp)::INTEGER AS hour, count(*) AS spans FROM spans GROUP BY 1, 2"""))
def q_write_spans_json(spark, sf_dir):
    t = json_table(spark, sf_dir)
    return t.groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("spans"))


@register("read_spans_json", S("""
SELECT coalesce(SpanAttributes['http.request.method'], '') AS method, count(*) AS n FROM spans GROUP BY 1"""))
def q_read_spans_json(spark, sf_dir):
    """The attribute-path count of the JSON layout (VARIANT subcolumn)."""
    return verify.count_by_attribute_json(json_table(spark, sf_dir))


@register("json_path", S("""
SELECT TraceId, SpanId, SpanAttributes['db.system'] AS db_system FROM spans WHERE SpanAttributes['db.system'] IS NOT NULL"""))
def q_json_path(spark, sf_dir):
    t = json_table(spark, sf_dir)
    v = F.variant_get("SpanAttributes", "$['db.system']", "string")
    return t.select("TraceId", "SpanId", v.alias("db_system")).filter(F.col("db_system").isNotNull())


@register("layout_parity_written", S(
    "SELECT 0::BIGINT AS left_only, 0::BIGINT AS right_only, count(*) AS rows, count(*) AS right_rows FROM spans"))
def q_layout_parity_written(spark, sf_dir):
    m = map_table(spark, sf_dir).drop("dt")
    j = encode.json_to_map_layout(json_table(spark, sf_dir))
    return setops.parity(m, j)


@register("rows_per_shard_written", S(f"SELECT {SHARD} AS host, count(*) AS rows_on_node FROM spans GROUP BY 1 ORDER BY 1"))
def q_rows_per_shard_written(spark, sf_dir):
    _, t = sharded_table(spark, sf_dir)
    return verify.rows_per_shard(t)


@register("union_shards", S("SELECT count(*) AS spans, count(DISTINCT TraceId) AS traces FROM spans"))
def q_union_shards(spark, sf_dir):
    path, _ = sharded_table(spark, sf_dir)
    u = setops.union_shards([layout.read_shard(spark, path, i) for i in range(3)])
    return u.agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("TraceId").alias("traces"))


@register("trace_colocation_written", S(f"""
SELECT count(*) AS traces, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS traces_on_one_shard,
       sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS traces_split
FROM (SELECT TraceId, count(DISTINCT {SHARD_NO}) AS n FROM spans GROUP BY TraceId)"""))
def q_trace_colocation_written(spark, sf_dir):
    _, t = sharded_table(spark, sf_dir)
    return profile.trace_colocation(t)


@register("write_sharded_rr", S("""
SELECT 'shard-' || ((1 + slice + batch_no) % 3)::VARCHAR AS host, sum(spans)::BIGINT AS rows_on_node FROM (
  SELECT slice, (sum(spans) OVER (PARTITION BY slice ORDER BY TraceId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 - spans) // 5000 AS batch_no, spans
  FROM (SELECT TraceId, count(*) AS spans, ('0x' || substr(TraceId, 13, 4))::INTEGER % 8 AS slice FROM spans GROUP BY 1))
GROUP BY 1 ORDER BY 1"""))
def q_write_sharded_rr(spark, sf_dir):
    path = _written(spark, sf_dir, "spans-rr", lambda s, p: layout.write_sharded_rr(s, 3, 0, 5000, p))
    return verify.rows_per_shard(layout.read_all_shards(spark, path))


@register("lookup_trace_bloom", S(_LEAN + f"TraceId = '{_TRACE7}'"))
def q_lookup_trace_bloom(spark, sf_dir):
    """Point lookup on the written table (Bloom filter + min/max pushdown)."""
    return filters.lean(filters.lookup_trace(map_table(spark, sf_dir), _TRACE7))


@register("filter_time_range_pruned", S(_LEAN + "Timestamp >= TIMESTAMP '1998-01-01' AND Timestamp < TIMESTAMP '1998-02-01'"))
def q_filter_time_range_pruned(spark, sf_dir):
    """Time range on the written table: partition pruning on dt plus the row predicate."""
    return filters.lean(filters.filter_time_range(map_table(spark, sf_dir), "1998-01-01", "1998-02-01"))


RETENTION_TTL = _dt.timedelta(days=3 * 365)


@register("retention_drop", S(f"""
SELECT count(*) AS spans_kept, count(DISTINCT Timestamp::DATE) AS partitions_kept FROM spans
WHERE Timestamp::DATE + INTERVAL 1 DAY + INTERVAL {RETENTION_TTL.days} DAY > (SELECT max(Timestamp) FROM spans)"""))
def q_retention_drop(spark, sf_dir):
    path = scratch_path(spark, "retention")
    layout.write_spans_map(spans_of(spark, sf_dir), path, _tasks(spark))
    t = layout.read_spans(spark, path)
    now = t.agg(F.max("Timestamp").cast("timestamp_ntz")).first()[0]
    layout.retention_drop(spark, path, RETENTION_TTL, now)
    kept = layout.read_spans(spark, path)
    return kept.agg(F.count(F.lit(1)).alias("spans_kept"), F.countDistinct("dt").alias("partitions_kept"))


@register("filter_time_range_pruned_month", S(_LEAN + "Timestamp >= TIMESTAMP '1998-01-10' AND Timestamp < TIMESTAMP '1998-02-20'"))
def q_filter_time_range_pruned_month(spark, sf_dir):
    """A range that begins within a month, on a table partitioned by month."""
    t = layout.read_spans(spark, month_table(spark, sf_dir))
    return filters.lean(filters.filter_time_range(t, "1998-01-10", "1998-02-20"))


def month_table(spark, sf_dir) -> str:
    return _written(spark, sf_dir, "spans-month", lambda s, p: layout.write_spans_map(s, p, granularity="month"))


@register("retention_drop_month", S(f"""
SELECT count(*) AS spans_kept, count(DISTINCT date_trunc('month', Timestamp)) AS partitions_kept,
       0::BIGINT AS live_rows_deleted FROM spans
WHERE date_trunc('month', Timestamp) + INTERVAL 1 MONTH + INTERVAL {RETENTION_TTL.days} DAY > (SELECT max(Timestamp) FROM spans)"""))
def q_retention_drop_month(spark, sf_dir):
    """Only months that have passed the TTL to their last day go; no row within it does."""
    path = layout.write_spans_map(spans_of(spark, sf_dir), scratch_path(spark, "retention-month"), granularity="month")
    t = layout.read_spans(spark, path)
    now = t.agg(F.max("Timestamp").cast("timestamp_ntz")).first()[0]
    alive = lambda df: df.filter(F.col("Timestamp") > F.lit(now - RETENTION_TTL)).count()
    before = alive(t)
    layout.retention_drop(spark, path, RETENTION_TTL, now)
    kept = layout.read_spans(spark, path)
    return kept.agg(F.count(F.lit(1)).alias("spans_kept"), F.countDistinct("month").alias("partitions_kept"),
                    F.lit(before - alive(kept)).cast("bigint").alias("live_rows_deleted"))


@register("retention_drop_hourly", S("""
SELECT count(*) AS spans_kept, count(DISTINCT date_trunc('hour', Timestamp)) AS partitions_kept FROM spans
WHERE date_trunc('hour', Timestamp) + INTERVAL 1 HOUR + INTERVAL 5 HOUR > (SELECT max(Timestamp) FROM spans)"""))
def q_retention_drop_hourly(spark, sf_dir):
    """The five-hour TTL of the hourly JSON table."""
    path = scratch_path(spark, "retention-hourly")
    layout.write_spans_json(spans_of(spark, sf_dir), path, _tasks(spark))
    now = layout.read_spans(spark, path).agg(F.max("Timestamp").cast("timestamp_ntz")).first()[0]
    layout.retention_drop(spark, path, _dt.timedelta(hours=5), now, hourly=True)
    return layout.read_spans(spark, path).agg(
        F.count(F.lit(1)).alias("spans_kept"), F.countDistinct("dt", "hour").alias("partitions_kept"))


@register("write_both_layouts", S(_EQUAL))
def q_write_both_layouts(spark, sf_dir):
    """One job writes both targets; what is read back is equal."""
    m, j = scratch_path(spark, "both-map"), scratch_path(spark, "both-json")
    layout.write_both_layouts(spans_of(spark, sf_dir), m, j, _tasks(spark), json_granularity="day")
    return setops.parity(layout.read_spans(spark, m), encode.json_to_map_layout(layout.read_spans(spark, j)))


@register("files_per_partition", S(f"""
SELECT {SHARD} AS host, date_trunc('month', Timestamp)::DATE AS month, count(*) AS rows, true AS has_parts
FROM spans GROUP BY ALL"""))
def q_files_per_partition(spark, sf_dir):
    """Parts of each (host, partition); their rows add up to the partition's."""
    path = _written(spark, sf_dir, "spans-sharded-month", lambda s, p: layout.write_sharded_hash(
        s, 3, p, method="md5prefix", granularity="month"))
    parts = layout.files_per_partition(spark, path, ("month",))
    return parts.select(F.concat(F.lit("shard-"), F.col("shard").cast("string")).alias("host"), "month", "rows",
                        ((F.col("parts") > 0) & (F.col("bytes") > 0)).alias("has_parts"))


@register("files_per_partition_sizes")
def q_files_per_partition_sizes(spark, sf_dir):
    """Parts, rows and bytes of each (host, partition); how many files there are is the writer's choice, so no SQL."""
    path = _written(spark, sf_dir, "spans-sharded-month", lambda s, p: layout.write_sharded_hash(
        s, 3, p, method="md5prefix", granularity="month"))
    parts = layout.files_per_partition(spark, path, ("month",))
    return parts.select(F.concat(F.lit("shard-"), F.col("shard").cast("string")).alias("host"), "month", "parts", "rows", "bytes", "size")


@register("compact_partitions", S("""
SELECT Timestamp::DATE AS dt, count(*) AS rows, ((count(*) + 999999) // 1000000)::BIGINT AS parts FROM spans GROUP BY 1"""))
def q_compact_partitions(spark, sf_dir):
    """Files of each day after compaction: one for each million rows that it has, or part of it."""
    map_table(spark, sf_dir)
    src = _WRITTEN[("spans-map", sf_dir, spark.sparkContext.applicationId)]
    out = layout.compact_partitions(spark, src, scratch_path(spark, "compacted"), n_tasks=_tasks(spark))
    return layout.files_per_partition(spark, out).select("dt", "rows", "parts")


@register("find_by_attr", S("""
SELECT TraceId, SpanId, SpanAttributes['http.request.method'] AS value FROM spans
WHERE SpanAttributes['http.request.method'] = 'POST'"""))
def q_find_by_attr(spark, sf_dir):
    """Attribute search on the side table: one directory, then a pushed value predicate."""
    path = _written(spark, sf_dir, "attr-index", layout.write_attr_index)
    return layout.find_by_attr(spark, path, "http.request.method", "POST")


@register("filter_files", S(_LEAN + "Timestamp::DATE BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'"))
def q_filter_files(spark, sf_dir):
    """Rows of the files of one month, chosen by file metadata alone."""
    t = map_table(spark, sf_dir)
    return filters.lean(filters.filter_files(t, path_like="%/dt=1998-03-%", min_bytes=1))


# --------------------------------------------------------------------------
# streaming (availableNow runs over time-ordered span files)
# --------------------------------------------------------------------------
from .streaming import batching, bounded, commitlog, metrics, streams  # noqa: E402

CLOSING_TRACE = "f" * 32


#: What the streams that count, assemble or pass on ids read of a span; the arrival files of these hold no other column.
STREAM_COLUMNS = ["Timestamp", "TraceId", "SpanId", "SpanKind", "ServiceName", "StatusCode", "StartUnixNano", "Duration"]


def stream_input(spark, sf_dir, kind: str = "spans", dup_prefix: str | None = None, columns: list[str] = STREAM_COLUMNS):
    key = ("stream-in", kind, sf_dir, spark.sparkContext.applicationId)
    if key not in _WRITTEN:
        s = spans_of(spark, sf_dir).select(*columns)
        if dup_prefix is not None:
            twice = F.when(F.col("TraceId").startswith(dup_prefix), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            s = s.select("*", F.explode(twice).alias("_copy")).drop("_copy")  # the spans are built once
        closing = lambda row: row.withColumns(
            {"TraceId": F.lit(CLOSING_TRACE), "Timestamp": F.lit("2100-01-01 00:00:00").cast("timestamp")})
        path = scratch_path(spark, f"stream-in-{kind}")
        streams.write_arrival_files(s, path, 8, closing=closing)
        _WRITTEN[key] = path
    path = _WRITTEN[key]
    schema = spark.read.parquet(path).schema
    return streams.stream_spans(spark, path, schema, files_per_trigger=2)


def _not_closing(df):
    return df.filter(F.col("TraceId") != CLOSING_TRACE) if "TraceId" in df.columns else df


@register("stream_service_counts", S("""
SELECT ServiceName, SpanKind, StatusCode, count(*) AS n FROM spans GROUP BY 1, 2, 3"""))
def q_stream_service_counts(spark, sf_dir):
    src = _not_closing(stream_input(spark, sf_dir))
    path, _ = streams.run_available_now(streams.service_counts(src), "service-counts", "update")
    return streams.read_latest(spark, path, ["ServiceName", "SpanKind", "StatusCode"])


@register("stream_ingest_rate", S("""
SELECT date_trunc('minute', Timestamp) AS minute, count(*) AS spans, round(count(*) / 60.0::DOUBLE, 6) AS spans_per_sec
FROM spans GROUP BY 1"""))
def q_stream_ingest_rate(spark, sf_dir):
    path, _ = streams.run_available_now(streams.ingest_rate(stream_input(spark, sf_dir)), "ingest-rate")
    return streams.read_result(spark, path)


@register("stream_recent_rate", S("""
SELECT minute, count(*) AS spans, round(count(*) / 300.0::DOUBLE, 6) AS spans_per_sec FROM (
  SELECT date_trunc('minute', Timestamp) - to_minutes(o) AS minute
  FROM spans, (SELECT unnest(range(0, 5)) AS o)) GROUP BY 1"""))
def q_stream_recent_rate(spark, sf_dir):
    q = streams.ingest_rate(stream_input(spark, sf_dir), every="1 minute", window="5 minutes")
    path, _ = streams.run_available_now(q, "recent-rate")
    return streams.read_result(spark, path)


@register("stream_dedup", S("SELECT TraceId, SpanId, ServiceName FROM spans"))
def q_stream_dedup(spark, sf_dir):
    read = ["Timestamp", "TraceId", "SpanId", "ServiceName"]
    src = _not_closing(stream_input(spark, sf_dir, kind="dups", dup_prefix="0", columns=read))
    path, _ = streams.run_available_now(streams.dedup(src).select("TraceId", "SpanId", "ServiceName"), "dedup")
    return streams.read_result(spark, path)


@register("stream_trace_assembly", S("""
SELECT TraceId, count(*) AS spans, sum(CASE WHEN StatusCode = 'Error' THEN 1 ELSE 0 END)::BIGINT AS errors,
       min(StartUnixNano) AS start_ns, max(StartUnixNano + Duration) AS end_ns
FROM spans GROUP BY TraceId"""))
def q_stream_trace_assembly(spark, sf_dir):
    src = stream_input(spark, sf_dir)
    path, _ = streams.run_available_now(streams.trace_assembly(src), "trace-assembly")
    return _not_closing(streams.read_result(spark, path))


@register("stream_to_table", S(_LEAN + "TRUE"))
def q_stream_to_table(spark, sf_dir):
    """A stream's spans in a committed table: one attempt of a batch is given up in the middle, and the query goes
    on from its checkpoint."""
    src = _not_closing(stream_input(spark, sf_dir, kind="whole", columns=fixtures.SPAN_COLUMNS))
    path = commitlog.run_with_failure(src, "to-table", fail_at=1)
    return filters.lean(commitlog.read_committed(spark, path).select(*src.columns))


@register("bounded_run", S("SELECT 1000 AS first_rows, count(*) - 1000 AS later_rows, count(*) AS spans FROM spans"))
def q_bounded_run(spark, sf_dir):
    """A stream that stops after exactly 1,000 spans, in the middle of a batch, and a second run that takes the rest."""
    src = _not_closing(stream_input(spark, sf_dir)).select("TraceId", "SpanId")
    path = scratch_path(spark, "stream-bounded")
    order = ["TraceId", "SpanId"]
    first, later = (bounded.run(src, path, order, max_rows=n) for n in (1000, None))
    return bounded.read_table(spark, path).distinct().agg(
        F.lit(first).alias("first_rows"), F.lit(later).cast("bigint").alias("later_rows"), F.count(F.lit(1)).alias("spans"))


@register("stream_metrics", O.with_ctes("""
SELECT count(*) AS attempts, sum(CASE WHEN ok THEN spans ELSE 0 END)::BIGINT AS sent,
       sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS errors, true AS several_batches, true AS rates_known FROM attempts""",
                                        O.attempts_cte()))
def q_stream_metrics(spark, sf_dir):
    """Totals of a run from the table that its listener appended every batch's metrics to."""
    observed = attempts_stream(spark, sf_dir).observe(
        "sends", F.count(F.lit(1)).alias("attempts"), F.sum(counters.sent()).cast("bigint").alias("sent"),
        F.sum(counters.errors()).cast("bigint").alias("errors"))
    with metrics.recorded(spark, "sends") as table:
        streams.run_available_now(observed, "metrics")
    rows = metrics.read_metrics(spark, table, {"attempts": "bigint", "sent": "bigint", "errors": "bigint"})
    busy = F.col("attempts") > 0
    return rows.agg(F.sum("attempts").alias("attempts"), F.sum("sent").alias("sent"), F.sum("errors").alias("errors"),
                    (F.count(F.when(busy, 1)) > 1).alias("several_batches"),
                    F.bool_and(~busy | (F.col("sent_per_sec") > 0) | (F.col("sent") == 0)).alias("rates_known"))


# --------------------------------------------------------------------------
# trace expansion: seeds (from orders) grown through the service topology
# --------------------------------------------------------------------------
from .sources import expand  # noqa: E402

N_EXPAND_SERVICES = 30


def _ops_sql(n: int) -> list[tuple[str, str]]:
    D = O._draw
    methods = [m for m, _ in pools.HTTP_ROUTES]
    routes = [r for _, r in pools.HTTP_ROUTES]
    lp = pools.LATENCY_PARAMS
    mu = "CASE " + " ".join(f"WHEN op_type = '{k}' THEN {v[0]}::DOUBLE" for k, v in lp.items()) + " END"
    sigma = "CASE " + " ".join(f"WHEN op_type = '{k}' THEN {v[1]}::DOUBLE" for k, v in lp.items()) + " END"
    dbp = [(i, x) for i, x in enumerate(pools.DB_SYSTEMS)]
    return [
        ("ops_h", "SELECT service_idx, name, md5('ops:' || service_idx::VARCHAR) AS h FROM services"),
        ("ops_entry_idx", f"SELECT service_idx, name, unnest(range(0, 2 + {D('h', 1)} % 3)) AS op_idx FROM ops_h"),
        ("ops_entry", f"""SELECT service_idx, op_idx::INTEGER AS op_idx, 'entry' AS role, 'http_server' AS op_type,
            'Server' AS kind, {O._pick(methods, D('r', 1))} AS method, {O._pick(routes, D('r', 1))} AS route,
            NULL::VARCHAR AS db_system, NULL::VARCHAR AS db_op, NULL::VARCHAR AS collection, -1 AS peer
          FROM (SELECT *, md5('entry:' || service_idx::VARCHAR || ':' || op_idx::VARCHAR) AS r FROM ops_entry_idx)"""),
        ("ops_consumer", f"""SELECT service_idx, (2 + {D('h', 1)} % 3)::INTEGER AS op_idx, 'entry' AS role,
            'msg_consumer' AS op_type, 'Consumer' AS kind, NULL::VARCHAR AS method, NULL::VARCHAR AS route,
            NULL::VARCHAR AS db_system, NULL::VARCHAR AS db_op, NULL::VARCHAR AS collection, -1 AS peer
          FROM ops_h WHERE {D('h', 5)} % 10 < 4"""),
        ("ops_counts0", f"""SELECT service_idx, name,
            CASE WHEN service_idx + 1 < {n} THEN {D('h', 9)} % 3 ELSE 0 END AS n_peers,
            1 + {D('h', 13)} % 2 AS n_db FROM ops_h"""),
        ("ops_slots", """SELECT service_idx, unnest(range(0, n_peers)) AS op_idx, 'call' AS slot FROM ops_counts0
          UNION ALL SELECT service_idx, unnest(range(n_peers, n_peers + n_db)), 'db' FROM ops_counts0
          UNION ALL SELECT service_idx, n_peers + n_db, 'internal' FROM ops_counts0"""),
        ("ops_child0", f"""SELECT service_idx, op_idx::INTEGER AS op_idx, slot,
            CASE WHEN slot = 'call' THEN service_idx + 1 + {D('r', 1)} % greatest({n} - service_idx - 1, 1) ELSE -1 END AS peer,
            {D('r', 5)} % 2 = 0 AS is_http, {O._pick(methods, D('r', 13))} AS m, {O._pick(routes, D('r', 13))} AS rt,
            {D('r', 9)} AS dbi
          FROM (SELECT *, md5('child:' || service_idx::VARCHAR || ':' || op_idx::VARCHAR) AS r FROM ops_slots)"""),
        ("ops_child", f"""SELECT service_idx, op_idx, 'child' AS role, op_type,
            CASE WHEN op_type = 'internal' THEN 'Internal' ELSE 'Client' END AS kind,
            CASE WHEN op_type = 'http_client' THEN m END AS method, CASE WHEN op_type = 'http_client' THEN rt END AS route,
            CASE WHEN op_type = 'db_client' THEN {O._pick([x[0] for _, x in dbp], 'dbi')} END AS db_system,
            CASE WHEN op_type = 'db_client' THEN {O._pick([x[1] for _, x in dbp], 'dbi')} END AS db_op,
            CASE WHEN op_type = 'db_client' THEN {O._pick([x[2] for _, x in dbp], 'dbi')} END AS collection, peer
          FROM (SELECT *, CASE WHEN slot = 'db' THEN 'db_client' WHEN slot = 'internal' THEN 'internal'
                               WHEN is_http THEN 'http_client' ELSE 'rpc_client' END AS op_type FROM ops_child0)"""),
        ("ops", f"""SELECT *, {mu} AS mu_log, {sigma} AS sigma_log FROM (
            SELECT * FROM ops_entry UNION ALL SELECT * FROM ops_consumer UNION ALL SELECT * FROM ops_child)"""),
        ("ops_counts", """SELECT service_idx AS svc, sum(CASE WHEN role = 'entry' THEN 1 ELSE 0 END)::INTEGER AS n_entry,
            sum(CASE WHEN role = 'child' THEN 1 ELSE 0 END)::INTEGER AS n_child FROM ops GROUP BY 1"""),
    ]


def _expand_sql(n: int, select: str | None = None) -> str:
    D, H, B = O._draw, O._hex60, O._bits
    ln = ("greatest(1000, floor(exp(mu_log + sigma_log * (sqrt(-2.0::DOUBLE * ln((" + B("x2", 0, 0x3FFFFFFF)
          + " + 1) / 1073741824.0::DOUBLE)) * cos(6.283185307179586::DOUBLE * (" + B("x2", 30, 0x3FFFFFFF)
          + " / 1073741824.0::DOUBLE)))))::BIGINT)")
    e = "md5({k} || '#e')"
    seeds = f"""SELECT o_orderkey AS trace_no,
        (((o_orderdate::DATE - DATE '1970-01-01')::BIGINT * 86400 + o_orderkey % 86400) * 1000000000
          - ({D("md5('seed:' || o_orderkey::VARCHAR)", 1)} % 2000)::BIGINT * 1000000) AS start_ns,
        (5 + {D("md5('seed:' || o_orderkey::VARCHAR)", 5)} % 16)::INTEGER AS budget FROM orders"""
    roots0 = f"""SELECT trace_no, start_ns, budget, 'x:' || trace_no::VARCHAR AS key,
        {H(e.format(k="('x:' || trace_no::VARCHAR)"), 1)} AS x1, {H(e.format(k="('x:' || trace_no::VARCHAR)"), 16)} AS x2
      FROM ex_seeds"""
    roots = f"""SELECT r.trace_no, r.budget, '' AS path, r.key, NULL::VARCHAR AS parent_key, r.svc, o.op_type, o.kind,
        o.method, o.route, o.db_system, o.db_op, o.collection, o.peer, r.start_ns,
        {ln.replace('mu_log', 'o.mu_log').replace('sigma_log', 'o.sigma_log').replace('x2', 'r.x2')} AS dur_ns,
        1 AS depth, TRUE AS expand, r.x1
      FROM (SELECT *, ({B('x1', 0)} % {n})::INTEGER AS svc FROM ex_roots0) r
      JOIN ops_counts c ON c.svc = r.svc
      JOIN ops o ON o.service_idx = r.svc AND o.role = 'entry' AND o.op_idx = ({B('r.x1', 16)} % c.n_entry)::INTEGER"""
    kids = f"""SELECT p.trace_no, p.budget, p.path AS ppath, p.key AS pkey, p.svc, c.n_child, p.start_ns AS p_start,
        p.dur_ns AS p_dur, p.depth, unnest(range(0, ({B('p.x1', 48, 0xFFF)} % 3 + 1)::INTEGER)) AS i
      FROM nodes p JOIN ops_counts c ON c.svc = p.svc WHERE p.expand AND p.depth <= {expand.MAX_DEPTH}"""
    kids2 = f"""SELECT k.*, {H(e.format(k='k.key'), 1)} AS x1, {H(e.format(k='k.key'), 16)} AS x2 FROM (
        SELECT *, pkey || i::VARCHAR AS key FROM ({kids})) k"""
    kids3 = f"""SELECT k.*, o.op_type, o.kind, o.method, o.route, o.db_system, o.db_op, o.collection, o.peer,
        o.mu_log, o.sigma_log,
        floor(k.p_dur::DOUBLE * 0.7::DOUBLE * ({B('k.x1', 16, 0xFFFFFFFF)}::DOUBLE / 4294967296.0::DOUBLE))::BIGINT AS "offset"
      FROM ({kids2}) k JOIN ops o ON o.service_idx = k.svc AND o.role = 'child' AND o.op_idx = ({B('k.x1', 0)} % k.n_child)::INTEGER"""
    calls = f"""SELECT trace_no, budget, ppath || i::VARCHAR AS path, key, pkey AS parent_key, svc, op_type, kind, method,
        route, db_system, db_op, collection, peer, p_start + "offset" AS start_ns,
        CASE WHEN {ln} > p_dur - "offset" AND p_dur - "offset" > 0 THEN p_dur - "offset" ELSE {ln} END AS dur_ns, depth
      FROM ({kids3})"""
    both = f"""SELECT *, unnest(CASE WHEN peer >= 0 THEN ['c', 's'] ELSE ['c'] END) AS role FROM ({calls})"""
    nxt = f"""SELECT trace_no, budget,
        CASE WHEN role = 's' THEN path || 's' ELSE path END AS path,
        CASE WHEN role = 's' THEN key || 's' ELSE key END AS key,
        CASE WHEN role = 's' THEN key ELSE parent_key END AS parent_key,
        CASE WHEN role = 's' THEN peer ELSE svc END AS svc,
        CASE WHEN role = 's' THEN (CASE WHEN op_type = 'rpc_client' THEN 'rpc_server' ELSE 'http_server' END) ELSE op_type END AS op_type,
        CASE WHEN role = 's' THEN 'Server' ELSE kind END AS kind,
        method, route, db_system, db_op, collection,
        CASE WHEN role = 's' THEN -1 ELSE peer END AS peer,
        CASE WHEN role = 's' THEN start_ns + floor(dur_ns::DOUBLE * 0.1::DOUBLE)::BIGINT ELSE start_ns END AS start_ns,
        CASE WHEN role = 's' THEN floor(dur_ns::DOUBLE * 0.85::DOUBLE)::BIGINT ELSE dur_ns END AS dur_ns,
        CASE WHEN role = 's' OR (op_type = 'internal' AND depth < {expand.INTERNAL_DEPTH}) THEN depth + 1 ELSE depth END AS depth,
        (role = 's' OR (peer < 0 AND op_type = 'internal' AND depth < {expand.INTERNAL_DEPTH})) AS expand
      FROM ({both})"""
    rec = f"""SELECT * FROM ex_roots
      UNION ALL
      SELECT n.*, {H(e.format(k='n.key'), 1)} AS x1 FROM ({nxt}) n"""
    kept = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_no ORDER BY path) AS preorder_rank FROM nodes)
      WHERE preorder_rank <= budget"""
    hb = O._hex60("md5(k.key)", 17)
    final = f"""SELECT md5('t:' || k.trace_no::VARCHAR) AS TraceId, substr(md5(k.key), 1, 16) AS SpanId,
        CASE WHEN k.parent_key IS NULL THEN '' ELSE substr(md5(k.parent_key), 1, 16) END AS ParentSpanId,
        CASE WHEN k.op_type IN ('http_server', 'http_client') THEN k.method || ' ' || k.route
             WHEN k.op_type = 'db_client' THEN k.db_op || ' ' || k.collection
             WHEN k.op_type = 'rpc_client' THEN 'grpc.' || p.name || '/Get'
             WHEN k.op_type = 'rpc_server' THEN s.name || '.v1.Service/Get'
             WHEN k.op_type = 'msg_consumer' THEN s.name || '.events process'
             ELSE 'compute.' || s.name END AS SpanName,
        k.kind AS SpanKind, s.name AS ServiceName, k.start_ns AS StartUnixNano, k.dur_ns AS Duration,
        CASE WHEN ({B(hb, 0)} % 1000) < {int(pools.ERROR_RATE * 1000)} THEN 'Error' ELSE 'Unset' END AS StatusCode
      FROM ex_kept k JOIN services s ON s.service_idx = k.svc LEFT JOIN services p ON p.service_idx = k.peer"""
    ctes = O.services_cte(n) + _ops_sql(n) + [
        ("ex_seeds", seeds), ("ex_roots0", roots0), ("ex_roots", roots), ("nodes", rec), ("ex_kept", kept)]
    return O.with_ctes(select or final, ctes, recursive=True)


@register("trace_expand", _expand_sql(N_EXPAND_SERVICES))
def q_trace_expand(spark, sf_dir):
    configure(spark)
    seeds = fixtures.seeds_from_orders(fixtures.read_table(spark, sf_dir, "orders"))
    sp = expand.trace_expand(seeds, N_EXPAND_SERVICES)
    return sp.select("TraceId", "SpanId", "ParentSpanId", "SpanName", "SpanKind", "ServiceName", "StartUnixNano",
                     "Duration", "StatusCode")


# --------------------------------------------------------------------------
# scalar expressions over the whole span table
# --------------------------------------------------------------------------
from .functions import scalars as SC  # noqa: E402


@register("hex_id", S("""
SELECT TraceId, SpanId, CASE WHEN lower(substr(md5(SpanId), 1, 16)) = '0000000000000000' THEN ''
                             ELSE lower(substr(md5(SpanId), 1, 16)) END AS derived_id,
       length(TraceId)::INTEGER AS trace_hex_len, length(SpanId)::INTEGER AS span_hex_len FROM spans"""))
def q_hex_id(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    return s.select("TraceId", "SpanId", SC.hex_id(F.md5("SpanId"), 16).alias("derived_id"),
                    F.length("TraceId").alias("trace_hex_len"), F.length("SpanId").alias("span_hex_len"))


@register("duration_ns", S("""
SELECT TraceId, SpanId, (StartUnixNano + Duration) - StartUnixNano AS duration_ns,
       StartUnixNano + Duration AS end_ns FROM spans"""))
def q_duration_ns(spark, sf_dir):
    s = spans_of(spark, sf_dir).withColumn("end_ns", F.col("StartUnixNano") + F.col("Duration"))
    return s.select("TraceId", "SpanId", SC.duration_ns("StartUnixNano", "end_ns").alias("duration_ns"), "end_ns")


@register("time_buckets", S("""
SELECT date_trunc('minute', Timestamp) AS minute, date_trunc('hour', Timestamp) AS hour, Timestamp::DATE AS day,
       epoch(date_trunc('second', Timestamp))::BIGINT AS seconds, count(*) AS spans
FROM spans GROUP BY 1, 2, 3, 4"""))
def q_time_buckets(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    return s.groupBy(SC.ntz(SC.start_of_minute("Timestamp")).alias("minute"), SC.ntz(SC.start_of_hour("Timestamp")).alias("hour"),
                     SC.to_day("Timestamp").alias("day"), SC.to_seconds("Timestamp").alias("seconds")) \
        .agg(F.count(F.lit(1)).alias("spans"))


def _readable_sql(x: str) -> str:
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    parts = " ".join(f"WHEN {x}::DOUBLE >= {float(1024 ** i)} THEN printf('%.2f', {x}::DOUBLE / {float(1024 ** i)}) || ' {units[i]}'"
                     for i in range(len(units) - 1, 0, -1))
    return f"CASE {parts} ELSE printf('%.2f', {x}::DOUBLE) || ' B' END"


@register("readable_size", S(f"""
SELECT ServiceName, sum(Duration)::BIGINT AS total, {_readable_sql('sum(Duration)')} AS readable FROM spans GROUP BY 1"""))
def q_readable_size(spark, sf_dir):
    s = spans_of(spark, sf_dir).groupBy("ServiceName").agg(F.sum("Duration").cast("bigint").alias("total"))
    return s.select("ServiceName", "total", SC.readable_size("total").alias("readable"))


@register("map_keys_values", S("""
SELECT TraceId, SpanId, array_to_string(list_sort(map_keys(SpanAttributes)), ',') AS keys,
       array_to_string(list_sort(map_values(SpanAttributes)), ',') AS vals,
       cardinality(ResourceAttributes)::INTEGER AS n_resource FROM spans"""))
def q_map_keys_values(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    return s.select("TraceId", "SpanId", F.array_join(F.array_sort(F.map_keys("SpanAttributes")), ",").alias("keys"),
                    F.array_join(F.array_sort(F.map_values("SpanAttributes")), ",").alias("vals"),
                    F.size("ResourceAttributes").alias("n_resource"))


@register("shard_of", S(f"SELECT TraceId, {SHARD_NO} AS shard FROM spans GROUP BY 1, 2"))
def q_shard_of(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    return s.select("TraceId", SC.shard_of("TraceId", 3).alias("shard")).distinct()


@register("draw_uniform", S("""
SELECT TraceId, round(('0x' || substr(md5(TraceId), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, 12) AS u,
       (['GET', 'POST', 'PUT'])[('0x' || substr(md5(TraceId), 1, 13))::BIGINT % 3 + 1] AS picked
FROM spans WHERE ParentSpanId = ''"""))
def q_draw_uniform(spark, sf_dir):
    s = spans_of(spark, sf_dir).filter(F.col("ParentSpanId") == "")
    d = SC.hex_draw(F.md5("TraceId"), 1, 13)
    return s.select("TraceId", F.round(SC.draw_uniform("TraceId"), 12).alias("u"),
                    SC.pick(["GET", "POST", "PUT"], d).alias("picked"))


@register("sample_lognormal", S("""
SELECT TraceId, greatest(1000, floor(exp(13.0::DOUBLE + 0.9::DOUBLE *
         (sqrt(-2.0::DOUBLE * ln(greatest(('0x' || substr(md5(TraceId || ':u1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE, 1e-300::DOUBLE)))
          * cos(6.283185307179586::DOUBLE * (('0x' || substr(md5(TraceId || ':u2'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))))::BIGINT) AS d
FROM spans WHERE ParentSpanId = ''"""))
def q_sample_lognormal(spark, sf_dir):
    s = spans_of(spark, sf_dir).filter(F.col("ParentSpanId") == "")
    return s.select("TraceId", SC.sample_lognormal(13.0, 0.9, "TraceId").alias("d"))


@register("lookups", S(f"""
SELECT TraceId, SpanId, CASE SpanAttributes['db.system'] {' '.join(f"WHEN '{k}' THEN {v}" for k, v in pools.DB_PORTS.items())} ELSE 0 END AS db_port,
       CASE WHEN SpanKind = 'Producer' THEN 'publish' ELSE 'process' END AS msg_operation,
       CASE WHEN coalesce(SpanAttributes['url.path'], '') <> '' THEN '{pools.PEER_HOST}' ELSE 'localhost' END AS peer_host
FROM spans"""))
def q_lookups(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    return s.select("TraceId", "SpanId", SC.db_port(F.col("SpanAttributes").getItem("db.system")).alias("db_port"),
                    SC.msg_operation(F.when(F.col("SpanKind") == "Producer", F.lit("msg_producer"))
                                     .otherwise(F.lit("msg_consumer"))).alias("msg_operation"),
                    SC.peer_host(F.col("SpanAttributes").getItem("url.path")).alias("peer_host"))


@register("text_from_draws", S("""
SELECT TraceId, SpanId, SpanAttributes['client.address'] AS client_ip, SpanAttributes['user_agent.original'] AS user_agent,
       SpanAttributes['db.query.text'] AS query_text
FROM spans WHERE SpanAttributes['client.address'] IS NOT NULL OR SpanAttributes['db.query.text'] IS NOT NULL"""))
def q_text_from_draws(spark, sf_dir):
    s = spans_of(spark, sf_dir)
    a = F.col("SpanAttributes")
    return s.filter(a.getItem("client.address").isNotNull() | a.getItem("db.query.text").isNotNull()).select(
        "TraceId", "SpanId", a.getItem("client.address").alias("client_ip"),
        a.getItem("user_agent.original").alias("user_agent"), a.getItem("db.query.text").alias("query_text"))


@register("service_name_of", S("""
SELECT ServiceName, count(*) AS spans FROM spans GROUP BY 1"""))
def q_service_name_of(spark, sf_dir):
    """Service names re-derived from the index (o_custkey % 24) via the cycling rule."""
    configure(spark)
    o = fixtures.read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 24).cast("int").alias("svc"))
    s = spans_of(spark, sf_dir)
    return s.groupBy("ServiceName").agg(F.count(F.lit(1)).alias("spans")).select(
        "ServiceName", "spans").join(
        o.select(SC.service_name_of("svc").alias("ServiceName")).distinct(), "ServiceName", "left_semi")


# --------------------------------------------------------------------------
# more joins, sinks and streams
# --------------------------------------------------------------------------
@register("join_span_operation", S("""
SELECT s.TraceId, s.SpanId, v.service_idx, v.version, v.host FROM spans s JOIN services v ON v.name = s.ServiceName"""))
def q_join_span_operation(spark, sf_dir):
    svc = catalog.services(spark, fixtures.N_FIXTURE_SERVICES)
    from .plans.strategies import broadcast_bounded

    dim = broadcast_bounded(svc.select(F.col("name").alias("ServiceName"), "service_idx", "version", "host"),
                            fixtures.N_FIXTURE_SERVICES)
    return spans_of(spark, sf_dir).join(dim, "ServiceName").select("TraceId", "SpanId", "service_idx", "version", "host")


@register("write_otlp_nested", S(f"""
SELECT TraceId, SpanId, ParentSpanId, SpanName, SpanKind, ServiceName, StartUnixNano, Duration, StatusCode,
       {O.canon_json('SpanAttributes')} AS span_json, {O.canon_json('ResourceAttributes')} AS resource_json, n_events
FROM spans"""))
def q_write_otlp_nested(spark, sf_dir):
    """Nested payloads written as JSON lines, read back and flattened: every span again."""
    from .functions.scalars import canonical_json

    payload = nested.group_by_resource(spans_of(spark, sf_dir))
    path = scratch_path(spark, "otlp-json")
    payload.write.mode("overwrite").option("compression", "gzip").json(path)
    back = nested.flatten_otlp(spark.read.schema(payload.schema).json(path))
    return back.select("TraceId", "SpanId", "ParentSpanId", "SpanName", "SpanKind", "ServiceName", "StartUnixNano", "Duration",
                       "StatusCode", canonical_json("SpanAttributes").alias("span_json"),
                       canonical_json("ResourceAttributes").alias("resource_json"), F.size("Events").alias("n_events"))


def attempts_stream(spark, sf_dir):
    key = ("stream-in", "attempts", sf_dir, spark.sparkContext.applicationId)
    if key not in _WRITTEN:
        path = scratch_path(spark, "stream-in-attempts")
        streams.write_arrival_files(attempts_of(spark, sf_dir), path, 8, order_col="ts")
        _WRITTEN[key] = path
    path = _WRITTEN[key]
    return streams.stream_spans(spark, path, spark.read.parquet(path).schema, files_per_trigger=2)


@register("stream_achieved_rate", O.with_ctes(_ACH, O.attempts_cte()))
def q_stream_achieved_rate(spark, sf_dir):
    src = attempts_stream(spark, sf_dir)
    q = (src.filter(F.col("ok")).withWatermark("ts", "1 minute")
         .groupBy(F.window("ts", "2 seconds").alias("w"))
         .agg(F.sum("spans").cast("bigint").alias("spans"))
         .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "spans",
                 F.round(F.col("spans") / F.lit(2.0), 6).alias("rate")))
    path, _ = streams.run_available_now(q, "achieved-rate", "update")
    return streams.read_latest(spark, path, ["window_start"])


@register("stream_batching", S("SELECT count(*) AS rows, true AS by_size, true AS by_timer, true AS within_cap FROM spans"))
def q_stream_batching(spark, sf_dir):
    """Spans of a stream in batches of 100 rows (at most 150), flushed after 5 seconds at the latest."""
    src = _not_closing(stream_input(spark, sf_dir)).select("TraceId", "SpanId")
    path = batching.run_until_flushed(batching.batched(src, rows=100, cap=150, seconds=5), "batching")
    done = batching.flushed(spark, path)
    return done.agg(F.sum("rows").alias("rows"), F.bool_or(F.col("reason") == "size").alias("by_size"),
                    F.bool_or(F.col("reason") == "timer").alias("by_timer"), (F.max("rows") <= 150).alias("within_cap"))


@register("late_rows", S("""
SELECT count(*) + count(*) FILTER (TraceId LIKE '0%') AS input_rows, count(*) AS written_rows,
       count(*) FILTER (TraceId LIKE '0%') AS dropped_rows FROM spans"""))
def q_late_rows(spark, sf_dir):
    """A replay after the end of the input is dropped whole: each row is late or a duplicate."""
    key = ("stream-in", "late", sf_dir, spark.sparkContext.applicationId)
    if key not in _WRITTEN:
        s = spans_of(spark, sf_dir).select("Timestamp", "TraceId", "SpanId")  # all that the dedup reads
        path = scratch_path(spark, "stream-in-late")
        streams.write_arrival_files(s, path, 4)
        streams.write_arrival_files(s.filter(F.col("TraceId").startswith("0")), path, 1)  # replayed, late
        _WRITTEN[key] = path
    path = _WRITTEN[key]
    given = spark.read.parquet(path)
    src = streams.stream_spans(spark, path, given.schema, files_per_trigger=2)
    out, _ = streams.run_available_now(streams.dedup(src).select("TraceId", "SpanId"), "late")
    counts = (given.select(F.lit(1).alias("i"), F.lit(0).alias("w"))
              .union(streams.read_result(spark, out).select(F.lit(0), F.lit(1))))
    return counts.agg(F.sum("i").alias("input_rows"), F.sum("w").alias("written_rows"),
                      (F.sum("i") - F.sum("w")).alias("dropped_rows"))


_FIT_SELECT = """SELECT op_type, count(*) AS n, round(avg(ln(dur_ns::DOUBLE)), 6) AS mu,
       round(stddev_pop(ln(dur_ns::DOUBLE)), 6) AS sigma,
       (""" + _CAT_MU.replace("op_type", "op_type") + """)::DOUBLE AS catalog_mu,
       (""" + _CAT_SIGMA + """)::DOUBLE AS catalog_sigma
FROM ex_kept GROUP BY op_type"""


@register("lognormal_fit_expanded", _expand_sql(N_EXPAND_SERVICES, _FIT_SELECT))
def q_lognormal_fit_expanded(spark, sf_dir):
    """Fitted log-normal parameters per operation family of expanded traces
    next to the catalog's (client calls are clamped to the parent's
    remainder, callee SERVER spans are 85 % of the client's)."""
    configure(spark)
    seeds = fixtures.seeds_from_orders(fixtures.read_table(spark, sf_dir, "orders"))
    svc = catalog.services(spark, N_EXPAND_SERVICES)
    ops = catalog.operations(svc, N_EXPAND_SERVICES)
    kept = expand.preorder_keep(expand.expand_nodes(seeds, ops, N_EXPAND_SERVICES))
    cat_mu = F.lit(None).cast("double")
    cat_sigma = F.lit(None).cast("double")
    for k, (mu, sigma) in pools.LATENCY_PARAMS.items():
        cat_mu = F.when(F.col("op_type") == k, F.lit(mu)).otherwise(cat_mu)
        cat_sigma = F.when(F.col("op_type") == k, F.lit(sigma)).otherwise(cat_sigma)
    ln = F.log(F.col("dur_ns").cast("double"))
    return (kept.groupBy("op_type")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ln), 6).alias("mu"), F.round(F.stddev_pop(ln), 6).alias("sigma"))
            .select("op_type", "n", "mu", "sigma", cat_mu.alias("catalog_mu"), cat_sigma.alias("catalog_sigma")))
