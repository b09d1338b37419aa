"""Data-quality rules of the span table, and a deterministic corrupted copy.

Every rule is a predicate; ``schema_conformance`` evaluates all of them in
one pass (one partial aggregate per task). ``corrupt`` damages a keyed subset
of rows so each rule has something to find; the rules' results on it are
checked against SQL like any other query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pools
from ..functions.scalars import idiv
from .verify import count_star

KINDS = ["Unspecified", "Internal", "Server", "Client", "Producer", "Consumer"]
STATUSES = ["Unset", "Ok", "Error"]


def rules(spans: DataFrame) -> dict[str, F.Column]:
    start_us = idiv("StartUnixNano", 1000)
    end_us = idiv(F.col("StartUnixNano") + F.col("Duration"), 1000)
    n_exc = F.size(F.filter("Events", lambda e: e["Name"] == "exception"))
    r = {
        "bad_trace_id": ~F.col("TraceId").rlike("^[0-9a-f]{32}$"),
        "bad_span_id": ~F.col("SpanId").rlike("^[0-9a-f]{16}$"),
        "bad_parent_id": (F.col("ParentSpanId") != "") & ~F.col("ParentSpanId").rlike("^[0-9a-f]{16}$"),
        "bad_kind": ~F.col("SpanKind").isin(*KINDS),
        "bad_status": ~F.col("StatusCode").isin(*STATUSES),
        "negative_duration": F.col("Duration") < 0,
        "event_outside_span": F.exists("Events", lambda e: (F.unix_micros(e["Timestamp"]) < start_us)
                                       | (F.unix_micros(e["Timestamp"]) > end_us)),
        "error_without_one_exception": (F.col("StatusCode") == "Error") & (n_exc != 1),
        "exception_without_error": (F.col("StatusCode") != "Error") & (n_exc > 0),
        "status_message_mismatch": ((F.col("StatusCode") == "Error") & (F.col("StatusMessage") != pools.STATUS_MESSAGE_ERROR))
        | ((F.col("StatusCode") != "Error") & (F.col("StatusMessage") != "")),
    }
    if "Events.Timestamp" in spans.columns:
        n_ts, n_nm, n_at = (F.size(F.col(f"`Events.{c}`")) for c in ("Timestamp", "Name", "Attributes"))
        r["unequal_event_arrays"] = (n_ts != n_nm) | (n_ts != n_at)
    return r


def schema_conformance(spans: DataFrame) -> DataFrame:
    """One row: the number of rows violating each rule, plus the row count."""
    checks = rules(spans)
    return spans.agg(count_star().alias("spans"),
                     *[F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n) for n, c in checks.items()])


def duplicate_spans(spans: DataFrame) -> DataFrame:
    """(TraceId, SpanId) pairs present more than once — globally, so retry
    copies that landed on different shards are found too."""
    return (spans.groupBy("TraceId", "SpanId").agg(count_star().alias("copies"))
            .filter(F.col("copies") > 1))


def corrupt(spans: DataFrame) -> DataFrame:
    """A damaged copy of ``spans`` (keyed by id prefixes, so reproducible):

    - parent id replaced by an unknown id (orphan): non-root, SpanId '0f…'
    - start moved 1 s before the parent (containment): non-root, SpanId '1f…'
    - upper-case id: SpanId 'a1…'; short id: SpanId 'b2…'
    - error span without its exception event: Error and SpanId '3…'
    - callee moved to service 0 (DAG): non-root Server, SpanId 'c…'
    - unknown kind 'SERVER': SpanId 'dd…'
    - duplicated rows (a retried batch on another shard): TraceId '00…'
    """
    sid = F.col("SpanId")
    nonroot = F.col("ParentSpanId") != ""
    c = spans.select(
        *[x for x in spans.columns if x not in ("SpanId", "ParentSpanId", "StartUnixNano", "Timestamp", "Events",
                                                 "ServiceName", "SpanKind")],
        F.when(sid.startswith("a1"), F.upper(sid)).when(sid.startswith("b2"), F.substring(sid, 1, 15))
        .otherwise(sid).alias("SpanId"),
        F.when(nonroot & sid.startswith("0f"), F.lit("deadbeefdeadbeef")).otherwise(F.col("ParentSpanId")).alias("ParentSpanId"),
        F.when(nonroot & sid.startswith("1f"), F.col("StartUnixNano") - 1_000_000_000)
        .otherwise(F.col("StartUnixNano")).alias("StartUnixNano"),
        F.when(nonroot & sid.startswith("1f"), F.col("Timestamp") - F.expr("INTERVAL 1 SECOND"))
        .otherwise(F.col("Timestamp")).alias("Timestamp"),
        F.when((F.col("StatusCode") == "Error") & sid.startswith("3"), F.filter("Events", lambda e: F.lit(False)))
        .otherwise(F.col("Events")).alias("Events"),
        F.when(nonroot & (F.col("SpanKind") == "Server") & sid.startswith("c"), F.lit(pools.SERVICE_NAMES[0]))
        .otherwise(F.col("ServiceName")).alias("ServiceName"),
        F.when(sid.startswith("dd"), F.lit("SERVER")).otherwise(F.col("SpanKind")).alias("SpanKind"),
    ).select(*spans.columns)
    return c.unionByName(c.filter(F.col("TraceId").startswith("00")))
