"""Row filters over span tables.

Column predicates (TraceId, SpanName, StatusCode, Duration, Timestamp) are
pushed into the Parquet scan (row-group min/max, dictionary and, when the
layout wrote them, Bloom filters). Map predicates are not pushed down by
Parquet; ``filter_time_range`` also adds the partition-column predicate so
directory pruning happens even though ``dt`` is not inferred from Timestamp.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAN = ["TraceId", "SpanId", "SpanName", "ServiceName", "Duration", "StartUnixNano"]


def lean(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in LEAN if c in df.columns])


def _within(spans: DataFrame, start: Column | None, end: Column | None) -> Column:
    """Partition predicates implied by ``start <= Timestamp < end``, from the partition columns
    that the table has (see ``layout.partition_keys``)."""
    cond = F.lit(True)
    for name, of in (("month", lambda t: F.to_date(F.date_trunc("month", t))), ("dt", F.to_date)):
        if name in spans.columns:
            cond = cond & (F.lit(True) if start is None else F.col(name) >= of(start))
            cond = cond & (F.lit(True) if end is None else F.col(name) <= of(end))
    if {"dt", "hour"} <= set(spans.columns):
        if start is not None:
            cond = cond & ((F.col("dt") > F.to_date(start)) | (F.col("hour") >= F.hour(start)))
        if end is not None:
            cond = cond & ((F.col("dt") < F.to_date(end)) | (F.col("hour") <= F.hour(end)))
    return cond


def filter_time_range(spans: DataFrame, start: str | dt.datetime, end: str | dt.datetime) -> DataFrame:
    """``start <= Timestamp < end`` plus the matching partition predicates."""
    s = F.lit(start).cast("timestamp")
    e = F.lit(end).cast("timestamp")
    return spans.filter((F.col("Timestamp") >= s) & (F.col("Timestamp") < e) & _within(spans, s, e))


def trace_id_for_order(order_key: int) -> str:
    return hashlib.md5(f"t:{order_key}".encode()).hexdigest()


def lookup_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("TraceId") == F.lit(trace_id))


def filter_attr_key(spans: DataFrame, key: str, column: str = "SpanAttributes") -> DataFrame:
    return spans.filter(F.map_contains_key(F.col(column), F.lit(key)))


def filter_attr_value(spans: DataFrame, value: str, column: str = "SpanAttributes") -> DataFrame:
    return spans.filter(F.array_contains(F.map_values(F.col(column)), F.lit(value)))


def filter_attr_equals(spans: DataFrame, key: str, value: str, column: str = "SpanAttributes") -> DataFrame:
    col = F.col(column)
    field = col.getItem(key) if dict(spans.dtypes)[column].startswith("map") else F.variant_get(col, f"$['{key}']", "string")
    return spans.filter(field == F.lit(value))


def filter_duration(spans: DataFrame, lo_ns: int, hi_ns: int) -> DataFrame:
    return spans.filter(F.col("Duration").between(lo_ns, hi_ns))


def filter_status(spans: DataFrame, status: str = "Error") -> DataFrame:
    return spans.filter(F.col("StatusCode") == F.lit(status))


def filter_span_name(spans: DataFrame, name: str) -> DataFrame:
    return spans.filter(F.col("SpanName") == F.lit(name))


def latest(spans: DataFrame) -> Column:
    """The table's latest Timestamp, as a scalar subquery that reads only the last
    partition directory, where the table has one."""
    for name in ("dt", "month"):
        if name in spans.columns:
            spans = spans.filter(F.col(name) == spans.select(F.max(name)).scalar())
            break
    return spans.select(F.max("Timestamp")).scalar()


def filter_recent(spans: DataFrame, minutes: int = 5, now: Column | None = None) -> DataFrame:
    """``Timestamp > now - minutes``, with the partitions that can hold such rows."""
    start = (now if now is not None else latest(spans)) - F.make_dt_interval(mins=F.lit(minutes))
    return spans.filter((F.col("Timestamp") > start) & _within(spans, start, None))


def filter_expired(spans: DataFrame, ttl_hours: int = 5, now: Column | None = None) -> DataFrame:
    """Rows past their TTL, ``Timestamp <= now - ttl``, with the partitions that can hold them."""
    end = (now if now is not None else latest(spans)) - F.make_dt_interval(hours=F.lit(ttl_hours))
    return spans.filter((F.col("Timestamp") <= end) & _within(spans, None, end))


def filter_files(df_with_meta: DataFrame, path_like: str | None = None, min_bytes: int | None = None) -> DataFrame:
    """Conjunctive filter on file metadata (``_metadata.file_path`` / ``file_size``)."""
    cond = F.lit(True)
    if path_like is not None:
        cond = cond & F.col("_metadata.file_path").like(path_like)
    if min_bytes is not None:
        cond = cond & (F.col("_metadata.file_size") >= min_bytes)
    return df_with_meta.filter(cond)


def validate_params(spans_min: int = 5, spans_max: int = 20, services: int = 30,
                    schema: str = "map", mode: str = "local", error_rate: float = 0.015,
                    event_rate: float = 0.10) -> None:
    """Reject bad job parameters before any Spark work starts."""
    problems = []
    if spans_min < 1:
        problems.append("spans-per-trace-min must be >= 1")
    if spans_max < spans_min:
        problems.append("spans-per-trace-max must be >= spans-per-trace-min")
    if services < 1:
        problems.append("services must be >= 1")
    if schema not in ("map", "json"):
        problems.append(f"unknown schema {schema!r} (map|json)")
    if mode not in ("local", "distributed", "shard-roundrobin"):
        problems.append(f"unknown mode {mode!r} (local|distributed|shard-roundrobin)")
    for name, r in (("error-rate", error_rate), ("event-rate", event_rate)):
        if not 0.0 <= r <= 1.0:
            problems.append(f"{name} must be in [0, 1]")
    if problems:
        raise ValueError("; ".join(problems))
