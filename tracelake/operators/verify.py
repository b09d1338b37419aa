"""The span table's verification and skew queries, as DataFrame jobs.

Each one is a single aggregation with map-side partial aggregation, so a hot
service, kind or minute never lands whole in one task; results are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ntz, shard_of, start_of_minute

N_SHARDS = 3


def count_star() -> Column:
    return F.count(F.lit(1))


def with_shard(spans: DataFrame, n_shards: int = N_SHARDS, method: str = "md5prefix") -> DataFrame:
    """Adds ``shard`` (hash of TraceId) and ``host`` ('shard-<n>') columns."""
    s = shard_of("TraceId", n_shards, method)
    return spans.withColumn("shard", s).withColumn("host", F.concat(F.lit("shard-"), s.cast("string")))


def total_spans(spans: DataFrame) -> DataFrame:
    return spans.agg(count_star().alias("total_spans"))


def rows_per_shard(spans: DataFrame, n_shards: int = N_SHARDS, method: str = "md5prefix") -> DataFrame:
    """Rows per node; ``spans`` may already carry a ``host`` column (as read
    back from a sharded layout), else shards come from the TraceId hash."""
    if "host" not in spans.columns:
        spans = with_shard(spans, n_shards, method)
    return spans.groupBy("host").agg(count_star().alias("rows_on_node")).orderBy("host")


def spans_per_service(spans: DataFrame, k: int = 50) -> DataFrame:
    """Top ``k`` services by span count (ties by name, for a stable result)."""
    return (spans.groupBy("ServiceName").agg(count_star().alias("spans"))
            .orderBy(F.desc("spans"), F.asc("ServiceName")).limit(k))


def kind_status_mix(spans: DataFrame) -> DataFrame:
    return (spans.groupBy("SpanKind", "StatusCode").agg(count_star().alias("n"))
            .orderBy(F.desc("n"), "SpanKind", "StatusCode"))


def recent(spans: DataFrame, minutes: int = 5, now: Column | None = None) -> DataFrame:
    """Spans with ``Timestamp > now - minutes``; ``now`` defaults to the
    table's latest Timestamp (a scalar subquery, so runs are repeatable)."""
    from .filters import filter_recent

    return filter_recent(spans, minutes, now)


def ingest_rate_minute(spans: DataFrame, minutes: int | None = 5, now: Column | None = None) -> DataFrame:
    """Spans and spans/second per minute bucket over the last ``minutes``
    (``None``: over the whole table)."""
    src = spans if minutes is None else recent(spans, minutes, now)
    return (src.groupBy(ntz(start_of_minute("Timestamp")).alias("minute"))
            .agg(count_star().alias("spans"))
            .withColumn("spans_per_sec", F.round(F.col("spans") / F.lit(60.0), 6))
            .orderBy("minute"))


def count_by_attribute(spans: DataFrame, key: str = "http.request.method", column: str = "SpanAttributes",
                       alias: str = "method") -> DataFrame:
    """Count by one attribute path; a missing key reads as '' (map-column default)."""
    value = F.coalesce(F.element_at(F.col(column), F.lit(key)), F.lit(""))
    return spans.groupBy(value.alias(alias)).agg(count_star().alias("n"))


def count_by_attribute_json(spans_json: DataFrame, key: str = "http.request.method",
                            column: str = "SpanAttributes", alias: str = "method") -> DataFrame:
    """The same over the JSON layout: extract from VARIANT first (VARIANT
    itself cannot be a grouping key)."""
    value = F.coalesce(F.variant_get(F.col(column), f"$['{key}']", "string"), F.lit(""))
    return spans_json.groupBy(value.alias(alias)).agg(count_star().alias("n"))
