"""Profile aggregations over span and attempt tables.

All are hash aggregations with partial (map-side) aggregation before the
shuffle; group keys are bounded-cardinality columns (service, kind, span
name, attribute key) or TraceId (many small groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pools
from .verify import count_star, with_shard

EXPECTED_EVENT_FRACTION = pools.ERROR_RATE + (1 - pools.ERROR_RATE) * pools.EVENT_RATE


def _r(c, n: int = 6):
    return F.round(c, n)


def shard_skew(spans: DataFrame, n_shards: int = 3, method: str = "md5prefix") -> DataFrame:
    """Per-shard count spread: the 'within a few percent' acceptance test."""
    if "shard" not in spans.columns:
        spans = with_shard(spans, n_shards, method)
    per = spans.groupBy("shard").agg(count_star().alias("rows"))
    return per.agg(
        count_star().alias("shards"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        _r(F.avg("rows")).alias("mean_rows"),
        _r(F.max("rows") / F.min("rows")).alias("max_over_min"),
        _r(F.greatest(F.max("rows") - F.avg("rows"), F.avg("rows") - F.min("rows")) / F.avg("rows") * 100).alias("max_dev_pct"),
        _r(F.stddev_pop("rows")).alias("stddev_rows"),
    )


def trace_colocation(spans: DataFrame, n_shards: int = 3, method: str = "md5prefix") -> DataFrame:
    """How many traces sit on exactly one shard (all, under TraceId hashing)."""
    if "shard" not in spans.columns:
        spans = with_shard(spans, n_shards, method)
    per = spans.groupBy("TraceId").agg(F.countDistinct("shard").alias("n_shards"))
    return per.agg(
        count_star().alias("traces"),
        F.sum(F.when(F.col("n_shards") == 1, 1).otherwise(0)).cast("bigint").alias("traces_on_one_shard"),
        F.sum(F.when(F.col("n_shards") > 1, 1).otherwise(0)).cast("bigint").alias("traces_split"),
    )


def service_uniformity(spans: DataFrame) -> DataFrame:
    """Share of the largest/smallest service and a chi-square statistic
    against the uniform split ('no single service dominating')."""
    per = spans.groupBy("ServiceName").agg(count_star().alias("n"))
    stats = per.agg(count_star().alias("services"), F.sum("n").alias("total"),
                    F.sum(F.col("n") * F.col("n")).alias("sum_sq"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))
    expected = F.col("total") / F.col("services")
    return stats.select(
        "services", F.col("total").cast("bigint").alias("total"),
        # sum((n - E)^2 / E) = sum(n^2)/E - total
        _r(F.col("sum_sq") / expected - F.col("total"), 4).alias("chi_square"),
        _r(F.col("max_n") / F.col("total")).alias("max_share"),
        _r(F.col("min_n") / F.col("total")).alias("min_share"),
        _r(F.col("max_n") / expected).alias("max_over_mean"),
    )


def distinct_ids(spans: DataFrame) -> DataFrame:
    """Spans, traces and distinct spans: by span, then by trace, then summed, so that no
    row is copied for the two distinct counts."""
    by_span = spans.groupBy("TraceId", "SpanId").agg(count_star().alias("n"))
    by_trace = by_span.groupBy("TraceId").agg(F.sum("n").alias("n"), count_star().alias("m"))
    return by_trace.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("spans"), count_star().alias("traces"),
                        F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("distinct_spans"))


def distinct_ids_approx(spans: DataFrame, rsd: float = 0.01) -> DataFrame:
    """HyperLogLog++ estimates: constant memory per partition, no shuffle of ids."""
    return spans.agg(
        count_star().alias("spans"),
        F.approx_count_distinct("TraceId", rsd).alias("traces_approx"),
        F.approx_count_distinct(F.concat("TraceId", "SpanId"), rsd).alias("spans_approx"),
    )


def explode_attributes(spans: DataFrame) -> DataFrame:
    """One row per (span, scope, key, value) from the flat attribute maps."""
    span_side = spans.select("TraceId", "SpanId", F.lit("span").alias("scope"),
                             F.explode("SpanAttributes").alias("key", "value"))
    res_side = spans.select("TraceId", "SpanId", F.lit("resource").alias("scope"),
                            F.explode("ResourceAttributes").alias("key", "value"))
    return span_side.unionByName(res_side)


def attr_cardinality(spans: DataFrame) -> DataFrame:
    """Distinct values per attribute key ('bounded cardinality' check).

    Resource attribute sets repeat for every span of a service instance, so
    spans are first pre-aggregated by their exact resource set (grouping on
    its entry array, with a span count) and only the distinct sets are
    exploded; span attributes vary per span and are exploded directly.
    """
    span_side = (spans.select(F.explode("SpanAttributes").alias("key", "value"))
                 .groupBy("key").agg(F.countDistinct("value").alias("n_values"), count_star().alias("n_spans"))
                 .withColumn("scope", F.lit("span")))
    res_sets = spans.groupBy(F.map_entries("ResourceAttributes").alias("entries")).agg(count_star().alias("c"))
    res_side = (res_sets.select("c", F.inline("entries"))
                .groupBy("key").agg(F.countDistinct("value").alias("n_values"), F.sum("c").alias("n_spans"))
                .withColumn("scope", F.lit("resource")))
    return span_side.unionByName(res_side).select("scope", "key", "n_values", "n_spans")


def error_event_rates(spans: DataFrame) -> DataFrame:
    """Measured error and event fractions against their configured values."""
    return spans.agg(
        count_star().alias("spans"),
        _r(F.avg(F.when(F.col("StatusCode") == "Error", 1.0).otherwise(0.0))).alias("error_rate"),
        _r(F.avg(F.when(F.size("Events") > 0, 1.0).otherwise(0.0))).alias("event_rate"),
        F.lit(pools.ERROR_RATE).alias("expected_error_rate"),
        F.lit(round(EXPECTED_EVENT_FRACTION, 6)).alias("expected_event_rate"),
    )


def explode_events(spans: DataFrame) -> DataFrame:
    """One row per event (inverse of the parallel-array encoding)."""
    return spans.select("TraceId", "SpanId", "ServiceName", F.inline("Events"))


def exception_counts(spans: DataFrame) -> DataFrame:
    ev = explode_events(spans).filter(F.col("Name") == "exception")
    return (ev.groupBy(F.element_at("Attributes", "exception.type").alias("exception_type"), "ServiceName")
            .agg(count_star().alias("n")))


QUANTILES = [0.5, 0.9, 0.95, 0.99]


#: Parts that a range of values is divided into in one round.
PARTS = 1024


def _cumulated(h: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Counts ``n`` with ``before``: those of smaller ``order`` with the same keys (a bounded number of rows a key)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _holding(wanted: DataFrame, h: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``wanted`` ranks (``r``) with the part that holds each, and the rank within it."""
    found = wanted.join(_cumulated(h, keys, order), keys).filter((F.col("r") > F.col("before")) & (F.col("r") <= F.col("before") + F.col("n")))
    return found.withColumn("r", F.col("r") - F.col("before")).drop("before", "n")


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, qs: list[float] = QUANTILES) -> DataFrame:
    """Per group ``n``, ``mean``, ``min``, ``max`` and the exact interpolated quantiles ``p50`` ... (= ``percentile`` /
    ``quantile_cont``) of an integer column; null values are left out.

    A selection by counted ranges, without a sort of the rows: (1) values are counted by the range that they fall into
    (a thirty-second of a power of two: some hundred rows a group), which says which range holds each quantile's two
    neighbours; (2) only these ranges are counted again in ``PARTS`` parts each; (3) only the parts that hold a neighbour are
    counted by value. All three are hash aggregations with partial counts, so a group with a third of all rows is
    counted by all tasks, and equal values are one row. The last window runs over one part's distinct values."""
    from ..plans.strategies import cut_lineage

    v, g = F.col("_v"), [f"_g{i}" for i in range(len(group_cols))]
    # Null group values are groups, too: keys are compared within a struct.
    rows = (df.filter(F.col(value_col).isNotNull())
            .select(F.struct(*(F.col(c).alias(n) for c, n in zip(group_cols, g))).alias("_g"), F.col(value_col).cast("bigint").alias("_v"))
            .withColumn("_range", (F.signum(v) * F.floor(F.log2(F.abs(v).cast("double") + 1) * 32)).cast("int")))
    ranges = cut_lineage(rows.groupBy("_g", "_range").agg(
        count_star().alias("n"), F.sum(v.cast("decimal(38,0)")).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")), "ranges")
    totals = ranges.groupBy("_g").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    pos = lambda q: (F.col("n") - 1) * F.lit(q)
    ends = [e for q in qs for e in (F.floor(pos(q)) + 1, F.ceil(pos(q)) + 1)]
    ranks = totals.select("_g", F.explode(F.array_distinct(F.array(*ends))).alias("r")).withColumn("rank", F.col("r"))

    first = cut_lineage(_holding(ranks, ranges.drop("s"), ["_g"], "_range"), "quantile-ranges")
    part = F.floor((v - F.col("lo")).cast("double") * PARTS / (F.col("hi") - F.col("lo") + 1).cast("double")).cast("int")
    # The ranges that hold a neighbour are fewer than two a quantile and group.
    inside = rows.join(first.select("_g", "_range", "lo", "hi").distinct(), ["_g", "_range"]).withColumn("_part", part)
    parts = inside.groupBy("_g", "_range", "_part").agg(count_star().alias("n"))
    second = cut_lineage(_holding(first, parts, ["_g", "_range"], "_part"), "quantile-parts")
    chosen = inside.join(second.select("_g", "_range", "_part").distinct(), ["_g", "_range", "_part"], "left_semi")
    values = chosen.groupBy("_g", "_range", "_part", v).agg(count_star().alias("n"))
    found = _holding(second, values, ["_g", "_range", "_part"], "_v").select("_g", "rank", "_v")

    at = lambda e: F.max(F.when(F.col("rank") == e, v)).cast("double")
    picked = (totals.join(found, "_g").groupBy("_g", "n", "s", "min", "max")
              .agg(*(x for i, q in enumerate(qs) for x in (at(ends[2 * i]).alias(f"_lo{i}"), at(ends[2 * i + 1]).alias(f"_hi{i}")))))
    return picked.select(
        *(F.col(f"_g.{n}").alias(c) for c, n in zip(group_cols, g)), "n", (F.col("s").cast("double") / F.col("n")).alias("mean"), "min", "max",
        *((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos(q) - F.floor(pos(q)))).alias(f"p{int(q * 100)}")
          for i, q in enumerate(qs)))


def latency_by_operation(spans: DataFrame, method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Mean, min, max and p50/p90/p95/p99 of Duration by (service, span name).

    ``exact`` gives the linear-interpolated quantiles (= quantile_cont) by counted
    ranges; ``approx`` uses the bounded ``percentile_approx`` sketch.
    """
    keys = ["ServiceName", "SpanName"]
    names = [f"p{int(q * 100)}_ns" for q in QUANTILES]
    aggs = [count_star().alias("n"), _r(F.avg("Duration"), 3).alias("mean_ns"),
            F.min("Duration").alias("min_ns"), F.max("Duration").alias("max_ns")]
    if method == "approx":
        out = spans.groupBy(*keys).agg(
            *aggs, F.percentile_approx(F.col("Duration").cast("double"), QUANTILES, accuracy).alias("_q"))
        return out.select(*keys, "n", "mean_ns", "min_ns", "max_ns",
                          *[_r(F.col("_q")[i], 3).alias(n) for i, n in enumerate(names)])
    q = exact_quantiles(spans, keys, "Duration")
    return q.select(*keys, "n", _r(F.col("mean"), 3).alias("mean_ns"), F.col("min").alias("min_ns"), F.col("max").alias("max_ns"),
                    *[_r(F.col(f"p{int(x * 100)}"), 3).alias(n) for x, n in zip(QUANTILES, names)])


def op_family(spans: DataFrame) -> DataFrame:
    """Adds ``op_type``: the operation family recovered from kind and attributes."""
    a = F.col("SpanAttributes")
    fam = (F.when(a.getItem("db.system").isNotNull(), F.lit("db_client"))
           .when(a.getItem("rpc.system").isNotNull() & (F.col("SpanKind") == "Server"), F.lit("rpc_server"))
           .when(a.getItem("rpc.system").isNotNull(), F.lit("rpc_client"))
           .when(a.getItem("messaging.system").isNotNull(), F.lit("msg_consumer"))
           .when(a.getItem("http.request.method").isNotNull() & (F.col("SpanKind") == "Server"), F.lit("http_server"))
           .when(a.getItem("http.request.method").isNotNull(), F.lit("http_client"))
           .otherwise(F.lit("internal")))
    return spans.withColumn("op_type", fam)


def lognormal_fit(spans: DataFrame) -> DataFrame:
    """mu = avg(ln d), sigma = stddev_pop(ln d) per operation family, next to
    the catalog's parameters (where the family has them)."""
    params = [(k, v[0], v[1]) for k, v in pools.LATENCY_PARAMS.items()]
    cat_mu = F.lit(None).cast("double")
    cat_sigma = F.lit(None).cast("double")
    for k, mu, sigma in params:
        cat_mu = F.when(F.col("op_type") == k, F.lit(mu)).otherwise(cat_mu)
        cat_sigma = F.when(F.col("op_type") == k, F.lit(sigma)).otherwise(cat_sigma)
    ln = F.log(F.col("Duration").cast("double"))
    return (op_family(spans).groupBy("op_type")
            .agg(count_star().alias("n"), _r(F.avg(ln), 6).alias("mu"), _r(F.stddev_pop(ln), 6).alias("sigma"))
            .select("op_type", "n", "mu", "sigma", cat_mu.alias("catalog_mu"), cat_sigma.alias("catalog_sigma")))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Per trace: spans, services, errors, start, end, duration, root name."""
    end = F.col("StartUnixNano") + F.col("Duration")
    is_root = F.col("ParentSpanId") == ""
    return spans.groupBy("TraceId").agg(
        count_star().alias("spans"),
        # a per-trace set bounded by the number of services (no Expand of every row)
        F.size(F.collect_set("ServiceName")).cast("bigint").alias("services"),
        F.sum(F.when(F.col("StatusCode") == "Error", 1).otherwise(0)).cast("bigint").alias("errors"),
        F.min("StartUnixNano").alias("start_ns"),
        F.max(end).alias("end_ns"),
        (F.max(end) - F.min("StartUnixNano")).alias("duration_ns"),
        F.min(F.when(is_root, F.col("SpanName"))).alias("root_name"),
    )


def trace_size_histogram(spans: DataFrame) -> DataFrame:
    per = spans.groupBy("TraceId").agg(count_star().alias("spans"))
    return per.groupBy("spans").agg(count_star().alias("traces")).orderBy("spans")


def http_status_classes(spans: DataFrame) -> DataFrame:
    """Counts by HTTP status class and span status; 4xx/5xx must be errors."""
    code = F.element_at("SpanAttributes", "http.response.status_code")
    return (spans.filter(code.isNotNull())
            .groupBy(F.concat(F.substring(code, 1, 1), F.lit("xx")).alias("status_class"), "StatusCode")
            .agg(count_star().alias("n")))


def rpc_status_counts(spans: DataFrame) -> DataFrame:
    code = F.element_at("SpanAttributes", "rpc.grpc.status_code")
    return (spans.filter(code.isNotNull())
            .groupBy("ServiceName", code.cast("int").alias("grpc_status"))
            .agg(count_star().alias("n")))


def db_usage(spans: DataFrame) -> DataFrame:
    a = F.col("SpanAttributes")
    return (spans.filter(a.getItem("db.system").isNotNull())
            .groupBy(a.getItem("db.system").alias("db_system"), a.getItem("db.operation.name").alias("db_operation"),
                     a.getItem("db.collection.name").alias("db_collection"))
            .agg(count_star().alias("calls"), _r(F.avg("Duration"), 3).alias("mean_ns"),
                 F.max("Duration").alias("max_ns"),
                 F.sum(F.when(F.col("StatusCode") == "Error", 1).otherwise(0)).cast("bigint").alias("errors")))


def send_outcomes(attempts: DataFrame) -> DataFrame:
    """OK / failed batches, send errors, sent and dropped spans."""
    per = attempts.groupBy("batch_id").agg(
        F.bool_or("ok").alias("ok"), F.max("spans").alias("spans"),
        F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("errors"))
    return per.agg(
        F.sum(F.when(F.col("ok"), 1).otherwise(0)).cast("bigint").alias("batches_ok"),
        F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("bigint").alias("batches_failed"),
        F.sum("errors").cast("bigint").alias("send_errors"),
        F.sum(F.when(F.col("ok"), F.col("spans")).otherwise(0)).cast("bigint").alias("spans_sent"),
        F.sum(F.when(F.col("ok"), 0).otherwise(F.col("spans"))).cast("bigint").alias("spans_dropped"),
    )


def latency_histogram(attempts: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative ``le`` buckets of send latency plus +Inf, with sum and count.

    One pass of conditional sums (a single partial aggregate per task), then
    the one result row is unpivoted into one row per bound.
    """
    bounds = bounds or pools.LATENCY_BUCKETS
    aggs = [F.sum(F.when(F.col("seconds") <= b, 1).otherwise(0)).cast("bigint").alias(f"b{i}")
            for i, b in enumerate(bounds)]
    one = attempts.agg(*aggs, count_star().alias("cnt"), _r(F.sum("seconds"), 6).alias("total_seconds"))
    pairs = ", ".join(f"'{b}', b{i}" for i, b in enumerate(bounds)) + ", '+Inf', cnt"
    return one.selectExpr(f"stack({len(bounds) + 1}, {pairs}) AS (le, bucket_count)", "total_seconds",
                          "cnt AS total_count")
