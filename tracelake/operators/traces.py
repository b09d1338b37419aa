"""Trace structure: parent/child joins, service edges and tree walks.

Joins are equi-joins on the composite key (TraceId, SpanId), which is unique
per span, so hash partitioning spreads even a huge trace over all tasks; a
parent with very many children is a skewed key on the child side only,
which AQE's skew-join splitting handles (enabled in ``session.configure``).

Tree walks (depth, pre-order rank, critical path) follow pointers by doubling. Tasks that
hold whole traces do so in memory (``operators.walks``); for traces too large for one task
each round joins every open pointer with its target's own pointer, so a tree of
any depth takes a logarithmic number of joins. Every round is written as a
Parquet table into the shared checkpoint folder, which keeps plans short. Spans
under a missing parent or in a cycle of parents end without a root; they are
left out of the walks and returned by ``unreached_spans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategies import cut_lineage
from . import walks
from .verify import count_star


def end_ns():
    return F.col("StartUnixNano") + F.col("Duration")


def _side(spans: DataFrame, prefix: str, cols: list[str]) -> DataFrame:
    return spans.select("TraceId", *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def join_parent_child(spans: DataFrame, how: str = "inner", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every non-root span with its parent (``how='left'`` keeps orphans).
    Columns are prefixed ``c_`` (child) and ``p_`` (parent); ``extra`` adds
    more span columns to both sides."""
    cols = ["SpanId", "ParentSpanId", "SpanName", "SpanKind", "ServiceName", "StatusCode", "StartUnixNano", "Duration",
            *extra]
    c = _side(spans.filter(F.col("ParentSpanId") != ""), "c_", cols)
    p = _side(spans, "p_", [x for x in cols if x != "ParentSpanId"])
    return c.join(p, (c.TraceId == p.TraceId) & (c.c_ParentSpanId == p.p_SpanId), how).select(c.TraceId, *[
        x for x in c.columns + p.columns if x != "TraceId"])


def parent_child_pairs(spans: DataFrame) -> DataFrame:
    j = join_parent_child(spans)
    return j.select(
        "TraceId", F.col("c_SpanId").alias("SpanId"), F.col("c_ParentSpanId").alias("ParentSpanId"),
        F.col("p_ServiceName").alias("parent_service"), F.col("c_ServiceName").alias("child_service"),
        F.col("p_SpanName").alias("parent_name"), F.col("c_SpanName").alias("child_name"),
        (F.col("c_StartUnixNano") - F.col("p_StartUnixNano")).alias("start_offset_ns"),
    )


def client_server_pairs(spans: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """CLIENT spans joined to the SERVER spans they caused (callee child)."""
    j = join_parent_child(spans, extra=extra)
    return j.filter((F.col("p_SpanKind") == "Client") & (F.col("c_SpanKind") == "Server"))


def service_edges(spans: DataFrame) -> DataFrame:
    """Caller → callee service edges: calls, errors, mean client and server latency."""
    pairs = client_server_pairs(spans)
    return pairs.groupBy(F.col("p_ServiceName").alias("caller"), F.col("c_ServiceName").alias("callee")).agg(
        count_star().alias("calls"),
        F.sum(F.when(F.col("p_StatusCode") == "Error", 1).otherwise(0)).cast("bigint").alias("client_errors"),
        F.sum(F.when(F.col("c_StatusCode") == "Error", 1).otherwise(0)).cast("bigint").alias("server_errors"),
        F.round(F.avg("p_Duration"), 3).alias("mean_client_ns"),
        F.round(F.avg("c_Duration"), 3).alias("mean_server_ns"),
    )


def network_gap(spans: DataFrame) -> DataFrame:
    """Client duration minus server duration per edge (time not spent in the callee)."""
    pairs = client_server_pairs(spans).withColumn("gap", F.col("p_Duration") - F.col("c_Duration"))
    return pairs.groupBy(F.col("p_ServiceName").alias("caller"), F.col("c_ServiceName").alias("callee")).agg(
        count_star().alias("calls"), F.round(F.avg("gap"), 3).alias("mean_gap_ns"),
        F.min("gap").alias("min_gap_ns"), F.max("gap").alias("max_gap_ns"))


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent id names no span of the same trace."""
    children = spans.filter(F.col("ParentSpanId") != "").select("TraceId", "SpanId", "ParentSpanId")
    parents = spans.select("TraceId", F.col("SpanId").alias("ParentSpanId"))
    return children.join(parents, ["TraceId", "ParentSpanId"], "left_anti").select("TraceId", "SpanId", "ParentSpanId")


def error_traces(spans: DataFrame) -> DataFrame:
    """All spans of traces that contain at least one error span."""
    bad = spans.filter(F.col("StatusCode") == "Error").select("TraceId")
    return spans.join(bad, "TraceId", "left_semi").select("TraceId", "SpanId", "ServiceName", "StatusCode")


def containment_violations(spans: DataFrame) -> DataFrame:
    """Children that start before or end after their parent."""
    j = join_parent_child(spans)
    c_end = F.col("c_StartUnixNano") + F.col("c_Duration")
    p_end = F.col("p_StartUnixNano") + F.col("p_Duration")
    bad = j.filter((F.col("c_StartUnixNano") < F.col("p_StartUnixNano")) | (c_end > p_end))
    return bad.select("TraceId", F.col("c_SpanId").alias("SpanId"), F.col("c_ParentSpanId").alias("ParentSpanId"),
                      F.col("c_StartUnixNano").alias("child_start_ns"), c_end.alias("child_end_ns"),
                      F.col("p_StartUnixNano").alias("parent_start_ns"), p_end.alias("parent_end_ns"))


def dag_violations(spans: DataFrame, services: DataFrame) -> DataFrame:
    """Edges whose callee index is not strictly above the caller's (a cycle risk)."""
    idx = services.select(F.col("name"), F.col("service_idx"))
    e = service_edges(spans)
    e = (e.join(idx.withColumnRenamed("name", "caller").withColumnRenamed("service_idx", "caller_idx"), "caller", "left")
         .join(idx.withColumnRenamed("name", "callee").withColumnRenamed("service_idx", "callee_idx"), "callee", "left"))
    return (e.filter(F.col("callee_idx").isNull() | F.col("caller_idx").isNull() | (F.col("callee_idx") <= F.col("caller_idx")))
            .select("caller", "callee", "caller_idx", "callee_idx", "calls"))


# --------------------------------------------------------------------------
# tree walks
# --------------------------------------------------------------------------
def unique_spans(spans: DataFrame, *cols: str) -> DataFrame:
    """One row per (TraceId, SpanId): of retried copies the smallest by ``cols``."""
    return spans.groupBy("TraceId", "SpanId").agg(F.min(F.struct(*cols)).alias("_s")).select("TraceId", "SpanId", "_s.*")


def _largest_trace(nodes: DataFrame) -> int:
    return nodes.groupBy("TraceId").count().agg(F.max("count")).first()[0] or 0


def follow_pointers(nodes: DataFrame, sizes: bool = False) -> DataFrame:
    """Follow each node's pointer to the end of its chain.

    ``nodes``: unique (TraceId, SpanId), ``up`` (SpanId of the next node, null at
    an end) and ``w`` (bigint). Returns (TraceId, SpanId, end, total, n): the
    chain's last node, the sum of ``w`` and the number of nodes on it. Chains that
    lead to a missing node or into a cycle are left out. With ``sizes``, also
    ``size``: the number of nodes whose chains pass through this one, itself included.

    Pointer doubling: before round k an open pointer spans 2^k nodes. A chain is at
    most as long as its trace has nodes, which bounds the rounds; what is
    still open then is in a cycle. Finished rows are not written again.
    """
    first = cut_lineage(nodes.select("TraceId", "SpanId", "up", F.col("w").cast("bigint").alias("total"),
                                     F.lit(1).cast("bigint").alias("n"),
                                     F.when(F.col("up").isNull(), F.col("SpanId")).alias("end")), "walk-0")
    rounds, known, now = max(1, _largest_trace(first)).bit_length(), first.limit(0), first
    size = first.select("TraceId", "SpanId", F.lit(1).cast("bigint").alias("size")) if sizes else None
    for k in range(rounds):
        step = now.filter("up IS NOT NULL")
        if step.isEmpty():
            break
        if sizes:  # a node's nodes within 2^k, and those of the nodes 2^k below it
            below = (step.join(size, ["TraceId", "SpanId"]).groupBy("TraceId", F.col("up").alias("SpanId"))
                     .agg(F.sum("size").alias("more")))
            size = cut_lineage(size.join(below, ["TraceId", "SpanId"], "left").select(
                "TraceId", "SpanId", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        known = known.unionByName(now.filter("up IS NULL"))
        target = known.unionByName(step).select(
            "TraceId", F.col("SpanId").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"),
            F.col("n").alias("_n"), F.col("end").alias("_end"))
        # an inner join: a pointer to a missing node leaves the walk
        now = cut_lineage(step.join(target, ["TraceId", "up"]).select(
            "TraceId", "SpanId", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("n") + F.col("_n")).alias("n"), F.col("_end").alias("end")), f"walk-{k + 1}")
    done = known.unionByName(now.filter("up IS NULL")).filter("end IS NOT NULL").select(
        "TraceId", "SpanId", "end", "total", "n")
    return done.join(size, ["TraceId", "SpanId"]) if sizes else done


def _tree_nodes(spans: DataFrame) -> DataFrame:
    return unique_spans(spans, "ParentSpanId", "StartUnixNano")


def _up(parent: str = "ParentSpanId"):
    return F.when(F.col(parent) != "", F.col(parent))


def _walked(spans: DataFrame, cols: list[str], solve, schema: str, by_pointers) -> DataFrame:
    """A walk by tasks that hold whole traces (``walks.solve_traces``); by joined pointers where traces are too large."""
    whole, large = walks.split_by_size(spans)
    out = walks.solve_traces(whole, cols, solve, schema)
    return out if large is None else out.unionByName(by_pointers(large).select(*out.columns))


def _depths(spans: DataFrame) -> DataFrame:
    """(TraceId, SpanId, depth) of every unique span; depth is null for spans that no root leads to."""
    return _walked(spans, ["ParentSpanId", "StartUnixNano"], walks.depths, "TraceId string, SpanId string, depth int",
                   lambda large: large.select("TraceId", "SpanId").distinct().join(
                       _pointer_depths(large).select(F.col("TraceId").alias("_t"), F.col("SpanId").alias("_s"), "depth"),
                       F.col("TraceId").eqNullSafe(F.col("_t")) & F.col("SpanId").eqNullSafe(F.col("_s")), "left"))


def span_depths(spans: DataFrame) -> DataFrame:
    """(TraceId, SpanId, depth) of every span under a root (root = depth 1)."""
    return _depths(spans).filter("depth IS NOT NULL")


def _pointer_depths(spans: DataFrame) -> DataFrame:
    nodes = _tree_nodes(spans).select("TraceId", "SpanId", _up().alias("up"), F.lit(1).alias("w"))
    return follow_pointers(nodes).select("TraceId", "SpanId", F.col("n").cast("int").alias("depth"))


def trace_depth(spans: DataFrame) -> DataFrame:
    """Max depth and reached spans per trace."""
    return span_depths(spans).groupBy("TraceId").agg(
        F.max("depth").alias("max_depth"), count_star().alias("spans_reached"))


def unreached_spans(spans: DataFrame) -> DataFrame:
    """Spans that no root leads to: their chain of parents ends in a missing span or
    is a cycle."""
    # a span without one of its ids is never found again, root or not
    return _depths(spans).filter("depth IS NULL OR TraceId IS NULL OR SpanId IS NULL").select("TraceId", "SpanId")


def preorder_ranks(spans: DataFrame) -> DataFrame:
    """(TraceId, SpanId, preorder_rank): the place of every reached span in its trace's
    depth-first order, siblings (and roots) by start, then SpanId.

    A span comes one place after its parent, plus the sizes of its earlier siblings'
    subtrees; the rank is the sum of these offsets up to the root. No path strings,
    no window over a trace: a trace with millions of spans is spread over all tasks.
    """
    return _walked(spans, ["ParentSpanId", "StartUnixNano"], walks.preorder,
                   "TraceId string, SpanId string, preorder_rank bigint", _pointer_preorder)


def _pointer_preorder(spans: DataFrame) -> DataFrame:
    from ..plans.scan import group_scan

    nodes = cut_lineage(_tree_nodes(spans), "tree-nodes")
    sizes = follow_pointers(nodes.select("TraceId", "SpanId", _up().alias("up"), F.lit(1).alias("w")), sizes=True)
    sized = nodes.join(sizes.select("TraceId", "SpanId", "size"), ["TraceId", "SpanId"])
    placed = group_scan(sized, ["TraceId", "ParentSpanId"], ["StartUnixNano", "SpanId"], "size")
    ranked = follow_pointers(placed.select("TraceId", "SpanId", _up().alias("up"), (F.col("prev_sum") + 1).alias("w")))
    return ranked.select("TraceId", "SpanId", F.col("total").alias("preorder_rank"))


def preorder_cap(spans: DataFrame, budget: F.Column | None = None) -> DataFrame:
    """Keep the first ``budget`` spans of every trace in depth-first order.

    ``budget`` is a column over TraceId (default: 5 + a 0..15 draw from the
    TraceId, the 5-20 span budget)."""
    if budget is None:
        budget = F.lit(5) + F.pmod(F.conv(F.substring("TraceId", 9, 4), 16, 10).cast("int"), F.lit(16))
    return preorder_ranks(spans).filter(F.col("preorder_rank") <= budget).select(
        "TraceId", "SpanId", F.col("preorder_rank").cast("int").alias("preorder_rank"))


def self_time(spans: DataFrame) -> DataFrame:
    """Span duration minus the union of its children's intervals (clipped to
    the span).

    Children sorted by start: a child adds ``e - max(s, M)`` new coverage,
    where M is the largest end among the children before it, a running maximum
    within a parent from the range-partitioned ``plans.scan.group_scan``: a parent
    with millions of children is spread over many tasks.
    """
    from ..plans.scan import group_scan

    j = join_parent_child(spans)
    p_end = F.col("p_StartUnixNano") + F.col("p_Duration")
    iv = j.select(
        "TraceId", F.col("c_ParentSpanId").alias("SpanId"), F.col("c_SpanId").alias("child"),
        F.greatest("c_StartUnixNano", "p_StartUnixNano").alias("s"),
        F.least(F.col("c_StartUnixNano") + F.col("c_Duration"), p_end).alias("e"),
    ).filter(F.col("e") > F.col("s"))
    scanned = group_scan(iv, ["TraceId", "SpanId"], ["s", "e", "child"], "e")
    new_cov = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.col("prev_max"), F.col("s"))))
    covered = scanned.groupBy("TraceId", "SpanId").agg(F.sum(new_cov).alias("child_ns"))
    return (spans.select("TraceId", "SpanId", "Duration").join(covered, ["TraceId", "SpanId"], "left")
            .select("TraceId", "SpanId", (F.col("Duration") - F.coalesce(F.col("child_ns"), F.lit(0))).alias("self_ns")))


def critical_path(spans: DataFrame) -> DataFrame:
    """Per trace, the chain of latest-ending children from the root: length,
    leaf span and leaf name. The 'last child' of every span is one
    aggregation (max_by on (end, SpanId)); only roots and last children can lie on a
    chain, and the pointers to last children are followed by doubling."""
    return _walked(spans, ["ParentSpanId", "StartUnixNano", "Duration", "SpanName"], walks.critical,
                   "TraceId string, cp_spans int, cp_leaf_span_id string, cp_leaf_name string", _pointer_critical)


def _pointer_critical(spans: DataFrame) -> DataFrame:
    nodes = cut_lineage(unique_spans(spans, "ParentSpanId", "StartUnixNano", "Duration", "SpanName"), "path-nodes")
    last = (nodes.filter(F.col("ParentSpanId") != "").groupBy("TraceId", F.col("ParentSpanId").alias("SpanId"))
            .agg(F.max_by("SpanId", F.struct(end_ns(), F.col("SpanId"))).alias("up")))
    on_path = last.select("TraceId", F.col("up").alias("SpanId")).union(
        nodes.filter(F.col("ParentSpanId") == "").select("TraceId", "SpanId"))
    chains = follow_pointers(on_path.join(last, ["TraceId", "SpanId"], "left").withColumn("w", F.lit(1)))
    roots = nodes.filter(F.col("ParentSpanId") == "").select("TraceId", "SpanId")
    leaves = nodes.select("TraceId", F.col("SpanId").alias("cp_leaf_span_id"), F.col("SpanName").alias("cp_leaf_name"))
    return (chains.join(roots, ["TraceId", "SpanId"]).select(
        "TraceId", F.col("n").cast("int").alias("cp_spans"), F.col("end").alias("cp_leaf_span_id"))
        .join(leaves, ["TraceId", "cp_leaf_span_id"]).select("TraceId", "cp_spans", "cp_leaf_span_id", "cp_leaf_name"))
