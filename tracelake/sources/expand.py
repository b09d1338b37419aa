"""Grow span trees from trace seeds through the service topology.

Every node's choices are keyed draws on its path key ``x:<trace>:<path>``
(path: one character per level, '0'-'2' for the i-th child, 's' for the
callee SERVER span under a CLIENT call), so the whole tree is a pure function
of the seed and the catalog. That turns the recursive depth-first generator
into a level-by-level job: each level is one broadcast join of the frontier
with the (small, bounded) operation table and an ``explode`` over the child
count, and the span budget becomes a pre-order cut — sorting paths
lexicographically is depth-first order, so the budget keeps the first
``budget`` nodes by path in every trace.

Draws of a node (digest ``md5(key || '#e')``, two 60-bit parses x1, x2):
  root:  x1 bits 0-15 service, 16-31 entry op
  child: x1 bits 0-15 operation, 16-47 start offset (uniform)
  all:   x1 bits 48-59 number of children (1-3); x2 two uniforms for the
         log-normal duration (Box-Muller).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bits, hex60
from ..plans.strategies import broadcast_bounded, cut_lineage
from . import catalog

MAX_DEPTH = 6        # children are added while depth <= 6
INTERNAL_DEPTH = 3   # an internal op recurses only while depth < 3
TWO_POW_30 = float(1 << 30)
TWO_POW_32 = float(1 << 32)


def _draws(key: Column) -> list[Column]:
    e = F.md5(F.concat(key, F.lit("#e")))
    return [hex60(e, 1).alias("x1"), hex60(e, 16).alias("x2")]


def _lognormal(mu: Column, sigma: Column) -> Column:
    u1 = (bits("x2", 0, 0x3FFFFFFF) + 1) / F.lit(TWO_POW_30)
    u2 = bits("x2", 30, 0x3FFFFFFF) / F.lit(TWO_POW_30)
    normal = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.greatest(F.lit(1000), F.floor(F.exp(mu + sigma * normal)).cast("bigint"))


def _n_children() -> Column:
    return (bits("x1", 48, 0xFFF) % 3 + 1).cast("int")


OP_COLS = ["op_type", "kind", "method", "route", "db_system", "db_op", "collection", "peer"]


def expand_nodes(seeds: DataFrame, ops: DataFrame, n_services: int, max_depth: int = MAX_DEPTH,
                 internal_depth: int = INTERNAL_DEPTH) -> DataFrame:
    """All tree nodes (uncapped): trace_no, path, key, parent_key, svc,
    op_type, kind, method, route, db_system, db_op, db_coll, peer,
    start_ns, dur_ns, budget."""
    bound = n_services * 16
    entry = broadcast_bounded(ops.filter(F.col("role") == "entry").select(
        F.col("service_idx").alias("svc"), "op_idx", *OP_COLS, "mu_log", "sigma_log"), bound)
    child = broadcast_bounded(ops.filter(F.col("role") == "child").select(
        F.col("service_idx").alias("svc"), "op_idx", *OP_COLS, "mu_log", "sigma_log"), bound)
    counts = broadcast_bounded(ops.groupBy(F.col("service_idx").alias("svc")).agg(
        F.sum(F.when(F.col("role") == "entry", 1).otherwise(0)).cast("int").alias("n_entry"),
        F.sum(F.when(F.col("role") == "child", 1).otherwise(0)).cast("int").alias("n_child")), bound)

    key = F.concat(F.lit("x:"), F.col("trace_no").cast("string"))
    roots = seeds.select("trace_no", "start_ns", "budget", key.alias("key"), *_draws(key))
    roots = roots.withColumn("svc", (bits("x1", 0) % n_services).cast("int")).join(counts, "svc")
    roots = roots.withColumn("op_idx", (bits("x1", 16) % F.col("n_entry")).cast("int")).join(entry, ["svc", "op_idx"])
    roots = roots.select(
        "trace_no", "budget", F.lit("").alias("path"), "key", F.lit(None).cast("string").alias("parent_key"),
        "svc", *[c for c in OP_COLS], "start_ns", _lognormal(F.col("mu_log"), F.col("sigma_log")).alias("dur_ns"),
        F.lit(1).alias("depth"), F.lit(True).alias("expand"), "x1")
    level = cut_lineage(roots, "expand-level")
    levels = [level]
    for _ in range(2 * max_depth + 2):
        parents = level.filter(F.col("expand") & (F.col("depth") <= max_depth)).join(counts, "svc")
        kids = parents.select(
            "trace_no", "budget", F.col("path").alias("ppath"), F.col("key").alias("pkey"), "svc", "n_child",
            F.col("start_ns").alias("p_start"), F.col("dur_ns").alias("p_dur"), "depth",
            F.explode(F.sequence(F.lit(0), _n_children() - 1)).alias("i"))
        ckey = F.concat(F.col("pkey"), F.col("i").cast("string"))
        kids = kids.select("*", ckey.alias("key"), *_draws(ckey))
        kids = kids.withColumn("op_idx", (bits("x1", 0) % F.col("n_child")).cast("int")).join(child, ["svc", "op_idx"])
        offset = F.floor(F.col("p_dur") * F.lit(0.7) * (bits("x1", 16, 0xFFFFFFFF) / F.lit(TWO_POW_32))).cast("bigint")
        kids = kids.withColumn("offset", offset).withColumn("rem", F.col("p_dur") - F.col("offset"))
        raw = _lognormal(F.col("mu_log"), F.col("sigma_log"))
        kids = kids.withColumn("c_dur", F.when((raw > F.col("rem")) & (F.col("rem") > 0), F.col("rem")).otherwise(raw))
        calls = kids.select(
            "trace_no", "budget", F.concat(F.col("ppath"), F.col("i").cast("string")).alias("path"), "key",
            F.col("pkey").alias("parent_key"), "svc", *OP_COLS,
            (F.col("p_start") + F.col("offset")).alias("start_ns"), F.col("c_dur").alias("dur_ns"),
            F.col("depth"), "x1")
        # the callee SERVER span of a remote call, and which nodes expand next
        roles = F.explode(F.when(F.col("peer") >= 0, F.array(F.lit("c"), F.lit("s"))).otherwise(F.array(F.lit("c"))))
        both = calls.select("*", roles.alias("role"))
        is_s = F.col("role") == "s"
        skey = F.concat(F.col("key"), F.lit("s"))
        nxt = both.select(
            "trace_no", "budget",
            F.when(is_s, F.concat(F.col("path"), F.lit("s"))).otherwise(F.col("path")).alias("path"),
            F.when(is_s, skey).otherwise(F.col("key")).alias("key"),
            F.when(is_s, F.col("key")).otherwise(F.col("parent_key")).alias("parent_key"),
            F.when(is_s, F.col("peer")).otherwise(F.col("svc")).alias("svc"),
            F.when(is_s, F.when(F.col("op_type") == "rpc_client", F.lit("rpc_server")).otherwise(F.lit("http_server")))
            .otherwise(F.col("op_type")).alias("op_type"),
            F.when(is_s, F.lit("Server")).otherwise(F.col("kind")).alias("kind"),
            "method", "route", "db_system", "db_op", "collection",
            F.when(is_s, F.lit(-1)).otherwise(F.col("peer")).alias("peer"),
            F.when(is_s, F.col("start_ns") + F.floor(F.col("dur_ns") * F.lit(0.1)).cast("bigint"))
            .otherwise(F.col("start_ns")).alias("start_ns"),
            F.when(is_s, F.floor(F.col("dur_ns") * F.lit(0.85)).cast("bigint")).otherwise(F.col("dur_ns")).alias("dur_ns"),
            F.when(is_s | ((F.col("op_type") == "internal") & (F.col("depth") < internal_depth)), F.col("depth") + 1)
            .otherwise(F.col("depth")).alias("depth"),
            (is_s | ((F.col("peer") < 0) & (F.col("op_type") == "internal") & (F.col("depth") < internal_depth)))
            .alias("expand"),
        )
        # every node's own draws (a server's from its own key)
        nxt = nxt.select("*", _draws(F.col("key"))[0])
        level = cut_lineage(nxt, "expand-level")
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def preorder_keep(nodes: DataFrame) -> DataFrame:
    """Keep the first ``budget`` nodes of each trace in depth-first order.

    A trace's node count is bounded by the depth cap and fan-out (at most
    3 children per level), so ranking inside one trace is a bounded window."""
    from pyspark.sql import Window

    w = Window.partitionBy("trace_no").orderBy("path")
    return nodes.withColumn("preorder_rank", F.row_number().over(w)).filter(F.col("preorder_rank") <= F.col("budget"))


def trace_expand(seeds: DataFrame, n_services: int = 30, max_depth: int = MAX_DEPTH,
                 internal_depth: int = INTERNAL_DEPTH) -> DataFrame:
    """Span table grown from seeds (trace_no, start_ns, budget)."""
    from .fixtures import decorate

    spark = seeds.sparkSession
    svc = catalog.services(spark, n_services)
    ops = catalog.operations(svc, n_services)
    kept = preorder_keep(expand_nodes(seeds, ops, n_services, max_depth, internal_depth))
    skeleton = kept.select(
        F.col("trace_no").alias("k"), F.lit("x").alias("role"), "key", "parent_key", "svc", "op_type", "kind",
        "start_ns", "dur_ns", F.lit(0).alias("op_draw"),
        F.when(F.col("op_type") == "rpc_client", F.col("peer")).cast("int").alias("peer"),
        "method", "route", "db_system", "db_op", F.col("collection").alias("db_coll"))
    return decorate(skeleton, svc, max_services=n_services)
