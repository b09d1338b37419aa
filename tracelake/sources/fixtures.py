"""Span and attempt tables derived from relational rows.

``spans_from_tables`` turns every order into one trace: the order is the root
span, every line item a call beneath it, and HTTP/RPC calls get the callee's
SERVER span in a higher-indexed service. Everything is integer arithmetic and
keyed md5 draws, so the same rows come out of Spark and DuckDB.

Identity: a line is identified by its full content
(linenumber, partkey, suppkey, quantity, price, shipdate), which is unique
within an order. This avoids a per-order window (a hot order would otherwise
be numbered inside one task): every span row is computed from its own join
row only, and the only shuffle is the orders ⋈ lineitem join on the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pools
from ..functions.scalars import (
    service_name_of,
    bits,
    client_ip,
    db_port,
    hex60,
    hex_draw,
    idiv,
    pick,
    query_text,
    ts_from_ns,
)
from ..plans.strategies import broadcast_bounded
from . import catalog

N_FIXTURE_SERVICES = len(pools.SERVICE_NAMES)  # 24: o_custkey % 24
LAST_SERVICE = N_FIXTURE_SERVICES - 1

EVENT_TYPE = T.ArrayType(T.StructType([
    T.StructField("Timestamp", T.TimestampType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Attributes", T.MapType(T.StringType(), T.StringType())),
]))
LINK_TYPE = T.ArrayType(T.StructType([
    T.StructField("TraceId", T.StringType()),
    T.StructField("SpanId", T.StringType()),
    T.StructField("TraceState", T.StringType()),
    T.StructField("Attributes", T.MapType(T.StringType(), T.StringType())),
]))


def _days(c: str) -> Column:
    return F.datediff(F.to_date(F.col(c)), F.lit("1970-01-01").cast("date")).cast("bigint")


def _num_key(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint").cast("string")


def _op_draw(h: Column) -> Column:
    """Route / db pick of a span: 12 bits of its digest (shared by a call and its callee)."""
    return bits(hex60(h, 17), 48, 0xFFF).cast("int")


def span_skeleton(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Tree shape, intervals and operation family of every span.

    Columns: k, role (r/c/s), key, parent_key, svc, op_type, kind, start_ns,
    dur_ns, op_draw (route / db pick shared by a call and its callee), peer.
    """
    o = orders.select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_custkey") % N_FIXTURE_SERVICES).cast("int").alias("svc"),
        ((_days("o_orderdate") * 86400 + F.col("o_orderkey") % 86400) * 1_000_000_000).alias("root_start"),
        (F.floor("o_totalprice").cast("bigint") * 1000 + 1000).alias("root_dur"),
        (F.col("o_orderpriority") == "5-LOW").alias("consumer"),
    )
    root_key = F.concat(F.lit("r:"), F.col("k").cast("string"))
    roots = o.select(
        "k", F.lit("r").alias("role"), root_key.alias("key"),
        F.lit(None).cast("string").alias("parent_key"), "svc",
        F.when(F.col("consumer"), F.lit("msg_consumer")).otherwise(F.lit("http_server")).alias("op_type"),
        F.when(F.col("consumer"), F.lit("Consumer")).otherwise(F.lit("Server")).alias("kind"),
        F.col("root_start").alias("start_ns"), F.col("root_dur").alias("dur_ns"),
        _op_draw(F.md5(root_key)).alias("op_draw"),
        F.lit(None).cast("int").alias("peer"),
    )

    line_key = F.concat_ws(
        ":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), _num_key("l_quantity"), _num_key("l_extendedprice"),
        F.col("ship_days").cast("string"))
    lines = lineitem.select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        _days("l_shipdate").cast("int").alias("ship_days"))
    # both sides grow with the data: a shuffle join, of the plain columns, which are shorter than the key made of them
    j = lines.join(o.hint("merge"), "k").select(
        "k", "svc", "root_start", "root_dur", "l_partkey", line_key.alias("lkey"), (F.col("l_suppkey") % 4).cast("int").alias("typ"),
        (F.floor("l_extendedprice").cast("bigint") * 1000 + 1000).alias("line_dur"))
    off = idiv(F.col("root_dur") * 7 * (F.col("l_partkey") % 100), 1000)
    call_key = F.concat(F.lit("c:"), F.col("k").cast("string"), F.lit(":"), F.col("lkey"))
    calls = j.select(
        "k", "svc", "typ", "root_dur",
        call_key.alias("call_key"),
        (F.col("root_start") + off).alias("call_start"),
        F.least(F.col("line_dur"), F.col("root_dur") - off).alias("call_dur"),
        F.when(F.col("svc") < LAST_SERVICE,
               F.col("svc") + 1 + F.col("l_partkey") % (F.lit(LAST_SERVICE) - F.col("svc"))).cast("int").alias("peer"),
    ).withColumn("op_draw", _op_draw(F.md5("call_key")))
    has_callee = F.col("typ").isin(0, 1) & (F.col("svc") < LAST_SERVICE)
    roles = F.explode(F.when(has_callee, F.array(F.lit("c"), F.lit("s"))).otherwise(F.array(F.lit("c"))))
    callish = calls.select("*", roles.alias("role"))
    is_s = F.col("role") == "s"
    call_type = (F.when(F.col("typ") == 2, F.lit("db_client")).when(F.col("typ") == 3, F.lit("internal"))
                 .when((F.col("typ") == 1) & F.col("peer").isNotNull(), F.lit("rpc_client"))
                 .otherwise(F.lit("http_client")))
    callee_type = F.when(F.col("typ") == 1, F.lit("rpc_server")).otherwise(F.lit("http_server"))
    children = callish.select(
        "k", "role",
        F.when(is_s, F.concat(F.lit("s"), F.substring("call_key", 2, 1 << 20))).otherwise(F.col("call_key")).alias("key"),
        F.when(is_s, F.col("call_key")).otherwise(F.concat(F.lit("r:"), F.col("k").cast("string"))).alias("parent_key"),
        F.when(is_s, F.col("peer")).otherwise(F.col("svc")).alias("svc"),
        F.when(is_s, callee_type).otherwise(call_type).alias("op_type"),
        F.when(is_s, F.lit("Server")).when(F.col("typ") == 3, F.lit("Internal")).otherwise(F.lit("Client")).alias("kind"),
        F.when(is_s, F.col("call_start") + idiv(F.col("call_dur"), 10)).otherwise(F.col("call_start")).alias("start_ns"),
        F.when(is_s, idiv(F.col("call_dur") * 85, 100)).otherwise(F.col("call_dur")).alias("dur_ns"),
        "op_draw",
        F.when(is_s, F.lit(None).cast("int")).otherwise(F.col("peer")).alias("peer"),
    )
    # A call of type 1 only has an RPC peer name when a callee service exists.
    children = children.withColumn("peer", F.when(F.col("op_type") == "rpc_client", F.col("peer")))
    return roots.unionByName(children)


def decorate(skeleton: DataFrame, services: DataFrame, max_services: int = N_FIXTURE_SERVICES) -> DataFrame:
    """Ids, names, status, attributes and events of every skeleton row, in
    the span-table column layout (map attributes) plus ``StartUnixNano``.

    Operation details (method, route, db_system, db_op, db_coll) are taken
    from the skeleton when it carries them (catalog-driven expansion), else
    picked from the pools by ``op_draw``."""
    given_cols = [c for c in ("method", "route", "db_system", "db_op", "db_coll") if c in skeleton.columns]
    for c in given_cols:
        skeleton = skeleton.withColumnRenamed(c, f"_given_{c}")
    given = {c: F.col(f"_given_{c}") for c in given_cols}
    s = skeleton.select(
        "*",
        F.md5("key").alias("h"),
        F.md5(F.concat(F.col("key"), F.lit("#"))).alias("a"),
    )
    # Draws: one 60-bit parse per digest, cut into 16-bit (12-bit) slices.
    #   hb = h[17..31]: error (bits 0-15), event (16-31), status (32-47), op pick (48-59)
    #   a1 = a[1..15]: user agent, ip octet 1, ip octet 2, event detail (48-59)
    #   a2 = a[16..30]: ip octet 3, thread, body size
    s = s.select("*", hex60("h", 17).alias("hb"), hex60("a", 1).alias("a1"), hex60("a", 16).alias("a2"))
    s = s.select(
        "*",
        (F.pmod(bits("hb", 0), F.lit(1000)) < int(pools.ERROR_RATE * 1000)).alias("is_err"),
        (F.pmod(bits("hb", 16), F.lit(10)) == 0).alias("info_draw"),
        bits("hb", 32).alias("status_draw"),
    )
    status_draw = F.col("status_draw")
    is_err = F.col("is_err")
    methods = [m for m, _ in pools.HTTP_ROUTES]
    routes = [r for _, r in pools.HTTP_ROUTES]
    s = s.select(
        "*",
        F.substring("h", 1, 16).alias("SpanId"),
        F.when(F.col("parent_key").isNull(), F.lit("")).otherwise(F.substring(F.md5("parent_key"), 1, 16)).alias("ParentSpanId"),
        F.md5(F.concat(F.lit("t:"), F.col("k").cast("string"))).alias("TraceId"),
        service_name_of("svc").alias("ServiceName"),
        service_name_of("peer").alias("peer_name"),
        *[given.get(c, default).alias(c) for c, default in (
            ("method", pick(methods, F.col("op_draw"))),
            ("route", pick(routes, F.col("op_draw"))),
            ("db_system", pick([x[0] for x in pools.DB_SYSTEMS], F.col("op_draw"))),
            ("db_op", pick([x[1] for x in pools.DB_SYSTEMS], F.col("op_draw"))),
            ("db_coll", pick([x[2] for x in pools.DB_SYSTEMS], F.col("op_draw"))))],
        (~is_err & F.col("info_draw")).alias("has_info"),
        F.when(is_err, pick(pools.HTTP_STATUS_ERROR, status_draw))
        .otherwise(pick(pools.HTTP_STATUS_OK, status_draw)).cast("string").alias("http_code"),
        F.when(is_err, pick(pools.GRPC_STATUS_ERROR, status_draw)).otherwise(F.lit(0)).cast("string").alias("grpc_code"),
    )
    t = F.col("op_type")
    http_common = [
        F.lit("http.request.method"), F.col("method"),
        F.lit("url.path"), F.col("route"),
        F.lit("url.scheme"), F.lit("http"),
        F.lit("network.protocol.version"), F.lit("1.1"),
        F.lit("server.address"), F.lit(pools.PEER_HOST),
        F.lit("server.port"), F.lit("8080"),
        F.lit("http.response.status_code"), F.col("http_code"),
    ]
    http_server_extra = [
        F.lit("client.address"), client_ip(bits("a1", 16), bits("a1", 32), bits("a2", 0)),
        F.lit("user_agent.original"), pick(pools.USER_AGENTS, bits("a1", 0)),
        F.lit("url.full"), F.concat(F.lit("http://" + pools.PEER_HOST), F.col("route")),
    ]
    rpc_service = F.when(t == "rpc_server", F.col("ServiceName")).otherwise(F.col("peer_name"))
    attrs = (
        F.when(t == "http_server", F.create_map(*http_common, *http_server_extra))
        .when(t == "http_client", F.create_map(*http_common))
        .when(t == "db_client", F.create_map(
            F.lit("db.system"), F.col("db_system"),
            F.lit("db.namespace"), F.lit(pools.NAMESPACE),
            F.lit("db.operation.name"), F.col("db_op"),
            F.lit("db.collection.name"), F.col("db_coll"),
            F.lit("server.address"), F.concat(F.col("db_system"), F.lit(".db.svc.cluster.local")),
            F.lit("server.port"), db_port("db_system").cast("string"),
            F.lit("db.query.text"), query_text("db_op", "db_coll")))
        .when(t.isin("rpc_client", "rpc_server"), F.create_map(
            F.lit("rpc.system"), F.lit("grpc"),
            F.lit("rpc.service"), F.concat(rpc_service, F.lit(".v1.Service")),
            F.lit("rpc.method"), F.lit("Get"),
            F.lit("rpc.grpc.status_code"), F.col("grpc_code")))
        .when(t == "msg_consumer", F.create_map(
            F.lit("messaging.system"), F.lit("kafka"),
            F.lit("messaging.destination.name"), F.concat(F.col("ServiceName"), F.lit(".events")),
            F.lit("messaging.operation"), F.lit("process"),
            F.lit("messaging.message.body.size"), (F.lit(256) + F.pmod(bits("a2", 32), F.lit(8192))).cast("string")))
        .otherwise(F.create_map(
            F.lit("code.namespace"), F.concat(F.lit("compute."), F.col("ServiceName")),
            F.lit("thread.name"), F.concat(F.lit("worker-"), F.pmod(bits("a2", 16), F.lit(16)).cast("string"))))
    )
    span_name = (
        F.when(t.isin("http_server", "http_client"), F.concat_ws(" ", "method", "route"))
        .when(t == "db_client", F.concat_ws(" ", "db_op", "db_coll"))
        .when(t == "rpc_client", F.concat(F.lit("grpc."), F.col("peer_name"), F.lit("/Get")))
        .when(t == "rpc_server", F.concat(F.col("ServiceName"), F.lit(".v1.Service/Get")))
        .when(t == "msg_consumer", F.concat(F.col("ServiceName"), F.lit(".events process")))
        .otherwise(F.concat(F.lit("compute."), F.col("ServiceName")))
    )
    event_pick = bits("a1", 48, 0xFFF)
    events = (
        F.when(F.col("is_err"), F.array(F.struct(
            ts_from_ns(F.col("start_ns") + idiv("dur_ns", 2)).alias("Timestamp"),
            F.lit("exception").alias("Name"),
            F.create_map(
                F.lit("exception.type"), pick(pools.EXCEPTION_TYPES, event_pick),
                F.lit("exception.message"), F.lit(pools.EXCEPTION_MESSAGE),
                F.lit("exception.escaped"), F.lit("false")).alias("Attributes"))))
        .when(F.col("has_info"), F.array(F.struct(
            ts_from_ns(F.col("start_ns") + idiv("dur_ns", 3)).alias("Timestamp"),
            F.lit("processing").alias("Name"),
            F.create_map(F.lit("stage"), pick(pools.INFO_STAGES, event_pick)).alias("Attributes"))))
        .otherwise(F.array().cast(EVENT_TYPE))
    )
    res = broadcast_bounded(
        services.select(F.col("service_idx").alias("svc"), F.col("resource_attributes").alias("ResourceAttributes")),
        max_rows=max_services)
    out = s.select(
        ts_from_ns("start_ns").alias("Timestamp"),
        "TraceId", "SpanId", "ParentSpanId",
        F.lit("").alias("TraceState"),
        span_name.alias("SpanName"),
        F.col("kind").alias("SpanKind"),
        "ServiceName", "svc",
        F.lit(pools.SCOPE_NAME).alias("ScopeName"),
        F.lit(pools.SCOPE_VERSION).alias("ScopeVersion"),
        attrs.alias("SpanAttributes"),
        F.col("dur_ns").alias("Duration"),
        F.when(F.col("is_err"), F.lit("Error")).otherwise(F.lit("Unset")).alias("StatusCode"),
        F.when(F.col("is_err"), F.lit(pools.STATUS_MESSAGE_ERROR)).otherwise(F.lit("")).alias("StatusMessage"),
        events.alias("Events"),
        F.array().cast(LINK_TYPE).alias("Links"),
        F.col("start_ns").alias("StartUnixNano"),
    )
    out = out.join(res, "svc", "left")
    return out.select(*SPAN_COLUMNS)


# Map-layout column order (the 22 table columns with Events/Links nested) plus
# StartUnixNano, which keeps full nanosecond precision.
SPAN_COLUMNS = [
    "Timestamp", "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind",
    "ServiceName", "ResourceAttributes", "ScopeName", "ScopeVersion", "SpanAttributes",
    "Duration", "StatusCode", "StatusMessage", "Events", "Links", "StartUnixNano",
]


def spans_from_tables(orders: DataFrame, lineitem: DataFrame, services: DataFrame | None = None) -> DataFrame:
    spark = orders.sparkSession
    if services is None:
        services = catalog.services(spark, N_FIXTURE_SERVICES)
    return decorate(span_skeleton(orders, lineitem), services)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``spans`` fixture of a driver data directory."""
    from ..session import configure

    configure(spark)
    # the JVM runs methods of over 8,000 bytes uncompiled; the projections that build spans are larger as one method
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spans_from_tables(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"))


def attempts_from_events(events: DataFrame) -> DataFrame:
    """Send log of batches: one attempt per event, a retry for failed ones.

    batch_id = event_id; attempt 0 fails when event_type = 'error', and its
    retry (attempt 1) succeeds when event_id is even. ``spans`` comes from
    ``props.k``; latency ``seconds`` = value / 1000.
    """
    base = events.select(
        F.col("event_id").alias("batch_id"),
        (F.col("event_type") == "error").alias("failed_first"),
        F.get_json_object("props", "$.k").cast("int").alias("spans"),
        (F.col("value") / 1000.0).alias("seconds"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    tries = F.explode(F.when(F.col("failed_first"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.select("*", tries.alias("attempt")).select(
        "batch_id", "attempt",
        F.when(F.col("attempt") == 0, ~F.col("failed_first")).otherwise(F.col("batch_id") % 2 == 0).alias("ok"),
        "spans", "seconds", "ts",
    )


def seeds_from_orders(orders: DataFrame, spans_min: int = 5, spans_max: int = 20) -> DataFrame:
    """Trace seeds: one per order, start at the order date plus a keyed
    back-dating of up to 2 s, span budget in [spans_min, spans_max]."""
    key = F.md5(F.concat(F.lit("seed:"), F.col("o_orderkey").cast("string")))
    return orders.select(
        F.col("o_orderkey").alias("trace_no"),
        ((_days("o_orderdate") * 86400 + F.col("o_orderkey") % 86400) * 1_000_000_000
         - F.pmod(hex_draw(key, 1), F.lit(2000)).cast("bigint") * 1_000_000).alias("start_ns"),
        (F.lit(spans_min) + F.pmod(hex_draw(key, 5), F.lit(spans_max - spans_min + 1))).cast("int").alias("budget"),
    )
