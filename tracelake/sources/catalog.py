"""Service topology dimension tables: ``services`` and ``operations``.

Both are small dimension tables whose size is a parameter of the job (the
number of services), never a function of the span volume; joins against them
are broadcast joins behind that bound (see ``plans.strategies``).

Each service's random choices are keyed hash draws on ``svc:<idx>`` (versions,
environment, region, pod) and ``ops:<idx>`` (operation pools), so the tables
are the same on every executor and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pools
from ..functions.scalars import hex_draw, pick, service_name_of


def services(spark: SparkSession, n: int = 30) -> DataFrame:
    """One row per service: name, namespace, version, host and its 17
    resource attributes (``resource_attributes`` map)."""
    if n < 1:
        raise ValueError(f"services must be at least 1, got {n}")
    base = spark.range(n).select(
        F.col("id").cast("int").alias("service_idx"),
        F.md5(F.concat(F.lit("svc:"), F.col("id").cast("string"))).alias("h"),
    )
    d = [hex_draw("h", 1 + 4 * j) for j in range(8)]
    named = base.select(
        "service_idx",
        service_name_of("service_idx").alias("name"),
        F.lit(pools.NAMESPACE).alias("namespace"),
        F.concat(F.lit("1."), F.pmod(d[0], F.lit(8)).cast("string"), F.lit("."),
                 F.pmod(d[1], F.lit(20)).cast("string")).alias("version"),
        pick(pools.ENVIRONMENTS, d[2]).alias("environment"),
        pick(pools.REGIONS, d[3]).alias("region"),
        F.pmod(d[4], F.lit(3)).alias("instance_no"),
        F.pmod(d[5], F.lit(12)).alias("host_no"),
        F.lower(F.hex(d[6])).alias("pod_suffix"),
        F.pmod(d[7], F.lit(12)).alias("node_no"),
    )
    attrs = F.create_map(
        F.lit("service.name"), F.col("name"),
        F.lit("service.namespace"), F.col("namespace"),
        F.lit("service.version"), F.col("version"),
        F.lit("service.instance.id"), F.concat(F.col("name"), F.lit("-"), F.col("instance_no").cast("string")),
        F.lit("deployment.environment"), F.col("environment"),
        F.lit("telemetry.sdk.name"), F.lit("opentelemetry"),
        F.lit("telemetry.sdk.language"), F.lit("go"),
        F.lit("telemetry.sdk.version"), F.lit(pools.SDK_VERSION),
        F.lit("host.name"), F.concat(F.lit("node-"), F.col("host_no").cast("string")),
        F.lit("host.arch"), F.lit("amd64"),
        F.lit("os.type"), F.lit("linux"),
        F.lit("cloud.provider"), F.lit("onprem"),
        F.lit("cloud.region"), F.col("region"),
        F.lit("k8s.namespace.name"), F.lit(pools.NAMESPACE),
        F.lit("k8s.deployment.name"), F.col("name"),
        F.lit("k8s.pod.name"), F.concat(F.col("name"), F.lit("-"), F.col("pod_suffix")),
        F.lit("k8s.node.name"), F.concat(F.lit("worker-"), F.col("node_no").cast("string")),
    )
    return named.select(
        "service_idx", "name", "namespace", "version",
        F.concat(F.col("name"), F.lit(pools.SERVICE_HOST_SUFFIX)).alias("host"),
        attrs.alias("resource_attributes"),
    )


def operations(svc: DataFrame, n: int) -> DataFrame:
    """Entry and child operations of every service.

    Entry ops: 2-4 HTTP server routes, plus a message consumer with p = 0.4.
    Child ops: 0-2 outbound calls to a strictly higher service index (HTTP or
    gRPC, so the call graph is a DAG), 1-2 database calls and one internal
    compute op. ``peer`` is -1 when the op calls no other service. ``n`` is
    the number of services in ``svc``.
    """
    s = svc.select("service_idx", "name", "namespace").withColumn("n_services", F.lit(n))
    s = s.withColumn("h", F.md5(F.concat(F.lit("ops:"), F.col("service_idx").cast("string"))))
    methods = [m for m, _ in pools.HTTP_ROUTES]
    routes = [r for _, r in pools.HTTP_ROUTES]

    # -- entry operations ----------------------------------------------------
    n_entry = F.lit(2) + F.pmod(hex_draw("h", 1), F.lit(3))
    entry_http = (
        s.select("*", F.explode(F.sequence(F.lit(0), n_entry - 1)).alias("op_idx"))
        .withColumn("r", F.md5(F.concat(F.lit("entry:"), F.col("service_idx").cast("string"), F.lit(":"),
                                        F.col("op_idx").cast("string"))))
        .select(
            "service_idx", "op_idx", F.lit("entry").alias("role"),
            pick(methods, hex_draw("r", 1)).alias("method"),
            pick(routes, hex_draw("r", 1)).alias("route"),
            F.lit("http_server").alias("op_type"), F.lit("Server").alias("kind"),
            F.lit(pools.LATENCY_PARAMS["http_server"][0]).alias("mu_log"),
            F.lit(pools.LATENCY_PARAMS["http_server"][1]).alias("sigma_log"),
            F.lit(None).cast("string").alias("destination"), F.lit(-1).alias("peer"),
            F.lit(None).cast("string").alias("peer_name"), "name",
        )
    )
    consumer = (
        s.filter(F.pmod(hex_draw("h", 5), F.lit(10)) < 4)
        .select(
            "service_idx", (F.lit(2) + F.pmod(hex_draw("h", 1), F.lit(3))).alias("op_idx"), F.lit("entry").alias("role"),
            F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("route"),
            F.lit("msg_consumer").alias("op_type"), F.lit("Consumer").alias("kind"),
            F.lit(pools.LATENCY_PARAMS["msg_consumer"][0]).alias("mu_log"),
            F.lit(pools.LATENCY_PARAMS["msg_consumer"][1]).alias("sigma_log"),
            F.concat(F.col("name"), F.lit(".events")).alias("destination"), F.lit(-1).alias("peer"),
            F.lit(None).cast("string").alias("peer_name"), "name",
        )
    )

    # -- child operations ----------------------------------------------------
    n_peers = F.when(F.col("service_idx") + 1 < F.col("n_services"), F.pmod(hex_draw("h", 9), F.lit(3))).otherwise(0)
    n_db = F.lit(1) + F.pmod(hex_draw("h", 13), F.lit(2))
    child_slots = s.select(
        "*",
        F.posexplode(F.concat(
            F.array_repeat(F.lit("call"), n_peers.cast("int")),
            F.array_repeat(F.lit("db"), n_db.cast("int")),
            F.array(F.lit("internal")),
        )).alias("op_idx", "slot"),
    ).withColumn("r", F.md5(F.concat(F.lit("child:"), F.col("service_idx").cast("string"), F.lit(":"),
                                     F.col("op_idx").cast("string"))))
    peer = F.col("service_idx") + 1 + F.pmod(hex_draw("r", 1), F.greatest(F.col("n_services") - F.col("service_idx") - 1, F.lit(1)))
    is_http = F.pmod(hex_draw("r", 5), F.lit(2)) == 0
    db_idx = hex_draw("r", 9)
    children = child_slots.select(
        "service_idx", "op_idx", "slot", "name", "namespace",
        F.when(F.col("slot") == "call", peer).otherwise(F.lit(-1)).alias("peer"),
        is_http.alias("is_http"),
        pick(methods, hex_draw("r", 13)).alias("m"), pick(routes, hex_draw("r", 13)).alias("rt"),
        pick([x[0] for x in pools.DB_SYSTEMS], db_idx).alias("db_system"),
        pick([x[1] for x in pools.DB_SYSTEMS], db_idx).alias("db_op"),
        pick([x[2] for x in pools.DB_SYSTEMS], db_idx).alias("collection"),
    )
    op_type = (F.when(F.col("slot") == "db", F.lit("db_client"))
               .when(F.col("slot") == "internal", F.lit("internal"))
               .when(F.col("is_http"), F.lit("http_client")).otherwise(F.lit("rpc_client")))
    mu = F.lit(None).cast("double")
    sigma = F.lit(None).cast("double")
    for t in ("db_client", "internal", "http_client", "rpc_client"):
        mu = F.when(op_type == t, F.lit(pools.LATENCY_PARAMS[t][0])).otherwise(mu)
        sigma = F.when(op_type == t, F.lit(pools.LATENCY_PARAMS[t][1])).otherwise(sigma)
    child = children.select(
        "service_idx", "op_idx", F.lit("child").alias("role"),
        F.when(op_type == "http_client", F.col("m")).alias("method"),
        F.when(op_type == "http_client", F.col("rt")).alias("route"),
        op_type.alias("op_type"),
        F.when(op_type == "internal", F.lit("Internal")).otherwise(F.lit("Client")).alias("kind"),
        mu.alias("mu_log"), sigma.alias("sigma_log"),
        F.lit(None).cast("string").alias("destination"), "peer",
        F.lit(None).cast("string").alias("peer_name"), "name",
        *[F.when(op_type == "db_client", F.col(c)).alias(c) for c in ("db_system", "db_op", "collection")],
        "namespace",
    )
    peers = svc.select(F.col("service_idx").alias("p_idx"), F.col("name").alias("p_name"))
    child = (child.join(F.broadcast(peers), child.peer == peers.p_idx, "left")
             .withColumn("peer_name", F.col("p_name")).drop("p_idx", "p_name"))

    def finish(df: DataFrame) -> DataFrame:
        for c in ("db_system", "db_op", "collection"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        if "namespace" not in df.columns:
            df = df.withColumn("namespace", F.lit(pools.NAMESPACE))
        return df

    allops = finish(entry_http).unionByName(finish(consumer)).unionByName(finish(child))
    op_name = (F.when(F.col("op_type").isin("http_server", "http_client"), F.concat_ws(" ", "method", "route"))
               .when(F.col("op_type") == "msg_consumer", F.concat(F.col("destination"), F.lit(" process")))
               .when(F.col("op_type") == "rpc_client", F.concat(F.lit("grpc."), F.col("peer_name"), F.lit("/Get")))
               .when(F.col("op_type") == "db_client", F.concat_ws(" ", "db_op", "collection"))
               .otherwise(F.concat(F.lit("compute."), F.col("name"))))
    return allops.select(
        "service_idx", F.col("op_idx").cast("int").alias("op_idx"), "role", op_name.alias("op_name"),
        "op_type", "kind", "mu_log", "sigma_log", "method", "route", "db_system",
        F.when(F.col("op_type") == "db_client", F.col("namespace")).alias("db_name"),
        "db_op", "collection",
        F.when(F.col("op_type") == "rpc_client", F.concat(F.col("peer_name"), F.lit(".v1.Service"))).alias("rpc_service"),
        F.when(F.col("op_type") == "rpc_client", F.lit("Get")).alias("rpc_method"),
        "destination", F.col("peer").cast("int").alias("peer"),
    )

