"""DuckDB SQL twins of the span queries (the correctness oracle).

``spans_ctes()`` rebuilds the ``spans`` fixture from the pre-registered
``orders`` and ``lineitem`` views with the same integer arithmetic and md5
draws as ``sources.fixtures`` — written independently as SQL, so a query and
its oracle agree only when both implementations agree. Event data is carried
as scalars (``ev_name``, ``ev_us``, ``ev_attrs``; at most one event per span)
rather than a nested list.
"""

from __future__ import annotations

from .functions import pools

N_SVC = len(pools.SERVICE_NAMES)
LAST = N_SVC - 1


def _lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _draw(h: str, pos: int) -> str:
    return f"('0x' || substr({h}, {pos}, 4))::INTEGER"


def _hex60(h: str, pos: int) -> str:
    return f"('0x' || substr({h}, {pos}, 15))::BIGINT"


def _bits(x: str, shift: int, mask: int = 0xFFFF) -> str:
    return f"(({x} >> {shift}) & {mask})" if shift else f"({x} & {mask})"


def _op_draw(h: str) -> str:
    return f"{_bits(_hex60(h, 17), 48, 0xFFF)}::INTEGER"


def _pick(values, draw: str) -> str:
    return f"({_lst(values)})[({draw}) % {len(values)} + 1]"


def _smap(pairs) -> str:
    keys = ", ".join(f"'{k}'" for k, _ in pairs)
    vals = ", ".join(v for _, v in pairs)
    return f"MAP([{keys}], [{vals}])"


def services_cte(n: int = N_SVC) -> list[tuple[str, str]]:
    d = [_draw("h", 1 + 4 * j) for j in range(8)]
    name = (f"CASE WHEN service_idx >= {N_SVC} THEN {_pick(pools.SERVICE_NAMES, 'service_idx')} || '-' || "
            f"(service_idx // {N_SVC})::VARCHAR ELSE {_pick(pools.SERVICE_NAMES, 'service_idx')} END")
    base = (f"SELECT range::INTEGER AS service_idx, md5('svc:' || range::VARCHAR) AS h FROM range({n})")
    named = f"""SELECT service_idx, {name} AS name, '{pools.NAMESPACE}' AS namespace,
        '1.' || ({d[0]} % 8)::VARCHAR || '.' || ({d[1]} % 20)::VARCHAR AS version,
        {_pick(pools.ENVIRONMENTS, d[2])} AS environment, {_pick(pools.REGIONS, d[3])} AS region,
        ({d[4]} % 3)::VARCHAR AS instance_no, ({d[5]} % 12)::VARCHAR AS host_no,
        lower(hex({d[6]})) AS pod_suffix, ({d[7]} % 12)::VARCHAR AS node_no
      FROM svc_h"""
    attrs = _smap([
        ("service.name", "name"), ("service.namespace", "namespace"), ("service.version", "version"),
        ("service.instance.id", "name || '-' || instance_no"), ("deployment.environment", "environment"),
        ("telemetry.sdk.name", "'opentelemetry'"), ("telemetry.sdk.language", "'go'"),
        ("telemetry.sdk.version", f"'{pools.SDK_VERSION}'"), ("host.name", "'node-' || host_no"),
        ("host.arch", "'amd64'"), ("os.type", "'linux'"), ("cloud.provider", "'onprem'"),
        ("cloud.region", "region"), ("k8s.namespace.name", f"'{pools.NAMESPACE}'"),
        ("k8s.deployment.name", "name"), ("k8s.pod.name", "name || '-' || pod_suffix"),
        ("k8s.node.name", "'worker-' || node_no"),
    ])
    final = (f"SELECT service_idx, name, namespace, version, name || '{pools.SERVICE_HOST_SUFFIX}' AS host, "
             f"{attrs} AS resource_attributes FROM svc_named")
    return [("svc_h", base), ("svc_named", named), ("services", final)]


def spans_ctes() -> list[tuple[str, str]]:
    days = "(({c})::DATE - DATE '1970-01-01')::BIGINT"
    o = f"""SELECT o_orderkey AS k, (o_custkey % {N_SVC})::INTEGER AS svc,
        ({days.format(c='o_orderdate')} * 86400 + o_orderkey % 86400) * 1000000000 AS root_start,
        floor(o_totalprice)::BIGINT * 1000 + 1000 AS root_dur,
        o_orderpriority = '5-LOW' AS consumer
      FROM orders"""
    roots = f"""SELECT k, 'r' AS role, 'r:' || k::VARCHAR AS key, NULL::VARCHAR AS parent_key, svc,
        CASE WHEN consumer THEN 'msg_consumer' ELSE 'http_server' END AS op_type,
        CASE WHEN consumer THEN 'Consumer' ELSE 'Server' END AS kind,
        root_start AS start_ns, root_dur AS dur_ns,
        {_op_draw("md5('r:' || k::VARCHAR)")} AS op_draw, NULL::INTEGER AS peer
      FROM fx_o"""
    lines = f"""SELECT l_orderkey AS k,
        concat_ws(':', l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
                  round(l_quantity * 100)::BIGINT::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR,
                  {days.format(c='l_shipdate')}::VARCHAR) AS lkey,
        l_partkey, (l_suppkey % 4)::INTEGER AS typ,
        floor(l_extendedprice)::BIGINT * 1000 + 1000 AS line_dur
      FROM lineitem"""
    calls = f"""SELECT l.k, o.svc, l.typ, 'c:' || l.k::VARCHAR || ':' || l.lkey AS call_key,
        o.root_start + (o.root_dur * 7 * (l.l_partkey % 100)) // 1000 AS call_start,
        least(l.line_dur, o.root_dur - (o.root_dur * 7 * (l.l_partkey % 100)) // 1000) AS call_dur,
        CASE WHEN o.svc < {LAST} THEN (o.svc + 1 + l.l_partkey % ({LAST} - o.svc))::INTEGER END AS peer
      FROM fx_l l JOIN fx_o o ON l.k = o.k"""
    callish = f"""SELECT *, {_op_draw('md5(call_key)')} AS op_draw,
        unnest(CASE WHEN typ IN (0, 1) AND svc < {LAST} THEN ['c', 's'] ELSE ['c'] END) AS role
      FROM fx_calls"""
    children = """SELECT k, role,
        CASE WHEN role = 's' THEN 's' || substr(call_key, 2) ELSE call_key END AS key,
        CASE WHEN role = 's' THEN call_key ELSE 'r:' || k::VARCHAR END AS parent_key,
        CASE WHEN role = 's' THEN peer ELSE svc END AS svc,
        CASE WHEN role = 's' THEN (CASE WHEN typ = 1 THEN 'rpc_server' ELSE 'http_server' END)
             ELSE (CASE WHEN typ = 2 THEN 'db_client' WHEN typ = 3 THEN 'internal'
                        WHEN typ = 1 AND peer IS NOT NULL THEN 'rpc_client' ELSE 'http_client' END) END AS op_type,
        CASE WHEN role = 's' THEN 'Server' WHEN typ = 3 THEN 'Internal' ELSE 'Client' END AS kind,
        CASE WHEN role = 's' THEN call_start + call_dur // 10 ELSE call_start END AS start_ns,
        CASE WHEN role = 's' THEN call_dur * 85 // 100 ELSE call_dur END AS dur_ns,
        op_draw,
        CASE WHEN role = 's' OR NOT (typ = 1) THEN NULL ELSE peer END AS peer
      FROM fx_callish"""
    skeleton = "SELECT * FROM fx_roots UNION ALL SELECT * FROM fx_children"
    methods = [m for m, _ in pools.HTTP_ROUTES]
    routes = [r for _, r in pools.HTTP_ROUTES]
    d0 = """SELECT *, md5(key) AS h, md5(key || '#') AS a FROM fx_skeleton"""
    d1 = f"""SELECT *, {_hex60('h', 17)} AS hb, {_hex60('a', 1)} AS a1, {_hex60('a', 16)} AS a2 FROM fx_d0"""
    status_draw = _bits("hb", 32)
    d2 = f"""SELECT *, substr(h, 1, 16) AS SpanId,
        CASE WHEN parent_key IS NULL THEN '' ELSE substr(md5(parent_key), 1, 16) END AS ParentSpanId,
        md5('t:' || k::VARCHAR) AS TraceId,
        {_pick(pools.SERVICE_NAMES, 'svc')} AS ServiceName,
        {_pick(pools.SERVICE_NAMES, 'peer')} AS peer_name,
        {_pick(methods, 'op_draw')} AS method, {_pick(routes, 'op_draw')} AS route,
        {_pick([x[0] for x in pools.DB_SYSTEMS], 'op_draw')} AS db_system,
        {_pick([x[1] for x in pools.DB_SYSTEMS], 'op_draw')} AS db_op,
        {_pick([x[2] for x in pools.DB_SYSTEMS], 'op_draw')} AS db_coll,
        ({_bits('hb', 0)} % 1000) < {int(pools.ERROR_RATE * 1000)} AS is_err,
        ({_bits('hb', 16)} % 10) = 0 AS info_draw,
        {status_draw} AS status_draw
      FROM fx_d1"""
    http_common = [
        ("http.request.method", "method"), ("url.path", "route"), ("url.scheme", "'http'"),
        ("network.protocol.version", "'1.1'"), ("server.address", f"'{pools.PEER_HOST}'"),
        ("server.port", "'8080'"), ("http.response.status_code", "http_code"),
    ]
    http_extra = [
        ("client.address", f"'10.' || ({_bits('a1', 16)} % 4)::VARCHAR || '.' || ({_bits('a1', 32)} % 256)::VARCHAR"
                           f" || '.' || ({_bits('a2', 0)} % 256)::VARCHAR"),
        ("user_agent.original", _pick(pools.USER_AGENTS, _bits('a1', 0))),
        ("url.full", f"'http://{pools.PEER_HOST}' || route"),
    ]
    ports = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pools.DB_PORTS.items())
    attrs = f"""CASE
        WHEN op_type = 'http_server' THEN {_smap(http_common + http_extra)}
        WHEN op_type = 'http_client' THEN {_smap(http_common)}
        WHEN op_type = 'db_client' THEN {_smap([
            ("db.system", "db_system"), ("db.namespace", f"'{pools.NAMESPACE}'"),
            ("db.operation.name", "db_op"), ("db.collection.name", "db_coll"),
            ("server.address", "db_system || '.db.svc.cluster.local'"),
            ("server.port", f"(CASE db_system {ports} ELSE 0 END)::VARCHAR"),
            ("db.query.text", "db_op || ' FROM ' || db_coll || ' WHERE id = ?'")])}
        WHEN op_type IN ('rpc_client', 'rpc_server') THEN {_smap([
            ("rpc.system", "'grpc'"),
            ("rpc.service", "(CASE WHEN op_type = 'rpc_server' THEN ServiceName ELSE peer_name END) || '.v1.Service'"),
            ("rpc.method", "'Get'"), ("rpc.grpc.status_code", "grpc_code")])}
        WHEN op_type = 'msg_consumer' THEN {_smap([
            ("messaging.system", "'kafka'"), ("messaging.destination.name", "ServiceName || '.events'"),
            ("messaging.operation", "'process'"),
            ("messaging.message.body.size", f"(256 + {_bits('a2', 32)} % 8192)::VARCHAR")])}
        ELSE {_smap([("code.namespace", "'compute.' || ServiceName"),
                     ("thread.name", f"'worker-' || ({_bits('a2', 16)} % 16)::VARCHAR")])}
      END"""
    name = """CASE
        WHEN op_type IN ('http_server', 'http_client') THEN method || ' ' || route
        WHEN op_type = 'db_client' THEN db_op || ' ' || db_coll
        WHEN op_type = 'rpc_client' THEN 'grpc.' || peer_name || '/Get'
        WHEN op_type = 'rpc_server' THEN ServiceName || '.v1.Service/Get'
        WHEN op_type = 'msg_consumer' THEN ServiceName || '.events process'
        ELSE 'compute.' || ServiceName END"""
    ev_pick = _bits("a1", 48, 0xFFF)
    d3 = f"""SELECT *,
        (CASE WHEN is_err THEN {_pick(pools.HTTP_STATUS_ERROR, 'status_draw')}
              ELSE {_pick(pools.HTTP_STATUS_OK, 'status_draw')} END)::VARCHAR AS http_code,
        (CASE WHEN is_err THEN {_pick(pools.GRPC_STATUS_ERROR, 'status_draw')} ELSE 0 END)::VARCHAR AS grpc_code,
        NOT is_err AND info_draw AS has_info
      FROM fx_d2"""
    final = f"""SELECT make_timestamp(start_ns // 1000) AS Timestamp, TraceId, SpanId, ParentSpanId,
        '' AS TraceState, {name} AS SpanName, kind AS SpanKind, ServiceName,
        s.resource_attributes AS ResourceAttributes,
        '{pools.SCOPE_NAME}' AS ScopeName, '{pools.SCOPE_VERSION}' AS ScopeVersion,
        {attrs} AS SpanAttributes,
        dur_ns AS Duration,
        CASE WHEN is_err THEN 'Error' ELSE 'Unset' END AS StatusCode,
        CASE WHEN is_err THEN '{pools.STATUS_MESSAGE_ERROR}' ELSE '' END AS StatusMessage,
        start_ns AS StartUnixNano, fx_d3.svc AS svc,
        CASE WHEN is_err OR has_info THEN 1 ELSE 0 END AS n_events,
        CASE WHEN is_err THEN 'exception' WHEN has_info THEN 'processing' END AS ev_name,
        CASE WHEN is_err THEN (start_ns + dur_ns // 2) // 1000
             WHEN has_info THEN (start_ns + dur_ns // 3) // 1000 END AS ev_us,
        CASE WHEN is_err THEN {_smap([("exception.type", _pick(pools.EXCEPTION_TYPES, ev_pick)),
                                      ("exception.message", f"'{pools.EXCEPTION_MESSAGE}'"),
                                      ("exception.escaped", "'false'")])}
             WHEN has_info THEN {_smap([("stage", _pick(pools.INFO_STAGES, ev_pick))])} END AS ev_attrs
      FROM fx_d3 LEFT JOIN services s ON s.service_idx = fx_d3.svc"""
    return services_cte() + [
        ("fx_o", o), ("fx_roots", roots), ("fx_l", lines), ("fx_calls", calls),
        ("fx_callish", callish), ("fx_children", children), ("fx_skeleton", skeleton),
        ("fx_d0", d0), ("fx_d1", d1), ("fx_d2", d2), ("fx_d3", d3), ("spans", final),
    ]


def attempts_cte() -> list[tuple[str, str]]:
    base = """SELECT event_id AS batch_id, event_type = 'error' AS failed_first,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS spans, value / 1000.0 AS seconds, ts
      FROM events"""
    att = """SELECT batch_id, attempt,
        CASE WHEN attempt = 0 THEN NOT failed_first ELSE batch_id % 2 = 0 END AS ok, spans, seconds, ts
      FROM (SELECT *, unnest(CASE WHEN failed_first THEN [0, 1] ELSE [0] END) AS attempt FROM att_base)"""
    return [("att_base", base), ("attempts", att)]


def with_ctes(select: str, *groups: list[tuple[str, str]], extra: list[tuple[str, str]] | None = None,
              recursive: bool = False) -> str:
    ctes: list[tuple[str, str]] = []
    for g in groups:
        ctes.extend(g)
    ctes.extend(extra or [])
    # The span table is computed once, however often a query joins it with itself.
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n == 'spans' else ''}(\n{q}\n)" for n, q in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"


def with_spans(select: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    return with_ctes(select, spans_ctes(), extra=extra, recursive=recursive)


def canon_json(m: str) -> str:
    """Sorted-key compact JSON text of a map expression; '{}' when empty/NULL."""
    return (f"coalesce(CASE WHEN cardinality({m}) > 0 THEN to_json(map_from_entries(list_sort(map_entries({m}))))::VARCHAR "
            f"END, '{{}}')")
