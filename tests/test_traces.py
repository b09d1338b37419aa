"""Hand-made traces with known depth, self time and critical path."""

from conftest import make_spans

from tracelake.operators import traces, windows

T1, T2, T3, T4, T5 = "t1", "t2", "t3", "t4", "t5"
ROWS = [
    # single span
    (T1, "a", "", "root", "Server", "frontend", 0, 100),
    # two overlapping children: [10,50] and [30,80] under [0,100]
    (T2, "r", "", "root", "Server", "frontend", 0, 100),
    (T2, "c1", "r", "GET /x", "Client", "frontend", 10, 40),
    (T2, "c2", "r", "GET /y", "Client", "frontend", 30, 50),
    # chain of depth 6, each child [s+1, e-1]
    *[(T3, f"n{i}", (f"n{i - 1}" if i else ""), f"op{i}", "Internal", "cart", i, 100 - 2 * i) for i in range(6)],
    # internal span with nested work: root [0,100] > internal [0,60] > db [10,20]
    (T4, "r", "", "root", "Server", "checkout", 0, 100),
    (T4, "i", "r", "compute.checkout", "Internal", "checkout", 0, 60),
    (T4, "d", "i", "SELECT orders", "Client", "checkout", 10, 10),
    # client without callee (budget ran out) next to a client with its server
    (T5, "r", "", "root", "Server", "cart", 0, 100),
    (T5, "c", "r", "GET /a", "Client", "cart", 10, 50),
    (T5, "s", "c", "GET /a", "Server", "catalog", 15, 42),
    (T5, "x", "r", "GET /b", "Client", "cart", 70, 20),
]


def rows_by(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_depth(spark):
    s = make_spans(spark, ROWS)
    d = rows_by(traces.trace_depth(s), "TraceId")
    assert {t: (r.max_depth, r.spans_reached) for (t,), r in d.items()} == {
        (T1): (1, 1), (T2): (2, 3), (T3): (6, 6), (T4): (3, 3), (T5): (3, 4)}


def test_self_time(spark):
    s = make_spans(spark, ROWS)
    st = {(r.TraceId, r.SpanId): r.self_ns for r in traces.self_time(s).collect()}
    assert st[(T1, "a")] == 100
    assert st[(T2, "r")] == 100 - 70  # union of [10,50] and [30,80]
    assert st[(T2, "c1")] == 40
    assert st[(T3, "n0")] == 2 and st[(T3, "n5")] == 90
    assert st[(T4, "r")] == 40 and st[(T4, "i")] == 50 and st[(T4, "d")] == 10
    assert st[(T5, "r")] == 100 - 50 - 20 and st[(T5, "c")] == 50 - 42


def test_critical_path(spark):
    s = make_spans(spark, ROWS)
    cp = rows_by(traces.critical_path(s), "TraceId")
    got = {t: (r.cp_spans, r.cp_leaf_span_id) for (t,), r in cp.items()}
    assert got == {T1: (1, "a"), T2: (2, "c2"), T3: (6, "n5"), T4: (3, "d"), T5: (2, "x")}


def test_preorder_cap(spark):
    from pyspark.sql import functions as F

    s = make_spans(spark, ROWS)
    kept = traces.preorder_cap(s, budget=F.lit(3)).collect()
    by_trace = {}
    for r in kept:
        by_trace.setdefault(r.TraceId, []).append((r.preorder_rank, r.SpanId))
    # depth-first, siblings by start: r, c, s (then x is cut)
    assert sorted(by_trace[T5]) == [(1, "r"), (2, "c"), (3, "s")]
    assert sorted(by_trace[T3]) == [(1, "n0"), (2, "n1"), (3, "n2")]
    assert sorted(by_trace[T1]) == [(1, "a")]


def test_edges_and_containment(spark):
    s = make_spans(spark, ROWS)
    e = rows_by(traces.service_edges(s), "caller", "callee")
    assert set(e) == {("cart", "catalog")} and e[("cart", "catalog")].calls == 1
    assert traces.containment_violations(s).count() == 0
    assert traces.orphans(s).count() == 0


def test_sibling_order(spark):
    s = make_spans(spark, ROWS)
    so = {(r.TraceId, r.SpanId): (r.sibling_no, r.gap_ns) for r in windows.sibling_order(s).collect()}
    assert so[(T2, "c1")] == (1, None)
    assert so[(T2, "c2")] == (2, 30 - 50)  # overlaps the previous sibling by 20
    assert so[(T5, "x")] == (2, 70 - 60)


def chain(trace, n, root=True):
    return [(trace, f"{trace}-{i}", (f"{trace}-{i - 1}" if i else ("" if root else "gone")), "op", "Internal", "cart", i, 1000 - i)
            for i in range(n)]


def test_deep_chains(spark):
    """Exact at any depth; spans without a root and spans in a cycle are reported, not walked."""
    cycle = [("loop", "a", "b", "op", "Internal", "cart", 0, 1), ("loop", "b", "a", "op", "Internal", "cart", 0, 1)]
    rows = [r for n in (1, 2, 13, 70, 300) for r in chain(f"c{n}", n)] + chain("lost", 9, root=False) + cycle
    s = make_spans(spark, rows)
    assert {r.TraceId: (r.max_depth, r.spans_reached) for r in traces.trace_depth(s).collect()} == \
        {f"c{n}": (n, n) for n in (1, 2, 13, 70, 300)}
    assert {r.TraceId: (r.cp_spans, r.cp_leaf_span_id) for r in traces.critical_path(s).collect()} == \
        {f"c{n}": (n, f"c{n}-{n - 1}") for n in (1, 2, 13, 70, 300)}
    lost = {(r.TraceId, r.SpanId) for r in traces.unreached_spans(s).collect()}
    assert lost == {("lost", f"lost-{i}") for i in range(9)} | {("loop", "a"), ("loop", "b")}


def test_repeated_spans_count_once(spark):
    s = make_spans(spark, ROWS)
    twice = s.unionByName(s)
    assert traces.trace_depth(twice).exceptAll(traces.trace_depth(s)).count() == 0
    assert traces.critical_path(twice).exceptAll(traces.critical_path(s)).count() == 0
    assert traces.preorder_ranks(twice).exceptAll(traces.preorder_ranks(s)).count() == 0


def test_preorder_equals_depth_first_walk(spark):
    import random

    rng = random.Random(3)
    rows = []
    for t in range(12):
        for i in range(rng.randrange(1, 60)):
            parent = "" if i == 0 or rng.random() < 0.05 else f"s{rng.randrange(i):03d}"
            rows.append((f"t{t}", f"s{i:03d}", parent, "op", "Internal", "cart", rng.randrange(20), 5))
    want = {}
    for t in {r[0] for r in rows}:
        children = {}
        for r in rows:
            if r[0] == t:
                children.setdefault(r[2], []).append((r[6], r[1]))
        stack, n = sorted(children[""], reverse=True), 0
        while stack:
            _, span = stack.pop()
            n += 1
            want[(t, span)] = n
            stack += sorted(children.get(span, []), reverse=True)
    got = {(r.TraceId, r.SpanId): r.preorder_rank for r in traces.preorder_ranks(make_spans(spark, rows)).collect()}
    assert got == want
