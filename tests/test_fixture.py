"""The span fixture built from orders and lineitem."""

from pyspark.sql import functions as F

from tracelake.functions import pools
from tracelake.operators import profile, quality, verify
from tracelake.sources.fixtures import SPAN_COLUMNS


def test_counts(spans_small):
    # FIXTURES.md: 10,948 spans and 1,500 traces at sf0.001
    r = profile.distinct_ids(spans_small).first()
    assert (r.spans, r.traces, r.distinct_spans) == (10948, 1500, 10948)


def test_schema(spans_small):
    assert spans_small.columns == SPAN_COLUMNS
    types = dict(spans_small.dtypes)
    assert types["Duration"] == "bigint" and types["SpanAttributes"] == "map<string,string>"


def test_clean_rules(spans_small):
    r = quality.schema_conformance(spans_small).first().asDict()
    assert r.pop("spans") == 10948
    assert all(v == 0 for v in r.values()), r


def test_corrupted_rules_fire(spans_small):
    r = quality.schema_conformance(quality.corrupt(spans_small)).first().asDict()
    for rule in ("bad_span_id", "bad_kind", "error_without_one_exception"):
        assert r[rule] > 0, rule
    assert quality.duplicate_spans(quality.corrupt(spans_small)).count() > 0


def test_kinds_and_services(spans_small):
    kinds = {r.SpanKind for r in verify.kind_status_mix(spans_small).collect()}
    assert kinds <= {"Server", "Client", "Internal", "Consumer"}
    svc = {r.ServiceName for r in verify.spans_per_service(spans_small).collect()}
    assert svc <= set(pools.SERVICE_NAMES)


def test_events_follow_status(spans_small):
    bad = spans_small.filter(
        ((F.col("StatusCode") == "Error") & (F.size("Events") != 1))
        | (F.size("Events") > 1)).count()
    assert bad == 0


def test_parity_detects_corruption(spans_small):
    from tracelake.operators import setops

    clean = setops.parity(spans_small, spans_small).first()
    assert (clean.left_only, clean.right_only, clean.rows) == (0, 0, 10948)
    bad = setops.parity(quality.corrupt(spans_small), spans_small).first()
    assert bad.left_only > 0 and bad.right_only > 0 and bad.rows > bad.right_rows
