"""Row encoders: the map and JSON table layouts and conversions between them.

All encoders are projections (no shuffle). The JSON layout stores attribute
sets as VARIANT (Spark's binary semi-structured type, sorted object keys)
and Events/Links as parallel arrays named like the table columns
(``Events.Timestamp`` …); the map layout keeps MAP<STRING,STRING> columns
and nested arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json

MAP_LAYOUT = [
    "Timestamp", "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind",
    "ServiceName", "ResourceAttributes", "ScopeName", "ScopeVersion", "SpanAttributes",
    "Duration", "StatusCode", "StatusMessage",
    "Events.Timestamp", "Events.Name", "Events.Attributes",
    "Links.TraceId", "Links.SpanId", "Links.TraceState", "Links.Attributes",
]
JSON_LAYOUT = [
    "Timestamp", "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind",
    "ServiceName", "Duration", "StatusCode", "StatusMessage",
    "ResourceAttributes", "SpanAttributes", "ScopeAttributes", "ScopeName", "ScopeVersion",
    "Links.TraceId", "Links.SpanId", "Links.TraceState", "Links.Attributes",
    "Events.Timestamp", "Events.Name", "Events.Attributes",
]


def q(name: str) -> F.Column:
    """Column reference that tolerates dots in table column names."""
    return F.col(f"`{name}`")


def events_to_arrays(spans: DataFrame, json_attrs: bool = False) -> list[F.Column]:
    attrs = F.transform("Events", lambda e: F.to_variant_object(e["Attributes"])) if json_attrs \
        else F.transform("Events", lambda e: e["Attributes"])
    return [F.transform("Events", lambda e: e["Timestamp"]).alias("Events.Timestamp"),
            F.transform("Events", lambda e: e["Name"]).alias("Events.Name"),
            attrs.alias("Events.Attributes")]


def links_to_arrays(spans: DataFrame, json_attrs: bool = False) -> list[F.Column]:
    attrs = F.transform("Links", lambda x: F.to_variant_object(x["Attributes"])) if json_attrs \
        else F.transform("Links", lambda x: x["Attributes"])
    return [F.transform("Links", lambda x: x["TraceId"]).alias("Links.TraceId"),
            F.transform("Links", lambda x: x["SpanId"]).alias("Links.SpanId"),
            F.transform("Links", lambda x: x["TraceState"]).alias("Links.TraceState"),
            attrs.alias("Links.Attributes")]


def encode_map_layout(spans: DataFrame) -> DataFrame:
    """The 22-column map layout (plus StartUnixNano when present, for full ns precision)."""
    extra = ["StartUnixNano"] if "StartUnixNano" in spans.columns else []
    return spans.select(
        "Timestamp", "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind",
        "ServiceName", "ResourceAttributes", "ScopeName", "ScopeVersion", "SpanAttributes",
        "Duration", "StatusCode", "StatusMessage", *events_to_arrays(spans), *links_to_arrays(spans), *extra)


def encode_json_layout(spans: DataFrame) -> DataFrame:
    """The 23-column JSON layout: VARIANT attributes, empty ScopeAttributes,
    Links before Events."""
    extra = ["StartUnixNano"] if "StartUnixNano" in spans.columns else []
    return spans.select(
        "Timestamp", "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind",
        "ServiceName", "Duration", "StatusCode", "StatusMessage",
        F.to_variant_object("ResourceAttributes").alias("ResourceAttributes"),
        F.to_variant_object("SpanAttributes").alias("SpanAttributes"),
        F.parse_json(F.lit("{}")).alias("ScopeAttributes"),
        "ScopeName", "ScopeVersion", *links_to_arrays(spans, True), *events_to_arrays(spans, True), *extra)


def variant_to_map(v: F.Column) -> F.Column:
    """An object's values as texts, without a JSON text between; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,string>")


def json_to_map_layout(json_df: DataFrame) -> DataFrame:
    """JSON layout → span rows with map attributes and nested Events/Links."""
    ev = F.arrays_zip(q("Events.Timestamp").alias("Timestamp"), q("Events.Name").alias("Name"),
                      F.transform(q("Events.Attributes"), variant_to_map).alias("Attributes"))
    lk = F.arrays_zip(q("Links.TraceId").alias("TraceId"), q("Links.SpanId").alias("SpanId"),
                      q("Links.TraceState").alias("TraceState"),
                      F.transform(q("Links.Attributes"), variant_to_map).alias("Attributes"))
    extra = ["StartUnixNano"] if "StartUnixNano" in json_df.columns else []
    return json_df.select(
        "Timestamp", "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind", "ServiceName",
        variant_to_map(F.col("ResourceAttributes")).alias("ResourceAttributes"), "ScopeName", "ScopeVersion",
        variant_to_map(F.col("SpanAttributes")).alias("SpanAttributes"), "Duration", "StatusCode", "StatusMessage",
        ev.alias("Events"), lk.alias("Links"), *extra)


def map_to_json_layout(spans: DataFrame) -> DataFrame:
    return encode_json_layout(spans)


def canonical_text(spans: DataFrame) -> DataFrame:
    """Layout-independent text form of a span (for parity checks and
    set operations, which maps and VARIANT do not support)."""
    ev = F.transform("Events", lambda e: F.concat_ws("|", F.unix_micros(e["Timestamp"]).cast("string"), e["Name"],
                                                     canonical_json(e["Attributes"])))
    lk = F.transform("Links", lambda k: F.concat_ws("|", k["TraceId"], k["SpanId"], k["TraceState"],
                                                    canonical_json(k["Attributes"])))
    return spans.select(
        "TraceId", "SpanId", "ParentSpanId", "TraceState", "SpanName", "SpanKind", "ServiceName",
        F.unix_micros("Timestamp").alias("ts_us"), "StartUnixNano", "Duration", "StatusCode", "StatusMessage",
        "ScopeName", "ScopeVersion",
        canonical_json("ResourceAttributes").alias("resource_json"),
        canonical_json("SpanAttributes").alias("span_json"),
        F.array_join(ev, ";").alias("events_text"),
        F.array_join(lk, ";").alias("links_text"),
    )


def attrs_to_json(spans: DataFrame) -> DataFrame:
    return spans.select("TraceId", "SpanId", canonical_json("SpanAttributes").alias("span_attrs_json"),
                        canonical_json("ResourceAttributes").alias("resource_attrs_json"))


def _expected_server(pairs: DataFrame) -> dict[str, F.Column]:
    """What a call's callee is by rule: the call's route or method as name, 10 % later, 85 % as long."""
    from ..functions.scalars import idiv

    attrs = F.col("p_SpanAttributes")
    rpc = attrs.getItem("rpc.service")
    return {"SpanName": F.when(rpc.isNotNull(), F.concat(rpc, F.lit("/"), attrs.getItem("rpc.method")))
            .otherwise(F.concat_ws(" ", attrs.getItem("http.request.method"), attrs.getItem("url.path"))),
            "StartUnixNano": F.col("p_StartUnixNano") + idiv("p_Duration", 10), "Duration": idiv(F.col("p_Duration") * 85, 100)}


def counterpart_rows(spans: DataFrame) -> DataFrame:
    """The SERVER row derived from each CLIENT call that has a callee, and the id of the span that is there."""
    from .traces import client_server_pairs

    pairs = client_server_pairs(spans, extra=("SpanAttributes",))
    row = _expected_server(pairs)
    return pairs.select("TraceId", F.col("p_SpanId").alias("ParentSpanId"), F.lit("Server").alias("SpanKind"),
                        row["SpanName"].alias("SpanName"), F.col("c_ServiceName").alias("ServiceName"),
                        row["StartUnixNano"].alias("StartUnixNano"), row["Duration"].alias("Duration"),
                        F.col("c_SpanId").alias("found_span"))


def server_counterpart(spans: DataFrame) -> DataFrame:
    """Compare the derived callee rows with the rows actually present: name, start and duration."""
    from .traces import client_server_pairs

    pairs = client_server_pairs(spans, extra=("SpanAttributes",))
    row = _expected_server(pairs)
    same = lambda c: F.sum(F.when(F.col(f"c_{c}") == row[c], 1).otherwise(0)).cast("bigint")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), same("SpanName").alias("name_match"),
                     same("StartUnixNano").alias("start_match"), same("Duration").alias("duration_match"))
