"""Writers send ids as bytes and write the ids they were given."""

from conftest import make_spans

from tracelake.plans.packing import deal_sorted


def test_writers_send_ids_as_bytes(spark):
    ids = ["0123456789abcdef", "UPPER0123456789A", "short", "", None, "é" * 9]
    s = make_spans(spark, [("f" * 32 if i % 2 else "t1", a, b, "op", "Internal", "cart", i, 1)
                           for i, (a, b) in enumerate(zip(ids, reversed(ids)))])
    out = deal_sorted(s, 2, ["TraceId", "SpanId"], ["TraceId", "SpanId"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(" in plan[plan.index("RepartitionByExpression"):]
    columns = ["TraceId", "SpanId", "ParentSpanId", "StartUnixNano"]
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, s.select(columns).collect()))


def test_folded_rows_come_back_as_they_were(spark):
    """Texts that hold the marks, nulls, maps of all kinds, times that the nanoseconds don't tell."""
    from pyspark.sql import functions as F

    from tracelake.plans.packing import fold, pack, unfold, unpack

    texts = ["", None, "a", "\x1d", "\x1e", "b\x1ec", "x\x1dy", "\x1f", "é"]
    maps = [None, {}, {"a": "1"}, {"a": None}, {"b": "\x1e", "a": "2"}, {"\x1d": "\x1d"}, {"": ""}, {"a\x1fb": "c"}]
    rows = [(i, a, texts[(i * 5 + 2) % 9], m, maps[(i * 3) % 8], f"{i:016x}" if i % 2 else None, i % 4, i % 5)
            for i, (a, m) in enumerate((a, m) for a in texts for m in maps)]
    df = spark.createDataFrame(rows, "n int, a string, `b.c` string, m map<string,string>, k map<string,string>, SpanId string, e int, t int").selectExpr(
        "*", "CASE e WHEN 0 THEN NULL WHEN 1 THEN array() WHEN 2 THEN array('x', NULL) ELSE array('') END AS Events",
        "CASE t WHEN 0 THEN NULL ELSE n * 1001L END AS StartUnixNano",
        "CASE t WHEN 1 THEN NULL WHEN 2 THEN timestamp_micros(5) ELSE timestamp_micros(n * 1001L div 1000) END AS Timestamp")
    folded = fold(pack(df, ids=True).withColumn("_range", F.col("n") % 3), df)
    assert {"a", "b.c"}.isdisjoint(folded.columns) and folded.filter("_texts IS NOT NULL AND _parts IS NULL").count() >= 10
    back = unpack(unfold(folded, df), df)
    assert back.columns == [*df.columns, "_range"]
    assert list(map(str, back.drop("_range").orderBy("n").collect())) == list(map(str, df.orderBy("n").collect()))
