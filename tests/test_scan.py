"""group_scan against a plain window on a hot group cut over many slices."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.plans.scan import group_scan


def test_hot_group_matches_window(spark):
    hot = spark.range(20000).select(F.lit("T").alias("g1"), F.lit("hot").alias("g2"),
                                    ((F.col("id") * 7919) % 20011).alias("o"),
                                    ((F.col("id") * 104729) % 1000003).alias("v"))
    cold = spark.range(3000).select(F.lit("T").alias("g1"), (F.col("id") % 300).cast("string").alias("g2"),
                                    F.col("id").alias("o"), ((F.col("id") * 31) % 977).alias("v"))
    nulls = spark.range(50).select(F.lit("T").alias("g1"), F.lit("nulls").alias("g2"), F.col("id").alias("o"),
                                   F.when(F.col("id") % 3 == 1, F.col("id")).alias("v"))
    df = hot.unionByName(cold).unionByName(nulls)
    got = group_scan(df, ["g1", "g2"], ["o"], "v", n_partitions=13)
    w = Window.partitionBy("g1", "g2").orderBy("o")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("g1", "g2", "o", "v", F.row_number().over(w).alias("rank"), F.lag("v").over(w).alias("prev_value"),
                     F.max("v").over(before).alias("prev_max"),
                     F.coalesce(F.sum("v").over(before), F.lit(0)).alias("prev_sum"))
    diff = got.select("g1", "g2", "o", "v", "rank", "prev_value", "prev_max", "prev_sum").exceptAll(want)
    assert diff.count() == 0
    assert got.count() == 23050


def test_hot_group_spans_several_tasks(spark, monkeypatch):
    """The slices that the scan works on, as written: one group lies in at least two of them."""
    from tracelake.plans import strategies

    written = []
    cut = strategies.cut_lineage
    monkeypatch.setattr(strategies, "cut_lineage", lambda df, name="level": written.append(cut(df, name)) or written[-1])
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("o"), F.col("id").alias("v"))
    scanned = group_scan(df, ["g"], ["o"], "v", n_partitions=6)
    assert scanned.agg(F.max("rank")).first()[0] == 20000
    per = [r["count"] for r in written[0].groupBy("_slice").count().collect()]
    assert len(per) >= 2 and max(per) < 10000


def test_scan_runs_without_python(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.col("id").alias("v"))
    text = group_scan(df, ["g"], ["o"], "v")._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text


def test_quantiles_equal_spark(spark, spans_small):
    from tracelake.operators import profile

    q = profile.QUANTILES
    want = spans_small.groupBy("ServiceName", "SpanName").agg(F.percentile(F.col("Duration").cast("double"), q).alias("p"))
    got = profile.latency_by_operation(spans_small).join(want, ["ServiceName", "SpanName"])
    off = [F.abs(F.col(f"p{int(x * 100)}_ns") - F.col("p")[i]) > 0.01 for i, x in enumerate(q)]
    assert got.count() == want.count() and got.filter(off[0] | off[1] | off[2] | off[3]).count() == 0
