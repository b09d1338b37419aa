"""Writers draw their ranges from the keys and make the rows once."""

import datetime as dt

from pyspark.sql import functions as F

from tracelake.plans import packing


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return "x" * i

    wide = spark.range(300).select("id", F.udf(text)(F.col("id") % 7).alias("text"))
    out = packing.deal_sorted(wide, 4, ["id"], ["id"]).withColumn("p", F.spark_partition_id()).collect()
    assert made.value == 300
    assert sorted((r["id"], r["text"]) for r in out) == [(i, "x" * (i % 7)) for i in range(300)]
    assert sorted({r["p"] for r in out}) == [0, 1, 2, 3]


def test_ranges_follow_the_order_of_the_keys(spark, monkeypatch):
    monkeypatch.setattr(packing, "KEYS_PER_RANGE", 20)
    day = lambda i: dt.datetime(2001, 1, 1) + dt.timedelta(hours=i)
    rows = [(None, None, b"")] * 5 + [(None if i % 9 == 0 else f"s{i % 3}", day(i // 2), bytes([i % 256])) for i in range(2000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t timestamp, b binary").repartition(3)
    keys = ["s", "t", "b"]
    got = df.withColumn("r", packing.range_no(df, keys, 7, len(rows))).orderBy(*keys).select("r").collect()
    numbers = [r["r"] for r in got]
    assert numbers == sorted(numbers) and set(numbers) == set(range(7))
    assert max(map(numbers.count, range(7))) < 2 * len(rows) / 7


def test_equal_keys_and_no_rows(spark):
    same = spark.range(50).select(F.lit("a").alias("k"), "id")
    out = packing.deal_sorted(same, 3, ["k"], ["k", "id"]).select("id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["id"] for r in out) == list(range(50)) and len({r["p"] for r in out}) == 1
    assert packing.deal_sorted(same.limit(0), 3, ["k"], ["k"]).collect() == []
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_thousands_of_ranges(spark):
    """As many as an attribute index of over a billion rows has: 200 keys for each."""
    rows, n = spark.range(700_000), 3_500
    cuts = [c.id for c in packing._cuts(rows, n, rows.count())]
    assert cuts == [i * 200 for i in range(1, n)]
