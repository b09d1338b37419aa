import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalars
from tracelake.operators.filters import validate_params


def test_readable_size(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024 ** 3,)], "b long")
    got = [r[0] for r in df.select(scalars.readable_size("b")).collect()]
    assert got == ["0.00 B", "1023.00 B", "1.50 KiB", "5.00 GiB"]


def test_pick_and_bits(spark):
    df = spark.range(20).select(scalars.pick(["a", "b", "c"], F.col("id")).alias("p"),
                                scalars.bits(F.lit(0x123456789ABCDE), 16).alias("b"))
    rows = df.collect()
    assert [r.p for r in rows[:4]] == ["a", "b", "c", "a"] and rows[0].b == 0x789A


def test_lognormal_floor(spark):
    d = spark.range(2000).select(scalars.sample_lognormal(1.0, 0.1, F.col("id").cast("string")).alias("d"))
    assert d.agg(F.min("d")).first()[0] == 1000  # exp(1) ns is floored at 1 µs


def test_shard_of_is_stable(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("t"))
    s = df.select(scalars.shard_of("t", 3).alias("a"), scalars.shard_of("t", 3).alias("b"))
    assert s.filter("a <> b").count() == 0
    counts = [r[1] for r in s.groupBy("a").count().collect()]
    assert min(counts) > 250


def test_validate_params():
    validate_params()
    with pytest.raises(ValueError):
        validate_params(spans_min=0)
    with pytest.raises(ValueError):
        validate_params(spans_min=10, spans_max=5)
    with pytest.raises(ValueError):
        validate_params(schema="xml")
