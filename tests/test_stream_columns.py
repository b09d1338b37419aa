"""Arrival files hold the columns that their streams read."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake import registry
from tracelake.session import scratch_path
from tracelake.streaming import streams


def test_stream_inputs_hold_what_streams_read(spark):
    assert registry.stream_input(spark, "/root/testdata/sf0.001").columns == registry.STREAM_COLUMNS


def test_arrival_files_take_one_shuffle(spark, monkeypatch):
    """Each file is a copy of its time range; the rows are dealt once and arrive in order of time."""
    dealt = []
    whole = DataFrame.repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *by: dealt.append(by) or whole(df, *by))
    given = spark.range(1000).selectExpr("id AS n", "format_string('%032x', id) AS TraceId", "timestamp_seconds(id) AS Timestamp",
                                         "map('k', string(id)) AS a")
    path = streams.write_arrival_files(given, scratch_path(spark, "t-arrivals"), 4, closing=lambda row: row.selectExpr(
        "n", "TraceId", "timestamp_seconds(99999) AS Timestamp", "a"))
    found = spark.read.parquet(path).selectExpr("*", "_metadata.file_path AS f", "_metadata.file_modification_time AS t")
    files = sorted(found.groupBy("f", "t").agg(F.min("Timestamp").alias("lo"), F.max("Timestamp").alias("hi"), F.count("*").alias("n"))
                   .collect(), key=lambda r: r.lo)
    assert len(files) == 9 and not dealt
    assert all(a.hi < b.lo for a, b in zip(files, files[1:]))
    assert all(a.t <= b.t for a, b in zip(files, files[2:]))  # the two files of a range are written at once
    kept = found.filter("Timestamp < timestamp_seconds(99999)").selectExpr("n", "TraceId", "Timestamp", "a.k AS k")
    assert sorted(kept.collect()) == sorted(given.selectExpr("n", "TraceId", "Timestamp", "a.k AS k").collect())


def _given(spark, rows):
    return spark.createDataFrame(rows, "n int, Timestamp timestamp, TraceId string")


def test_rows_lie_on_disk_once_while_arrival_files_are_written(spark, monkeypatch):
    """The rows aren't dealt anew, and a file's folder is deleted as soon as the file is there."""
    dealt, left = [], []
    frame, drop = type(spark.range(1)), streams.drop_path
    whole = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, *by: dealt.append(by) or whole(df, *by))
    monkeypatch.setattr(streams, "drop_path", lambda s, at: left.append((at, len(s.read.parquet(path).inputFiles()))) or drop(s, at))
    path = scratch_path(spark, "t-arrivals-disk")
    given = spark.range(1000).selectExpr("id AS n", "timestamp_seconds(id) AS Timestamp")
    streams.write_arrival_files(given, path, 4)
    assert not dealt
    assert [n for _, n in left] == [2, 2, 4, 4, 6, 6, 8, 8, 8] and len({at for at, _ in left}) == 9
    assert spark.read.parquet(path).count() == 1000


def test_arrival_files_of_odd_rows(spark):
    """Rows without a time, of one time only, repeated ones, and none at all."""
    at = dt.datetime(2020, 1, 1)
    for rows in ([(1, None, "a"), (2, at, "b"), (2, at, "b"), (3, dt.datetime(2021, 1, 1), None)], [(1, at, "a")] * 3, [(1, None, "a")], []):
        path = streams.write_arrival_files(_given(spark, rows), scratch_path(spark, "t-arrivals-odd"), 2)
        assert sorted(map(str, spark.read.parquet(path).select("n", "Timestamp", "TraceId").collect())) == sorted(
            map(str, _given(spark, rows).collect()))
