import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tracelake.session import local_session

    ckpt = tempfile.mkdtemp(prefix="tracelake-test-ckpt-")
    s = local_session("*", shuffle_partitions=8, app="tracelake-tests", extra={"spark.checkpoint.dir": ckpt})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def spans_small(spark):
    from tracelake.sources.fixtures import load_spans

    return load_spans(spark, SF0001).cache()


def make_spans(spark, rows):
    """rows: (trace, span, parent, name, kind, service, start_ns, dur_ns[, status])"""
    from pyspark.sql import functions as F

    from tracelake.sources.fixtures import EVENT_TYPE

    data = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8] if len(r) > 8 else "Unset") for r in rows]
    df = spark.createDataFrame(data, "TraceId string, SpanId string, ParentSpanId string, SpanName string, "
                                     "SpanKind string, ServiceName string, StartUnixNano long, Duration long, "
                                     "StatusCode string")
    return (df.withColumn("Timestamp", F.timestamp_micros(F.call_function("div", F.col("StartUnixNano"), F.lit(1000))))
            .withColumn("Events", F.array().cast(EVENT_TYPE))
            .withColumn("StatusMessage", F.lit(""))
            .withColumn("SpanAttributes", F.create_map().cast("map<string,string>")))
