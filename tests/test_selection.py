"""Quantiles by counted ranges and limits of any size against plain sorts."""

import random

import numpy as np
import pytest

from tracelake.operators import profile, windows


def test_quantiles_equal_numpy(spark):
    rng = random.Random(8)
    rows = [("hot", rng.choice([7, 7, rng.randrange(10 ** 9), -rng.randrange(10 ** 6)])) for _ in range(3000)]
    rows += [(f"g{i % 7}", rng.randrange(-50, 50)) for i in range(300)]
    rows += [(None, 2 ** 62), (None, -(2 ** 62)), (None, 0), ("one", 5), ("nulls", None), ("zero", 0), ("zero", 0)]
    got = profile.exact_quantiles(spark.createDataFrame(rows, "g string, v long").repartition(6), ["g"], "v").collect()
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert {r["g"] for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        values = groups[r["g"]]
        assert (r["n"], r["min"], r["max"]) == (len(values), min(values), max(values))
        assert r["mean"] == pytest.approx(sum(values) / len(values), rel=1e-12, abs=1e-9)
        for q in profile.QUANTILES:
            assert r[f"p{int(q * 100)}"] == pytest.approx(np.quantile(np.array(values, float), q), rel=1e-9, abs=1e-6)


def test_quantiles_sort_no_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    plan = profile.exact_quantiles(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("n", [0, 1, 37, 500, 1999, 2000, 5000])
def test_limits_of_any_size(spark, n, monkeypatch):
    monkeypatch.setattr(windows, "RANKED", 20)  # several rounds
    rng = random.Random(2)
    rows = [(f"t{i}", f"s{i:05d}", rng.choice([5, 5, 10 ** 15, rng.randrange(10 ** 18)])) for i in range(1990)]
    df = spark.createDataFrame([*rows, *((f"n{i}", f"n{i}", None) for i in range(10))],
                               "TraceId string, SpanId string, StartUnixNano long").repartition(5)
    got = sorted(map(tuple, windows.limit_spans(df, n).collect()))
    assert got == sorted(sorted(rows, key=lambda r: (r[2], r[1]))[:n])
