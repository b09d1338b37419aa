"""Parity compares digests of rows."""

import pytest

from tracelake.functions.scalars import row_digest
from tracelake.operators import setops


def test_parity_shuffles_digests(spans_small):
    keys = [x for x in setops.parity(
        spans_small, spans_small)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert keys and not any("span_json" in x for x in keys)


@pytest.mark.parametrize("values", [(("a", None), ("a", "")), (("ab", "c"), ("a", "bc")), (("1:a", "-"), ("1:a", None))])
def test_digests_tell_rows_apart(spark, values):
    df = spark.createDataFrame(list(values), "x string, y string")
    assert df.select(row_digest("x", "y")).distinct().count() == 2
