"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path, ship_code

#: A run of the six ASCII white-space characters, and a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of rows that Spark hands to a Python worker at once: bounds the worker's memory, however
#: long the texts are (one longer row is a batch of its own).
BATCH_BYTES = "4m"


def ship_package(spark: SparkSession) -> SparkSession:
    """Make a session ready for the operators: batches bounded in bytes, and this package given
    to the executors' Python workers, once a context, as ``--py-files`` would."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship_code(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RECORDED: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def recorded_tables() -> Iterator[list[str]]:
    """The paths of the tables that :func:`materialize` writes inside of the block."""
    token = _RECORDED.set([])
    try:
        yield _RECORDED.get()
    finally:
        _RECORDED.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete recorded tables, for a caller that needs none of the results built on them any more."""
    for path in paths:
        drop_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives
    the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    if (recorded := _RECORDED.get()) is not None:
        recorded.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_names(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows of ``keys`` with ``name``: a long that grows in the order
    of ``cols``.

    The keys are dealt into ranges and sorted; a key's name is its partition
    number and its place there. Materialised at once, so names stay fixed."""
    named = (keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
             .withColumn("name", F.monotonically_increasing_id()))
    return materialize(named, "names")


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A materialised copy of ``df`` with a unique long for each row, so that
    repeated rows stay apart and a retried task can't change the numbers."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def running_totals(df: DataFrame, order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """``df`` with the exclusive running total of columns in a global order.

    ``values`` maps a numeric column to the name of its running total. Rows are
    dealt into ranges, summed up within each, and only one row of sums for each
    partition meets in a single task. Ties in ``order`` must not matter."""
    from pyspark.sql import Window

    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_pos", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_pos", 33)), "ranges")
    within = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    sums = sums.select("_part", *(F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}")
                                  for v in values))
    out = placed.join(sums, "_part")
    for v, name in values.items():
        out = out.withColumn(name, F.col(f"_b_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)))
    return out.drop("_part", "_pos", *(f"_b_{v}" for v in values))
