"""Exact ordered scans within groups that survive a hot group.

A window ``PARTITION BY g ORDER BY o`` puts every row of group ``g`` into one
task. ``group_scan`` computes the same running values (row number, previous row's
value, running maximum and sum of the earlier rows) over a *range* partitioning of
(g, o) instead, so a group holding a third of all rows is cut into many
contiguous slices:

1. ``repartitionByRange(g, o)`` + sort, written to the shared folder: slice s holds a
   contiguous run of the global (g, o) order.
2. Windows over (slice, g) give the running values within the slice.
3. Only a slice's first group can have begun in an earlier slice. Its carry-in
   comes from the first and last groups of the slices before: at most two rows per slice,
   whatever the number of rows. That table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_scan(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str,
               n_partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based position in the group), ``prev_value`` (the
    previous row's ``value_col``), ``prev_max`` (max ``value_col`` over all
    earlier rows of the group) and ``prev_sum`` (their sum, null values left out), exact and
    in (group_cols, order_cols) order, which must be a total order within a group.
    ``value_col`` is an integer column. Without ``n_partitions`` Spark chooses the slices.
    """
    from .strategies import cut_lineage

    value = F.col(value_col).cast("bigint")
    dealt = (df.repartitionByRange(n_partitions, *group_cols, *order_cols) if n_partitions
             else df.repartitionByRange(*group_cols, *order_cols))
    local = cut_lineage(dealt.sortWithinPartitions(*group_cols, *order_cols)
                        .withColumn("_slice", F.spark_partition_id()), "group-scan")
    key = F.struct(*group_cols)
    ends = local.groupBy("_slice").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    # first and last group of each slice; groups between them lie within it
    edges = (local.join(F.broadcast(ends), "_slice").filter((key == F.col("_first")) | (key == F.col("_last")))
             .groupBy("_slice", *group_cols)
             .agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_max"), F.sum(value).alias("_sum"),
                  F.max_by(F.struct(value.alias("v")), F.struct(*order_cols)).alias("_prev")))
    across = Window.partitionBy(*group_cols).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        "_slice", *group_cols, F.sum("_n").over(before).alias("_c_rank"), F.max("_max").over(before).alias("_c_max"),
        F.sum("_sum").over(before).alias("_c_sum"), F.lag("_prev").over(across).alias("_c_prev"),
    ).filter(F.col("_c_rank").isNotNull())
    here = Window.partitionBy("_slice", *group_cols).orderBy(*order_cols)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    scanned = local.select(
        "*", F.row_number().over(here).cast("bigint").alias("_rank"), F.lag(value).over(here).alias("_value"),
        F.max(value).over(earlier).alias("_most"), F.sum(value).over(earlier).alias("_total"))
    zero = F.lit(0).cast("bigint")
    return scanned.join(F.broadcast(carry), ["_slice", *group_cols], "left").select(
        *df.columns,
        (F.col("_rank") + F.coalesce("_c_rank", zero)).alias("rank"),
        F.when(F.col("_rank") > 1, F.col("_value")).otherwise(F.col("_c_prev.v")).alias("prev_value"),
        F.greatest("_most", "_c_max").alias("prev_max"),
        (F.coalesce("_total", zero) + F.coalesce("_c_sum", zero)).cast("bigint").alias("prev_sum"))
