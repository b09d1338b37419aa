"""Physical-plan helpers: bounded broadcasts, lineage cuts, skew-safe top-k.

Nothing here replaces Catalyst; these are the few places where a Spark user
states a fact the optimizer cannot know (a proven size bound, a hot key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest side we hint for broadcast, in bytes.
BROADCAST_BYTES = 16 << 20


def broadcast_bounded(df: DataFrame, max_rows: int, row_bytes: int = 2_000) -> DataFrame:
    """Broadcast hint for a side of at most ``max_rows`` rows of at most ``row_bytes``, known by
    construction (a dimension sized by a job parameter). Beyond the bound the planner chooses."""
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_BYTES else df


def cut_lineage(df: DataFrame, name: str = "level") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder (``spark.checkpoint.dir``) and reading it back.

    Used by iterative jobs (level-by-level tree walks) so plans stay short
    and a lost executor recomputes from the written table, not from the
    scan. Parquet is columnar and compressed, cheaper to write and re-read
    than row checkpoints.
    """
    from ..session import scratch_path
    from .packing import dropped_shuffles

    path = scratch_path(df.sparkSession, name)
    with dropped_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def salted_top_k(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int | Column,
                 salt_col: Column | None = None, salts: int = 64, rank_name: str = "rank") -> DataFrame:
    """Exact top-k rows per group that survives a hot group.

    Phase 1 ranks inside (group, salt) sub-groups and keeps k rows each, so a
    group holding a third of all rows is spread over ``salts`` tasks; phase 2
    ranks the at most ``salts * k`` survivors per group. ``order_cols`` must
    be a total order (add a unique tie-breaker) for a deterministic result.
    ``k`` may be a column (a per-group budget).
    """
    k = F.lit(k) if isinstance(k, int) else k
    salt = salt_col if salt_col is not None else F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    pre = (df.withColumn("_salt", salt)
           .withColumn("_r1", F.row_number().over(w1))
           .filter(F.col("_r1") <= k)
           .drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return pre.withColumn(rank_name, F.row_number().over(w2)).filter(F.col(rank_name) <= k)
