"""A corpus pipeline over ``documents``: each stage applies one operator of
``tracelake.llm`` to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import stages
from tracelake.llm.common import table
from tracelake.session import configure, scratch_path

#: (name, function) in order; a function takes (spark, docs, sf_dir).
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("near_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("byte_bpe", stages.encode_texts),
]

#: DuckDB SQL for the rows of ``run``: none. The stages rest on learned weights,
#: fingerprints and seeded draws, which SQL can't express; tests/llm compares them with
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one written as Parquet and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
