"""The stages of ``corpus_pipeline.py``: operators as filters of a document table.

A stage takes (spark, docs, sf_dir). ``docs`` has the columns of ``documents``; other
columns are carried along. All but the last stage return the columns they were given. A
stage's result has to be written before the next stage of that ``sf_dir`` is called: that one deletes the tables
in the shared folder that it rests on. Tables of other operators' results are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, mixing, simhash, toxicity
from .common import drop_tables, materialize, recorded_tables, ship_package, table, with_row_ids
from .queries import RANKS, held_out, vocabulary


#: Tables that the last stage over a folder wrote.
_TABLES: dict[str, list[str]] = {}


def _stage(of: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that deletes the tables of the stage before: its input was written and read again, so they can go."""
    @wraps(of)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        drop_tables(spark, _TABLES.pop(sf_dir, []))
        with recorded_tables() as used:
            out = of(spark, docs, sf_dir)
        _TABLES[sf_dir] = used
        return out

    return run


_OWN = ("doc_id", "text", "source")


def _boxed(docs: DataFrame) -> DataFrame:
    """The columns that operators use, and all others in one struct, so that no name of
    theirs meets one that an operator uses."""
    others = [c for c in docs.columns if c not in _OWN]
    box = F.struct(*(F.col(f"`{c}`").alias(c) for c in others)) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*_OWN, box.alias("_row"))


def _unboxed(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; with another text (and n_chars, where there is such a
    column) if its column is named."""
    columns = {c: F.col(c) if c in _OWN else F.col("_row").getField(c) for c in docs.columns}
    if text:
        columns["text"] = F.col(text)
        if "n_chars" in columns:
            columns["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(column.alias(c) for c, column in columns.items()))


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity classifier doesn't reject (score below 0.5). It
    learns from the labels of the documents it is given, held-out ones left out."""
    model = toxicity.train(toxicity.labelled_texts(docs, table(spark, sf_dir, "labels"), held_out(0, 5)))
    return _unboxed(toxicity.score(_boxed(docs), model).where("score < 0.5"), docs)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated runs of lines. A document that loses all its words
    goes; one that had none stays."""
    left = line_dedup.dedup_rows(with_row_ids(_boxed(docs)))
    emptied = (F.size("deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _unboxed(left.where(~F.coalesce(emptied, F.lit(False))), docs, "text")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the smallest doc_id (null last), of rows
    that share it the one of smallest text hash, of equal rows any one."""
    rows = _boxed(docs).withColumn("row_id", F.monotonically_increasing_id())
    rows = materialize(simhash.with_fingerprints(rows), "near-dedup")
    roots = simhash.component_roots(rows.select("doc_id", "fp"), 3)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col("row_id").alias("row_id"))
    first = (rows.select("fp", place.alias("place")).join(roots.select("fp", "root"), "fp")
             .groupBy("root").agg(F.min("place").alias("first")))
    return _unboxed(rows.join(first.select("first.row_id"), "row_id", "left_semi"), docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole copy that is taken of a document, and one more with the
    stretches of its text that are taken once more. Documents without words aren't part of a mix."""
    rows = with_row_ids(_boxed(docs))
    plan = mixing.mix(rows, row_col="row_id").where("taken > 0").select("row_id", "passes", "spans")
    taken = mixing.taken_texts(rows.join(plan, "row_id"))
    return _unboxed(taken.withColumn("taken", F.explode("texts")), docs, "taken")


@_stage
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, and whether decoding them gives its text back, in place of the text."""
    checked = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    decoded = bpe.decode(bpe.encode(checked, vocabulary(RANKS)), vocabulary(RANKS))
    return (decoded.withColumn("n_tokens", F.size("ids").cast("long"))
            .withColumn("round_trip", F.sha2("decoded", 256) == F.col("_sha")).drop("_sha", "decoded"))
