"""Deleting repeated runs of lines with a suffix array over line-ID sequences.

1. Each document is the sequence of the IDs of its lines (blank ones left out). Prefix doubling
   ranks the suffixes: level 0 names the lines in sorted order, level k + 1 names
   the pairs of level-k names 2^k lines apart, again in sorted order. The names of a level
   put all suffixes in order of their first 2^k lines. Only suffixes whose prefix occurs
   again go on, so a level is as large as the repeats are, not as the corpus.
2. A run counts from ``MIN_WORDS`` words. For each line the shortest run of that many words
   that begins there, and the one that ends there, is looked up: suffixes that agree on its
   m lines form an interval of the suffix array whose longest common prefix is at least m,
   and two level-k names, k = floor(log2 m), tell them from all others. No line is
   without words, so m is at most ``MIN_WORDS`` and the levels are few, however long the
   documents are: deeper ranks couldn't change an interval.
3. Of an interval's members the first (by doc_id and place) stays, the others are
   later copies. A maximal repeated run is the union of these short runs, so that deleting
   their lines deletes it whole. A line always stays where it first occurred in such a run.

All steps are grouped counts and joins on names; a line that a third of the documents share
is pre-counted before the shuffle, and its join is split by Spark's skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ordered_names, with_row_ids

MIN_WORDS = 50
_BLANK = " \t\n\v\f\r"


def windows(words: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, how many lines the shortest run of at least ``least`` words has that
    begins there, and that ends there; 0 if there is none."""
    sums = np.r_[0, np.cumsum(words)]
    n = len(words)
    at = np.arange(n)
    stop = np.searchsorted(sums, sums[:-1] + least, side="left")
    start = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    return np.where(stop <= n, stop - at, 0), np.where(start >= 0, at + 1 - start, 0)


def _lines(least: int):
    names = ["row_id", "doc_id", "pos", "h1", "h2", "after", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs, places, hashes, after, before = [], [], [], [], [], []
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [s for s in (line.strip(_BLANK) for line in (text or "").split("\n")) if s]
                if not lines:
                    continue
                data = [line.encode() for line in lines]
                hashes += [xxhash.xxh3_128_digest(d) for d in data]
                a, b = windows([len(d.split()) for d in data], least)
                rows.append(np.full(len(data), row))
                docs += [doc] * len(data)
                places.append(np.arange(len(data)))
                after.append(a)
                before.append(b)
            if rows:
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                cat = lambda x: pa.array(np.concatenate(x).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows)), pa.array(docs, pa.int64()), cat(places), pa.array(h[:, 0]),
                     pa.array(h[:, 1]), cat(after), cat(before)], names)

    return run


def _again(keys: DataFrame, *cols: str) -> DataFrame:
    """The distinct keys that occur more than once, named in their order."""
    return ordered_names(keys.groupBy(*cols).count().where("count > 1").select(*cols), *cols)


def suffix_levels(lines: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k, ``row_id``, ``pos``, ``name``: the rank of the suffix at each line by its
    first 2^k lines, for the suffixes whose first 2^k lines occur elsewhere, too."""
    first = lines.join(_again(lines, "h1", "h2"), ["h1", "h2"]).select("row_id", "pos", "name")
    out = [materialize(first, "suffixes-0")]
    for k in range(levels - 1):
        nxt = out[-1].select("row_id", (F.col("pos") - 2 ** k).alias("pos"), F.col("name").alias("after"))
        pairs = materialize(out[-1].withColumnRenamed("name", "here").join(nxt, ["row_id", "pos"]), "pairs")
        names = _again(pairs, "here", "after")
        out.append(materialize(pairs.join(names, ["here", "after"]).select("row_id", "pos", "name"), f"suffixes-{k + 1}"))
    return out


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row_id``, ``runs`` (array of (pos, n): n lines from pos on, blank ones not counted,
    that are a later copy; they may overlap) for the rows of ``rows`` (``row_id``, ``doc_id``,
    ``text``) that have any."""
    lines = materialize(rows.select("row_id", "doc_id", "text").mapInArrow(
        _lines(min_words), "row_id long, doc_id long, pos int, h1 long, h2 long, after int, before int"), "lines")
    levels = suffix_levels(lines, max(1, min_words).bit_length())
    names = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        names = names.union(level.withColumn("k", F.lit(k)))
    spans = F.array(F.struct(F.col("pos").alias("pos"), F.col("after").alias("n")),
                    F.struct((F.col("pos") - F.col("before") + 1).alias("pos"), F.col("before").alias("n")))
    runs = (lines.select("row_id", "doc_id", F.explode(F.array_distinct(F.filter(spans, lambda s: s["n"] > 0))).alias("s"))
            .select("row_id", "doc_id", "s.pos", "s.n").distinct()
            .withColumn("k", F.length(F.bin("n")) - 1))
    head = names.withColumnRenamed("name", "head")
    tail = names.select("row_id", "k", F.col("pos").alias("_tail"), F.col("name").alias("tail"))
    found = (runs.join(head, ["row_id", "pos", "k"])
             .withColumn("_tail", (F.col("pos") + F.col("n") - F.pow(F.lit(2), "k")).cast("int"))
             .join(tail, ["row_id", "k", "_tail"]))
    found = materialize(found.select("row_id", "pos", "n", "head", "tail",
                                     F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"),
                                              F.col("row_id").alias("c"), F.col("pos").alias("d")).alias("place")), "runs")
    first = (found.groupBy("n", "head", "tail").agg(F.min("place").alias("first"), F.count("*").alias("members"))
             .where("members > 1").drop("members"))
    # Written first: Spark splits a hot key only where both sides of the join are plain exchanges.
    later = found.join(materialize(first, "first-places"), ["n", "head", "tail"]).where(F.col("place") > F.col("first"))
    return later.groupBy("row_id").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))


def without(text: str, runs: list[dict]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the lines of the runs, the maximal stretches deleted (first line,
    lines; blank ones not counted) and how many words they had."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(_BLANK)]
    gone = np.zeros(len(full) + 1, np.int64)
    for run in runs:
        gone[run["pos"]] += 1
        gone[run["pos"] + run["n"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    stretches = [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
    drop = np.zeros(len(lines), bool)
    words = 0
    for at, n in stretches:  # blank lines between two deleted ones go, too
        drop[full[at]:full[at + n - 1] + 1] = True
        words += sum(len(lines[i].encode().split()) for i in full[at:at + n])
    return "\n".join(line for line, d in zip(lines, drop) if not d), stretches, words


_STRETCH = "array<struct<first:int,lines:int>>"


def dedup_rows(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` (materialised, with a unique ``row_id``, ``doc_id`` and ``text``) with the text
    left, ``deleted`` (maximal stretches) and ``words_deleted``; other columns stay."""
    joined = rows.join(later_copies(rows, min_words).withColumnRenamed("runs", "_runs"), "row_id", "left")
    kept = [c for c in rows.columns if c not in ("text", "deleted", "words_deleted")]
    schema = rows.selectExpr(*(f"`{c}`" for c in kept), "text", f"CAST(NULL AS {_STRETCH}) AS deleted",
                             "CAST(0 AS BIGINT) AS words_deleted").schema
    inner = pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [without(t, r) if r and t else (t, [], 0)
                    for t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cut = pa.array([[{"first": a, "lines": n} for a, n in d[1]] for d in done], inner)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array([d[0] for d in done], pa.string()), cut,
                 pa.array([d[2] for d in done], pa.int64())], [*kept, "text", "deleted", "words_deleted"])

    return joined.select("text", "_runs", *(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: ``doc_id``, ``text`` (what is left), ``deleted`` (maximal deleted
    stretches: first line and number of lines, blank lines not counted), ``words_deleted``.

    Lines are compared without the white space around them; a run of lines of at least
    ``min_words`` words that occurred before, in a smaller doc_id (null last) or further up
    in the same text, is deleted. Rows that share a doc_id are documents of their own, one after
    the other. Null texts stay null; empty tables give no rows; other columns are not read."""
    rows = with_row_ids(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return dedup_rows(rows, min_words).drop("row_id")
