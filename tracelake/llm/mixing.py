"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Each source's target is its share of all words by weight, at most ``MAX_EPOCHS``
   times its size; what exceeds that is reshared by weight until none is above.
2. Texts become equal blocks of words. All blocks of the mix are allocated to the sources
   by the highest quotients target / (2 k + 1), and each source's blocks to its shards
   in the same way, by size: integer quotas.
3. Within a shard the documents lie one after another in a seeded order. A quota of
   q blocks out of n takes every block floor(q / n) times and, once more, the q mod n
   blocks of smallest seeded hash. So no word is taken over ``MAX_EPOCHS`` times.

Shards have a bounded number of words, so a source with a third of all rows is many
tasks. Only sums reach the driver. Everything depends on the rows and the seed alone, not
on partitions or retries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, running_totals

MAX_EPOCHS, WEIGHTS = 3, (5.0, 2.0, 1.0)
#: Words of a block, and of a shard (about; a longer document is a shard's whole share).
BLOCK, SHARD = 16, 1_000_000
SEED = 42


def word_count(text: Column) -> Column:
    """Number of words; null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (one row each: ``size``, ``weight``) with ``target`` (double).

    Each step fixes the sources whose share is above their limit and reshares the
    rest; the share of a unit of weight only grows, so the steps end."""
    limit = F.col("size") * F.lit(float(max_epochs))
    unit = None
    while True:
        capped = F.lit(False) if unit is None else F.col("weight") * F.lit(unit) >= limit
        total, fixed, weight = sources.agg(F.sum("size"), F.sum(F.when(capped, limit)),
                                           F.sum(F.when(~capped, F.col("weight")))).first()
        share = max(float(total) - (fixed or 0.0), 0.0) / weight if weight else None
        if share is None or unit is not None and share <= unit:
            return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(unit or 0.0)))
        unit = share


def sainte_lague(parties: DataFrame) -> DataFrame:
    """``grp``, ``party``, ``quota``: how many of its group's ``seats`` each party with
    ``votes`` gets by the highest quotients votes / (2 k + 1); ties to the smaller party.

    With n parties, V votes and S seats a party's quota lies within votes / V (S +- n / 2)
    +- 1. Seats below the band are sure, so only some three quotients a party are ranked,
    however many seats there are."""
    sums = parties.groupBy("grp").agg(F.sum("votes").alias("_v"), F.count("*").alias("_n"), F.max("seats").alias("_s"))
    share = F.when(F.col("_v") > 0, F.col("votes") / F.col("_v")).otherwise(F.lit(0.0))
    rows = materialize(
        parties.join(sums, "grp")
        .withColumn("_low", F.greatest(F.lit(0), F.floor(share * (F.col("_s") - F.col("_n"))) - 1).cast("long"))
        .withColumn("_high", F.ceil(share * (F.col("_s") + F.col("_n"))).cast("long") + 1)
        .withColumn("_low", F.when((F.col("_s") > 0) & (share > 0), F.col("_low")).otherwise(0))
        .select("grp", "party", "votes", "_low", "_high", "_s"), "parties")
    bids = (rows.where((F.col("_s") > 0) & (F.col("votes") > 0))
            .select("grp", "party", F.explode(F.sequence("_low", "_high")).alias("k"), "votes")
            .select("grp", "party", "k", (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"), F.lit(1).alias("one")))
    # A bid's rank in its group follows from its place in the order of all groups.
    ranked = materialize(running_totals(bids, ["grp", F.desc("quotient"), "party", "k"], {"one": "before"}), "bids")
    bounds = (rows.groupBy("grp").agg((F.max("_s") - F.sum("_low")).alias("open"))
              .join(ranked.groupBy("grp").agg(F.min("before").alias("base")), "grp"))
    won = (ranked.join(bounds, "grp").where(F.col("before") - F.col("base") < F.col("open"))
           .groupBy("grp", "party").agg(F.count("*").alias("won")))
    return (rows.join(won, ["grp", "party"], "left")
            .select("grp", "party", (F.col("_low") + F.coalesce("won", F.lit(0))).alias("quota")))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published SplitMix64 one)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def take_blocks(sizes: np.ndarray, quota: int, key: int, block: int) -> tuple[int, np.ndarray]:
    """Full passes over a shard of documents laid end to end, and the sorted blocks that
    are taken once more."""
    n = -(-int(sizes.sum()) // block)
    passes, extra = divmod(quota, n) if n else (0, 0)
    hashes = _mixed(np.arange(n, dtype=np.uint64) ^ _mixed(np.array([key], np.int64).view(np.uint64)))
    return passes, np.sort(np.argsort(hashes, kind="stable")[:extra])


def _take(block: int, max_epochs: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id", "size"], kind="stable")
        sizes = part["size"].to_numpy(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = -(-int(ends[-1]) // block)
        passes, blocks = take_blocks(sizes, min(int(part["quota"].iloc[0]), max_epochs * n),
                                     int(part["key"].iloc[0]), block)
        first = np.searchsorted((blocks + 1) * block, starts, side="right")
        last = np.searchsorted(blocks * block, ends, side="left")
        spans, taken = [], sizes * passes
        for i, (a, b, s, e) in enumerate(zip(first, last, starts, ends)):
            found = []
            for at in blocks[a:b] * block:
                lo, hi = int(max(at, s) - s), int(min(at + block, e) - s)
                if found and found[-1][1] == lo:
                    found[-1][1] = hi
                else:
                    found.append([lo, hi])
            spans.append(found)
            taken[i] += sum(hi - lo for lo, hi in found)
        return part.assign(passes=passes, spans=spans, taken=taken)[
            ["row_id", "doc_id", "size", "source_size", "target", "taken", "passes", "spans"]]

    return run


_OUT = ("row_id long, doc_id long, size long, source_size long, target double, taken long, passes int, "
        "spans array<array<long>>")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id``, ``size`` (words), ``source_size``, ``target``
    (words, its source's), ``taken`` (words the mix takes, repeats counted), and how:
    ``passes`` whole copies and ``spans`` ([from, to) in words) once more. ``row_id``
    is ``row_col``, if given.

    Sources in code point order, null last, take ``weights`` in turn. Null and empty
    texts have size 0 and nothing is taken of them. Rows that share a doc_id are
    documents of their own, in the order of a hash of their texts; equal rows are interchangeable.
    An empty table gives no rows; other columns are not read."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = materialize(docs.select(
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row_id"),
        F.col(id_col).cast("long").alias("doc_id"), key.alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)).alias("order")), "sizes")
    sums = rows.groupBy("source_key").agg(F.sum("size").alias("size")).withColumn("one", F.lit(1))
    placed = running_totals(sums, [F.col("source_key") == "", "source_key"], {"one": "source_no"})
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = materialize(placed.select("source_key", "source_no", "size", turn.alias("weight")), "sources")
    sources = materialize(with_targets(sources, max_epochs), "targets")
    total = sources.agg(F.sum("size")).first()[0] or 0
    quotas = sainte_lague(sources.select((F.col("source_no") * 0).alias("grp"), F.col("source_no").alias("party"),
                                         F.col("target").alias("votes"), F.lit(round(total / block)).alias("seats")))
    sources = materialize(sources.join(quotas.select(F.col("party").alias("source_no"), "quota"), "source_no")
                          .select("source_key", "source_no", "target", F.col("size").alias("source_size"),
                                  F.col("quota").alias("seats"),
                                  F.greatest(F.lit(1), F.ceil(F.col("size") / shard)).alias("shards")), "quotas")
    dealt = materialize(rows.join(sources, "source_key")
                        .withColumn("shard", F.pmod("order", F.col("shards"))).drop("shards"), "shards")
    # A key for the seeded draw that doesn't depend on which other sources there are.
    drawn = F.xxhash64(F.lit(seed), "source_key", "shard").alias("key")
    shards = (dealt.where("size > 0").groupBy("source_no", "shard", "source_key")
              .agg(F.sum("size").cast("double").alias("votes"), F.max("seats").alias("seats")))
    by_shard = sainte_lague(shards.select(F.col("source_no").alias("grp"), F.col("shard").alias("party"), "votes", "seats"))
    by_shard = by_shard.select(F.col("grp").alias("source_no"), F.col("party").alias("shard"), "quota")
    filled = (dealt.where("size > 0").join(by_shard, ["source_no", "shard"]).select("*", drawn)
              .groupBy("source_no", "shard").applyInPandas(_take(block, max_epochs), _OUT))
    none = dealt.where("size = 0").select("row_id", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
                                          F.lit(0).alias("passes"), F.array().cast("array<array<long>>").alias("spans"))
    return filled.unionByName(none)


_WORDS = re.compile("[^\x20\x09-\x0d]+")


def cut(text: str, spans: list[list[int]]) -> str:
    """The stretches of a text that cover [from, to) of its words, a line each."""
    if not spans:
        return ""
    out, bounds, at = [], iter(_WORDS.finditer(text)), -1
    for lo, hi in spans:
        start = end = 0
        while at < hi - 1:
            word = next(bounds)
            at += 1
            if at == lo:
                start = word.start()
            end = word.end()
        out.append(text[start:end])
    return "\n".join(out)


def taken_texts(plan: DataFrame, text_col: str = "text", out_col: str = "texts") -> DataFrame:
    """``plan`` (with ``passes``, ``spans`` and the text) with the taken texts as an array:
    each whole copy, and the spans' words. A null text gives none."""
    kept = [c for c in plan.columns if c not in ("spans", out_col, "_extra")]
    schema = plan.select(*kept).schema.add("_extra", "string")
    place = 1 + kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                extra = [cut(t, s) if s and t else None
                         for s, t in zip(part.column(0).to_pylist(), part.column(place).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(extra, pa.string())], [*kept, "_extra"])

    whole = F.when(F.col(text_col).isNotNull(), F.array_repeat(text_col, F.col("passes"))).otherwise(F.array().cast("array<string>"))
    more = F.when(F.col("_extra").isNotNull(), F.array("_extra")).otherwise(F.array().cast("array<string>"))
    return (plan.select("spans", *kept).mapInArrow(run, schema)
            .withColumn(out_col, F.concat(whole, more)).drop("_extra", "passes"))
