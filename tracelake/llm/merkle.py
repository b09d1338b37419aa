"""Merkle manifest of a table: one digest for each source and one for all of it, with a proof a row.

1. A row's leaf is H of its columns, each written as byte count, ``:`` and value (``-`` for null).
2. Leaves get their place in their source: dealt into ranges of (source, order) and sorted, and only a
   row for each range and source meets for the places before it, so a source with a third of all
   rows lies in many tasks.
3. Every level is equijoined with itself on computed sibling places (slots 1 to fanout - 1 further,
   around the run of ``fanout`` nodes); the rows of slot zero emit the parents. A tree is done
   when one node is left. The trees' last nodes, in the order of the sources, are the leaves of the top tree.
4. Proofs go down again: a node's steps are its own siblings and then its parent's steps. A level has a
   third of the rows of the one below, so that long proofs exist only where they are digested.

H is sha256 in lowercase hex, of inputs as text end to end. Levels are tables in the shared folder.

Null sources are one tree, the first. Rows of null order come first in their tree; rows that share it are
ordered by leaf, and equal rows are all leaves. An empty table has no rows and no root.
Columns that aren't named take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_ids

FANOUT = 3


def digest(*parts: Column) -> Column:
    """H of texts end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A column's value as it stands in a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    """A row's leaf, some columns with another value in place of theirs."""
    return digest(*(field((replaced or {}).get(c, F.col(c))) for c in columns))


def _placed(rows: DataFrame, group: str | None, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a unique ``row_id``) with ``tree`` (a long for each group, ascending with it),
    ``place`` (from 0, in the order of ``order`` within the group) and ``size`` (rows of the group)."""
    rows = rows.withColumn("_g", F.col(group) if group else F.lit(0))
    keys = ["_g", *order, "row_id"]
    dealt = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("_pos", F.monotonically_increasing_id())
                        .withColumn("_part", F.shiftright("_pos", 33)), "merkle-order")
    # A row for each range and group; of one group at most as many as there are ranges.
    runs = dealt.groupBy("_part", "_g").agg(F.min("_pos").alias("_lo"), F.count("*").alias("_n"))
    across = Window.partitionBy("_g")
    before = across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_part").alias("_p"), F.col("_g").alias("_h"), "_lo", F.min("_lo").over(across).alias("tree"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                       F.sum("_n").over(across).alias("size"))
    return (dealt.join(runs, (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")))
            .withColumn("place", F.col("_before") + F.col("_pos") - F.col("_lo"))
            .drop("_pos", "_part", "_p", "_lo", "_before", "_g", "_h"))


def _level(nodes: DataFrame, fanout: int, kept: Sequence[str]) -> DataFrame:
    """Nodes (``tree``, ``place``, ``node``, ``size``) with ``before`` and ``after``: the digests of their
    siblings on either side, end to end. One equijoin for each other slot of a run."""
    out = nodes.withColumn("slot", F.col("place") % fanout)
    shifts = range(1, fanout)
    for shift in shifts:
        other = nodes.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("node").alias(f"_d{shift}"))
        out = (out.withColumn("_s", F.col("place") - F.col("slot") + (F.col("slot") + shift) % fanout)
               .join(other, (F.col("tree") == F.col("_t")) & (F.col("_s") == F.col("_p")), "left").drop("_t", "_p", "_s"))

    def on_side(after: bool) -> Column:
        """Siblings so many slots on come after the node, until the run begins again."""
        return F.concat(*(F.when((F.col("slot") + s < fanout) == F.lit(after), F.coalesce(f"_d{s}", F.lit("")))
                          .otherwise(F.lit("")) for s in shifts))

    return out.select("tree", "place", "slot", "node", "size", on_side(False).alias("before"),
                      on_side(True).alias("after"), *kept)


def _climb(nodes: DataFrame, fanout: int, kept: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """All levels with siblings, from the leaves (with their ``kept`` columns) up, and the last node of
    each tree: ``tree``, ``node``, ``height`` (levels below it)."""
    levels, done, largest = [], [], nodes.agg(F.max("size")).first()[0] or 0
    while True:
        done.append(nodes.where("size = 1").select("tree", "node", F.lit(len(levels)).alias("height")))
        if largest <= 1:
            return levels, materialize(reduce(DataFrame.union, done), "merkle-roots")
        level = materialize(_level(nodes.where("size > 1"), fanout, [] if levels else kept), "merkle-level")
        levels.append(level)
        nodes = level.where("slot = 0").select(
            "tree", F.floor(F.col("place") / fanout).cast("long").alias("place"),
            digest(F.col("node"), F.col("after")).alias("node"),
            F.ceil(F.col("size") / fanout).cast("long").alias("size"))
        largest = -(-largest // fanout)


_STEPS = "array<struct<before:string,after:string>>"


def _descend(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, fanout: int, kept: Sequence[str]) -> DataFrame:
    """From ``roots`` (``tree``, ``height``, ``node``, ``steps``) to a row for each leaf: its ``kept`` columns, ``subroot``
    and ``steps`` (its siblings, then those of the nodes above it, then the root's steps)."""
    tops = lambda h: roots.where(F.col("height") == h).select(
        F.col("tree").alias("_t"), F.lit(0).cast("long").alias("_p"), F.col("node").alias("subroot"), "steps")
    above = None
    for h in range(len(levels) - 1, -1, -1):
        above = tops(h + 1) if above is None else above.unionByName(tops(h + 1))
        rows = (levels[h].withColumn("_s", F.floor(F.col("place") / fanout).cast("long"))
                .join(above, (F.col("tree") == F.col("_t")) & (F.col("_s") == F.col("_p")))
                .withColumn("steps", F.concat(F.array(F.struct("before", "after")), "steps")))
        above = rows.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), "subroot", "steps")
        if h % 4 == 1:  # a shorter lineage; levels in between are read once
            above = materialize(above, "merkle-steps")
    alone = leaves.where("size = 1").join(tops(0), F.col("tree") == F.col("_t"))
    out = [d.select("subroot", "steps", *kept) for d in ([rows] if levels else []) + [alone]]
    return reduce(DataFrame.unionByName, out)


def manifest(rows: DataFrame, columns: Sequence[str], group: str, order: str, fanout: int = FANOUT,
             carried: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``rows``: ``order``'s column, ``leaf`` (of ``columns``), ``subroot`` (of its group's
    tree), ``root``, ``steps`` (for each level from the leaf to the root, the digests ``before`` and ``after`` the path,
    end to end) and the ``carried`` columns, given by name."""
    carried = carried or {}
    own = {"leaf": leaf(columns), "_order": F.col(order), **{f"_c_{n}": c for n, c in carried.items()}}
    kept = with_row_ids(rows.select(F.col(group).alias("_group"), *(c.alias(n) for n, c in own.items())))
    leaves = materialize(_placed(kept, "_group", ["_order", "leaf"])
                         .select("tree", "place", "size", F.col("leaf").alias("node"), *own), "merkle-leaves")
    levels, subroots = _climb(leaves, fanout, list(own))

    # The trees' last nodes are the leaves of the top tree.
    subroots = subroots.select("node", "height", F.col("tree").alias("row_id"))
    firsts = materialize(_placed(subroots, None, ["row_id"]), "merkle-tops")
    held = ["row_id", "height", "_node"]
    firsts = firsts.withColumn("_node", F.col("node"))
    upper, last = _climb(firsts, fanout, held)
    last = last.withColumn("steps", F.array().cast(_STEPS))
    root = last.first()
    tops = materialize(_descend(firsts, upper, last, fanout, held).select(
        F.col("row_id").alias("tree"), "height", F.col("_node").alias("node"), "steps"), "merkle-subroots")

    out = _descend(leaves, levels, tops, fanout, list(own))
    return out.select(F.col("_order").alias(order), "leaf", "subroot", F.lit(root and root["node"]).alias("root"),
                      "steps", *(F.col(f"_c_{n}").alias(n) for n in carried))


def proof_digest(steps: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def fold(node: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, node, lambda at, s: digest(s["before"], at, s["after"]))
