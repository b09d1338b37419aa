"""Walks of whole traces: a task gets its traces' nodes in one shuffle and follows their pointers in numpy.

Traces of up to ``MOST_NODES`` spans (nearly all) are dealt to tasks whole; a task solves some ``BATCH_NODES`` nodes, of many
traces, at once, so that its memory doesn't grow with the table. Larger traces, and spans without a TraceId, are told
apart by a count first; for them ``operators.traces`` joins pointers by doubling, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.packing import pack_id, unpack_id
from ..plans.strategies import cut_lineage
from ..session import ship_code

#: Spans of the largest trace that a task takes whole (some 20 MB), and nodes that it solves at once.
MOST_NODES = 100_000
BATCH_NODES = 200_000


def split_by_size(spans: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Spans of traces that a task takes whole; those of larger ones and without a TraceId (None: there are none)."""
    large = cut_lineage(spans.groupBy("TraceId").agg(F.count(F.lit(1)).alias("n"))
                        .filter((F.col("n") > MOST_NODES) | F.col("TraceId").isNull())
                        .select(F.col("TraceId").alias("_large")), "large-traces")
    if large.isEmpty():
        return spans, None
    same = spans["TraceId"].eqNullSafe(large["_large"])
    return spans.join(large, same, "left_anti"), spans.join(large, same, "left_semi")


def solve_traces(spans: DataFrame, cols: list[str], solve: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``solve`` over the unique nodes (TraceId, SpanId, ``cols``: of retried copies the smallest) of whole traces.

    One shuffle, by TraceId; ids travel as bytes. ``solve`` gets the nodes of some traces, all of each."""
    ship_code(spans.sparkSession)
    sent = (spans.select(pack_id("TraceId").alias("_t"), pack_id("SpanId").alias("_s"),
                         *[(pack_id(c) if c == "ParentSpanId" else F.col(c)).alias(c) for c in cols])
            .repartition("_t"))
    least = F.min(F.struct(*[(unpack_id(c) if c == "ParentSpanId" else F.col(c)).alias(c) for c in cols]))
    nodes = (sent.groupBy("_t", "_s").agg(least.alias("_n")).sortWithinPartitions("_t")
             .select(unpack_id("_t").alias("TraceId"), unpack_id("_s", "SpanId").alias("SpanId"), "_n.*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH_NODES:
                continue
            table = pa.Table.from_batches(held)
            trace = _codes(table["TraceId"])[0]
            cut = int(np.flatnonzero(np.r_[True, trace[1:] != trace[:-1]])[-1])  # the last trace may go on
            if cut:
                yield from solve(table.slice(0, cut)).to_batches()
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return nodes.mapInArrow(run, schema)


def _codes(*columns: pa.ChunkedArray) -> tuple:
    """Each column as numbers of its distinct texts (null: -1), and the texts."""
    one = pa.chunked_array([k for c in columns for k in c.chunks], pa.string()).combine_chunks().dictionary_encode()
    numbers = pc.fill_null(one.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return (*np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), one.dictionary)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value is known, and the value (0: null); in this order nulls sort first, as in Spark."""
    return (pc.is_valid(column).to_numpy(), pc.fill_null(column, 0).to_numpy())


class Forest:
    """Nodes of whole traces: ``up`` is a node's parent, ``end`` above a root, ``lost`` where the parent is missing."""

    def __init__(self, nodes: pa.Table):
        self.n = nodes.num_rows
        self.end, self.lost = self.n, self.n + 1
        self.trace, _ = _codes(nodes["TraceId"])
        self.span, self.parent, texts = _codes(nodes["SpanId"], nodes["ParentSpanId"])
        self.text_rank = np.full(len(texts) + 1, -1)  # a null's, at -1, is the least
        self.text_rank[pc.array_sort_indices(texts).to_numpy()] = np.arange(len(texts))
        self.rootless = (self.parent >= 0) & (self.parent != pc.index(texts, "").as_py())
        many = len(texts) + 1
        key = np.where(self.span >= 0, self.trace * many + self.span, -1)
        order = np.argsort(key, kind="stable")
        wanted = self.trace * many + self.parent
        at = order[np.minimum(np.searchsorted(key[order], wanted), self.n - 1)]
        self.up = np.where(self.rootless, np.where(key[at] == wanted, at, self.lost),
                           np.where(self.span >= 0, self.end, self.lost))

    def to_root(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a root is above each node, and the sum of the weights from the node to that root. Before round k a
        pointer spans 2^k nodes; what is still open after the last round is in a cycle."""
        to, total = np.r_[self.up, self.end, self.lost], np.r_[weight, 0, 0]
        for _ in range(self.n.bit_length() + 1):
            if (to >= self.n).all():
                break
            total = total + total[to]
            to = to[to]
        return to[:self.n] == self.end, total[:self.n]


def depths(nodes: pa.Table) -> pa.Table:
    """TraceId, SpanId, depth (root 1; null without a root)."""
    reached, depth = (f := Forest(nodes)).to_root(np.ones(nodes.num_rows, np.int64))
    return pa.table({"TraceId": nodes["TraceId"], "SpanId": nodes["SpanId"],
                     "depth": pa.array(depth.astype(np.int32), mask=~reached)}) if f.n else nodes


def preorder(nodes: pa.Table) -> pa.Table:
    """TraceId, SpanId, preorder_rank of the nodes under a root: one place after the parent, plus the sizes of the earlier
    siblings' subtrees (siblings, and roots, by start, then SpanId), summed up to the root."""
    nodes = nodes.filter(pc.is_valid(nodes["SpanId"]))
    f = Forest(nodes)
    reached, depth = f.to_root(np.ones(f.n, np.int64))
    size = np.ones(f.n + 2, np.int64)
    here = np.flatnonzero(reached)
    here = here[np.argsort(-depth[here], kind="stable")]
    for level in np.split(here, np.flatnonzero(np.diff(depth[here])) + 1):  # from the deepest
        np.add.at(size, f.up[level], size[level])
    known, start = _numbers(nodes["StartUnixNano"])
    order = here[np.lexsort([x[here] for x in (f.text_rank[f.span], start, known, f.parent, f.trace)])]
    before = np.cumsum(size[order]) - size[order]
    first = np.r_[True, (np.diff(f.trace[order]) != 0) | (np.diff(f.parent[order]) != 0)][:len(order)]
    offset = np.zeros(f.n, np.int64)
    offset[order] = before - before[first][np.cumsum(first) - 1] + 1 if len(order) else 0
    rank = f.to_root(offset)[1]
    return pa.table({"TraceId": nodes["TraceId"], "SpanId": nodes["SpanId"],
                     "preorder_rank": pa.array(rank)}).filter(pa.array(reached))


def critical(nodes: pa.Table) -> pa.Table:
    """A row for each root: TraceId, number of spans on the chain of latest-ending children, its leaf's SpanId and name."""
    f = Forest(nodes)
    end_known, end = _numbers(pc.add(nodes["StartUnixNano"], nodes["Duration"]))
    here = np.flatnonzero(f.rootless)
    order = here[np.lexsort([x[here] for x in (f.text_rank[f.span], end, end_known, f.parent, f.trace)])]
    last = order[np.r_[(np.diff(f.trace[order]) != 0) | (np.diff(f.parent[order]) != 0), True][:len(order)]]
    last = last[(f.up[last] < f.n) & (f.span[last] >= 0)]
    to, spans = np.arange(f.n), np.zeros(f.n, np.int64)
    to[f.up[last]], spans[f.up[last]] = last, 1
    for _ in range(f.n.bit_length() + 1):
        spans, to = spans + spans[to], to[to]
    root = np.flatnonzero(~f.rootless & (f.parent >= 0) & (f.span >= 0))
    leaf = nodes.take(pa.array(to[root]))
    return pa.table({"TraceId": nodes["TraceId"].take(pa.array(root)), "cp_spans": pa.array((spans[root] + 1).astype(np.int32)),
                     "cp_leaf_span_id": leaf["SpanId"], "cp_leaf_name": leaf["SpanName"]})
