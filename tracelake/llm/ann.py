"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

1. Inner products become distances: with M the largest norm, a vector x gets the extra
   component sqrt(M^2 - |x|^2) and a query 0, so that the nearest vector has the
   largest product.
2. Each of ``TABLES`` tables hashes with ``HASHES`` Gaussian projections cut into slots of
   width ``WIDTH`` times M. A query visits its own bucket and the perturbed ones in order of
   estimated success (Lv et al. 2007): the order over sorted slot distances is
   worked out once from their expected squares.
3. Vectors are dealt into blocks, queries into chunks. Each block and chunk meet in a task
   that hashes the block, merges the tables' candidates, reranks them by the exact product
   and returns each query's best. The best over all blocks follow.

A vector that occurs very often is spread over the blocks like any other. Queries
that find fewer than they should are searched again among all rows.

Blocks meet all chunks, so that work grows with vectors times queries (see README: on vectors without near
neighbours a bucket visits most rows anyway).
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_ids

HASHES, WIDTH, TABLES, PROBES = 8, 2.0, 10, 150
#: Vectors of a block and queries of a chunk, about.
BLOCK, CHUNK = 8192, 2048
SEED = 42


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of perturbations by expected score. A set holds ranks (from
    1) in the ascending order of a query's 2 * hashes distances to the slots' sides; ranks j and
    2 * hashes + 1 - j are the two sides of one slot and never go together."""
    k = hashes
    cost = [0.0] + [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else
                    1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2))
                    for j in range(1, 2 * k + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[1], (1,))]
    while heap and len(out) < probes:
        score, ranks = heappop(heap)
        if all(2 * k + 1 - j not in ranks for j in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last < 2 * k:
            heappush(heap, (score - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heappush(heap, (score + cost[last + 1], (*ranks, last + 1)))
    return out


def _mixed(slots: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of slot numbers."""
    out = np.zeros(slots.shape[:-1], np.uint64)
    for i in range(slots.shape[-1]):
        out = (out ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def candidates(queries: np.ndarray, vectors: np.ndarray, largest: float, hashes: int, width: float, tables: int,
               order: list[tuple[int, ...]], seed: int) -> np.ndarray:
    """Boolean matrix: which vectors each query meets in the visited buckets of any table."""
    extra = np.sqrt(np.maximum(largest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
    met = np.zeros((len(queries), len(vectors)), bool)
    rows = np.arange(len(queries))[:, None]
    for t in range(tables):
        rng = np.random.default_rng([seed, t])
        a, b = rng.normal(size=(vectors.shape[1] + 1, hashes)), rng.uniform(0, 1, hashes)
        scale = width * largest
        slots = np.floor((vectors @ a[:-1] + extra[:, None] * a[-1]) / scale + b).astype(np.int64)
        keys = _mixed(slots)
        by_key = np.argsort(keys, kind="stable")
        places = (queries @ a[:-1]) / scale + b
        own = np.floor(places).astype(np.int64)
        rest = places - own
        side = np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1, kind="stable")
        probes = np.repeat(own[:, None, :], len(order), axis=1)
        for p, ranks in enumerate(order):
            for j in ranks:
                c = side[:, j - 1]
                probes[rows[:, 0], p, c % hashes] += np.where(c < hashes, -1, 1)
        wanted = _mixed(probes).ravel()
        sorted_keys = keys[by_key]
        first = np.searchsorted(sorted_keys, wanted, side="left")
        sizes = np.searchsorted(sorted_keys, wanted, side="right") - first
        hit = np.flatnonzero(sizes)
        n = sizes[hit]
        ends = np.cumsum(n)
        flat = np.repeat(first[hit] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        met[np.repeat(hit // len(order), n), by_key[flat]] = True
    return met


def nearest_of(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray,
               met: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query row's best ``k`` among the vectors it met, but for its own row: query_row, vec_id, score."""
    met &= query_rows[:, None] != rows[None, :]
    # Where most pairs are candidates, one product of matrices is cheaper than gathering them.
    rough = queries @ vectors.T if met.mean() > 0.1 else None
    out_q, out_v, out_s = [], [], []
    for i, query in enumerate(queries):
        at = np.flatnonzero(met[i])
        if not len(at):
            continue
        near = rough[i, at] if rough is not None else vectors[at] @ query
        if len(at) > k:  # the last place may be shared, and products differ in the last bits
            last = np.partition(near, len(near) - k)[len(near) - k]
            at = at[near >= last - 1e-9 * max(1.0, abs(last))]
        score = (vectors[at] * query).sum(axis=1)
        best = np.lexsort((ids[at], -score))[:k]
        out_q.append(np.full(len(best), query_rows[i]))
        out_v.append(ids[at][best])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _matrix(part: pa.Table) -> np.ndarray:
    column = part.column("vector").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _meet(queries: DataFrame, vectors: DataFrame, k: int, block: int, chunk: int, pick) -> DataFrame:
    """Each query's best ``k`` of the candidates that ``pick`` gives, over all blocks and chunks."""
    n, m = vectors.count(), queries.count()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-m // chunk))

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, v = _matrix(left), _matrix(right)
            number = lambda part, name: part.column(name).to_numpy()
            found = nearest_of(q, number(left, "row_id"), v, number(right, "row_id"), number(right, "vec_id"), pick(q, v), k)
        return pa.table(dict(zip(("query_row", "vec_id", "score"), found)))

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("row_id", "vector", F.pmod(F.xxhash64("row_id"), F.lit(chunks)).cast("int").alias("chunk"),
                          numbers(blocks).alias("block"))
    right = vectors.select("row_id", "vec_id", "vector", F.pmod(F.xxhash64("row_id", F.lit(SEED)), F.lit(blocks)).cast("int").alias("block"),
                           numbers(chunks).alias("chunk"))
    pairs = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return _best(pairs.applyInArrow(part, "query_row long, vec_id long, score double"), k)


def usable(vector: Column) -> Column:
    """Not null, not all zero, without null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
           vector_col: str = "embedding", hashes: int = HASHES, width: float = WIDTH, tables: int = TABLES,
           probes: int = PROBES, block: int = BLOCK, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row that ``is_query``
    (a condition on ``vec_id``) holds for, the ``k`` other rows with the largest inner
    product found (all, if there are fewer), ties to the smaller vec_id.

    Rows that share an id are rows of their own, as queries and as candidates. Vectors that are null, zero or hold null
    or non-finite components take no part, nor do rows without an id. Vectors of another length have no product with
    a query: each length is searched by itself. An empty table gives no rows; other columns are not read."""
    rows = (embeddings.select(F.col(id_col).cast("long").alias("vec_id"),
                              F.col(vector_col).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    rows = with_row_ids(rows.withColumn("length", F.size("vector")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("length").agg(F.count("*").alias("n"), F.max(norm).alias("largest")).orderBy("length").collect()
    order = probe_order(hashes, probes)
    out = rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    for same in sizes:  # in any sound table one length
        mine = rows.where(F.col("length") == same["length"]).drop("length")
        queries = mine.where(is_query)
        found = materialize(_meet(queries, mine, k, block, chunk, lambda q, v, m=same["largest"]: candidates(
            q, v, m, hashes, width, tables, order, seed)), "neighbours")
        full = found.groupBy("query_row").count().where(F.col("count") >= min(k, same["n"] - 1)).select(F.col("query_row").alias("row_id"))
        short = materialize(queries.join(full, "row_id", "left_anti"), "short-queries")
        if not short.isEmpty():
            again = _meet(short, mine, k, block, chunk, lambda q, v: np.ones((len(q), len(v)), bool))
            found = found.join(short.select(F.col("row_id").alias("query_row")), "query_row", "left_anti").unionByName(again)
        named = found.join(queries.select(F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row")
        out = out.union(named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out
