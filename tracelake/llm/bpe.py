"""Byte-level BPE by ranks: encoding in padded matrices, and decoding.

Distinct pieces of a chunk are sorted into matrices by length, one byte's id a
cell. In each round every row merges its leftmost pair of least rank, all rows at
once; rows without a pair to merge leave the matrix. Pairs are looked up in
an open-addressing hash table of numpy arrays, built once on the driver from the rank
file and broadcast (a few MB, bounded by the vocabulary). Pieces over ``WIDEST``
bytes are merged with a heap in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .pretokens import UnitTable

NONE = np.int32(2**31 - 1)
WIDEST = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """A rank file: token bytes by id, and a hash table from pairs of ids to the id
    of what they merge to."""

    def __init__(self, lines: bytes):
        tokens = {}
        for line in lines.split(b"\n"):
            if line:
                token, rank = line.split()
                tokens[base64.b64decode(token)] = int(rank)
        self.size = max(tokens.values(), default=-1) + 1
        by_id = [b""] * self.size
        for token, rank in tokens.items():
            by_id[rank] = token
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.by_id = by_id
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        lengths = np.array([len(t) for t in by_id], np.int64)
        self.token_ends = np.cumsum(lengths)
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        pairs = {}
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._build(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32))
        self.whole = tokens

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            won = todo[free & first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE. Negative ids never merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE)
        flat, found = keys.ravel(), out.ravel()
        todo = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        at = self._slot(flat[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == flat[todo]
            found[todo[hit]] = self.values[at[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge a matrix of ids padded with -1 on the right. Returns the merged matrix
        and each row's length."""
        out = np.full(rows.shape, -1, np.int32)
        alive, ids = np.arange(len(rows)), rows.astype(np.int32)
        ranks = self.merged(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.zeros((len(ids), 0), np.int32)
        while len(alive) and ranks.shape[1]:
            j = ranks.argmin(axis=1)  # the leftmost of the least
            r = np.arange(len(alive))
            new = ranks[r, j]
            on = new != NONE
            if not on.all():  # compaction: rows that are done leave
                out[alive[~on], :ids.shape[1]] = ids[~on]
                alive, ids, ranks, j, new = alive[on], ids[on], ranks[on], j[on], new[on]
                r = np.arange(len(alive))
                if not len(alive):
                    break
            ids[r, j] = new
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > j[:, None]), axis=1)
            cols = cols[:-1]
            if not len(cols):
                ranks = ranks[:, :0]
                break
            ranks = np.take_along_axis(ranks, cols + (cols > j[:, None]), axis=1)
            has = j < ids.shape[1] - 1
            ranks[r[has], j[has]] = self.merged(ids[r[has], j[has]], ids[r[has], j[has] + 1])
            has = j > 0
            ranks[r[has], j[has] - 1] = self.merged(ids[r[has], j[has] - 1], ids[r[has], j[has]])
        out[alive, :ids.shape[1]] = ids
        return out, (out >= 0).sum(axis=1)

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece, merged in the same order with a heap."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.merged(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, rank in enumerate(first.tolist()) if rank != NONE]
        heapq.heapify(heap)
        if not hasattr(self, "_pairs"):
            used = self.values != NONE
            self._pairs = dict(zip(self.keys[used].tolist(), self.values[used].tolist()))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or self._pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self._pairs.get(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := self._pairs.get(ids[p] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, p))
        return [x for x in ids if x is not None]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each."""
        data = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in data])
        counts = np.ones(len(data), np.int64)
        single = np.array([self.whole.get(d, -1) for d in data], np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        other = np.flatnonzero(single < 0)
        width = 4
        while len(other):
            now = other[sizes[other] <= width] if width <= WIDEST else other
            other = other[sizes[other] > width] if width <= WIDEST else other[:0]
            if width > WIDEST:
                for i in now:
                    ids = np.array(self.merge_long(data[i]), np.int32)
                    counts[i] = len(ids)
                    found.append((np.full(1, i), ids[None, :]))
            # A matrix of a few MB at a time.
            for at in range(0, len(now) if width <= WIDEST else 0, max(1, (1 << 19) // width)):
                rows = now[at:at + max(1, (1 << 19) // width)]
                raw = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in rows), np.uint8)
                ids = self.byte_ids[raw].reshape(len(rows), width)
                ids[np.arange(width) >= sizes[rows][:, None]] = -1
                merged, counts[rows] = self.merge_rows(ids)
                found.append((rows, merged))
            width *= 2
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        whole = single >= 0
        out[(ends - counts)[whole]] = single[whole]
        for rows, ids in found:
            keep = ids >= 0
            place = (ends - counts)[rows][:, None] + np.arange(ids.shape[1])
            out[place[keep]] = ids[keep]
        return out, counts

    def decode(self, ids: np.ndarray) -> bytes:
        ends = self.token_ends[ids]
        starts = np.where(ids > 0, self.token_ends[ids - 1], 0)
        sizes = ends - starts
        stop = np.cumsum(sizes)
        if not len(stop):
            return b""
        return self.token_bytes[np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1])].tobytes()


def _broadcast(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Ranks(f.read()))


_TABLES: dict[str, UnitTable] = {}


def _table(path: str, ranks: Ranks) -> UnitTable:
    """This worker's table of units, kept between tasks."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = UnitTable(ranks.encode_pieces)
    return _TABLES[path]


def list_array(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                                    pa.array(ids.astype(np.int32)))


#: Bytes of text behind a batch that goes back to Spark, but for a single longer document.
BATCH_IDS = 1 << 21


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """Each row's ids as little-endian unsigned 32-bit integers."""
    ends = np.r_[0, np.cumsum(counts)] * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", out_col: str = "ids",
           pack: bool = False) -> DataFrame:
    """``docs`` without its text column, with ``ids`` (array of int; with ``pack`` binary,
    four little-endian bytes each): each match of the pattern in the text, encoded apart
    by the ranks. Null and empty texts have no ids. Rows and other columns stay as they are; a
    column named ``out_col`` is replaced."""
    shared = _broadcast(docs.sparkSession, ranks_path)
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = docs.select(*kept).schema.add(out_col, BinaryType() if pack else ArrayType(IntegerType()))
    column = packed if pack else list_array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ranks_path, shared.value)
        for batch in batches:
            texts = batch.column(0)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // BATCH_IDS
            bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(texts) else [0]
            for at, to in zip(bounds[:-1], bounds[1:]):
                part = batch.slice(at, to - at)
                ids = column(*table.ids_of(part.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], [*kept, out_col])

    return docs.select(F.col(text_col).cast("string").alias("_text"), *kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids (an array, or packed) stand for (binary; null
    ids as none)."""
    shared = _broadcast(encoded.sparkSession, ranks_path)
    kept = [c for c in encoded.columns if c != out_col]
    schema = encoded.select(*kept).schema.add(out_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(kept.index(ids_col))
                if pa.types.is_binary(column.type):
                    ids = (np.frombuffer(x or b"", "<u4").astype(np.int64) for x in column.to_pylist())
                else:
                    ids = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for x in column)
                decoded = [ranks.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*kept, out_col])

    return encoded.select(*kept).mapInArrow(run, schema)
