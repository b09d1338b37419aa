"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

1. Each text's 64-bit fingerprint is the bitwise majority over the XXH64 values
   of its word shingles. Rows with one fingerprint are one node from here on.
2. The fingerprint is cut into four segments of 16 bits. Three differing bits at
   most fall on them so that either two segments are equal, or one is equal and
   each of the others differs in one bit. So two fingerprints within three bits
   share a key of one of two kinds: two whole segments (6 keys), or one whole
   segment and a Golay codeword near another segment (4 segments, up to 6
   codewords each). Segments are padded with zeros to the code's 23 bits.
3. Fingerprints that share a key are compared. A bucket returns a spanning
   forest of its links, not all pairs, so a group of copies gives as many rows
   as it has members. Buckets over ``BUCKET`` rows are cut into blocks, and each
   pair of blocks is compared in a task of its own: no candidate is dropped.
4. Components come from :mod:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import materialize
from .components import connected_components

SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Rows of a bucket that one task compares; larger buckets go block by block.
BUCKET = 4096
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes | None], shingle: int) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts. A text without words has 0; one with
    fewer words than a shingle has that of its whole word sequence."""
    h, hashes, counts = xxhash.xxh64_digest, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        if len(words) < shingle:
            found = [h(b" ".join(words), SEED)]
        else:
            found = [h(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))]
        counts[i] = len(found)
        hashes.append(b"".join(found))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    values = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
    n = counts[full]
    ends = np.cumsum(n)
    # Sums over at most 255 hashes fit into the bytes of a 64-bit lane.
    per_doc = -(-n // 255)
    first_chunk = np.cumsum(per_doc) - per_doc
    chunk_in_doc = np.arange(per_doc.sum()) - np.repeat(first_chunk, per_doc)
    starts = np.repeat(ends - n, per_doc) + 255 * chunk_in_doc
    ones = np.empty((len(full), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((values >> np.uint64(k)) & _LANES, starts)
        sums = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, k::8] = np.add.reduceat(sums, first_chunk, axis=0)
    bits = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
    out[full] = bits.view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3,
                      out_col: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each text as a long (its 64 bits). Only
    the columns given are carried; ``out_col`` replaces one of that name."""
    kept = [c for c in docs.columns if c != out_col]
    schema = docs.select(*kept).schema.add(out_col, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(kept.index(text_col)).cast(pa.binary()).to_pylist()
            fp = pa.array(fingerprints_of(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*kept, out_col])

    return docs.select(*kept).mapInArrow(run, schema)


def _text_free(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id``, ``fp``: fingerprints without carrying the texts further."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fp = pa.array(fingerprints_of(texts, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints: row index, key, whether the key is the fingerprint's
    own (its nearest codeword; whole segments always are). Of two that share a
    key, one at least must have it as its own."""
    n = len(fp)
    segments = [(fp >> np.uint64(SEGMENT_BITS * s) & np.uint64(0xFFFF)).astype(np.uint32) for s in range(SEGMENTS)]
    near = [golay.nearby(s) for s in segments]
    rows, keys, own = [], [], []
    for kind, (a, b) in enumerate(combinations(range(SEGMENTS), 2)):
        rows.append(np.arange(n))
        keys.append((np.int64(kind) << 32) | (segments[a].astype(np.int64) << 16) | segments[b])
        own.append(np.ones(n, bool))
    for s in range(SEGMENTS):
        codes, counts = near[(s + 1) % SEGMENTS]
        for j in range(6):
            r = np.flatnonzero(counts > j)
            rows.append(r)
            keys.append((np.int64(8 + s) << 32) | (segments[s][r].astype(np.int64) << 12) | codes[r, j])
            own.append(np.full(len(r), j == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            part = fp[at:at + 4096]
            rows, keys, own = bucket_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(own)],
                                             ["key", "fp", "own"])


def _forest(fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one bucket's links, found breadth first."""
    us, vs = [], []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= distance
            if not own[u]:
                near &= own[left]
            if near.any():
                found = left[near]
                us.append(np.full(len(found), fp[u]))
                vs.append(fp[found])
                queue.extend(found)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def links_of_buckets(key: np.ndarray, fp: np.ndarray, own: np.ndarray, distance: int,
                     small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by ``key``, whole buckets only: all pairs of small buckets,
    and a spanning forest of each larger one."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    us, vs = [], []
    in_small = np.repeat(sizes <= small, sizes)
    for d in range(1, min(small, sizes.max(initial=1))):
        i = np.flatnonzero((key[d:] == key[:-d]) & in_small[d:])
        if not len(i):
            break
        i = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= distance) & (own[i] | own[i + d])]
        us.append(fp[i])
        vs.append(fp[i + d])
    for b in np.flatnonzero(sizes > small):
        at = slice(starts[b], starts[b] + sizes[b])
        u, v = _forest(fp[at], own[at], distance)
        us.append(u)
        vs.append(v)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _compare(distance: int):
    """Stream over rows sorted by (key, block): whole buckets are compared as they end."""
    def links(key, fp, own):
        u, v = links_of_buckets(key, fp.view(np.uint64), own, distance)
        keep = u != v
        pairs = np.unique(np.stack([u[keep], v[keep]]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], ["u", "v"])

    def finish(waiting):
        key, block, fp, own = (np.concatenate(x) for x in zip(*waiting))
        if len(key):
            change = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            yield links(np.cumsum(np.r_[0, change]), fp, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            key, block = cols[:2]
            if not len(key):
                continue
            last = (key == key[-1]) & (block == block[-1])
            cut = len(key) - int(last.sum())  # where the bucket that may go on begins
            goes_on = waiting and cut == 0 and waiting[-1][0][-1:] == key[:1] and waiting[-1][1][-1:] == block[:1]
            if not goes_on:
                yield from finish([*waiting, [c[:cut] for c in cols]])
                waiting = []
            waiting.append([c[cut:] for c in cols])
        if waiting:
            yield from finish(waiting)

    return run


def fingerprint_links(fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``fps``: distinct fingerprints (``fp`` long), materialised. Returns links
    ``u``, ``v`` that connect the same components as all pairs within
    ``distance`` (at most 3) bits do."""
    if not 0 <= distance < SEGMENTS:
        raise ValueError("the segments bear at most 3 differing bits")
    keys = fps.select("fp").mapInArrow(_emit_keys, "key long, fp long, own boolean")
    hot = materialize(keys.groupBy("key").count().where(F.col("count") > bucket)
                      .select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")), "hot-buckets")
    n = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = (keys.join(hot, "key", "left")
             .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
             .select("key", (F.least(mine, F.col("other")) * n + F.greatest(mine, F.col("other"))).alias("block"),
                     "fp", "own"))
    return (dealt.repartition("key", "block").sortWithinPartitions("key", "block")
            .mapInArrow(_compare(distance), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``
    (smallest doc_id reachable over links of at most ``distance`` differing bits).

    Null and empty texts, and texts of white space alone, have fingerprint zero and
    link like any other. Repeated rows are returned as often as they occur. A null
    doc_id is in its component but never its id (null if it has no other). An empty
    table gives no rows; other columns are not read."""
    prints = materialize(_text_free(docs, id_col, text_col, shingle), "fingerprints")
    roots = component_roots(prints, distance)
    return (prints.join(roots, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def component_roots(prints: DataFrame, distance: int) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that stands for the component) and
    ``component_id`` for each distinct fingerprint of ``prints`` (``doc_id``, ``fp``)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected_components(fingerprint_links(nodes, distance))
    # Both sides of each join are written first: Spark splits a hot key only where they are plain exchanges.
    placed = materialize(nodes.join(roots, nodes.fp == roots.node, "left")
                         .select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "placed")
    ids = materialize(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    return materialize(placed.join(ids, "root").select("fp", "root", "component_id"), "roots")
