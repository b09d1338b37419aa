"""Token ids as ORC files: written in ascending document order, read stripe by stripe.

Rows are dealt into ranges of doc_id and sorted, so that files, stripes and row groups
cover narrow ranges of it. ORC packs the ids with its integer run-length
encoding; the row index and the Bloom filter on doc_id let a reader skip stripes and row
groups. A file's rows carry the running number of ids within it; the base of each
file is the sum over the files before it, from one row for each file.

Ids come from the ``tokenizers`` library. Its byte-level models encode every piece of
the split on its own, so the library gets distinct runs of pieces once and their ids are
looked up after; tokenizers with other steps (a normalizer, another split) get whole texts.
Texts that hold an added token's content (``<|endoftext|>``) also go to the library whole:
it finds the token there before it splits.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BATCH_IDS, list_array
from .pretokens import UnitTable

STRIPE_BYTES, ROW_GROUP = 64 << 20, 1000
#: Pieces whose ids a worker keeps (some 200 MB): the library is the dear part here.
KEPT = 1_000_000
_ENCODERS: dict[int, object] = {}
#: Fixed value: how a byte-level vocabulary writes the space.
_SPACE = "\u0120"


def pieces_apart(config: dict) -> bool:
    """Whether the tokenizer encodes each match of the published split on its own."""
    pre = config.get("pre_tokenizer") or {}
    return (not config.get("normalizer") and not config.get("truncation") and not config.get("padding")
            and config.get("model", {}).get("type") == "BPE" and not config["model"].get("ignore_merges")
            and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
            and all(t.get("special") for t in config.get("added_tokens", [])))


def _encoder(text: str):
    """(texts) -> ids in one array, number of ids of each text; kept between tasks."""
    if (key := hash(text)) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, plain = Tokenizer.from_str(text), Tokenizer.from_str(text)
        plain.encode_special_tokens = True  # for pieces, which are no added tokens

        def whole(texts: list[str | None], by=tokenizer) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in by.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return (np.fromiter((i for ids in found for i in ids), np.int32),
                    np.array([len(ids) for ids in found], np.int64))

        def dealt(texts: list, chosen: np.ndarray, one, other) -> tuple[np.ndarray, np.ndarray]:
            """Ids by ``one`` for the chosen texts and by ``other`` for the rest, in the texts' order."""
            ids, own = one([t for t, c in zip(texts, chosen) if c])
            rest, rest_sizes = other([t for t, c in zip(texts, chosen) if not c])
            sizes = np.zeros(len(texts), np.int64)
            sizes[chosen], sizes[~chosen] = own, rest_sizes
            place = np.repeat(chosen, sizes)
            out = np.empty(len(place), np.int32)
            out[place], out[~place] = ids, rest
            return out, sizes

        config = json.loads(text)
        added = [t["content"] for t in config.get("added_tokens", []) if t["content"]]
        if pieces_apart(config):
            spaced = np.zeros(max(config["model"]["vocab"].values()) + 1, bool)
            spaced[[i for token, i in config["model"]["vocab"].items() if token[0] == _SPACE]] = True
        else:
            spaced = None

        def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces that begin with their only space go to the library as one text: their
            first tokens are those that begin with a space."""
            joined = np.array([t[:1] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace()
                               and " " not in t[1:] for t in texts], bool)
            if joined.sum() < 2:
                return whole(texts, plain)
            return dealt(texts, joined, run_on, lambda rest: whole(rest, plain))

        def run_on(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            one = plain.encode_batch_fast(["".join(texts)], add_special_tokens=False)
            ids = np.array(one[0].ids, np.int32)
            return ids, np.diff(np.r_[np.flatnonzero(spaced[ids]), len(ids)])

        known = UnitTable(pieces, KEPT).ids_of

        def apart(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            holds = np.array([any(a in t for a in added) if t else False for t in texts], bool)
            return dealt(texts, holds, whole, known) if holds.any() else known(texts)

        _ENCODERS.clear()
        _ENCODERS[key] = whole if spaced is None else apart
    return _ENCODERS[key]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (array of int, the end id last), ``file_start``
    (ids before the row in its partition), in the partitions and order of ``docs``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = _encoder(shared.value), 0
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size, dtype=np.int64) // BATCH_IDS
            bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(size) else [0]
            for at, to in zip(bounds[:-1], bounds[1:]):
                ids, counts = encode(texts.slice(at, to - at).to_pylist())
                ends = np.cumsum(counts)
                ids, counts = np.insert(ids, ends, end_id), counts + 1
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(counts), list_array(ids, counts),
                     pa.array(starts)], ["doc_id", "n_tokens", "ids", "file_start"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, file_start long"))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", stripe_bytes: int = STRIPE_BYTES) -> str:
    """Write the token ids of ``docs`` under ``path`` in ascending order of doc_id.

    Null texts count as empty and get the end id alone. Null doc_ids come first; rows that
    share a doc_id are ordered by a hash of their text and all written. An empty table
    gives files without rows. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie"))
    (tokenize(ordered, tokenizer_path, end_id).withColumn("file_no", F.spark_partition_id())
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_GROUP))
     .option("orc.stripe.size", str(stripe_bytes)).orc(path))
    return path


_SCHEMA = "doc_id long, n_tokens long, ids array<int>, file_start long, file_no int"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``. A
    filter on doc_id reaches the files' statistics and Bloom filters."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    sums = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = sums.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Broadcast: 12 bytes for each file, and a file holds many thousands of documents.
    return (rows.join(F.broadcast(bases), "file_no")
            .select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids"))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids_crc32`` (crc32 of the ids as little-endian 32-bit integers) in
    place of ``ids``."""
    kept = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
                   for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    schema = tokens.select(*kept).schema.add("ids_crc32", "long")
    return tokens.select("ids", *kept).mapInArrow(run, schema)
