"""Alignment of two tokenizers' tokens over the same bytes, and counts of the linked token pairs.

1. Each text is encoded by a byte-level BPE (A) and a piece BPE (B); tokens are laid out by their end offsets in bytes.
2. Intervals, a text each at first, are divided at shared cuts, all intervals of a batch at once: the end of an
   interval's middle A token is looked up among the B ends by bisect; where it isn't shared, the A tokens around the
   middle are looked up in rings of doubling width, and the nearest shared end divides. Both halves go on; an
   interval without a shared end inside is a group.
3. A token pair is linked where the byte ranges overlap: a token's partners run from the B token that holds its first
   byte to the one that holds its last.
4. A pair's count is the number of texts that hold it linked. Runs of texts (blocks) pre-aggregate: only a block's
   distinct pairs are shuffled, counted and joined with the counts; a block's texts then meet the
   counts of its own pairs. Nothing of it is broadcast, and a block's size is bounded in pairs.

Null and empty texts, and texts whose joined bytes of either side differ from the text's with its leading space, have no
tokens: their numbers are 0 and their group digest is ''. Repeated rows are rows of their own, also in the counts. A very long text
is a batch and a block of its own. Columns other than the two named aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .pretokens import Kept
from .token_files import _encoder

#: Characters of text that are aligned at once; (text, pair) rows of a block; units whose ids a worker keeps.
BATCH_CHARS, BLOCK_PAIRS, KEPT = 1 << 20, 1 << 21, 250_000
#: Fixed value: the sign that stands for a space in the piece vocabulary.
_SPACE = "▁"
_UNIT = re.compile(" +[^ ]*")


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The A side: ids of texts without special tokens, and each id's bytes."""

    def __init__(self, config: str):
        parsed = json.loads(config)
        parsed["added_tokens"] = []  # their strings in a text are plain text
        letters = byte_letters()
        vocab = parsed["model"]["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.encode = _encoder(json.dumps(parsed))


class Pieces:
    """The B side. No piece has a space sign after another sign, so that no merge crosses the end of a word: each
    distinct unit (spaces and what follows up to the next) is encoded once while it is kept. A vocabulary
    that has such a piece gets whole texts."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode()
                      for i, p in enumerate(pieces)]
        self.begins = np.array([p.startswith(_SPACE) for p in pieces], bool)
        self.apart = not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and self._plain()
        self.kept = Kept()

    def _plain(self) -> bool:
        """Whether the model adds one space in front and leaves white space as it is."""
        text = "  a \t b\n"
        return b"".join(self.bytes[i] for i in self.model.encode(text)) == (" " + text).encode()

    def _add(self, units: list[str]) -> None:
        single = np.array([u[1:2] not in ("", " ") and _SPACE not in u for u in units], bool)
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(units), np.int64)
        joined = [u for u, s in zip(units, single) if s]
        if joined:  # one text, in which each unit begins at its only space
            found = np.array(self.model.encode("".join(joined)[1:], num_threads=1), np.int32)
            sizes[single] = np.diff(np.r_[np.flatnonzero(self.begins[found]), len(found)])
            ids.append(found)
        rest = [u for u, s in zip(units, single) if not s]
        for at, found in zip(np.flatnonzero(~single), self.model.encode([u[1:] for u in rest], num_threads=1) if rest else []):
            found = found or [self.model.piece_to_id(_SPACE)]  # a text's last space; the library gives an empty text none
            sizes[at] = len(found)
            ids.append(np.array(found, np.int32))
        order = [*(u for u, s in zip(units, single) if s), *rest]
        self.kept.add(order, np.concatenate(ids), np.r_[sizes[single], sizes[~single]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, which all begin with a space, in one array, and the number of each text's ids."""
        if not self.apart:
            found = self.model.encode([t[1:] for t in texts], num_threads=1)
            return (np.fromiter((i for ids in found for i in ids), np.int32),
                    np.fromiter(map(len, found), np.int64, len(found)))
        if self.kept.full(KEPT):
            self.kept = Kept()
        lists = [_UNIT.findall(t) for t in texts]
        ids, sizes = self.kept.gather(self.kept.rows([u for units in lists for u in units], self._add))
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return ids, np.diff(np.r_[0, np.r_[0, np.cumsum(sizes)][ends]])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` items: the number of its run, and its place in the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def _cuts(end_a: np.ndarray, end_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals of A tokens from ``lo`` to before ``hi``: an A token whose end lies inside and is shared, near the
    middle (-1: there is none), and the B token that ends there."""
    middle = (lo + hi - 2) // 2
    found, other = np.full(len(lo), -1), np.zeros(len(lo), np.int64)
    at = np.searchsorted(end_b, end_a[middle])
    hit = end_b[at] == end_a[middle]
    found[hit], other[hit] = middle[hit], at[hit]
    open_, near = np.flatnonzero(~hit), 1
    while len(open_):
        # The ring of distances from near to before 2 * near, on either side.
        m, before, after = middle[open_], lo[open_], hi[open_] - 2
        first, last = np.maximum(m - 2 * near + 1, before), np.minimum(m + 2 * near - 1, after)
        left, right = np.maximum(m - near - first + 1, 0), np.maximum(last - m - near + 1, 0)
        run, place = _spread(left + right)
        token = np.where(place < left[run], first[run] + place, m[run] + near + place - left[run])
        at = np.searchsorted(end_b, end_a[token])
        hit = end_b[at] == end_a[token]
        run, token, at = run[hit], token[hit], at[hit]
        order = np.lexsort((token, np.abs(token - m[run]), run))
        run, token, at = run[order], token[order], at[order]
        best = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else run
        found[open_[run[best]]], other[open_[run[best]]] = token[best], at[best]
        done = (first == before) & (last == after)
        done[run[best]] = True
        open_, near = open_[~done], 2 * near
    return found, other


def divide(end_a: np.ndarray, end_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of texts that lie end to end: the number of A tokens, and of B tokens, before the end of each group.
    ``stop_a`` and ``stop_b`` are those numbers for each text; no text is without tokens."""
    lo_a, hi_a = np.r_[0, stop_a[:-1]].astype(np.int64), stop_a.astype(np.int64)
    lo_b, hi_b = np.r_[0, stop_b[:-1]].astype(np.int64), stop_b.astype(np.int64)
    leaves = []
    while len(lo_a):
        many = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        cut, other = np.full(len(lo_a), -1), np.zeros(len(lo_a), np.int64)
        cut[many], other[many] = _cuts(end_a, end_b, lo_a[many], hi_a[many])
        leaf = cut < 0
        leaves.append((hi_a[leaf], hi_b[leaf]))
        lo_a, hi_a, lo_b, hi_b, cut, other = (x[~leaf] for x in (lo_a, hi_a, lo_b, hi_b, cut + 1, other + 1))
        pair = lambda a, b: np.stack([a, b], 1).reshape(-1)
        lo_a, hi_a, lo_b, hi_b = pair(lo_a, cut), pair(cut, hi_a), pair(lo_b, other), pair(other, hi_b)
    group_a, group_b = (np.concatenate(x) for x in zip(*leaves)) if leaves else (np.zeros(0, np.int64),) * 2
    order = np.argsort(group_a)
    return group_a[order], group_b[order]


def links(end_a: np.ndarray, start_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all overlapping pairs, by A token."""
    first = np.searchsorted(end_b, start_a, "right")
    run, place = _spread(np.searchsorted(end_b, end_a) - first + 1)
    return run, first[run] + place


class _Digits:
    """Decimal ids as rows of bytes: digits, right-aligned, and room for one sign."""

    def __init__(self, ids: int):
        self.width = len(str(ids))
        text = np.array([str(i).rjust(self.width) + " " for i in range(ids)], f"S{self.width + 1}")
        self.table = text.view(np.uint8).reshape(ids, self.width + 1)

    def rows(self, ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
        out = self.table[ids]
        out[:, -1] = signs
        return out


class Aligner:
    """Both tokenizers, and the alignment of a list of texts."""

    def __init__(self, config: str, model: bytes):
        self.a, self.b = ByteLevel(config), Pieces(model)
        self.size_a, self.size_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.digits = _Digits(max(len(self.size_a), len(self.size_b)))

    def _agree(self, texts: list[str], ids_a, n_a, ids_b, n_b) -> np.ndarray:
        """Which texts both sides' bytes give back."""
        whole = "".join(texts).encode()
        join = lambda x, ids: b"".join(map(x.bytes.__getitem__, ids.tolist()))
        if join(self.a, ids_a) == whole == join(self.b, ids_b):
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            if all((np.add.reduceat(s[i], np.r_[0, np.cumsum(n)[:-1]]) == size).all()
                   for s, i, n in ((self.size_a, ids_a, n_a), (self.size_b, ids_b, n_b))):
                return np.ones(len(texts), bool)
        parts = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((ids_a, n_a), (ids_b, n_b))]
        return np.array([join(self.a, x) == t.encode() == join(self.b, y) for t, x, y in zip(texts, *parts)], bool)

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """By text: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``digest``; ``cuts`` (byte offsets at which groups end, in the text
        with its space) with the groups of each text; and the distinct linked pairs (``pair``, ``held`` links of it), by text."""
        out = {n: np.zeros(len(texts), np.int64) for n in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
        out |= {"digest": [""] * len(texts), "cuts": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "held": np.zeros(0, np.int64)}
        # A sign that stands for a space comes back as one.
        own = np.array([i for i, t in enumerate(texts) if t and _SPACE not in t], np.int64)
        spaced = [" " + texts[i] for i in own]
        if not spaced:
            return out
        (ids_a, n_a), (ids_b, n_b) = self.a.encode(spaced), self.b.encode(spaced)
        agree = self._agree(spaced, ids_a, n_a, ids_b, n_b)
        if not agree.all():
            ids_a, ids_b = ids_a[np.repeat(agree, n_a)], ids_b[np.repeat(agree, n_b)]
            own, n_a, n_b = own[agree], n_a[agree], n_b[agree]
            if not len(own):
                return out
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        group_a, group_b = divide(end_a, end_b, stop_a, stop_b)
        stop = np.searchsorted(group_a, stop_a) + 1
        link_a, link_b = links(end_a, end_a - self.size_a[ids_a], end_b)
        text = np.repeat(np.arange(len(own)), n_a)
        span = len(self.size_a) * len(self.size_b)
        keys = text[link_a] * span + ids_a[link_a].astype(np.int64) * len(self.size_b) + ids_b[link_b]
        keys, held = np.unique(keys, return_counts=True)
        of, pair = np.divmod(keys, span)
        out["n_a"][own], out["n_b"][own], out["n_groups"][own] = n_a, n_b, np.diff(np.r_[0, stop])
        out["n_links"][own] = np.bincount(text[link_a], minlength=len(own))
        out["n_pairs"][own] = np.bincount(of, minlength=len(own))
        first = np.r_[0, end_a[stop_a[:-1] - 1]]
        out["cuts"] = end_a[group_a - 1] - np.repeat(first, np.diff(np.r_[0, stop]))
        out["pair"], out["held"] = pair, held
        for i, digest in zip(own, self._digests(ids_a, ids_b, group_a, group_b, stop)):
            out["digest"][i] = digest
        return out

    def _digests(self, ids_a, ids_b, group_a, group_b, stop) -> Iterator[str]:
        """sha256 of each text's groups as decimal ids: ``a1,a2|b1;a3|b2,b3``."""
        sides = []
        for ids, ends, sign in ((ids_a, group_a, "|"), (ids_b, group_b, ";")):
            signs = np.full(len(ids), ord(","), np.uint8)
            signs[ends - 1] = ord(sign)
            sides.append(self.digits.rows(ids, signs))
        sizes = np.stack([np.diff(np.r_[0, group_a]), np.diff(np.r_[0, group_b])], 1).reshape(-1)
        side = np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)
        rows = np.empty((len(side), self.digits.width + 1), np.uint8)
        rows[~side], rows[side] = sides
        used = rows != ord(" ")
        written = np.r_[0, np.cumsum(used.sum(axis=1))]
        flat = rows[used].tobytes()
        ends = written[(group_a + group_b)[stop - 1]]
        for at, to in zip(np.r_[0, ends[:-1]], ends):
            yield hashlib.sha256(memoryview(flat)[at:to - 1]).hexdigest()


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(config: str, model: bytes) -> Aligner:
    """Kept between tasks of a worker."""
    if (key := hash((config, model))) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(config, model)
    return _ALIGNERS[key]


class _Block:
    """Distinct pairs of a run of texts, with the number of texts that hold each."""

    def __init__(self, number: int):
        self.number, self.pairs, self.waiting = number, 0, []
        self.keys, self.texts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> None:
        self.pairs += len(pairs)
        self.waiting.append(pairs)
        if sum(map(len, self.waiting)) > 1 << 19:
            self.merge()

    def merge(self) -> None:
        new, texts = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (self.keys[:0],) * 2
        keys, at = np.unique(np.r_[self.keys, new], return_inverse=True)
        self.texts = np.bincount(at, np.r_[self.texts, texts], len(keys)).astype(np.int64)
        self.keys, self.waiting = keys, []


_TEXTS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, cuts array<long>, "
          "pairs array<long>, held array<long>, block long, texts array<long>")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()), pa.array(values)).cast(
        pa.list_(pa.int64()))


def align(docs: DataFrame, tokenizer_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text",
          cuts: bool = True) -> DataFrame:
    """One row a text: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``cuts`` (byte offsets where groups
    end, in the text with its leading space; null without ``cuts``), ``pairs`` (distinct linked pairs: A id times the
    size of B's vocabulary, plus B id), ``held`` (links of each), ``block``. Besides, a row a block
    with ``texts`` (null in texts' rows): its ``pairs`` and how many of its texts hold each. Written to the shared folder."""
    with open(tokenizer_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    names = [c.split()[0] for c in _TEXTS.split(", ")]
    kinds = [pa.string() if n == "groups_sha256" else pa.list_(pa.int64()) if n in ("cuts", "pairs", "held", "texts")
             else pa.int64() for n in names]

    def rows(ids: pa.Array, texts: list, tools: Aligner, block: _Block) -> pa.RecordBatch:
        found = tools.align(texts)
        block.add(found["pair"])
        cols = {"doc_id": ids, "groups_sha256": pa.array(found["digest"], pa.string()),
                "pairs": _lists(found["pair"], found["n_pairs"]), "held": _lists(found["held"], found["n_pairs"]),
                "block": pa.array(np.full(len(texts), block.number)),
                **{n: pa.array(found[n]) for n in ("n_a", "n_b", "n_groups", "n_links")}}
        if cuts:
            cols["cuts"] = _lists(found["cuts"], found["n_groups"])
        return pa.RecordBatch.from_arrays([cols.get(n, pa.nulls(len(texts), k)) for n, k in zip(names, kinds)], names)

    def closing(block: _Block) -> pa.RecordBatch:
        block.merge()
        cols = {"block": [block.number], "pairs": [block.keys], "texts": [block.texts]}
        return pa.RecordBatch.from_arrays([pa.array(cols.get(n, [None]), k) for n, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block = _aligner(*shared.value), None
        for batch in batches:
            texts, numbers = batch.column(1).to_pylist(), batch.column(2)
            size = np.cumsum([len(t or "") for t in texts]) // BATCH_CHARS
            bounds = np.flatnonzero(np.r_[True, size[1:] != size[:-1], True]) if texts else [0]
            for at, to in zip(bounds[:-1], bounds[1:]):
                if block and block.pairs > BLOCK_PAIRS:
                    yield closing(block)
                    block = None
                block = block or _Block(numbers[int(at)].as_py())
                yield rows(batch.column(0).slice(at, to - at), texts[at:to], tools, block)
        if block:
            yield closing(block)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.monotonically_increasing_id().alias("number"))
    return materialize(given.mapInArrow(run, _TEXTS), "alignment")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """``a``, ``b``, ``count`` (texts that hold the pair linked), ``best`` (whether no pair of its A id has more)."""
    blocks = _block_pairs(aligned, b_size)
    counts = blocks.groupBy("a", "b").agg(F.sum("texts").alias("count"))
    of_a = Window.partitionBy("a")  # at most as many rows as B's vocabulary
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def _block_pairs(aligned: DataFrame, b_size: int) -> DataFrame:
    rows = aligned.where("texts IS NOT NULL").select("block", F.inline(F.arrays_zip("pairs", "texts")))
    return rows.select("block", F.expr(f"pairs div {b_size}").alias("a"), (F.col("pairs") % b_size).alias("b"), "texts")


def vocabulary_size(model_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path).vocab_size()


def link_statistics(aligned: DataFrame, counts: DataFrame, b_size: int) -> DataFrame:
    """The texts' rows of ``aligned`` without their pairs, with ``n_best`` (links whose pair is a best one) and ``count_sum``
    (of the links' counts)."""
    blocks = _block_pairs(aligned, b_size)
    known = (blocks.select("block", "a", "b").join(materialize(counts, "pair-counts").hint("merge"), ["a", "b"])
             .select(F.col("block").alias("of"), (F.col("a") * b_size + F.col("b")).alias("pair"), "count", "best"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    texts = aligned.where("texts IS NULL").select(*kept, "pairs", "held", "block")
    schema = texts.select(*kept).schema.add("n_best", "long").add("count_sum", "long")

    def total(rows: pa.Table, found: pa.Table) -> pa.Table:
        """Of a block."""
        pair = found.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], found.column("count").to_numpy()[order], found.column("best").to_numpy()[order]
        lists = rows.column("pairs").combine_chunks()
        held = rows.column("held").combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        sums = [np.r_[0, np.cumsum(held * x)] for x in (best[at], count[at])]
        out = [pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]
        return pa.Table.from_arrays([*(rows.column(c) for c in kept), *out], [*kept, "n_best", "count_sum"])

    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(total, schema)
