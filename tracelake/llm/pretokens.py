"""Splitting texts into the pieces that byte-level BPE merges on their own, and a
bounded table of pieces that were encoded before."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the published pattern of the byte-level vocabularies of 50k ids.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same for texts whose characters all lie below U+0180, with the classes written out:
# the standard library's matcher is faster.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_NARROW = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile("[^\x00-ſ]")
_FULL = regex.compile(PATTERN)

_RUN = re.compile(r"\s\s")

#: Characters of text looked up at once; pieces that are kept (some 200 bytes each).
CHUNK, KEPT = 1 << 21, 250_000


def split(text: str) -> list[str]:
    """The pieces of a text."""
    return (_FULL if _WIDE.search(text) else _NARROW).findall(text)


class Kept:
    """Ids by string, in one growing array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.chars = self.used = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    def full(self, most: int) -> bool:
        return len(self.index) > most or self.chars > 16 * most

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.index), len(keys)
        while n + m > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n:n + m] = sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.chars += sum(map(len, keys))
        self.index.update(zip(keys, range(n, n + m)))

    def rows(self, keys: list[str], add) -> np.ndarray:
        """The rows of the keys; ``add`` is given those that are missing first."""
        at = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            add(list(dict.fromkeys(keys[i] for i in missing)))
            at[missing] = [self.index[keys[i]] for i in missing]
        return at

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows in one array, and the number of ids of each."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class UnitTable:
    """Ids of texts, of which each distinct piece is encoded once while it is kept.

    ``encode`` gets a list of pieces and returns their ids in one array and the number of
    ids of each. Where no two white spaces meet, every space of a text begins a piece, so that
    the text falls into units of whole pieces there, and a chunk's distinct units are split.
    Texts with runs of white space, and very long ones, are split whole."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int | None = None):
        self.encode, self.keep = encode, keep or KEPT
        self.pieces = Kept()

    def _add_pieces(self, pieces: list[str]) -> None:
        self.pieces.add(pieces, *self.encode(pieces))

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.full(self.keep):
            self.pieces = Kept()
        return self.pieces.gather(self.pieces.rows(pieces, self._add_pieces))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without runs of white space, and the number of ids of each text."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        unit, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        first = bounds[:-1]  # a text's first unit has no space before it
        heads = [*(split(words[i]) for i in unit[first]), [" "]]  # and a lone space at a text's end
        pieces = [p for h in heads for p in h]
        inner = np.ones(len(unit), bool)
        inner[first] = False
        used = np.zeros(len(words), bool)
        used[unit[inner]] = True
        used &= np.fromiter(map(bool, words), bool, len(words))
        # The other units end to end are one text, and each begins with its only space.
        rest = split("".join([" " + w for w, u in zip(words, used) if u]))
        begin = np.flatnonzero(np.fromiter((p[0] == " " for p in rest), bool, len(rest)))
        ids, sizes = self._of_pieces(pieces + rest)
        stop = np.cumsum(np.r_[[len(h) for h in heads], np.diff(np.r_[begin, len(rest)])].astype(np.int64))
        total = np.r_[0, np.cumsum(sizes)][np.r_[0, stop]]
        row = np.full(len(words), len(heads) - 1)
        row[used] = len(heads) + np.arange(len(begin))
        at = row[unit]
        at[first] = np.arange(len(first))
        sizes = np.diff(total)[at]
        ends = np.cumsum(sizes)
        out = ids[np.repeat(total[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.diff(np.r_[0, ends][bounds])

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        counts, parts, waiting, size = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [], 0

        def flush():
            if waiting:
                ids, counts[waiting] = self._plain([texts[i] for i in waiting])
                parts.append(ids)
                waiting.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= CHUNK and not _RUN.search(text):
                waiting.append(i)
                size += len(text)
                if size >= CHUNK:
                    flush()
                    size = 0
                continue
            flush()
            size = 0
            matches = (_FULL if _WIDE.search(text) else _NARROW).finditer(text)
            while pieces := [m.group() for m in islice(matches, CHUNK // 16)]:
                ids, sizes = self._of_pieces(pieces)
                counts[i] += sizes.sum()
                parts.append(ids)
        flush()
        return np.concatenate(parts), counts
