"""Hashed character n-grams of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters handled at once; longer texts go piece by piece.
PIECE = 1 << 20
_STEP, _SPREAD = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def hashed(text: str | None, orders: tuple[int, ...], bits: int, letters: bool = False) -> Iterator[np.ndarray]:
    """Bucket numbers (below 2 ** bits) of all n-grams of the lower-cased text, one
    array for each order and piece of the text. With ``letters``, each run of other signs
    counts as one space."""
    text = (text or "").lower()
    longest = max(orders)
    for at in range(0, max(len(text), 1), PIECE):
        codes = np.frombuffer(text[at:at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        whole = min(PIECE, len(codes))  # n-grams that begin in this piece
        if letters:
            sound = _letters()[codes]
            keep = sound | np.r_[True, sound[:-1]]
            whole = int(keep[:whole].sum())
            codes = np.where(sound, codes, 32)[keep]
        codes = codes.astype(np.uint64)
        value = codes
        for n in range(1, longest + 1):
            if n > 1:
                if len(value) < 2:
                    break
                value = value[:-1] * _STEP + codes[n - 1:]
            if n in orders:
                part = value[:whole]
                yield (((part + np.uint64(n)) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int32)


def present(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The distinct bucket numbers of a text, ascending."""
    parts = list(hashed(text, orders, bits))
    if sum(map(len, parts)) < 1 << (bits - 6):
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
    seen = np.zeros(1 << bits, bool)
    for part in parts:
        seen[part] = True
    return np.flatnonzero(seen).astype(np.int32)
