"""The perfect binary Golay code (23, 12, 7) as lookup tables.

Every 23-bit word lies within distance 3 of one codeword. ``nearest`` gives that
codeword's 12-bit index. ``nearby`` gives the indices of all codewords within
distance 3, or within 4 for words at distance 3 from theirs (six of them). Two
words that differ in at most one bit always meet: the nearest codeword of either
is among the nearby ones of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unit = [_remainder(1 << i) for i in range(LENGTH)]
    near = np.zeros(1 << CHECK, np.uint32)
    weight = np.zeros(1 << CHECK, np.uint8)
    for w in (1, 2, 3):
        for bits in combinations(range(LENGTH), w):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            near[syndrome], weight[syndrome] = sum(1 << b for b in bits), w
    # The coset's patterns of weight 4 lead to the codewords at distance 4.
    more = [[] for _ in range(1 << CHECK)]
    for bits in combinations(range(LENGTH), 4):
        syndrome = unit[bits[0]] ^ unit[bits[1]] ^ unit[bits[2]] ^ unit[bits[3]]
        if weight[syndrome] == 3:
            more[syndrome].append(sum(1 << b for b in bits))
    patterns = np.repeat(near[:, None], 6, axis=1)
    for syndrome, found in enumerate(more):
        patterns[syndrome, 1:1 + len(found)] = found
    return np.array(unit, np.uint32), patterns, np.where(weight == 3, 6, 1).astype(np.uint8)


UNIT, PATTERNS, COUNTS = _tables()


def syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint32)
    for i in range(LENGTH):
        out ^= np.where(words >> np.uint32(i) & np.uint32(1), UNIT[i], np.uint32(0))
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (words ^ PATTERNS[syndromes(words), 0]) >> np.uint32(CHECK)


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the near codewords, the nearest first: a matrix of six columns, and how
    many of each row's columns count (1 or 6)."""
    s = syndromes(words)
    return (words[:, None] ^ PATTERNS[s]) >> np.uint32(CHECK), COUNTS[s]
