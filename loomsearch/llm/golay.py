"""The binary Golay code of length 23: every word is within three bits of one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, CHECKS = 23, 11


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits by the 12 data bits; by syndrome, the errors that lead to near codewords.

    A word at distance 3 from its codeword has five more codewords at distance 4, so a
    syndrome has one error pattern or six; missing ones repeat the first.
    """
    check = np.zeros(1 << 12, dtype=np.int32)
    for data in range(1 << 12):
        rest = data << CHECKS
        for bit in range(BITS - 1, CHECKS - 1, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - CHECKS)
        check[data] = rest
    near: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            error = sum(1 << p for p in places)
            found = near[int(check[error >> CHECKS]) ^ (error & ((1 << CHECKS) - 1))]
            if weight < 4 or found[0].bit_count() == 3:
                found.append(error)
    return check, np.array([(f * 6)[:6] if len(f) == 1 else f for f in near], dtype=np.int32)


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each word, nearest first: shape (n, 6)."""
    check, near = _tables()
    words = words.astype(np.int32)
    syndrome = check[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    return (words[:, None] ^ near[syndrome]) >> CHECKS


def nearest_codeword(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each word."""
    check, near = _tables()
    words = words.astype(np.int32)
    syndrome = check[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    return (words ^ near[syndrome, 0]) >> CHECKS
