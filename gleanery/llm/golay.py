"""The perfect binary Golay code (23, 12): every 23-bit word lies within three bits of exactly one codeword.

Words are handled in numpy, a whole array at a time. A codeword is known by its 12-bit index (its information bits).
"""

from __future__ import annotations

import itertools

import numpy as np

N_BITS, INDEX_BITS = 23, 12
# Fixed value: the code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words modulo the generator, by long division on all words at once."""
    left = words.astype(np.int64).copy()
    for bit in range(N_BITS - 1, 10, -1):
        left ^= ((left >> bit) & 1) * (GENERATOR << (bit - 11))
    return left


def index_table() -> np.ndarray:
    """uint16[4096 + 2048] split as needed by nearest(): remainders of the high part, then errors by syndrome."""
    high = _syndromes(np.arange(1 << INDEX_BITS, dtype=np.int64) << 11)
    flips = [sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(N_BITS), n)]
    errors = np.zeros(1 << 11, np.int64)
    patterns = np.array(flips, np.int64)
    errors[_syndromes(patterns)] = patterns
    return np.concatenate([high, errors])


def nearest(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int64)
    syndrome = table[words >> 11] ^ (words & 0x7FF)
    return (words ^ table[(1 << INDEX_BITS) + syndrome]) >> 11
