"""The perfect binary Golay code of length 23, as a hash that forgives two bit errors.

Every 23-bit word lies within distance 3 of exactly one of the 4,096 codewords. The
codewords nearest to a word and to its 23 neighbours at distance 1 are one or six
in number; two words at distance 2 or less have a common neighbour (or are
neighbours), so they share at least one of these codewords.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0xC75
LENGTH, DATA_BITS, CORRECTS = 23, 12, 3


def codeword(data: int) -> int:
    """The systematic codeword: 12 data bits, then the remainder of the division."""
    rest = data << (LENGTH - DATA_BITS)
    for bit in range(LENGTH - 1, LENGTH - DATA_BITS - 1, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - (LENGTH - DATA_BITS))
    return data << (LENGTH - DATA_BITS) | rest


@functools.cache
def decoder() -> np.ndarray:
    """The data bits of the nearest codeword, for each of the 2^23 words."""
    words = np.array([codeword(data) for data in range(1 << DATA_BITS)], dtype=np.uint32)
    errors = [
        sum(1 << bit for bit in bits) for weight in range(CORRECTS + 1) for bits in itertools.combinations(range(LENGTH), weight)
    ]
    nearest = np.empty(1 << LENGTH, dtype=np.uint16)
    for error in errors:
        nearest[words ^ np.uint32(error)] = np.arange(1 << DATA_BITS, dtype=np.uint16)
    return nearest


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) pairs: the nearest codewords of each word and of its neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.int64)
    near = np.sort(decoder()[words[:, None] ^ flips], axis=1)
    first = np.ones(near.shape, dtype=bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, columns = np.nonzero(first)
    return rows, near[rows, columns].astype(np.int64)
