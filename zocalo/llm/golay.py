"""The binary Golay code of length 23 and the codewords near a word, as tables built from its generator polynomial."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator, 11 bits."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def near_errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the nearest codeword's error pattern, and all patterns to list (padded with -1).

    The code is perfect: every word is within distance 3 of exactly one codeword. A word at distance 3 from it also
    lies at distance 4 from five others. Listing those six (or the one, when it is nearer) makes the nearest codeword
    of any word at distance 1 a listed one: if the neighbour's codeword is another, it is at distance 3 from the
    neighbour, so at most 4 from the word.
    """
    bits = [sum(1 << b for b in chosen) for weight in range(5) for chosen in combinations(range(LENGTH), weight)]
    patterns = np.array(bits)
    weights = np.bitwise_count(patterns)
    own = syndromes(patterns)
    nearest = np.full(2048, -1)
    low = weights <= 3
    nearest[own[low]] = patterns[low]
    listed = np.full((2048, 6), -1)
    listed[:, 0] = nearest
    filled = np.ones(2048, int)
    for pattern, s in zip(patterns[weights == 4].tolist(), own[weights == 4].tolist()):
        listed[s, filled[s]] = pattern
        filled[s] += 1
    return nearest, listed


def nearest_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ near_errors()[0][syndromes(words)]) >> 11


def listed_indices(words: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords listed for each word, one row of 6 (-1 where there are fewer)."""
    patterns = near_errors()[1][syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)
