"""The perfect binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within three errors of exactly one of the 4096 codewords.
A word's keys are the indices of the codewords that it and its one-bit neighbours
decode to: one key, or six.  Two words that differ in at most two bits have a
neighbour (or themselves) between them, so they share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
#: Fixed value: a generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_FLIPS = np.concatenate(([0], 1 << np.arange(LENGTH))).astype(np.int64)


def _remainders(words: np.ndarray) -> np.ndarray:
    for bit in range(LENGTH - 1, 10, -1):
        words = np.where((words >> bit) & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""
    low = _remainders(np.arange(1 << 12, dtype=np.int64))
    high = _remainders(np.arange(1 << 11, dtype=np.int64) << 12)
    errors = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(LENGTH), n)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    error[_remainders(errors)] = errors
    return low, high, error


_LOW, _HIGH, _ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index, 0 to 4095, of the codeword nearest to each 23-bit word."""
    words = np.asarray(words, np.int64)
    return (words ^ _ERROR[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, key) for each distinct key of each word."""
    found = np.sort(decode(np.asarray(words, np.int64)[:, None] ^ _FLIPS[None, :]), 1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    at, _ = np.nonzero(first)
    return at, found[first]
