"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash.

Each 23-bit word lies within distance 3 of exactly one codeword, so a word has one nearest codeword index of 12 bits.
``probes`` gives the indices of a word and of all its one-bit neighbours: one if the word is within 2 of its codeword,
six otherwise. Words that differ in one bit or none therefore meet: the index of one is among the probes of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code.
GENERATOR = 0b101011100011
BITS, CHECK_BITS = 23, 11
MOST_PROBES = 6


def _remainder(word: int) -> int:
    for shift in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECK_BITS)
    return word


#: Syndromes are linear: three tables of a byte each cover a word.
_SYNDROME = np.array([[_remainder(byte << 8 * k & (1 << BITS) - 1) for byte in range(256)] for k in range(3)], dtype=np.int32)
#: The error of at most three bits that belongs to each of the 2^11 syndromes.
_ERROR = np.zeros(1 << CHECK_BITS, dtype=np.int32)
for _n in range(1, 4):
    for _places in combinations(range(BITS), _n):
        _error = sum(1 << p for p in _places)
        _ERROR[_remainder(_error)] = _error


def index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int32)
    syndrome = _SYNDROME[0][words & 255] ^ _SYNDROME[1][words >> 8 & 255] ^ _SYNDROME[2][words >> 16 & 255]
    return (words ^ _ERROR[syndrome]) >> CHECK_BITS


def probes(words: np.ndarray, width: int = BITS) -> np.ndarray:
    """Per word the distinct indices of it and its neighbours in the lowest ``width`` bits, padded with -1 to six columns."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
    found = np.sort(index((words.astype(np.int32)[:, None] ^ flips[None, :]).ravel()).reshape(len(words), len(flips)), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :MOST_PROBES]
