"""The binary Golay code of length 23: every word is within three bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

POLYNOMIAL = 0b101011100011  # fixed value: a generator polynomial of the code
BITS, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= POLYNOMIAL << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    high = np.array([_remainder(x << CHECK) for x in range(1 << (BITS - CHECK))], np.uint32)
    error = np.zeros(1 << CHECK, np.uint32)
    for weight in range(1, 4):
        for places in combinations(range(BITS), weight):
            word = sum(1 << p for p in places)
            error[_remainder(word)] = word
    return high, error


class Decoder:
    def __init__(self):
        self.high, self.error = _tables()

    def index(self, words: np.ndarray) -> np.ndarray:
        """Number (12 bits) of the codeword nearest to each word."""
        words = words.astype(np.uint32)
        syndrome = self.high[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
        return ((words ^ self.error[syndrome]) >> CHECK).astype(np.int64)

    def nearby(self, words: np.ndarray, bits: int) -> np.ndarray:
        """(word, index) rows, without repeats: the codewords that the word, or a word which
        differs from it in one of its ``bits`` bits, decodes to. Of two words which differ in one
        bit, each one's own codeword is among the other's."""
        flips = np.array([0, *(1 << i for i in range(bits))], np.uint32)
        found = self.index((words.astype(np.uint32)[:, None] ^ flips).ravel()).reshape(len(words), -1)
        rows = np.repeat(np.arange(len(words)), len(flips))
        return np.unique(np.stack([rows, found.ravel()], axis=1), axis=0)
