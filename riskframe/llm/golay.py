"""Fuzzy keys of bit segments from the perfect Golay code (23, 12)."""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Length and dimension of the code, and its generator polynomial.
LENGTH = 23
DIMENSION = 12
GENERATOR = 0b110001110101


def _syndrome(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - DIMENSION))
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the one error pattern of up to three bits
    for each syndrome (the code is perfect: there is exactly one)."""
    single = [_syndrome(1 << b) for b in range(LENGTH)]

    def linear(bits: list[int]) -> np.ndarray:
        table = np.zeros(1 << len(bits), dtype=np.int64)
        for i, syndrome in enumerate(bits):
            table[1 << i : 2 << i] = table[: 1 << i] ^ syndrome
        return table

    errors = np.zeros(1 << (LENGTH - DIMENSION), dtype=np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            syndrome = 0
            for p in places:
                syndrome ^= single[p]
            errors[syndrome] = sum(1 << p for p in places)
    return linear(single[:12]), linear(single[12:]), errors


LOW, HIGH, ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    error = ERRORS[LOW[words & 0xFFF] ^ HIGH[words >> 12]]
    return (words ^ error) >> (LENGTH - DIMENSION)


def fuzzy_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, codeword index) for each word of `bits` bits and those one bit away.

    Two words that differ in at most two bits have a word between them at one bit from both, so
    they share at least one index. A word has at most six different ones.
    """
    near = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode(words[:, None] ^ near[None, :]), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, _ = np.nonzero(fresh)
    return rows, found[fresh]
