"""Words and shingles of many texts at once, as hash arrays.

A word is a run of ASCII letters and digits and of non-ASCII characters; A-Z are
lower-cased. Hashes are 64-bit sums of position-weighted byte codes, mixed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: a random code per lower-cased byte; 0 outside words
CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[LOWER] * IS_WORD
_FACTOR = 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) * 2, _U(_FACTOR)))])
    return _powers


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): words of document i are hashes[first[i]:first[i + 1]]."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[flat]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begin[heads] = inside[heads]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    run = np.cumsum(begin, dtype=np.int32) - 1
    place = np.arange(n, dtype=np.int64)
    place -= starts[np.maximum(run, 0)]
    place[~inside] = 0
    np.maximum(place, 0, out=place)
    terms = CODES[flat]
    terms *= powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(terms, starts)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; those that cross documents are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for i in range(k):
        out *= _U(_FACTOR)
        out += words[i : i + n]
    return mix(out)


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; none: 0."""
    ones = bit_rows(hashes).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
