"""Words and word shingles of a text as 64-bit hashes, computed on whole byte arrays.

A word's hash is a polynomial over per-byte random values modulo 2^64, read off prefix sums, then mixed; a shingle's
hash folds the hashes of its words and is mixed again. Two different shingles share a hash with probability 2^-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = int(_random.integers(1, 1 << 62)) * 2 + 1
_BACK = pow(_BASE, -1, 1 << 64)
_FOLD = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a lower-cased text (ASCII letters only are lowered), in order."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    up, back = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[begins]) * back[begins])


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of ``words`` words, sorted; a shorter text is one shingle, a text without words has none."""
    hashes = word_hashes(text) if text else np.empty(0, np.uint64)
    width = min(words, len(hashes))
    if not width:
        return hashes
    folded = np.full(len(hashes) - width + 1, _U(width))
    for k in range(width):
        folded = folded * _FOLD + hashes[k:k + len(folded)]
    return np.unique(mixed(folded))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
