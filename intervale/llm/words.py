"""Vectorised words of many texts at once: byte buffers, word bounds and 64-bit word hashes, in numpy.

A word is a maximal run of bytes that are not in ``\\x20\\x09-\\x0D``.  Hashes are polynomial over the bytes of a word and
then mixed; they depend on nothing but those bytes, so every worker and run agrees.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z; every ASCII byte that is no letter becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n, grown to the longest buffer seen."""
    if len(_pow[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _pow[k] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(texts: list[bytes], size: int = 1 << 20):
    """Index ranges of consecutive texts of about ``size`` bytes together; a longer text stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the texts with a space after each, and each text's start (one more for the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), at


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, word starts, word ends, word hashes, and the first word's index of each text (one more for the end)."""
    buf, at = joined(texts)
    start, end = word_bounds(buf)
    return buf, start, end, word_hashes(buf, start, end), np.searchsorted(start, at)


def word_matrix(buf: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Words as rows of bytes, padded with spaces; all words must fit."""
    at = start[:, None] + np.arange(width)
    got = buf[np.minimum(at, len(buf) - 1)]
    got[at >= end[:, None]] = 32
    return got


def split_long(start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words longer than ``width`` as several pieces of at most that: starts, ends, and the piece's word."""
    parts = np.maximum(1, -(-(end - start) // width))
    of = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    s = start[of] + nth * width
    return s, np.minimum(s + width, end[of]), of
