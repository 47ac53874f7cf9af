"""Byte n-grams of the distinct words of many texts, for the character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from intervale.llm.words import LETTERS, blocks, joined, mix, split_long, word_bounds, word_hashes, word_matrix

WIDTH = 32


def letters(text: str | None) -> bytes:
    """Lower case, in UTF-8; ASCII characters that are no letters become spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS)


class Words:
    """Distinct words of a block of texts (pieces of ``WIDTH`` bytes of longer ones), and which text holds which."""

    def __init__(self, raw: list[bytes]) -> None:
        buf, at = joined(raw)
        start, end, _ = split_long(*word_bounds(buf), WIDTH)
        _, one, self.which = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        self.buf, self.start, self.end = buf, start[one], end[one]
        self.first = np.searchsorted(start, at)
        self.texts = len(raw)
        self.text_of = np.repeat(np.arange(self.texts), np.diff(self.first))

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct words by length class: their indices, their bytes with a space before and spaces after, their lengths."""
        size = self.end - self.start
        low = 0
        for high in (4, 8, 12, 20, WIDTH):
            of = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(of):
                m = np.full((len(of), high + 2), 32, np.uint8)
                m[:, 1:-1] = word_matrix(self.buf, self.start[of], self.end[of], high)
                yield of, m, size[of]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum over its words of the words' values (one or more columns)."""
        if values.ndim == 1:
            return np.bincount(self.text_of, values[self.which], self.texts)
        return np.stack([self.sums(values[:, c]) for c in range(values.shape[1])], 1)


def word_blocks(texts: list[str | None]) -> Iterator[Words]:
    raw = [letters(t) for t in texts]
    for i, j in blocks(raw):
        yield Words(raw[i:j])


def packed(m: np.ndarray, n: int) -> np.ndarray:
    """The n-gram (n < 8) that ends at each column from n - 1 on, as bytes of a 64-bit number with n on top."""
    wide = m.shape[1] - n + 1
    got = np.full((len(m), wide), n, np.uint64)
    for k in range(n):
        got = (got << np.uint64(8)) | m[:, k : k + wide]
    return got


class Lookup:
    """A read-only map from 64-bit keys to numbers, by open addressing in numpy; missing keys give nan."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, np.nan, np.float32)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]
            done = self.keys[at] == keys[todo]
            self.values[at[done]] = values[todo[done]]
            todo, at = todo[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.keys[at]
        got = self.values[at]
        miss = np.flatnonzero((held != keys) & (held != 0))
        got[(held != keys)] = np.nan
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[miss]]
            hit = held == keys[miss]
            got[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit & (held != 0)]
        return got
