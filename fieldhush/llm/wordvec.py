"""Words, word hashes and shingles of a whole Arrow batch at once, as NumPy arrays.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, which in UTF-8 is the same as a run of
characters other than those. Hashes are 64 bits, equal on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), _STEP)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


@dataclass
class Words:
    """Texts ``i`` own bytes ``at[i]:at[i+1]`` of ``data`` and words ``of[i]:of[i+1]``."""

    data: np.ndarray
    at: np.ndarray
    of: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, lower: bool) -> Words:
    n = len(data)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < n]
    first[begins] = inside[begins]  # a text's first byte starts a word even after another text's word
    start = np.flatnonzero(first)
    total = np.concatenate([[0], np.cumsum(inside)])
    where = total[start]
    length = np.diff(np.append(where, total[-1]))
    of = np.searchsorted(start, at)
    if not len(start):
        return Words(data, at, of, start, length, np.zeros(0, np.uint64))
    b = data[inside]
    if lower:
        b = _LOWER[b]
    pos = np.arange(len(b)) - np.repeat(where, length)
    h = np.add.reduceat(_BYTE[b] * powers(int(length.max()))[pos], where)
    return Words(data, at, of, start, length, mix(h + length.astype(np.uint64)))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether they all belong to the word's text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[i : n - k + 1 + i]
    end = np.repeat(w.of[1:], np.diff(w.of))
    whole = np.arange(n) + k <= end
    return np.append(mix(h), np.zeros(k - 1, np.uint64)), whole


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles over words with A-Z lower-cased.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    for _, data, at in slices(texts):
        w = words(data, at, lower=True)
        h, whole = windows(w, k)
        for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(h[a : b - k + 1])
            elif b > a:
                x = np.array([b - a], np.uint64)
                for i in range(a, b):
                    x = mix(x * np.uint64(0xA0761D6478BD642F) + w.hash[i : i + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)
