"""Words of many texts as arrays of 64-bit hashes.

Python tasks get texts as Arrow batches. Here the bytes of a batch are looked at together, with numpy: no object is made
for a word. Letters A-Z are lower-cased; words are runs of 0-9, a-z and all that isn't ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True
#: For words between white space, marks and all.
BETWEEN_BLANKS = np.ones(256, bool)
BETWEEN_BLANKS[[32, 9, 10, 11, 12, 13]] = False
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        steps = [np.full(n, b, np.uint64) for b in (_BASE, inverse)]
        for s in steps:
            s[0] = 1
        _powers, _inverse = (np.multiply.accumulate(s) for s in steps)
    return _powers, _inverse


class Words:
    """hash: of each word; start, end: its bytes in data; doc: its text; first: number of each text's first word."""

    __slots__ = ("data", "doc", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD):
        """data: bytes; text i is data[offsets[i]:offsets[i + 1]]. is_word: of each byte, whether it is part of words."""
        self.data = data
        mask = is_word[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # no word goes over the end of a text
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        begins = mask & (~before | edge[:n])
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        ends = mask & (~after | edge[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        powers, inverse = _tables(n)
        if len(self.start):
            value = np.where(is_word, _LOWER.astype(np.uint64) + np.uint64(1), np.uint64(0))
            summed = np.add.reduceat(value[data] * powers[:n], self.start)
            self.hash = mix(summed * inverse[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k words in a row, by the number of the first; and whether those lie in one text."""
        n = max(0, len(self.hash) - k + 1)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += self.hash[j : j + n]
        return mix(out), self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def chunks(column: pa.Array, most_bytes: int = 2_000_000, is_word: np.ndarray = _IS_WORD) -> Iterator[tuple[int, int, Words]]:
    """The texts of an Arrow string column, some at a time: from, to, their words. Null texts are empty.

    A text is never divided; one larger than most_bytes comes alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, end, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], is_word)
        at = end


def words_of(text: str | None) -> Words:
    """The words of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]))
