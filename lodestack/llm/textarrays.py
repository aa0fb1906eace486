"""Words of Arrow text batches as numpy arrays: boundaries, 64-bit word hashes, window hashes.

Words are cut on bytes: all separators are ASCII, so UTF-8 needs no decoding.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators: every ASCII byte that is no digit or letter.
NON_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = bytes(LOWER)

_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Bytes kept of the last eight of a word that has fewer left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 512


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = np.asarray(x, np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """Words of a few documents. first[d]:first[d+1] are document d's words; start and end are byte positions in buf."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False):
        self.buf = buf = LOWER[buf] if lower else buf
        self.bounds = bounds
        word = ~separators[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(buf), bool)
        after = np.empty(len(buf), bool)
        if len(buf):
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word; the two seeds together give 128 bits.

        Words are read eight bytes at a time, each time through a bijective mixer, so words of one length of at most
        eight bytes never collide; words of over LONG_WORD bytes are hashed by BLAKE2b.
        """
        eights = np.ndarray(len(self.buf) + 1, "<u8", np.concatenate([self.buf, np.zeros(8, np.uint8)]), strides=(1,))
        left = self.end - self.start
        out = mix(left, 29 + seed)
        rows = np.flatnonzero(left <= LONG_WORD)
        at, left = self.start[rows], left[rows]
        while len(rows):
            out[rows] = mix(out[rows] ^ (eights[at] & _MASKS[np.minimum(left, 8)]), seed)
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * seed : 8 * seed + 8], "little")
        return out

    def words(self, d: int) -> list[bytes]:
        raw = self.buf.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        a, b = self.first[d], self.first[d + 1]
        return [raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of h[i:i+k] at every i that has k words left, whatever documents they are of."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for t in range(1, k):
        acc *= _STEPS[seed]
        acc += h[t : t + n]
    return mix(acc, k + 17 * seed)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k words (by start, as in window_hashes) lie in one document."""
    total = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))[: max(0, total - k + 1)]
    return np.arange(len(last)) + k <= last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes, one document at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False, limit: int = 1 << 20) -> Iterator[tuple[int, int, Batch]]:
    """A string column as Batches of about limit bytes: (from row, to row, words)."""
    buf, bounds = utf8(column)
    for i, j in pieces(bounds, limit):
        yield i, j, Batch(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], separators, lower)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def longs(column: pa.Array) -> np.ndarray:
    """An integer column as int64; null is the largest value, so it comes after every id."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
