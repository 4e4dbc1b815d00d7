"""Vectorised reading of Arrow text batches: words, lines and their 64-bit hashes, a slice of bytes at a time.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; as those are ASCII, words of UTF-8
bytes and of code points are the same. Hashes take a string eight bytes at a time, each step mixed before the next, so
that no arrangement of letters cancels out; strings beyond 512 bytes go through BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LONG = 512
#: Of the last eight bytes of a string, those that belong to it.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice:
    """Some whole texts: rows ``lo`` to ``hi`` of a batch, their bytes and the offsets of each text."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.n = hi - lo

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~SPACE[self.data]
        first = np.ones(len(self.data), bool)
        first[1:] = ~inside[:-1]
        cuts = self.offsets[:-1]
        first[cuts[cuts < len(self.data)]] = True
        first &= inside
        starts = np.flatnonzero(first)
        last = np.ones(len(self.data), bool)
        last[:-1] = ~inside[1:]
        cuts = self.offsets[1:]
        last[cuts[cuts > 0] - 1] = True
        last &= inside
        ends = np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each line between line feeds; a text without bytes has none."""
        feeds = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(np.diff(self.offsets))
        starts = np.sort(np.concatenate([self.offsets[:-1][full], feeds + 1]))
        ends = np.sort(np.concatenate([feeds, self.offsets[1:][full]]))
        # where two texts meet, equal positions stand in the order of their texts
        return starts, ends, np.repeat(full, self.per_text(self.data == 10)[full] + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes from each start to each end."""
        out = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        long = ends - starts > _LONG
        rows = np.flatnonzero(~long) if long.any() else np.arange(len(starts))
        at, left = starts[rows], (ends - starts)[rows]
        while len(rows):
            part = eight[at] & _MASKS[np.minimum(left, 8)]
            out[rows] = mix(out[rows] ^ part) + np.uint64(0x9E3779B97F4A7C15)
            on = left > 8
            rows, at, left = rows[on], at[on] + 8, left[on] - 8
        for k in np.flatnonzero(long):
            found = hashlib.blake2b(self.data[starts[k] : ends[k]], digest_size=8).digest()
            out[k] = int.from_bytes(found, "little")
        return out


#: Texts in a slice at most, so that a text's number takes 12 bits.
SLICE_TEXTS = 1 << 12


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``most`` bytes; a longer text is a slice of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(column), lo + SLICE_TEXTS)
        part = data[offsets[lo] : offsets[hi]]
        yield Slice(lo, hi, LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


#: Weights of the places in a window of words.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, owner: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of ``size`` words inside a text, and the window's hash."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _PLACES[k]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return at, mix(out[at])
