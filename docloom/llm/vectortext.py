"""Vectorised tokenising and shingle hashing over Arrow batches of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A batch is
handled as one byte buffer, so the cost is a few numpy passes per byte instead
of a Python call per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte but letters and digits: words are then free of punctuation.
NO_WORD = np.arange(256) < 128
NO_WORD[48:58] = NO_WORD[65:91] = NO_WORD[97:123] = False

#: Odd multiplier of the polynomial word hash, its inverse modulo 2**64, and that of the shingle hash.
_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: a bijection that spreads every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * (out[done - 1 : done] * base)
        done += step
    return out[:n]


class WordIndex:
    """Words of a batch: where each starts and ends, its document, its 64-bit hash."""

    def __init__(self, column: pa.Array, separators: np.ndarray = _SPACE) -> None:
        data, offsets = buffers(column)
        self.rows = len(column)
        self.data = _LOWER[data]
        space = separators[data]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= space[1:]
        last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        counts = np.bincount(self.doc, minlength=self.rows) if len(self.start) else np.zeros(self.rows, np.int64)
        self.counts = counts
        self.bounds = np.concatenate([[0], np.cumsum(counts)])

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """Hash of each word; the same word has the same hash in every batch."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            stop = max(at + 1, int(np.searchsorted(self.end, self.start[at] + block, side="right")))
            low, high = self.start[at], self.end[stop - 1]
            up, down = _powers(high - low, _WORD_BASE), _powers(high - low, _WORD_INVERSE)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
            begin = self.start[at:stop] - low
            out[at:stop] = (sums[self.end[at:stop] - low] - sums[begin]) * down[begin]
            at = stop
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A text of fewer than ``width`` words has its whole word sequence as its one
    shingle; a null or wordless text has none.
    """
    words = WordIndex(column)
    hashes = words.hashes()
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _SHINGLE_BASE + hashes[k : k + len(rolled)]
    rolled = mix(rolled + np.uint64(width))
    out = []
    for d in range(words.rows):
        a, b = int(words.bounds[d]), int(words.bounds[d + 1])
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.uint64(0)
            for h in hashes[a:b]:
                short = np.uint64((int(short) * int(_SHINGLE_BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([short + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class CirculantMinHash:
    """MinHash signatures from two permutations of a universe of ``size`` cells.

    The first permutation scatters the shingles; the second gives the values,
    and its circular shift by ``k`` gives coordinate ``k``: for a shingle at
    cell ``p``, coordinate ``k`` is ``second[(p - k) mod size]``.  All
    coordinates of a shingle are thus one contiguous slice of one table.
    """

    def __init__(self, coordinates: int, size_bits: int = 20, seed: int = 7) -> None:
        self.coordinates, self.mask = coordinates, np.uint64((1 << size_bits) - 1)
        draw = np.random.default_rng(seed)
        self.first = draw.permutation(1 << size_bits).astype(np.int64)
        second = draw.permutation(1 << size_bits).astype(np.int32)
        reversed_ = second[::-1]  # so that a rising k reads on to the right
        self.table = np.concatenate([reversed_, reversed_[:coordinates]])
        self.windows = np.lib.stride_tricks.sliding_window_view(self.table, coordinates)
        self.last = (1 << size_bits) - 1

    def signature(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        cells = self.last - self.first[(shingles & self.mask).astype(np.int64)]
        out = None
        for at in range(0, len(cells), block):
            low = self.windows[cells[at : at + block]].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out
