"""Sets of word shingles of whole Arrow batches, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.llm.common import mix

SLICE_BYTES = 2 << 20  # text worked on at a time; a longer text is a slice of its own

_BLANKS = np.zeros(256, dtype=bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTES = (mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1))[_LOWER]
_BYTES[_BLANKS] = 0
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD1B54A32D192ED03)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest slice had bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)])
                for b in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the slice, and how many words each text has."""
    solid = ~_BLANKS[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    starts[cuts] = solid[cuts]  # a text's first letter follows the last one of another text
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | starts[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    up, down = _powers(len(data))
    sums = np.cumsum(_BYTES[data] * up)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    hashes = mix((sums[last] - before) * down[first])
    return hashes, np.diff(np.searchsorted(first, np.r_[0, ends]))


def _shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes text by text, and how many each text has; repeats are still there."""
    at = np.r_[0, np.cumsum(counts)]
    padded = np.r_[hashes, np.zeros(width, dtype=np.uint64)]
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + padded[k : k + len(hashes)]
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    for text in np.flatnonzero((counts > 0) & (counts < width)):
        value = counts[text : text + 1].astype(np.uint64)
        for word in range(at[text], at[text + 1]):
            value = value * _STEP + hashes[word]
        rolled[at[text]] = value[0]
    of = np.repeat(np.arange(len(counts)), many)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return mix(rolled[at[of] + place]), many


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one slice of the texts after the other: (flat, sizes), the sorted distinct shingle
    hashes of every text one after the other, and how many each has.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Null and blank texts have none, a
    text of fewer than `width` words has its whole sequence as the only one.
    """
    wide = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(wide):
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), len(wide))
        part = data[offsets[start] : offsets[stop]]
        ends = offsets[start + 1 : stop + 1] - offsets[start]
        if len(part):
            flat, many = _shingles(*_word_hashes(part, ends), width)
        else:
            flat, many = np.empty(0, np.uint64), np.zeros(stop - start, dtype=np.int64)
        at = np.r_[0, np.cumsum(many)]
        for low, high in zip(at[:-1], at[1:], strict=True):
            flat[low:high].sort()
        new = np.ones(len(flat), dtype=bool)
        new[1:] = flat[1:] != flat[:-1]
        new[at[:-1][many > 0]] = True
        sizes = np.add.reduceat(new, at[:-1][many > 0]) if len(flat) else np.empty(0, np.int64)
        out = np.zeros(len(many), dtype=np.int64)
        out[many > 0] = sizes
        yield flat[new], out
        start = stop
