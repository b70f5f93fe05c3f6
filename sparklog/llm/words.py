"""Words of many texts at once: places and 64-bit hashes, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit numbers over all their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=8)
def _values(separators: bytes) -> np.ndarray:
    """A number for each byte: 0 for separators, the same for A-Z as for a-z."""
    lowered = np.arange(256)
    lowered[65:91] += 32
    values = mix((lowered.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)) | np.uint64(1)
    values[list(separators)] = 0
    return values


#: Separators of `[^\\x20\\x09-\\x0D]+`, and of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_WORDS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


class Words:
    """Words of the texts in one slice: start, end (bytes), hash, and first[i] : first[i + 1] for text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: bytes):
        self.data, self.bounds = data, bounds
        values = _values(separators)
        inner = (values != 0)[data]
        edge = np.zeros(len(data) + 1, np.bool_)
        edge[bounds] = True
        starts = inner.copy()
        starts[1:] &= ~inner[:-1] | edge[1:-1]
        ends = inner
        ends[:-1] &= ~inner[1:] | edge[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        if len(self.start):
            up, down = _powers(1 << max(len(data) - 1, 1).bit_length())
            weighed = values[data]
            weighed *= up[: len(data)]
            self.hash = mix(np.add.reduceat(weighed, self.start) * down[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) over a string column, nulls as empty texts, in slices of bounded size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
