"""Texts of an Arrow batch as numpy arrays: words, their hashes and those of word shingles.

Nothing here makes a Python object per word. Hashes are polynomials modulo
2**64 over an odd base, mixed at the end; work arrays are bounded by cutting
batches into blocks of texts and blocks into runs of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 21
RUN_BYTES = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the powers of a base and of its inverse modulo 2**64."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < count:
        size = max(count, RUN_BYTES + 4096) if base == BASE else count
        inverse = np.uint64(pow(key, -1, 1 << 64))
        made = []
        for factor in (base, inverse):
            values = np.full(size, factor, np.uint64)
            values[0] = 1
            made.append(np.cumprod(values, dtype=np.uint64))
        if base != BASE and size > RUN_BYTES:
            return made[0], made[1]
        _POWERS[key] = (made[0], made[1])
    return _POWERS[key]


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block:
    """Some texts in a row: their bytes, where each begins, and their words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        self.count = len(offsets) - 1

    def find_words(self, space: np.ndarray = _SPACE) -> None:
        """Set ``starts``, ``ends`` of words in the bytes and ``bounds`` of each text's words."""
        inside = ~space[self.data]
        fresh = np.zeros(len(inside) + 1, bool)
        fresh[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | fresh[1:-1]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | fresh[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self, low: bool = False, longest: int | None = None) -> np.ndarray:
        """Return a 64-bit hash per word, of its first ``longest`` bytes if given."""
        data = LOWERED[self.data] if low else self.data
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return span_hashes(data, self.starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Return a hash of the bytes of each span; spans are in order and do not overlap."""
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        stop = max(int(np.searchsorted(ends, origin + RUN_BYTES, "right")), at + 1)
        run = data[origin : ends[stop - 1]]
        forward, back = _powers(BASE, len(run) + 1)
        sums = np.empty(len(run) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((run.astype(np.uint64) + np.uint64(1)) * forward[: len(run)], out=sums[1:])
        left, right = starts[at:stop] - origin, ends[at:stop] - origin
        found[at:stop] = (sums[right] - sums[left]) * back[left]
        at = stop
    return mixed(found)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Return a hash of every ``width`` words in a row, and the bounds of each text's shingles.

    A text with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    whole = np.where(counts >= width, counts - width + 1, 0)
    total = len(words)
    long = np.zeros(0, np.uint64)
    if total >= width:
        # A sum of word hashes times powers of STEP, word by word.
        long = np.zeros(total - width + 1, np.uint64)
        for offset in range(width):
            long *= STEP
            long += words[offset : total - width + 1 + offset]
        long = mixed(long)
    short = np.flatnonzero((counts > 0) & (counts < width))
    made = np.maximum(whole, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_bounds[-1], np.uint64)
    if len(long):
        source = np.repeat(bounds[:-1] - out_bounds[:-1], made) + np.arange(len(out))
        source[out_bounds[short]] = 0
        out[:] = long[np.minimum(source, len(long) - 1)]
    for doc in short:
        value = np.uint64(len(words[bounds[doc] : bounds[doc + 1]]))
        for word in words[bounds[doc] : bounds[doc + 1]]:
            value = np.uint64((int(value) * int(STEP) + int(word)) & 0xFFFFFFFFFFFFFFFF)
        out[out_bounds[doc]] = mixed(np.array([value]))[0]
    return out, out_bounds


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of texts of about ``size`` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1, at + 1)
        yield Block(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop
