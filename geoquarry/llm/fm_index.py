"""A compressed full-text index over word numbers: a wavelet matrix over the Burrows-Wheeler transform.

All operations take arrays of queries, so that many texts are searched in step.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a running count per 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Return how many ones stand before each position."""
        block = at >> 6
        part = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(part)


class FMIndex:
    """An index of word sequences; each is followed by an end mark of its own.

    ``sequences`` are numbers from 1 on, laid end to end, and ``bounds`` says
    where each begins. ``length`` is the number of words of which suffixes
    with equal beginnings form a block.
    """

    def __init__(self, sequences: np.ndarray, bounds: np.ndarray, length: int) -> None:
        count = len(bounds) - 1
        owner = np.repeat(np.arange(count), np.diff(bounds))
        self.text = np.zeros(len(sequences) + count, np.int64)
        self.text[np.arange(len(sequences)) + owner] = sequences
        self.begins = bounds[:-1] + np.arange(count)
        self.sizes = np.diff(bounds)
        ends = bounds[1:] + np.arange(count)
        symbols = int(sequences.max()) + 1 if len(sequences) else 1
        order, near = self._sorted(ends, count, length)
        self.order = order
        last = self.text[order - 1]  # the first position follows the last end mark
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=symbols + 1))])
        self.levels = max(1, int(symbols).bit_length())
        self._build(last)
        self.origin = self._walk(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))
        same = np.zeros(len(order), bool)
        same[1:] = near(order[1:], order[:-1])
        self.block = np.cumsum(~same) - 1
        self.block_start = np.flatnonzero(~same)
        self.block_end = np.append(self.block_start[1:], len(order))

    def _sorted(self, ends: np.ndarray, count: int, length: int) -> tuple[np.ndarray, object]:
        """Sort all suffixes by doubling; also return a test whether two share their first ``length`` words."""
        size = len(self.text)
        rank = self.text + count
        rank[ends] = np.arange(count)
        half = 1
        kept = {1: rank}
        order = np.argsort(rank, kind="stable")
        while True:
            ahead = np.zeros(size, np.int64)
            ahead[:-half] = rank[half:] + 1 if half < size else 0
            key = rank * (max(int(ahead.max()), 0) + 2) + ahead
            order = np.argsort(key, kind="stable")
            fresh = np.ones(size, np.int64)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            half *= 2
            if half <= length:
                kept[half] = rank
            if rank[order[-1]] == size - 1 or half >= size:
                break
        width = max(kept)
        level, shift = kept[width], max(length - width, 0)

        def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            alike = level[left] == level[right]
            for step in range(width, shift + width, width):
                move = min(step, shift)
                a, b = np.minimum(left + move, size - 1), np.minimum(right + move, size - 1)
                alike &= level[a] == level[b]
            return alike

        return order, near

    def _build(self, values: np.ndarray) -> None:
        self.rows = []
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1
            self.rows.append(BitVector(bits.astype(np.uint8)))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Follow positions down the levels by the bits of the symbols."""
        for row, level in zip(self.rows, range(self.levels - 1, -1, -1), strict=True):
            ones = row.ones(at)
            at = np.where((symbols >> level) & 1 == 1, row.zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the suffix ranges of the searched words with one more word before them."""
        both = self._walk(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.first[symbols] - self.origin[symbols]
        return start + both[: len(low)], start + both[len(low) :]

    def window_blocks(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search all sequences from their ends backwards; return sequence, start and block of every window.

        The length of the match grows word by word up to ``window``; then the
        range widens to all suffixes that share ``window`` words before the
        next word is put in front.
        """
        by_size = np.argsort(-self.sizes, kind="stable")
        found = []
        low = np.zeros(len(by_size), np.int64)
        high = np.full(len(by_size), len(self.text), np.int64)
        sizes = self.sizes[by_size]
        for step in range(int(sizes.max()) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, "left"))  # longer than the steps so far
            chosen = by_size[:live]
            start = sizes[:live] - 1 - step
            symbols = self.text[self.begins[chosen] + start]
            low[:live], high[:live] = self.extend(symbols, low[:live], high[:live])
            if step + 1 >= window:
                block = self.block[low[:live]]
                found.append((chosen, start, block))
                low[:live], high[:live] = self.block_start[block], self.block_end[block]
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))

    def block_least(self, values: np.ndarray) -> np.ndarray:
        """Return the least value of each block, given a value per sequence."""
        owner = np.searchsorted(self.begins, self.order, "right") - 1
        return np.minimum.reduceat(values[owner], self.block_start)
