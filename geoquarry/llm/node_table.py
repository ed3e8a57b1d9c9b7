"""A minimal perfect hash over distinct 128-bit digests, for flat arrays indexed by slot."""

from __future__ import annotations

import numpy as np

from geoquarry.llm.text_arrays import mixed

# Places per key that is still without a slot, in each level.
ROOM = 1.6


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return the distinct pairs of two arrays."""
    order = np.lexsort((second, first))
    one, two = first[order], second[order]
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one[fresh], two[fresh]


class NodeTable:
    """Slots 0 to n - 1 of n distinct digests.

    Every level deals the digests that have no slot yet to places; one that
    is alone in its place gets the place's rank as its slot, the others go
    to the next level. The digest itself is kept at its slot, so a lookup
    never takes another one for it.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.first, self.second = np.empty_like(first), np.empty_like(second)
        left, given = np.arange(len(first)), 0
        while len(left):
            size = int(len(left) * ROOM) + 8
            place = self._places(first[left], second[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = given + np.cumsum(alone) - 1
            self.levels.append((alone, ranks))
            placed = alone[place]
            slots = ranks[place[placed]]
            self.first[slots], self.second[slots] = first[left[placed]], second[left[placed]]
            given += int(alone.sum())
            left = left[~placed]

    def __len__(self) -> int:
        return len(self.first)

    @staticmethod
    def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        tint = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (mixed(first + mixed(second ^ tint)) % np.uint64(size)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Return the slot of each digest, -1 where the table does not have it."""
        found = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, (alone, ranks) in enumerate(self.levels):
            if not len(left):
                break
            place = self._places(first[left], second[left], level, len(alone))
            here = alone[place]
            found[left[here]] = ranks[place[here]]
            left = left[~here]
        same = found >= 0
        same[same] = (self.first[found[same]] == first[same]) & (self.second[found[same]] == second[same])
        found[~same] = -1
        return found


def gather_up(values: np.ndarray, parents: np.ndarray, depths: np.ndarray, how: np.ufunc) -> None:
    """Add (or otherwise combine) the value of every slot to its parent's, the deepest slots first."""
    order = np.argsort(-depths, kind="stable")
    order = order[parents[order] >= 0]
    bounds = np.flatnonzero(np.diff(depths[order])) + 1
    for level in np.split(order, bounds):
        how.at(values, parents[level], values[level])
