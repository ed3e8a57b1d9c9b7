"""Probabilistic automata of formats, inferred from examples by merging states of their prefix tree."""

from __future__ import annotations

import io
from collections.abc import Mapping, Sequence

import numpy as np

# Fixed characters of the alphabet: what a credential may hold.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SYMBOLS = len(ALPHABET)
CODES = np.full(256, -1, np.int16)
CODES[list(ALPHABET)] = np.arange(SYMBOLS)
# Stands for the end of a word where symbols are counted.
END = -1
# Chance of calling two equal frequencies different.
ALPHA = 0.05
# What every count gives away to what no example had: a path of a single example says nothing.
DISCOUNT = 1.0
# Logarithm that stands for a chance of zero.
IMPOSSIBLE = -1e9
# Strings up to this length are scored side by side, longer ones one by one.
SIDE_BY_SIDE = 512


class _Tree:
    """The prefix tree of examples, with counts; states are merged in place."""

    def __init__(self, words: Sequence[bytes] = ()) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.arcs: list[dict[int, int]] = [{}]
        self.ends = [0]
        self.passed = [0]
        for word in words:
            state = 0
            self.passed[0] += 1
            for symbol in CODES[np.frombuffer(word, np.uint8)].tolist():
                self.arcs[state][symbol] = self.arcs[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.arcs.append({})
                    self.ends.append(0)
                    self.passed.append(0)
                state = self.next[state][symbol]
                self.passed[state] += 1
            self.ends[state] += 1

    @classmethod
    def of_prefixes(cls, counts: Mapping[bytes, Mapping[int, int]], least: float) -> _Tree:
        """Build the tree of the prefixes that at least so many examples have.

        ``counts`` holds, by prefix, how many examples go on with each symbol and how many end (``END``).
        Arcs to rarer prefixes are counted and lead nowhere yet.
        """
        tree, places = cls(), {b"": 0}
        for prefix in sorted(counts, key=lambda prefix: (len(prefix), prefix)):
            own = counts[prefix]
            passed = sum(own.values())
            if prefix and (passed < least or prefix[:-1] not in places):
                continue
            state = places.setdefault(prefix, len(tree.next))
            if prefix:
                tree.next[places[prefix[:-1]]][int(CODES[prefix[-1]])] = state
                tree.next.append({})
                tree.arcs.append({})
                tree.ends.append(0)
                tree.passed.append(0)
            tree.arcs[state] = {symbol: count for symbol, count in sorted(own.items()) if symbol != END}
            tree.ends[state], tree.passed[state] = own.get(END, 0), passed
        return tree

    def alike(self, kept: int, other: int, reach: float) -> bool:
        """Tell whether two states, and those that follow both, have frequencies within their Hoeffding bounds."""
        waiting = [(kept, other)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.passed[a], self.passed[b]
            bound = reach * (n**-0.5 + m**-0.5)
            if bound >= 1:
                continue  # no frequencies differ by more, here or below
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            ours, theirs = self.arcs[a], self.arcs[b]
            for symbol in ours.keys() | theirs.keys():
                if abs(ours.get(symbol, 0) / n - theirs.get(symbol, 0) / m) > bound:
                    return False
            waiting += [(self.next[a][symbol], below) for symbol, below in self.next[b].items() if symbol in self.next[a]]
        return True

    def fold(self, kept: int, other: int) -> None:
        """Add a subtree's counts to a state and to those it leads to."""
        waiting = [(kept, other)]
        while waiting:
            a, b = waiting.pop()
            self.passed[a] += self.passed[b]
            self.ends[a] += self.ends[b]
            for symbol, count in self.arcs[b].items():
                self.arcs[a][symbol] = self.arcs[a].get(symbol, 0) + count
                below = self.next[b].get(symbol)
                if below is None:
                    continue
                if symbol in self.next[a]:
                    waiting.append((self.next[a][symbol], below))
                else:
                    self.next[a][symbol] = below


class Automaton:
    """Transitions and log-probabilities by state and symbol; the last state holds what no example had."""

    def __init__(self, steps: np.ndarray, logs: np.ndarray, ends: np.ndarray) -> None:
        self.steps, self.logs, self.ends = steps, logs, ends

    @classmethod
    def inferred(cls, words: Sequence[bytes], *, strict: bool = False, alpha: float = ALPHA) -> Automaton:
        """Infer an automaton from distinct examples over ``ALPHABET``.

        Kept states grow from the root. A state that follows a kept one is
        merged with the first kept state of compatible statistics, its
        predecessor first; where there is none it is kept itself. What no
        example had gets the letter frequencies of all examples; if
        ``strict``, it is no word of the format.
        """
        automaton = cls._merged(_Tree(sorted(words)), alpha)
        codes = [CODES[np.frombuffer(word, np.uint8)] for word in words]
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum([len(code) for code in codes], dtype=np.int64)
        return automaton.refitted(automaton.visits(data, stops - [len(code) for code in codes], stops), strict=strict)

    @classmethod
    def of_prefixes(cls, counts: Mapping[bytes, Mapping[int, int]], least: float, alpha: float = ALPHA) -> Automaton:
        """Infer the states from the prefixes that at least so many examples have; ``refitted`` gives the chances."""
        return cls._merged(_Tree.of_prefixes(counts, least), alpha)

    @classmethod
    def _merged(cls, tree: _Tree, alpha: float) -> Automaton:
        reach = (0.5 * np.log(2 / alpha)) ** 0.5
        kept = [0]
        number = {0: 0}
        while True:
            fringe = [(one, at) for one in kept for at, to in sorted(tree.next[one].items()) if to not in number]
            if not fringe:
                break
            for before, symbol in fringe:
                state = tree.next[before][symbol]
                for other in [before, *(one for one in kept if one != before)]:
                    if tree.alike(other, state, reach):
                        tree.next[before][symbol] = other
                        tree.fold(other, state)
                        break
                else:
                    number[state] = len(kept)
                    kept.append(state)
        steps = np.full((len(kept) + 1, SYMBOLS), len(kept), np.int32)
        for at, state in enumerate(kept):
            for symbol, to in tree.next[state].items():
                steps[at, symbol] = number[to]
        return cls(steps, np.zeros(steps.shape), np.zeros(len(steps)))

    def visits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Count what examples do in each state: the symbols they go on with, and in the last column that they end.

        What leads nowhere, being rare, is merged with the state before it.
        """
        found = np.zeros((len(self.steps), SYMBOLS + 1), np.int64)
        nowhere = len(self.steps) - 1
        steps = np.where(self.steps == nowhere, np.arange(len(self.steps))[:, None], self.steps)
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state = np.zeros(len(order), np.int64)
        for step in range(int(sizes[0]) if len(order) else 0):
            active = int(np.searchsorted(-sizes, -step, "left"))
            here, symbol = state[:active], CODES[data[starts[:active] + step]]
            np.add.at(found, (here, symbol), 1)
            state[:active] = steps[here, symbol]
        np.add.at(found, (state, SYMBOLS), 1)
        return found

    def refitted(self, counts: np.ndarray, *, strict: bool = False) -> Automaton:
        """Return the automaton with the chances of ``counts``, the ``visits`` of all its examples."""
        nowhere = len(self.steps) - 1
        own = np.broadcast_to(np.arange(len(self.steps), dtype=np.int32)[:, None], self.steps.shape)
        steps = np.where((self.steps == nowhere) & (counts[:, :-1] > 0), own, self.steps)
        return self._smoothed(counts.astype(float), steps, strict)

    @classmethod
    def _smoothed(cls, counts: np.ndarray, steps: np.ndarray, strict: bool) -> Automaton:
        kept = steps[:-1]
        letters = (counts.sum(axis=0) + 1) / (counts.sum() + SYMBOLS + 1)
        given = np.minimum(counts, 0.0 if strict else DISCOUNT)
        # The last state has no examples of its own.
        nothing = (np.arange(len(steps)) == len(kept))[:, None]
        whole = counts - given + (given.sum(axis=1, keepdims=True) + nothing) * letters
        with np.errstate(divide="ignore"):
            logs = np.maximum(np.log(whole / whole.sum(axis=1, keepdims=True)), IMPOSSIBLE)
        return cls(steps, logs[:, :-1].copy(), logs[:, -1].copy())

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Return the log-probability of each span of bytes, all of them in the alphabet."""
        sizes = ends - starts
        found = np.zeros(len(starts))
        order = np.argsort(-sizes, kind="stable")
        long = int((sizes > SIDE_BY_SIDE).sum())
        for at in order[:long]:
            found[at] = self._one(CODES[data[starts[at] : ends[at]]])
        order = order[long:]
        state = np.zeros(len(order), np.int32)
        for step in range(int(sizes[order[0]]) if len(order) else 0):
            active = int(np.searchsorted(-sizes[order], -step, "left"))
            here = order[:active]
            symbol = CODES[data[starts[here] + step]]
            found[here] += self.logs[state[:active], symbol]
            state[:active] = self.steps[state[:active], symbol]
        found[order] += self.ends[state]
        return found

    def _one(self, symbols: np.ndarray) -> float:
        logs, steps = self.logs.tolist(), self.steps.tolist()
        total, state = 0.0, 0
        for first in range(0, len(symbols), 1 << 16):
            for symbol in symbols[first : first + (1 << 16)].tolist():
                total += logs[state][symbol]
                state = steps[state][symbol]
        return total + float(self.ends[state])

    def packed(self) -> bytes:
        body = io.BytesIO()
        np.savez(body, steps=self.steps, logs=self.logs, ends=self.ends)
        return body.getvalue()

    @classmethod
    def unpacked(cls, body: bytes) -> Automaton:
        held = np.load(io.BytesIO(body))
        return cls(held["steps"], held["logs"], held["ends"])
