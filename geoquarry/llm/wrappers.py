"""Union-free wrappers of a site's pages: sequences of labelled elements, optional or repeated groups, and text slots."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

from geoquarry.llm.html_pages import Element

# A node is [label, optional, repeated, children]; a text slot has the label "#".
Node = list
LONGEST_PERIOD = 4
LARGE = 250_000


def of_page(element: Element) -> list[Node]:
    """Return the children of an element as nodes, with repeated siblings folded; empty elements vanish."""
    done: dict[int, list[Node]] = {}
    stack = [(element, False)]
    while stack:
        here, ready = stack.pop()
        inner = [child for child in here.children if isinstance(child, Element)]
        if not ready:
            stack.append((here, True))
            stack += [(child, False) for child in inner]
            continue
        nodes = []
        for child in here.children:
            if not isinstance(child, Element):
                nodes.append(["#", False, False, []])
            elif done.get(id(child)):
                nodes.append([child.label, False, False, done[id(child)]])
        done[id(here)] = folded(nodes)
    return done[id(element)]


def folded(nodes: list[Node]) -> list[Node]:
    """Fold neighbouring copies of a group of up to four siblings into one repeated group."""
    for period in range(1, LONGEST_PERIOD + 1):
        if len(nodes) < 2 * period:
            break
        out: list[Node] = []
        at = 0
        while at < len(nodes):
            group = nodes[at : at + period]
            names = [node[0] for node in group]
            stop = at + period
            while [node[0] for node in nodes[stop : stop + period]] == names:
                group = [merged(a, b) for a, b in zip(group, nodes[stop : stop + period], strict=True)]
                stop += period
            if stop > at + period:
                out += [[name, optional, True, inner] for name, optional, _, inner in group]
                at = stop
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def merged(left: Node, right: Node) -> Node:
    """Align two nodes of one label: what either lacks becomes optional."""
    return [left[0], left[1] or right[1], left[2] or right[2], aligned(left[3], right[3])]


def aligned(left: list[Node], right: list[Node]) -> list[Node]:
    """Align two sequences of nodes by their labels; a mismatch is resolved into optional nodes."""
    if left == right:
        return left
    out: list[Node] = []
    i = j = 0
    for a, b in _matches([node[0] for node in left], [node[0] for node in right]):
        out += [_optional(node) for node in left[i:a]] + [_optional(node) for node in right[j:b]]
        out.append(merged(left[a], right[b]))
        i, j = a + 1, b + 1
    out += [_optional(node) for node in left[i:]] + [_optional(node) for node in right[j:]]
    return folded(out)


def _optional(node: Node) -> Node:
    return [node[0], True, node[2], node[3]]


def _matches(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Return places of a common subsequence: the longest, or for very long sequences the greedy one."""
    pairs = []
    if len(left) * len(right) > LARGE:
        places: dict[str, list[int]] = {}
        for at in range(len(left) - 1, -1, -1):
            places.setdefault(left[at], []).append(at)
        low = -1
        for b, name in enumerate(right):
            own = places.get(name, [])
            while own and own[-1] <= low:
                own.pop()
            if own:
                low = own.pop()
                pairs.append((low, b))
        return pairs
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for a in range(len(left) - 1, -1, -1):
        for b in range(len(right) - 1, -1, -1):
            best[a][b] = best[a + 1][b + 1] + 1 if left[a] == right[b] else max(best[a + 1][b], best[a][b + 1])
    a = b = 0
    while a < len(left) and b < len(right):
        if left[a] == right[b]:
            pairs.append((a, b))
            a, b = a + 1, b + 1
        elif best[a + 1][b] >= best[a][b + 1]:
            a += 1
        else:
            b += 1
    return pairs


def dumped(nodes: list[Node]) -> str:
    """Return a wrapper as text that equal wrappers share."""
    return json.dumps(nodes, separators=(",", ":"), ensure_ascii=False)


def expression(nodes: list[Node]) -> str:
    """Return a wrapper as a regular expression over elements: ``<a>( ... )`` with ``?``, ``+`` or ``*``."""
    parts = []
    for name, optional, repeated, inner in nodes:
        body = "#" if name == "#" else f"<{name}>({expression(inner)})"
        parts.append(body + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[(optional, repeated)])
    return " ".join(parts)


class Sequence:
    """Neighbouring nodes of a wrapper, to match pages with: every node has a number, in page order.

    ``number`` is that of the element around them, and 0 for the whole page.
    Neighbours that repeat form one run, in which a page may go back.
    """

    __slots__ = ("end", "inner", "labels", "many", "number", "numbers", "path", "places", "runs")

    def __init__(self, nodes: list[Node], number: int = 0, path: str = "") -> None:
        self.number, self.path = number, path
        self.numbers: list[int] = []
        self.inner: list[Sequence | None] = []
        self.places: dict[str, list[int]] = {}
        self.runs: list[tuple[int, int]] = []
        number += 1
        for at, (name, _, many, below) in enumerate(nodes):
            self.places.setdefault(name, []).append(at)
            self.numbers.append(number)
            self.inner.append(None if name == "#" else Sequence(below, number, f"{path}>{name}"))
            number = number + 1 if name == "#" else self.inner[-1].end + 1
            self.runs.append((self.runs[-1][0] if at and many and nodes[at - 1][2] else at, at))
        for at in range(len(nodes) - 2, -1, -1):
            if self.runs[at + 1][0] <= at:
                self.runs[at] = (self.runs[at][0], self.runs[at + 1][1])
        self.end = number - 1  # the largest number in it
        self.many = frozenset(at for at, node in enumerate(nodes) if node[2])
        self.labels = frozenset(self.places)

    def after(self, name: str, at: int, below: set[str]) -> int | None:
        """Return the next node of a label, best one that has all labels of the page's element."""
        found = self.places.get(name)
        if not found:
            return None
        ahead = found[bisect_right(found, at) :]
        if at >= 0:
            first, stop = self.runs[at]
            if at in self.many:
                back = found[bisect_left(found, first) : bisect_right(found, at)]
                cut = bisect_right(ahead, stop)
                ahead = ahead[:cut] + back + ahead[cut:]
        if len(ahead) > 1 and below:
            for place in ahead:
                if below <= self.inner[place].labels:
                    return place
        return ahead[0] if ahead else None


def regions(sequence: Sequence) -> list[tuple[int, str, tuple[int, ...], bool]]:
    """Return ``number, path, numbers of the elements around it, is text`` of every node, in page order.

    A number of an element stands for text in it that no slot matches.
    """
    found = []
    stack = [(sequence, ())]
    while stack:
        here, around = stack.pop()
        inside = (*around, here.number)
        found.append((here.number, here.path, inside, False))
        for number, below in zip(here.numbers, here.inner, strict=True):
            if below is None:
                found.append((number, here.path, inside, True))
            else:
                stack.append((below, inside))
    return sorted(found)


def repeating(sequence: Sequence) -> set[int]:
    """Return the numbers of the nodes that repeat."""
    found: set[int] = set()
    stack = [sequence]
    while stack:
        here = stack.pop()
        found.update(here.numbers[at] for at in here.many)
        stack += [below for below in here.inner if below is not None]
    return found


def numbered(root: Element, wrapper: Sequence) -> dict[tuple[int, int], int]:
    """Match a page with its wrapper: return the number of the wrapper's slot for each place of text.

    Text that no slot matches has the number of the innermost element that matches.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[list, Sequence | None, int]] = [(root.children, wrapper, 0)]
    while stack:
        children, sequence, outer = stack.pop()
        at = -1
        for index, child in enumerate(children):
            text = not isinstance(child, Element)
            if not text and not child.filled:
                continue
            place = None
            if sequence is not None:
                below = set() if text else {inner.label if isinstance(inner, Element) else "#" for inner in child.children if not isinstance(inner, Element) or inner.filled}
                place = sequence.after("#" if text else child.label, at, below)
            if place is not None:
                at = place
            if text:
                found[id(children), index] = outer if place is None else sequence.numbers[place]
            elif place is None:
                stack.append((child.children, None, outer))
            else:
                stack.append((child.children, sequence.inner[place], sequence.numbers[place]))
    return found
