"""Secrets in texts: fixed patterns, and formats learned from what the patterns find.

What the patterns match are labelled credentials. All distinct ones of a kind,
and all distinct other candidates of a sort, are turned into a probabilistic
automaton (``automata``). Every candidate of every text is
then scored: how much likelier the best format is than an ordinary token,
given how many distinct ones of each there are. Ordinary tokens are told apart
by sort, so that the many words do not stand for card numbers or addresses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.automata import CODES, END, SYMBOLS, Automaton
from geoquarry.llm.common import prepared
from geoquarry.llm.text_arrays import Block, span_hashes, text_blocks

# The kinds in their order, and the patterns of the first two.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
HEX = b"0123456789abcdef"

# Candidates are runs of the alphabet, without dots and dashes at their ends.
SHORTEST = 8
TRIMMED = b".-"
# States of an automaton are told apart by prefixes of one in so many examples, up to so many bytes;
# what all examples do, whole, is counted in these states.
RESOLUTION = 1_000
DEEPEST = 128
# A candidate is reported when it is so many times likelier to be a credential than not.
ODDS = 99.0
# Other tokens by what they hold: no digits, no letters, both. Each sort has an automaton of its own.
SORTS = ["words", "numbers", "mixed"]

_NOT_HEX = np.ones(256, bool)
_NOT_HEX[list(HEX)] = False
_NOT_ALPHABET = CODES < 0
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_TRIM = np.zeros(256, bool)
_TRIM[list(TRIMMED)] = True


@dataclass(frozen=True)
class Formats:
    """An automaton per kind and sort, and how many distinct credentials or other tokens of it there are."""

    automata: dict[str, Automaton]
    counts: dict[str, float]


def _runs(block: Block, outside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the begins and ends of runs of at least so many bytes."""
    view = Block(block.first, block.data, block.offsets)
    view.find_words(outside)
    fine = view.ends - view.starts >= least
    return view.starts[fine], view.ends[fine]


def _base_spans(block: Block) -> list[tuple[int, int, int, int]]:
    """Return kind, begin, end and begin of the credential of the patterns' matches, as bytes of the block, in order."""
    found = [(2, int(start), int(stop), int(start)) for start, stop in zip(*_runs(block, _NOT_HEX, LEAST["hex"]), strict=True)]
    for at in range(block.count):
        offset = int(block.offsets[at])
        text = block.data[offset : block.offsets[at + 1]].tobytes()
        if b"=" in text or b":" in text:
            found += [
                (0, offset + match.start(), offset + match.end(), offset + match.start(2))
                for match in ASSIGN.finditer(text)
                if match.end(2) - match.start(2) >= LEAST["assign"]
            ]
        found += [
            (1, offset + match.start(), offset + match.end(), offset + match.start())
            for match in ACCESS.finditer(text)
            if match.end() - match.start() >= LEAST["access"]
        ]
    return sorted(found, key=lambda span: (span[1], span[0]))


def _candidates(block: Block, base: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Return the begins and ends of candidates that do not overlap a pattern's match."""
    starts, ends = _runs(block, _NOT_ALPHABET, SHORTEST)
    solid = np.flatnonzero(~_TRIM[block.data])
    if not len(solid) or not len(starts):
        return starts[:0], ends[:0]
    low = np.searchsorted(solid, starts)
    high = np.searchsorted(solid, ends)
    fine = low < high
    starts, ends = solid[low[fine]], solid[high[fine] - 1] + 1
    fine = ends - starts >= SHORTEST
    if base:
        covered = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(covered, [span[1] for span in base], 1)
        np.add.at(covered, [span[2] for span in base], -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
        fine &= inside[ends] == inside[starts]
    return starts[fine], ends[fine]


def _sorts(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Return the number of each candidate's sort."""
    digits, letters = (np.concatenate([[0], np.cumsum(kind[block.data])]) for kind in (_DIGIT, _LETTER))
    with_digits = digits[ends] > digits[starts]
    with_letters = letters[ends] > letters[starts]
    return np.where(with_digits, np.where(with_letters, 2, 1), 0)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Return the examples of each kind and sort, whole, once a block."""
    for batch in batches:
        for block in text_blocks(batch.column(0)):
            base = _base_spans(block)
            kinds: list[str] = []
            words: list[bytes] = []
            for number, kind in enumerate(KINDS):
                own = {block.data[span[3] : span[2]].tobytes() for span in base if span[0] == number}
                kinds += [kind] * len(own)
                words += own
            starts, ends = _candidates(block, base)
            if len(starts):
                first = np.unique(span_hashes(block.data, starts, ends), return_index=True)[1]
                starts, ends = starts[first], ends[first]
                kinds += [SORTS[sort] for sort in _sorts(block, starts, ends)]
                words += [block.data[start:stop].tobytes() for start, stop in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.large_binary()).cast(pa.binary())], ["kind", "word"])


class _Prefixes:
    """Counts of the prefixes of one kind's examples, which come in order."""

    def __init__(self, least: float) -> None:
        self.least = least
        self.first: bytes | None = None
        self.word = b""
        self.open: list[dict[int, int]] = []
        self.found: list[tuple[bytes, int, int]] = []

    def add(self, word: bytes) -> None:
        cut = word[:DEEPEST]
        if self.first is None:
            self.first, self.open = cut, [{}]
        shared = 0
        while shared < min(len(cut), len(self.word)) and cut[shared] == self.word[shared]:
            shared += 1
        self._close(shared, last=False)
        self.word = cut
        self.open += [{} for _ in range(len(cut) - shared)]
        ended = int(CODES[word[DEEPEST]]) if len(word) > DEEPEST else END
        self.open[-1][ended] = self.open[-1].get(ended, 0) + 1

    def _close(self, depth: int, *, last: bool) -> None:
        while len(self.open) > depth + 1:
            own = self.open.pop()
            size = len(self.open)
            passed, symbol = sum(own.values()), int(CODES[self.word[size - 1]])
            self.open[-1][symbol] = self.open[-1].get(symbol, 0) + passed
            self._keep(self.word[:size], own, passed, last)

    def _keep(self, prefix: bytes, own: dict[int, int], passed: int, last: bool) -> None:
        # Other tasks may hold more of the prefixes of the first and the last example.
        if passed >= self.least or last or (self.first or b"").startswith(prefix):
            self.found += [(prefix, symbol, count) for symbol, count in own.items()]

    def done(self) -> list[tuple[bytes, int, int]]:
        self._close(0, last=True)
        self._keep(b"", self.open[0], sum(self.open[0].values()), True)
        return self.found


def _prefix_counts(least: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, _Prefixes] = {}
        for batch in batches:
            for kind, word in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if kind not in own:
                    own[kind] = _Prefixes(least[kind])
                own[kind].add(word.as_py())
        for kind, prefixes in own.items():
            rows = prefixes.done()
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.string()), *(pa.array([row[at] for row in rows], as_) for at, as_ in enumerate((pa.binary(), pa.int32(), pa.int64())))],
                ["kind", "prefix", "symbol", "n"],
            )

    return run


def _visit_counts(shapes: dict[str, Automaton]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), object)
            for kind in set(kinds.tolist()):
                words = batch.column(1).filter(pa.array(kinds == kind)).cast(pa.large_binary())
                offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
                data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
                found = shapes[kind].visits(data, offsets[:-1], offsets[1:])
                totals[kind] = totals[kind] + found if kind in totals else found
        for kind, found in totals.items():
            states, symbols = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(states), pa.string()), pa.array(states, pa.int32()), pa.array(symbols, pa.int32()), pa.array(found[states, symbols], pa.int64())],
                ["kind", "state", "symbol", "n"],
            )

    return run


def learn_formats(docs: DataFrame) -> Formats:
    """Infer the formats from the whole texts of a table.

    All distinct examples of a kind or sort are sorted by Spark. Prefixes
    that one in ``RESOLUTION`` of them has make the states; then every
    example, at its whole length, is counted in them. Per kind the driver
    gets its number of examples, its states and their counts.
    """
    prepared(docs)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_examples, "kind string, word binary").distinct()
    examples = found.repartitionByRange("kind", "word").sortWithinPartitions("kind", "word").checkpoint()
    counts = {row["kind"]: float(row["n"]) for row in examples.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    least = {kind: max(count / RESOLUTION, 1.0) for kind, count in counts.items()}
    prefixes = examples.mapInArrow(_prefix_counts(least), "kind string, prefix binary, symbol int, n bigint").groupBy("kind", "prefix", "symbol").agg(F.sum("n").alias("n"))

    def inferred(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        own: dict[bytes, dict[int, int]] = {}
        for prefix, symbol, count in zip(*(rows.column(name).to_pylist() for name in ("prefix", "symbol", "n")), strict=True):
            own.setdefault(prefix, {})[symbol] = count
        return pa.table([pa.array([kind]), pa.array([Automaton.of_prefixes(own, least[kind]).packed()], pa.binary())], ["kind", "body"])

    shapes = {row["kind"]: Automaton.unpacked(bytes(row["body"])) for row in prefixes.groupBy("kind").applyInArrow(inferred, "kind string, body binary").collect()}
    visits = examples.mapInArrow(_visit_counts(shapes), "kind string, state int, symbol int, n bigint").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n"))
    totals = {kind: np.zeros((len(shape.steps), SYMBOLS + 1), np.int64) for kind, shape in shapes.items()}
    for row in visits.collect():
        totals[row["kind"]][row["state"], row["symbol"]] = row["n"]
    return Formats({kind: shape.refitted(totals[kind], strict=kind in KINDS) for kind, shape in shapes.items()}, counts)


def _learned_spans(block: Block, base: list[tuple[int, int, int, int]], formats: Formats) -> list[tuple[int, int, int]]:
    """Return kind, begin and end of candidates that one of the formats explains."""
    known = [number for number, kind in enumerate(KINDS) if kind in formats.automata]
    starts, ends = _candidates(block, base)
    if not len(starts) or not known:
        return []
    _, first, back = np.unique(span_hashes(block.data, starts, ends), return_index=True, return_inverse=True)
    one, two = starts[first], ends[first]
    sorts, plain = _sorts(block, one, two), np.zeros(len(first))
    for number, sort in enumerate(SORTS):
        own = sorts == number
        model = formats.automata.get(sort) or Automaton.inferred([])
        plain[own] = model.scores(block.data, one[own], two[own]) + np.log(formats.counts.get(sort, 1.0))
    gains = np.array([
        formats.automata[KINDS[number]].scores(block.data, one, two) + np.log(formats.counts[KINDS[number]]) - plain for number in known
    ])
    best, gain = gains.argmax(axis=0), gains.max(axis=0)
    taken = np.flatnonzero((gain > np.log(ODDS))[back])
    return [(len(KINDS) + known[best[back[at]]], int(starts[at]), int(ends[at])) for at in taken]


def secret_spans(docs: DataFrame, formats: Formats) -> DataFrame:
    """Return ``doc_id, secrets`` of every document, in the order of the spans.

    ``secrets`` is an array of ``kind, start, end`` in code points, ordered
    by start and then by kind: ``assign, access, hex`` are matches of the
    patterns, ``like_assign, like_access, like_hex`` candidates outside of
    those that a learned format explains. Null and empty texts have none;
    rows of equal id stay rows of their own; a null id stays null. Further columns are ignored. An
    empty table gives an empty one, and without any credential in the table
    that the formats were learned from nothing is added to the patterns.
    """
    prepared(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [*KINDS, *(f"like_{kind}" for kind in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            secrets: list[list[dict]] = []
            for block in text_blocks(batch.column(1)):
                base = _base_spans(block)
                spans = [span[:3] for span in base] + _learned_spans(block, base, formats)
                own: list[list[tuple[int, int, int]]] = [[] for _ in range(block.count)]
                begins = block.offsets[:-1]
                # Of empty texts with the same begin only the last is not empty.
                owners = np.searchsorted(begins, [span[1] for span in spans], "right") - 1
                for owner, span in zip(owners.tolist(), spans, strict=True):
                    own[owner].append(span)
                for at, mine in enumerate(own):
                    if not mine:
                        secrets.append([])
                        continue
                    offset = int(block.offsets[at])
                    data = block.data[offset : block.offsets[at + 1]]
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    secrets.append([
                        {"kind": names[kind], "start": int(points[start - offset]), "end": int(points[stop - offset])}
                        for kind, start, stop in sorted(mine, key=lambda span: (span[1], span[0]))
                    ])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(secrets, kind)], ["doc_id", "secrets"])

    return rows.mapInArrow(run, "doc_id bigint, secrets array<struct<kind: string, start: bigint, end: bigint>>")
