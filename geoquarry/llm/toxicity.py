"""Toxicity: boosted trees over lexicon densities and style rates, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.boosting import Tree, grow, isotonic
from geoquarry.llm.common import prepared
from geoquarry.llm.labelled import training_rows
from geoquarry.llm.text_arrays import LOWERED, Block, span_hashes, text_blocks

# At most so many labelled documents are used to fit the lexicon, the trees and the calibration.
SAMPLE = 20_000
LEXICON = 600
STEMS = (4, 5, 6)
NEAR = 5

# Words that address the reader in four languages.
SECOND_PERSON = (
    "you", "your", "yours", "you're", "u", "ur",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre",
    "tú", "ti", "tus", "usted", "ustedes", "vosotros", "eres",
)
# Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_APART = ~_LETTER
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_PLAIN = LOWERED.copy()
for _sign, _letter in LOOKALIKES.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_DROPPED = np.zeros(256, bool)
_DROPPED[[ord(c) for c in "*._-'"]] = True
_PLAIN_APART = _APART.copy()
_PLAIN_APART[[ord(c) for c in LOOKALIKES]] = False

FEATURES = (
    "lexicon density", "lexicon hits", "strongest hit", "weight density", "obfuscated rate",
    "hits near second person", "second person density", "capitals", "words in capitals", "exclamation rate",
    "punctuation rate", "digit rate", "odd words", "words",
)


def word_hashes(words: list[str]) -> np.ndarray:
    """Return the hashes that the words have in a text."""
    data = [word.encode() for word in words]
    ends = np.cumsum([len(word) for word in data], dtype=np.int64)
    starts = ends - np.array([len(word) for word in data], np.int64)
    return span_hashes(np.frombuffer(b"".join(data), np.uint8), starts, ends)


@dataclass
class Lexicon:
    """Sorted hashes of words and of word beginnings of a given byte length, with log-odds."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, terms: list[tuple[str, int, float]]) -> Lexicon:
        """Build from (term, length or 0 for whole words, log-odds)."""
        made = cls()
        for length in sorted({length for _, length, _ in terms}):
            own = [(term, weight) for term, size, weight in terms if size == length]
            keys = word_hashes([term for term, _ in own])
            order = np.argsort(keys)
            made.tables[length] = keys[order], np.array([weight for _, weight in own])[order]
        return made

    def weights(self, block: Block, data: np.ndarray) -> np.ndarray:
        """Return the largest log-odds of each word of a block, 0 without a hit."""
        best = np.zeros(len(block.starts))
        for length, (keys, values) in self.tables.items():
            ends = block.ends if not length else np.minimum(block.ends, block.starts + length)
            found = span_hashes(data, block.starts, ends)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = keys[at] == found
            if length:
                hit &= block.ends - block.starts >= length
            best = np.where(hit, np.maximum(best, values[at]), best)
        return best


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _normalised(block: Block) -> Block:
    """Return the texts with lookalikes as letters and joining signs removed."""
    keep = ~_DROPPED[block.data]
    data = np.where(_PLAIN_APART[block.data], np.uint8(0x20), _PLAIN[block.data])[keep]
    offsets = np.concatenate([[0], np.cumsum(keep)])[block.offsets]
    made = Block(block.first, data, offsets)
    made.find_words()
    return made


def features(block: Block, lexicon: Lexicon) -> np.ndarray:
    """Return one row of ``FEATURES`` per text; a text without words has zeros."""
    low = LOWERED[block.data]
    block.find_words(_APART)
    bounds = block.bounds
    hashes = span_hashes(low, block.starts, block.ends)
    weights = lexicon.weights(block, low)
    hit = weights > 0
    persons = np.isin(hashes, word_hashes(list(SECOND_PERSON)))
    owner = np.repeat(np.arange(block.count), np.diff(bounds))
    at = np.flatnonzero(persons)
    places = np.flatnonzero(hit)
    near = np.zeros(len(hit), bool)
    if len(at):
        after = np.minimum(np.searchsorted(at, places), len(at) - 1)
        for side in (after, np.maximum(after - 1, 0)):
            near[places] |= (np.abs(at[side] - places) <= NEAR) & (owner[at[side]] == owner[places])
    strongest = np.zeros(block.count)
    np.maximum.at(strongest, owner[places], weights[places])
    words = np.maximum(np.diff(bounds), 1)
    hits = _per_text(hit, bounds)
    plain = _normalised(block)
    hidden = lexicon.weights(plain, plain.data) > 0
    hidden_hits = np.maximum(_per_text(hidden, plain.bounds) - hits, 0)
    chars = np.maximum(np.diff(block.offsets), 1)
    upper = (block.data >= 0x41) & (block.data <= 0x5A)
    letters = np.maximum(_per_text(_LETTER[block.data], block.offsets), 1)
    ups = np.concatenate([[0], np.cumsum(upper)])
    long = block.ends - block.starts
    shouted = (ups[block.ends] - ups[block.starts] == long) & (long > 1)
    digit = (block.data >= 0x30) & (block.data <= 0x39)
    mark = _PUNCTUATION[block.data]
    inner = np.zeros(len(mark), bool)
    inner[1:-1] = (mark | digit)[1:-1] & _LETTER[block.data[:-2]] & _LETTER[block.data[2:]]
    return np.column_stack([
        hits / words, np.log1p(hits), strongest, _per_text(weights, bounds) / words,
        hidden_hits / words, _per_text(near, bounds) / words, _per_text(persons, bounds) / words,
        _per_text(upper, block.offsets) / letters, _per_text(shouted, bounds) / words,
        _per_text(block.data == 0x21, block.offsets) / chars, _per_text(mark, block.offsets) / chars,
        _per_text(digit, block.offsets) / chars, _per_text(inner, block.offsets) / words, np.log1p(np.diff(bounds)),
    ])


@dataclass
class ToxicityModel:
    """A fitted model; small enough to go along with every task."""

    lexicon: Lexicon
    start: float
    trees: list[Tree]
    ends: np.ndarray
    heights: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Return the uncalibrated log-odds of rows of features."""
        return self.start + sum((tree.predict(rows) for tree in self.trees), np.zeros(len(rows)))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Return chances; inside a step the order of the raw scores is kept by a small tilt."""
        step = np.minimum(np.searchsorted(self.ends, raw), len(self.ends) - 1)
        tilt = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.clip(0.98 * self.heights[step] + 0.02 * tilt, 0.0, 1.0)

    def score(self, text: Column) -> Column:
        """Return the chance that a text is toxic; null counts as empty."""
        model = self

        @F.arrow_udf("double")
        def chance(column: pa.Array) -> pa.Array:
            parts = [model.calibrated(model.raw(features(block, model.lexicon))) for block in text_blocks(column)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        return chance(text)


def learn_lexicon(rows: DataFrame, *, size: int = LEXICON, least: int = 5) -> list[tuple[str, int, float]]:
    """Return the words and word beginnings that speak most for toxicity in labelled rows.

    Evidence is counted in documents, with log-odds shrunk by a standard
    deviation, so that rare chance words stay out.
    """
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))))
    tokens = rows.select("label", token.alias("token"), F.monotonically_increasing_id().alias("row"))
    forms = [F.struct(F.col("token").alias("term"), F.lit(0).alias("length"))]
    for length in STEMS:
        start = F.substring("token", 1, length)
        forms.append(F.struct(start.alias("term"), F.octet_length(start).alias("length")))
    each = tokens.select("label", "row", F.inline(F.array(*forms)))
    counted = each.groupBy("term", "length").agg(
        F.sum("label").cast("double").alias("bad"), F.sum(1 - F.col("label")).cast("double").alias("good")
    )
    totals = rows.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    bad, good = float(totals["bad"] or 0), float(totals["good"] or 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    shrunk = odds - 2.0 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    strong = counted.filter(F.col("bad") >= least).withColumn("odds", odds).withColumn("shrunk", shrunk)
    best = strong.filter("shrunk > 0").orderBy(F.desc("shrunk"), "term", "length").limit(size).collect()
    return [(row["term"], row["length"], row["odds"]) for row in best]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows: half for the lexicon, the rest for trees and calibration.

    ``labels`` holds only rows that may be learned from. Below 2,000 rows
    there are too few for separate parts: trees and calibration then use all
    of them. Labels of one kind only give all documents the same chance.
    """
    prepared(docs)
    rows = training_rows(docs, labels, "toxic", sample).checkpoint()
    lexicon = Lexicon.of(learn_lexicon(rows.filter("part < 5")))

    @F.arrow_udf("array<double>")
    def measured(column: pa.Array) -> pa.Array:
        parts = [features(block, lexicon) for block in text_blocks(column)]
        values = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.array(list(values), pa.list_(pa.float64()))

    # At most ``sample`` rows of a few numbers.
    seen = rows.select("label", "part", measured("text").alias("values")).collect()
    values = np.array([row["values"] for row in seen]).reshape(len(seen), len(FEATURES))
    truth = np.array([row["label"] for row in seen], float)
    part = np.array([row["part"] for row in seen], int)
    order = np.lexsort((*values.T, truth, part))  # the same trees whatever the order of arrival
    values, truth, part = values[order], truth[order], part[order]
    if len(set(truth.tolist())) < 2:
        return ToxicityModel(lexicon, 0.0, [], np.zeros(1), np.array([(truth.sum() + 0.1) / (len(truth) + 0.2)]))
    fold = part >= 5 if len(truth) >= 2000 else np.ones(len(truth), bool)
    start, trees = grow(values[fold & (part % 3 != 0)], truth[fold & (part % 3 != 0)], rounds=60, depth=3, rate=0.2)
    model = ToxicityModel(lexicon, start, trees, np.zeros(1), np.zeros(1))
    rest = fold & (part % 3 == 0) if len(truth) >= 2000 else fold
    model.ends, model.heights = isotonic(model.raw(values[rest]), truth[rest])
    return model


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``toxicity``, the chance that the whole text is toxic, to every document.

    The column replaces one of the same name. Null and empty texts get the
    score of a text without words; equal texts get equal scores; an empty
    table gives an empty one.
    """
    prepared(docs)
    return docs.withColumn("toxicity", model.score(F.col("text").cast("string")))
