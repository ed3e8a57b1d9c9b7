"""Quality: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.labelled import training_rows
from geoquarry.llm.text_arrays import Block, mixed, shingle_hashes, span_hashes, text_blocks

# At most so many labelled documents are used to fit the model.
SAMPLE = 20_000
# Share of each class covariance that is replaced by the pooled one and by its diagonal.
TO_POOLED = 0.1
TO_DIAGONAL = 0.1
RATE = 1e-3

_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True
_KINDS = {
    "capitals": [*range(0x41, 0x5B)],
    "digits": [*range(0x30, 0x3A)],
    "sentence ends": [ord(c) for c in ".?"],
    "shouts": [ord("!")],
    "commas": [ord(c) for c in ",;:"],
    "bars": [ord("|")],
    "symbols": [ord(c) for c in "*#%$&@^~=+<>_/\\{}[]"],
    "breaks": [0x0A],
    "wide": [*range(0x80, 0x100)],
}
_TABLES = {name: np.isin(np.arange(256), values) for name, values in _KINDS.items()}
FEATURES = (
    "words", "word bytes", "spread of word bytes", "long words", "short words", "odd word ends", "different words",
    "different triples", "line words", "different lines", *_KINDS,
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _different(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Return the share of different values in each text."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    _, first = np.unique(hashes + mixed(owner + np.uint64(1)), return_index=True)
    return np.bincount(owner[first].astype(np.int64), minlength=len(counts)) / np.maximum(counts, 1)


def statistics(block: Block) -> np.ndarray:
    """Return transformed statistics, one row of ``FEATURES`` per text; all finite, also for empty texts."""
    block.find_words()
    bounds, sizes = block.bounds, (block.ends - block.starts).astype(np.float64)
    count = np.diff(bounds)
    words = np.maximum(count, 1)
    mean = _sums(sizes, bounds) / words
    variance = np.maximum(_sums(sizes * sizes, bounds) / words - mean * mean, 0)
    last = block.data[block.ends - 1] if len(block.ends) else np.zeros(0, np.uint8)
    odd = _TABLES["symbols"][last] | _TABLES["shouts"][last] | _TABLES["bars"][last]
    hashes = block.hashes(low=True)
    triples, triple_bounds = shingle_hashes(hashes, bounds, 3)
    line = Block(block.first, block.data, block.offsets)
    line.find_words(_LINE)
    lines = np.maximum(np.diff(line.bounds), 1)
    chars = np.maximum(np.diff(block.offsets), 1)
    rates = [np.log(_sums(table[block.data], block.offsets) / chars + RATE) for table in _TABLES.values()]
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(np.sqrt(variance)),
        np.log(_sums(sizes > 12, bounds) / words + 10 * RATE), np.log(_sums(sizes <= 3, bounds) / words + 10 * RATE),
        np.log(_sums(odd, bounds) / words + RATE),
        _different(hashes, bounds), _different(triples, triple_bounds), np.log1p(count / lines),
        _different(span_hashes(line.data, line.starts, line.ends), line.bounds), *rates,
    ])


@dataclass
class QuadraticModel:
    """Two Gaussian classes: means, Cholesky factors and log-determinants, and the calibration of their difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Return the log-density of class 1 over class 0, compressed without changing its order."""
        scaled = (rows - self.centre) / self.scale
        density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            solved = np.linalg.solve(factor, (scaled - mean).T)
            density.append(constant - 0.5 * (solved * solved).sum(axis=0))
        raw = density[1] - density[0]
        return np.sign(raw) * np.log1p(np.abs(raw))

    def chance(self, rows: np.ndarray) -> np.ndarray:
        """Return the calibrated chance of class 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(rows) + self.shift, -40, 40)))

    def score(self, text: Column) -> Column:
        """Return the chance that a text is of good quality; null counts as empty."""
        model = self

        @F.arrow_udf("double")
        def chance(column: pa.Array) -> pa.Array:
            parts = [model.chance(statistics(block)) for block in text_blocks(column)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        return chance(text)


def discriminant(rows: np.ndarray, truth: np.ndarray) -> QuadraticModel:
    """Fit class means and shrunk covariances, and cache their Cholesky factors."""
    size = rows.shape[1]
    centre = rows.mean(axis=0) if len(rows) else np.zeros(size)
    scale = np.maximum(rows.std(axis=0), 1e-3) if len(rows) else np.ones(size)
    scaled = (rows - centre) / scale
    groups = [scaled[truth == label] for label in (0, 1)]
    own = [np.cov(group.T, bias=True) if len(group) > 1 else np.eye(size) for group in groups]
    weights = np.array([len(group) + 1.0 for group in groups])
    pooled = sum(weight * part for weight, part in zip(weights, own, strict=True)) / weights.sum()
    means, factors, constants = [], [], []
    for group, part, weight in zip(groups, own, weights, strict=True):
        # Few rows say little about a full matrix, so small classes lean more on the pooled one.
        lean = min(1.0, TO_POOLED + size / (size + weight))
        shrunk = (1 - lean) * part + lean * pooled
        shrunk = (1 - TO_DIAGONAL) * shrunk + TO_DIAGONAL * np.diag(np.diag(shrunk)) + 1e-3 * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        means.append(group.mean(axis=0) if len(group) else np.zeros(size))
        factors.append(factor)
        constants.append(np.log(weight / weights.sum()) - np.log(np.diag(factor)).sum())
    return QuadraticModel(centre, scale, np.array(means), np.array(factors), np.array(constants))


def calibrate(model: QuadraticModel, rows: np.ndarray, truth: np.ndarray) -> None:
    """Fit the logistic slope and shift by Newton steps, slightly drawn to slope 1."""
    value = model.difference(rows)
    design = np.column_stack([value, np.ones(len(value))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        slope = design.T @ (truth - chance) - 0.1 * (theta - [1.0, 0.0])
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, slope), -1.0, 1.0)
    model.slope, model.shift = max(float(theta[0]), 0.05), float(theta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> QuadraticModel:
    """Fit on at most ``sample`` labelled rows.

    ``labels`` holds only rows that may be learned from. A class without
    rows gets the centre of all and a pooled covariance.
    """
    prepared(docs)

    @F.arrow_udf("array<double>")
    def measured(column: pa.Array) -> pa.Array:
        parts = [statistics(block) for block in text_blocks(column)]
        values = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.array(list(values), pa.list_(pa.float64()))

    rows = training_rows(docs, labels, "quality", sample)
    # At most ``sample`` rows of a few numbers.
    seen = rows.select("label", measured("text").alias("values")).collect()
    values = np.array([row["values"] for row in seen]).reshape(len(seen), len(FEATURES))
    truth = np.array([row["label"] for row in seen], int)
    order = np.lexsort((*values.T, truth))  # the same sums whatever the order of arrival
    values, truth = values[order], truth[order]
    model = discriminant(values, truth)
    calibrate(model, values, truth)
    return model


def quality(docs: DataFrame, model: QuadraticModel) -> DataFrame:
    """Add ``quality_score``, the chance of good quality of the whole text, to every document.

    The column replaces one of the same name. Null and empty texts get the
    score of a text without words; equal texts get equal scores; an empty
    table gives an empty one.
    """
    prepared(docs)
    return docs.withColumn("quality_score", model.score(F.col("text").cast("string")))
