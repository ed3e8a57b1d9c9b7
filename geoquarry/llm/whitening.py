"""Whitening of embeddings from exact integer cross-products over bit planes.

Entries become integers. Each dimension is shifted to begin at zero and cut
into bit planes; a plane is packed over the rows of a block into 64-bit
words. The cross-product of two dimensions is the sum, over pairs of their
planes, of the population count of the AND, weighted by the planes' powers
of two. Counts are exact and add up over blocks and tasks in any order, so
sums are centred as integers, and only the centred matrix becomes doubles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.session import scratch_path

SCALE = 256
COMPONENTS = 4
# Rows whose planes are held at once, and values that are.
BLOCK_ROWS = 1 << 15
BLOCK_BITS = 1 << 27
# Entries beyond this are taken as this: a long holds no more.
FARTHEST = float(2**62)


@dataclass(frozen=True)
class Whitening:
    """What the fit list of one table gives: exact moments, axes and their shares."""

    n: int
    sums: list[int]
    lows: np.ndarray
    highs: np.ndarray
    axes: np.ndarray  # a column per component
    values: np.ndarray  # eigenvalues, falling
    trace: float


def width_of(vectors: DataFrame) -> int:
    """Return the length that most vectors have, the larger one of equal counts; 0 without any."""
    sizes = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def whole_entries(vectors: DataFrame, width: int) -> DataFrame:
    """Return ``vec_id, x`` of the rows that hold ``width`` finite entries; ``x`` has ``floor(256 * c)``."""
    entries = F.col("embedding").cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), F.lit(FARTHEST)), F.lit(-FARTHEST))).cast("bigint"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") == width) & fine
    return vectors.filter(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.values if isinstance(column, pa.ListArray) else column.combine_chunks().values
    start = column.offsets[0].as_py() if len(column) else 0
    return values.to_numpy()[start : start + len(column) * width].reshape(-1, width)


def _limits(distinct: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Return the rows and each dimension's smallest and largest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, low, high = 0, np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for batch in batches:
            if batch.num_rows:
                block = _matrix(batch.column(0), width)
                rows, low, high = rows + len(block), np.minimum(low, block.min(axis=0)), np.maximum(high, block.max(axis=0))
        if rows:
            columns = [np.arange(width, dtype=np.int32), np.full(width, rows), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(values) for values in columns], ["dim", "n", "low", "high"])

    parts = distinct.mapInArrow(run, "dim int, n bigint, low bigint, high bigint")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    if not found:
        return 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
    return found[0]["n"], np.array([row["low"] for row in found]), np.array([row["high"] for row in found])


def bit_planes(block: np.ndarray, lows: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Return each dimension's planes, the lowest bit first, packed over the rows into 64-bit words."""
    shifted = block.view(np.uint64) - lows.view(np.uint64)
    room = -len(block) % 64
    planes = []
    for dim, count in enumerate(bits):
        places = np.arange(count, dtype=np.uint64)
        flags = ((shifted[:, dim] >> places[:, None]) & np.uint64(1)).astype(np.uint8)
        planes.append(np.packbits(np.pad(flags, ((0, 0), (0, room))), axis=1).view(np.uint64))
    return planes


def plane_counts(planes: list[np.ndarray], deepest: int) -> np.ndarray:
    """Return counts ``[j, k, s]`` for j <= k: over planes p of j and q of k with p + q = s, the rows that have both bits."""
    width = len(planes)
    stacked = np.concatenate(planes)
    sizes = [len(own) for own in planes]
    begins = np.cumsum([0, *sizes])
    owner = np.repeat(np.arange(width), sizes)
    level = np.arange(len(owner)) - begins[owner]
    counts = np.zeros((width, width, 2 * deepest), np.int64)
    for dim, own in enumerate(planes):
        later = slice(begins[dim], None)
        for number, plane in enumerate(own):
            both = np.bitwise_count(stacked[later] & plane).sum(axis=1, dtype=np.int64)
            np.add.at(counts[dim], (owner[later], level[later] + number), both)
    return counts


def _scatter(distinct: DataFrame, lows: np.ndarray, highs: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Return the exact sums and cross-products of the shifted dimensions.

    A task sends one compressed slice a dimension; slices are added by
    dimension, so what reaches the driver depends on the width alone.
    """
    width = len(lows)
    bits = np.array([(int(high) - int(low)).bit_length() for low, high in zip(lows, highs, strict=True)])
    deepest = max(int(bits.max()), 1)
    rows_at_once = int(max(64, min(BLOCK_ROWS, BLOCK_BITS // max(int(bits.sum()), 1))))
    fields = "dim int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, any_ = np.zeros((width, width, 2 * deepest), np.int64), np.zeros((width, deepest), np.int64), False
        for batch in batches:
            block = _matrix(batch.column(0), width)
            for start in range(0, len(block), rows_at_once):
                planes = bit_planes(np.ascontiguousarray(block[start : start + rows_at_once]), lows, bits)
                products += plane_counts(planes, deepest)
                for dim, own in enumerate(planes):
                    sums[dim, : len(own)] += np.bitwise_count(own).sum(axis=1, dtype=np.int64)
                any_ = True
        if any_:
            bodies = [zlib.compress(np.concatenate([sums[dim], products[dim].ravel()]).tobytes(), 1) for dim in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(bodies, pa.binary())], ["dim", "body"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(zlib.decompress(body.as_py()), np.int64)
                totals[dim] = totals[dim] + values if dim in totals else values
        bodies = [values.tobytes() for values in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(bodies, pa.binary())], ["dim", "body"])

    parts = distinct.mapInArrow(run, fields).repartition(width, "dim").mapInArrow(added, fields).collect()
    sums, products = [0] * width, [[0] * width for _ in range(width)]
    for part in parts:
        values = np.frombuffer(part["body"], np.int64)
        dim = part["dim"]
        sums[dim] = sum(int(count) << place for place, count in enumerate(values[:deepest]))
        for other, counts in enumerate(values[deepest:].reshape(width, 2 * deepest)):
            if other >= dim:
                products[dim][other] = products[other][dim] = sum(int(count) << place for place, count in enumerate(counts) if count)
    return sums, products


def fit(distinct: DataFrame, width: int) -> Whitening:
    """Fit the whitening on rows of one distinct integer vector ``x`` each."""
    n, lows, highs = _limits(distinct, width)
    sums, products = _scatter(distinct, lows, highs) if n else ([0] * width, [[0] * width for _ in range(width)])
    # Shifting leaves the covariance as it is; n * n times it is an integer.
    centred = [[n * products[j][k] - sums[j] * sums[k] for k in range(width)] for j in range(width)]
    square = max(n * n, 1)
    covariance = np.array([[value / square for value in row] for row in centred])
    values, axes = np.linalg.eigh(covariance)
    trace = sum(centred[j][j] for j in range(width)) / square
    whole = [total + n * int(low) for total, low in zip(sums, lows, strict=True)]
    return Whitening(n, whole, lows, highs, axes[:, ::-1].copy(), values[::-1].copy(), trace)


def _deviations(block: np.ndarray, model: Whitening) -> list[int | None]:
    """Return the sum over dimensions of ``(n * x - S) ** 2``; null where a long can not hold it."""
    worst = max(max(model.n * int(high) - total, total - model.n * int(low)) for low, high, total in zip(model.lows, model.highs, model.sums, strict=True))
    if worst * worst * len(model.sums) < 1 << 62:
        return ((model.n * block - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((model.n * int(x) - total) ** 2 for x, total in zip(row, model.sums, strict=True)) for row in block]
    return [value if value < 1 << 63 else None for value in exact]


def _projector(model: Whitening, count: int):
    """Return what turns integer vectors into whitened components; components without spread give NaN."""
    means = np.array([total / model.n for total in model.sums])
    floor = len(means) * np.finfo(float).eps * max(float(model.values[0]), 0.0)
    spread = model.values[:count]
    usable = spread > floor
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, spread, 1.0)), np.nan)

    def project(block: np.ndarray) -> np.ndarray:
        return (block - means) @ model.axes[:, :count] * scale

    return project, usable


def _identity_error(distinct: DataFrame, model: Whitening, count: int) -> float | None:
    """Return how far the covariance of the whitened fit list is from the identity, over components with spread."""
    project, usable = _projector(model, count)
    kept = [at for at in range(count) if usable[at]]
    if not kept:
        return None
    width = len(model.sums)
    names = [f"z{at}" for at in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = project(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(made[:, at]) for at in kept], names)

    rows = distinct.mapInArrow(run, ", ".join(f"{name} double" for name in names))
    pairs = [(one, two) for at, one in enumerate(names) for two in names[at:]]
    row = rows.agg(*(F.covar_pop(one, two) for one, two in pairs)).first()
    return max(abs(value - (1.0 if one == two else 0.0)) for value, (one, two) in zip(row, pairs, strict=True))


def whitened(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """Whiten vectors: one row per vector and component.

    ``vectors`` has ``vec_id, embedding``. Rows whose vector is null, holds
    null or non-finite entries, or has another length than most vectors of
    the table (the larger length of equal counts) are left out; an empty
    vector is as none. Repeated vectors count once in the fit, and each row
    is returned. Entries beyond 2**62 / 256 count as that. Null ids stay null. Further columns are
    ignored. A table without vectors gives no rows.

    Returns ``vec_id, component, n, deviation, whitened, explained,
    identity_error``, as numbered by falling eigenvalue. ``deviation`` is
    null where a long can not hold it. A component without spread (an
    eigenvalue of 0 within rounding) has null for ``whitened``, and
    ``identity_error`` is about the others; without any it is null.
    """
    spark = prepared(vectors)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    width = width_of(vectors)
    if not width:
        return spark.createDataFrame([], schema)
    rows = whole_entries(vectors, width)
    path = scratch_path(spark, "fit-list")
    rows.select("x").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    model = fit(distinct, width)
    if not model.n:
        return spark.createDataFrame([], schema)
    count = min(components, width)
    error = _identity_error(distinct, model, count)
    project, _ = _projector(model, count)
    shares = [float(value) / model.trace if model.trace > 0 else 0.0 for value in np.maximum(model.values[:count], 0.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _matrix(batch.column(1), width)
            size = len(block)
            flat = project(block).ravel()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(size), count)))
            far = pa.array(_deviations(block, model), pa.int64()).take(pa.array(np.repeat(np.arange(size), count)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, model.n)),
                    far,
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(np.array(shares), size)),
                    pa.array([error] * (size * count), pa.float64()),
                ],
                schema.replace(",", "").split()[::2],
            )

    return rows.mapInArrow(run, schema)
