"""Embedding near-dedup: tiles of vectors compared in the order of their principal components.

Vectors are rotated to their principal axes. Two unit vectors of cosine c lie
``sqrt(2 - 2c)`` apart, so vectors are dealt to cells of that width along the
first axes and only neighbouring cells meet, cut into tiles of bounded size.
Inside a pair of tiles the leading axes are multiplied first; the norms of
what is left bound the rest, and pairs stop as soon as they cannot reach the
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.components import components

THRESHOLD = 0.95
TILE = 2048
CELL_AXES = 2
# Axes after which the bound is tested.
STAGES = (8, 24)
STRIDE = 512
SLACK = 1e-9


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), size)


def unit(rows: np.ndarray) -> np.ndarray:
    """Return the rows at length 1; large and small components neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def axes_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Return the principal axes of all unit vectors, largest share first, per number of components.

    Tasks sum outer products; the sums of all tasks are added in one place
    per size, a matrix at a time.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = unit(_matrix(batch.column(0).filter(pa.array(sizes == size)), int(size)))
                sums[int(size)] = sums.get(int(size), 0) + rows.T @ rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([value.tobytes() for value in sums.values()], pa.binary())], ["size", "body"]
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[size] = sums.get(size, 0) + np.frombuffer(body.as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([value.tobytes() for value in sums.values()], pa.binary())], ["size", "body"]
        )

    fields = "size int, body binary"
    parts = vectors.select("vector").mapInArrow(products, fields).repartition("size").mapInArrow(added, fields).collect()
    found = {}
    for part in parts:
        moments = np.frombuffer(part["body"]).reshape(part["size"], part["size"])
        found[part["size"]] = np.linalg.eigh(moments)[1][:, ::-1]
    return found


def _spread(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Return the smallest node that each node reaches, by halving paths."""
    root = np.arange(nodes)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def close_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Return the places of all pairs of rows whose cosine reaches the threshold."""
    size = left.shape[1]
    units = [unit(left), unit(right)]
    turned = [rows @ axes for rows in units]
    tails = []
    for rows in turned:
        rest = np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1]
        tails.append(np.sqrt(np.concatenate([rest, np.zeros((len(rows), 1))], axis=1)))
    first = min(STAGES[0], size)
    # Cauchy-Schwarz: the norms of the other axes as one more axis give the bound.
    heads = [np.column_stack([rows[:, :first], tail[:, first]]) for rows, tail in zip(turned, tails, strict=True)]
    lefts, rights = [], []
    for at in range(0, len(left), STRIDE):
        bound = heads[0][at : at + STRIDE] @ heads[1].T
        flat = np.flatnonzero(bound.reshape(-1) >= threshold - SLACK)
        a, b = flat // len(right) + at, flat % len(right)
        for low in range(0, len(a), 1 << 15):
            x, y = a[low : low + (1 << 15)], b[low : low + (1 << 15)]
            partial = np.einsum("ij,ij->i", turned[0][x, :first], turned[1][y, :first])
            done = first
            for stage in STAGES[1:]:
                if done < stage < size and len(x):
                    partial = partial + np.einsum("ij,ij->i", turned[0][x, done:stage], turned[1][y, done:stage])
                    open_ = partial + tails[0][x, stage] * tails[1][y, stage] >= threshold - SLACK
                    x, y, partial, done = x[open_], y[open_], partial[open_], stage
            cosine = np.einsum("ij,ij->i", units[0][x], units[1][y])
            good = cosine >= threshold
            lefts.append(x[good])
            rights.append(y[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def usable(vector: Column) -> Column:
    """Return whether a vector has a direction: no null, infinite or undefined component, and one that is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(rows: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Return ``vec_id, n_links, component_id, kept`` of every vector in the column ``embedding``.

    Vectors of different length never link; null, zero and not finite ones
    link with nothing. Equal vectors are compared once and count as often as
    they occur. ``component_id`` is the smallest id that links reach; a null
    id is larger than all others and not kept. Repeated rows are vectors of
    their own. An empty table gives an empty one.
    """
    spark = prepared(rows)
    named = rows.select("vec_id", F.col("embedding").alias("vector"))
    named = named.withColumn("v", F.when(usable(F.col("vector")), F.xxhash64("vector")))
    different = (
        named.filter("v IS NOT NULL")
        .groupBy("v", "vector")
        .agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
        .checkpoint()
    )
    axes = axes_of(different)
    shared = spark.sparkContext.broadcast(axes)  # one matrix per vector length
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-6) + 1e-9

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                turned = unit(_matrix(part.column(2), int(size))) @ shared.value[int(size)][:, :CELL_AXES]
                place = np.zeros((len(turned), CELL_AXES), np.int32)
                place[:, : turned.shape[1]] = np.floor(turned / width)
                columns = [*part.columns, pa.array(np.full(len(turned), size, np.int32)), pa.array(place[:, 0]), pa.array(place[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["v", "times", "vector", "size", "x", "y"])

    kind = different.schema["vector"].dataType.simpleString()
    placed = different.select("v", "times", "vector").mapInArrow(
        cells, f"v bigint, times bigint, vector {kind}, size int, x int, y int"
    ).checkpoint()
    held = placed.groupBy("size", "x", "y").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    cell = ["size", "x", "y"]
    tiles = placed.join(held, cell).withColumn("tile", F.pmod(F.xxhash64("v", F.lit(3)), F.col("tiles").cast("bigint")).cast("int"))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    around = held.select("size", "x", "y", "tiles", F.inline(steps))
    around = around.withColumns({"x2": F.col("x") + F.col("dx"), "y2": F.col("y") + F.col("dy")})
    other = held.select("size", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("tiles").alias("tiles2"))
    meeting = around.join(other, ["size", "x2", "y2"])
    meeting = meeting.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    from_ = F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("tile")).otherwise(0)
    meeting = meeting.withColumn("tile2", F.explode(F.sequence(from_, F.col("tiles2") - 1)))
    meeting = meeting.select(*cell, "tile", "x2", "y2", "tile2", F.struct(*cell, "tile", "x2", "y2", "tile2").alias("pair")).checkpoint()
    firsts = tiles.join(meeting.select(*cell, "tile", "pair"), [*cell, "tile"]).select("pair", F.lit(0).alias("side"), "v", "times", "vector")
    seconds = meeting.filter("x <> x2 OR y <> y2 OR tile <> tile2").select(
        "size", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("tile2").alias("tile"), "pair"
    )
    seconds = tiles.join(seconds, [*cell, "tile"]).select("pair", F.lit(1).alias("side"), "v", "times", "vector")

    def compared(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        names, times = table.column("v").to_numpy()[order], table.column("times").to_numpy()[order]
        vectors = table.column("vector").combine_chunks().take(pa.array(order))
        size = len(vectors[0])
        values = _matrix(vectors, size)
        split = int((side == 0).sum())
        if split == len(values):
            left, right = close_pairs(values, values, shared.value[size], threshold)
            apart = left < right
            left, right = left[apart], right[apart]
        else:
            left, right = close_pairs(values[:split], values[split:], shared.value[size], threshold)
            right = right + split
        links = np.bincount(left, times[right], len(values)) + np.bincount(right, times[left], len(values))
        root = _spread(len(values), left, right)
        met = np.flatnonzero(links > 0)
        return pa.table({"v": names[met], "links": links[met].astype(np.int64), "root": names[root[met]]})

    met = firsts.unionByName(seconds).groupBy("pair").applyInArrow(compared, "v bigint, links bigint, root bigint").checkpoint()
    counts = met.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(met.select(F.col("v").alias("a"), F.col("root").alias("b")))
    classes = different.select("v", "times", "least").join(counts, "v", "left").join(joined, "v", "left")
    classes = classes.withColumn("component", F.coalesce("component", "v"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "component").select(
        "v", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    done = named.select("vec_id", "v").join(classes, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
