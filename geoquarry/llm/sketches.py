"""Tables of fixed size that tasks fill from all rows and that are added up slice by slice."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoquarry.llm.text_arrays import Block, text_blocks

SKETCH_BITS = 21
SLICES = 16
FILTER_BITS = 26


def _collected(rows: DataFrame, fill: Callable, join: Callable, shrink: Callable, size: int, kind: type) -> np.ndarray:
    """Fill one table per task, join the tables of all tasks slice by slice, and collect the shrunk slices."""
    width = size // SLICES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, kind)
        for batch in batches:
            fill(table, batch)
        if table.any():
            parts = [zlib.compress(table[at * width : (at + 1) * width].tobytes(), 1) for at in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "body"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for slice_, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(zlib.decompress(body.as_py()), kind)
                tables[slice_] = join(tables[slice_], values) if slice_ in tables else values
        bodies = [shrink(values).tobytes() for values in tables.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array(bodies, pa.binary())], ["slice", "body"])

    fields = "slice int, body binary"
    parts = rows.mapInArrow(partial, fields).repartition(SLICES, "slice").mapInArrow(joined, fields).collect()
    whole = shrink(np.zeros(size, kind))
    for part in parts:
        whole[part["slice"] * width : (part["slice"] + 1) * width] = np.frombuffer(part["body"], whole.dtype)
    return whole


def frequency_slots(hashes: np.ndarray) -> np.ndarray:
    """Return the slot of each 64-bit hash in a table of frequencies."""
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_levels(texts: DataFrame, hashes_of: Callable[[Block], np.ndarray]) -> np.ndarray:
    """Count the hashes of all whole texts in 2**21 slots and return eight steps per doubling, 2 MB whatever the data."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for block in text_blocks(batch.column(0)):
            table += np.bincount(frequency_slots(hashes_of(block)), minlength=len(table))

    def shrink(values: np.ndarray) -> np.ndarray:
        return np.minimum(8 * np.log2(values + 1.0), 255).astype(np.uint8)

    return _collected(texts.select("text"), fill, np.add, shrink, 1 << SKETCH_BITS, np.int64)


def bitmap(values: DataFrame) -> np.ndarray:
    """Return 2**26 bits in which the one long column's values are marked: 8 MB whatever the data.

    Marked does not prove presence, but an unmarked value is absent. With
    more values than bits everything is marked and the filter lets all pass.
    """

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        slot = bit_slots(keys)
        np.bitwise_or.at(table, slot >> 3, (1 << (slot & 7)).astype(np.uint8))

    def same(table: np.ndarray) -> np.ndarray:
        return table.copy()

    return _collected(values, fill, np.bitwise_or, same, 1 << (FILTER_BITS - 3), np.uint8)


def bit_slots(keys: np.ndarray) -> np.ndarray:
    """Return the bit that stands for each 64-bit key."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Return which keys are marked in a bitmap."""
    slot = bit_slots(keys)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
