"""Vector-tile archives as tables: headers with metadata, and every directory entry.

The root directory of an archive is read in one task. Its leaf directories
become rows of their own and are spread over all tasks, so one very large
archive is read as widely as many small ones.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.operators.ranking import running_sums
from geoquarry.session import ensure_checkpoints

# The layout of the archive header, version 3.
HEADER_LENGTH = 127
MAGIC = b"PMTiles"
FIRST_READ = 16384
# Headers that a task holds at once; their metadata may be long.
HEADER_ROWS = 64
TILE_TYPES = ("unknown", "mvt", "png", "jpeg", "webp", "avif", "mlt")
COMPRESSIONS = ("unknown", "none", "gzip", "brotli", "zstd")

HEADERS = (
    "archive string, tile_type string, tile_compression string, internal_compression string, "
    "min_zoom int, max_zoom int, west double, south double, east double, north double, "
    "data_offset bigint, metadata string, vector_layers array<string>, error string"
)
ENTRIES = (
    "archive string, tile_id bigint, run_length bigint, offset bigint, length bigint, "
    "leaf_start bigint, compression string"
)


def parse_header(data: bytes) -> dict:
    """Read the fixed header.

    Raises:
        ValueError: The bytes do not start with a version 3 header.
    """
    if len(data) < HEADER_LENGTH or data[:7] != MAGIC:
        raise ValueError("Not a tile archive")
    if data[7] != 3:
        raise ValueError(f"Tile archive version {data[7]} is not supported; version 3 is")
    offsets = struct.unpack("<8Q", data[8:72])
    codes = struct.unpack("<6B", data[96:102])
    sides = [value / 1e7 for value in struct.unpack("<4i", data[102:118])]
    names = ("root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length")

    def named(names: tuple[str, ...], code: int) -> str:
        return names[code] if code < len(names) else "unknown"

    return {
        **dict(zip(names, offsets, strict=True)),
        "internal_compression": named(COMPRESSIONS, codes[1]),
        "tile_compression": named(COMPRESSIONS, codes[2]),
        "tile_type": named(TILE_TYPES, codes[3]),
        "min_zoom": codes[4],
        "max_zoom": codes[5],
        "bounds": sides,
    }


def inflate(data: bytes, compression: str) -> bytes:
    """Undo the compression of a directory or of the metadata."""
    if compression == "gzip":
        return gzip.decompress(data)
    if compression in ("none", "unknown"):
        return data
    raise ValueError(f"{compression} compression is not supported")


def numbers_of(data: bytes) -> np.ndarray:
    """Decode a run of variable-length numbers at once."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    raw = raw[: ends[-1] + 1] if len(ends) else raw[:0]
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << shift, starts)


def directory(data: bytes) -> np.ndarray:
    """Decode a directory into rows of tile id, run length, offset and length.

    Ids are running sums. An offset of 0 continues behind the entry before it.
    """
    numbers = numbers_of(data)
    count = int(numbers[0]) if len(numbers) else 0
    if len(numbers) < 1 + 4 * count or not len(numbers):
        raise ValueError("Truncated directory")
    deltas, runs, lengths, marks = numbers[1 : 1 + 4 * count].reshape(4, count)
    fixed = marks > 0
    if count:
        fixed[0] = True
    anchor = np.maximum.accumulate(np.where(fixed, np.arange(count), 0))
    before = np.cumsum(lengths) - lengths
    offsets = (marks - 1)[anchor] + before - before[anchor]
    return np.column_stack([np.cumsum(deltas), runs, offsets, lengths])


def read_headers(archives: DataFrame) -> DataFrame:
    """Return one header row per path in ``archives.archive``; an unreadable one has ``error``."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from geoquarry.sources.object_store import open_input

        schema = _arrow_schema(HEADERS)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                if len(rows) == HEADER_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
                row: dict = dict.fromkeys(schema.names)
                row["archive"] = path
                try:
                    with open_input(path) as handle:
                        first = handle.read(FIRST_READ)
                        head = parse_header(first)
                        metadata = _part(handle, first, head["metadata_offset"], head["metadata_length"])
                    text = inflate(metadata, head["internal_compression"]).decode() if metadata else "{}"
                    value = json.loads(text)
                    layers = value.get("vector_layers") if isinstance(value, dict) else None
                    row |= {name: head[name] for name in ("tile_type", "tile_compression", "internal_compression", "min_zoom", "max_zoom", "data_offset")}
                    row |= dict(zip(("west", "south", "east", "north"), head["bounds"], strict=True))
                    row["metadata"] = text if isinstance(value, dict) else "{}"
                    row["vector_layers"] = [str(layer["id"]) for layer in layers or [] if isinstance(layer, dict) and "id" in layer]
                except (OSError, ValueError) as error:
                    row["error"] = str(error)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("archive").mapInArrow(headers, HEADERS)


def _arrow_schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in text.split(", "))])


def _part(handle, first: bytes, offset: int, length: int) -> bytes:
    if offset + length <= len(first):
        return first[offset : offset + length]
    handle.seek(offset)
    return handle.read(length)


def _rows(path: str, found: np.ndarray, leaf_start: int, compression: str) -> pa.RecordBatch:
    size = len(found)
    columns = [pa.array([path] * size, pa.string())]
    columns += [pa.array(found[:, column], pa.int64()) for column in range(4)]
    columns += [pa.array(np.full(size, leaf_start)), pa.array([compression] * size, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_arrow_schema(ENTRIES))


def read_entries(archives: DataFrame) -> DataFrame:
    """Return every tile entry below the paths in ``archives.archive``, leaves expanded to any depth.

    Columns ``archive, tile_id, run_length, offset, length``. Each level is
    written once; a directory that was read before, as in an archive that
    points back to itself, is not read again.
    """
    ensure_checkpoints(archives.sparkSession)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from geoquarry.sources.object_store import open_input

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as handle:
                    first = handle.read(FIRST_READ)
                    head = parse_header(first)
                    raw = _part(handle, first, head["root_offset"], head["root_length"])
                found = directory(inflate(raw, head["internal_compression"]))
                yield _rows(path, found, head["leaf_offset"], head["internal_compression"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from geoquarry.sources.object_store import open_input

        for batch in batches:
            for archive, offset, length, leaf_start, compression in zip(*(batch.column(name) for name in ("archive", "offset", "length", "leaf_start", "compression")), strict=True):
                path, start, codec = archive.as_py(), leaf_start.as_py(), compression.as_py()
                with open_input(path) as handle:
                    handle.seek(start + offset.as_py())
                    raw = handle.read(length.as_py())
                yield _rows(path, directory(inflate(raw, codec)), start, codec)

    level = archives.select("archive").mapInArrow(roots, ENTRIES).checkpoint()
    every = level.where("run_length > 0")
    seen: DataFrame | None = None
    while True:
        pointers = level.where("run_length = 0")
        if seen is not None:
            pointers = pointers.join(seen, ["archive", "offset"], "left_anti")
        if pointers.isEmpty():
            break
        level = pointers.select(*level.columns).repartition("archive", "offset").mapInArrow(leaves, ENTRIES).checkpoint()
        places = pointers.select("archive", "offset")
        seen = places if seen is None else seen.unionByName(places)
        every = every.unionByName(level.where("run_length > 0"))
    return every.select("archive", "tile_id", "run_length", "offset", "length")


def running_offsets(rows: DataFrame) -> DataFrame:
    """Decode directory columns that are still deltas, given as rows.

    ``rows`` holds ``(archive, directory, pos, id_delta, run_length, mark, length)``.
    Ids are running sums. A mark of 0 behind the first row continues where the
    entry before it ends: the entries since the last mark form one stretch,
    and their lengths add up from its start.
    """
    keys = ["archive", "directory"]
    marked = (F.col("mark") > 0) | (F.col("pos") == 0)
    summed = running_sums(
        rows,
        keys,
        "pos",
        {"tile_id": F.col("id_delta"), "_upto": F.col("length"), "_stretch": F.when(marked, 1).otherwise(0)},
    ).withColumn("_before", F.col("_upto") - F.col("length"))
    starts = summed.where(marked).select(
        *keys, "_stretch", (F.col("mark") - 1 - F.col("_before")).alias("_start")
    )
    return summed.join(starts, [*keys, "_stretch"]).select(
        *keys, "pos", "tile_id", "run_length", (F.col("_start") + F.col("_before")).alias("offset"), "length"
    )
