"""A Spark sink for GeoParquet: each file's footer names CRS, types, box columns and extent.

``df.write.format("geoquarry-parquet")`` takes one target, or many: then rows
carry the number of their target, and a task keeps one file open for each
target that it meets. Tasks write below a hidden folder; the commit moves the
files of successful tasks into place and reports the counts of every target,
an abort removes them. A lost or repeated task leaves nothing visible.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from geoquarry.session import scratch_path, ship_package
from geoquarry.sources.object_store import store_of

FORMAT = "geoquarry-parquet"
# The column that tells the target of a row, where there are several.
TARGET = "_target"
# Rows and bytes that a row group holds at most.
GROUP_ROWS = 100_000
GROUP_BYTES = 128 * 1024 * 1024
# The format's version, and the full definition of the system that nearly all files use; others are named by their code.
VERSION = "1.1.0"
WGS84 = {
    "type": "GeographicCRS", "name": "WGS 84",
    "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984",
              "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}},
    "coordinate_system": {"subtype": "ellipsoidal", "axis": [
        {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
        {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"}]},
    "id": {"authority": "EPSG", "code": 4326},
}


@dataclass(frozen=True)
class Target:
    """One copy: its folder, its columns as ``(column of the rows, name in the file)``, and what its footers say.

    ``geometry`` and ``box`` are names in the file, ``crs`` is an ``AUTHORITY:CODE``, a
    definition as JSON, or empty when it is unknown. Tables have no geometry.
    """

    path: str
    columns: tuple[tuple[str, str], ...]
    geometry: str | None = None
    box: str | None = None
    crs: str = "OGC:CRS84"
    types: tuple[str, ...] = ()

    def footer(self, extent: Sequence[float] | None) -> bytes | None:
        """Return the ``geo`` value of a file that reaches over an extent."""
        if self.geometry is None:
            return None
        about: dict = {"encoding": "WKB", "geometry_types": list(self.types)}
        if self.crs != "OGC:CRS84":  # what readers assume anyway
            about["crs"] = crs_value(self.crs)
        if self.box is not None:
            about["covering"] = {"bbox": {side: [self.box, side] for side in ("xmin", "ymin", "xmax", "ymax")}}
        if extent is not None:
            about["bbox"] = list(extent)
        return json.dumps({"version": VERSION, "primary_column": self.geometry, "columns": {self.geometry: about}}).encode()


def crs_value(name: str) -> dict | None:
    """Return a system's definition for a footer; none for an unknown one."""
    if not name:
        return None
    if name.startswith("{"):
        return json.loads(name)
    if name == "EPSG:4326":
        return WGS84
    authority, _, code = name.rpartition(":")
    return {"name": name, "id": {"authority": authority, "code": int(code) if code.isdigit() else code}}


@dataclass
class _Moved(WriterCommitMessage):
    """Files of a task: target, place below the hidden folder, rows, and rows without geometry."""

    files: list[tuple[int, str, int, int]] = field(default_factory=list)


class _File:
    """One open file; row groups are gathered before they are written."""

    def __init__(self, target: Target, path: str) -> None:
        self.target, self.path = target, path
        self.store, self.inner = store_of(path)
        self.writer = None
        self.held: list[pa.Table] = []
        self.rows = self.empty = self.held_bytes = self.held_rows = 0
        self.extent: list[float] | None = None

    def add(self, rows: pa.Table) -> None:
        rows = rows.select([stored for stored, _ in self.target.columns]).rename_columns([name for _, name in self.target.columns])
        self.rows += rows.num_rows
        if self.target.geometry is not None:
            self.empty += rows.column(self.target.geometry).null_count
        if self.target.box is not None:
            self._stretch(rows.column(self.target.box))
        self.held.append(rows)
        self.held_rows += rows.num_rows
        self.held_bytes += rows.nbytes
        if self.held_rows >= GROUP_ROWS or self.held_bytes >= GROUP_BYTES:
            self._flush()

    def _stretch(self, box: pa.ChunkedArray) -> None:
        sides = dict(zip((kind.name for kind in box.type), box.combine_chunks().flatten(), strict=True)) if len(box) else {}
        found = [how(sides[name]).as_py() for how, name in ((pc.min, "xmin"), (pc.min, "ymin"), (pc.max, "xmax"), (pc.max, "ymax"))] if sides else [None]
        if None in found:
            return
        known = self.extent or found
        self.extent = [min(known[0], found[0]), min(known[1], found[1]), max(known[2], found[2]), max(known[3], found[3])]

    def _flush(self) -> None:
        import pyarrow.parquet as pq

        table = pa.concat_tables(self.held)
        if self.writer is None:
            self.handle = self.store.open_output_stream(self.inner)
            self.writer = pq.ParquetWriter(self.handle, table.schema.remove_metadata(), compression="zstd", store_schema=False)
        self.writer.write_table(table, row_group_size=GROUP_ROWS)
        self.held, self.held_rows, self.held_bytes = [], 0, 0

    def close(self) -> None:
        if self.held or self.writer is None:
            self._flush()
        geo = self.target.footer(self.extent)
        if geo is not None:
            self.writer.add_key_value_metadata({"geo": geo.decode()})
        self.writer.close()
        self.handle.close()

    def drop(self) -> None:
        if self.writer is not None:
            self.handle.close()
            self.store.delete_file(self.inner)


class _Writer(DataSourceArrowWriter):
    def __init__(self, targets: list[Target], schema: pa.Schema, hidden: str, report: str) -> None:
        self.targets, self.schema, self.hidden, self.report = targets, schema, hidden, report

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Moved:
        """Write the rows of one task; the first task's name is as random as any repeated one's."""
        files: dict[int, _File] = {}
        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch])
                if len(self.targets) == 1:
                    parts = {0: rows}
                else:
                    owner = rows.column(TARGET)
                    parts = {number: rows.filter(pc.equal(owner, number)) for number in pc.unique(owner).to_pylist()}
                for number, own in parts.items():
                    if number not in files:
                        files[number] = _File(self.targets[number], f"{self.hidden}/{uuid.uuid4().hex}.parquet")
                    files[number].add(own)
            for file in files.values():
                file.close()
        except BaseException:
            for file in files.values():
                file.drop()
            raise
        return _Moved([(number, file.path, file.rows, file.empty) for number, file in files.items()])

    def commit(self, messages: list[_Moved | None]) -> None:
        """Move all files into place, and tell what each target holds; one without rows gets an empty file."""
        moved = [file for message in messages if message is not None for file in message.files]
        for number in set(range(len(self.targets))) - {file[0] for file in moved}:
            empty = _File(self.targets[number], f"{self.hidden}/{uuid.uuid4().hex}.parquet")
            empty.add(self.schema.empty_table())
            empty.close()
            moved.append((number, empty.path, 0, 0))
        totals = [[0, 0] for _ in self.targets]
        for place, (number, path, rows, empty) in enumerate(moved):
            store, inner = store_of(path)
            folder = store_of(self.targets[number].path)[1]
            store.create_dir(folder, recursive=True)
            store.move(inner, f"{folder}/part-{place:05d}-{inner.rsplit('/', 1)[1]}")
            totals[number][0] += rows
            totals[number][1] += empty
        store, inner = store_of(self.hidden)
        store.delete_dir(inner)
        store, inner = store_of(self.report)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        lines = [json.dumps({"target": number, "features": rows, "refused": empty}) for number, (rows, empty) in enumerate(totals)]
        with store.open_output_stream(inner) as out:
            out.write("\n".join(lines).encode())

    def abort(self, messages: list[_Moved | None]) -> None:
        """Remove what tasks have written."""
        store, inner = store_of(self.hidden)
        store.delete_dir_contents(inner, missing_dir_ok=True)


class GeoParquetSink(DataSource):
    """The sink behind ``write_targets``; options are ``targets``, ``hidden`` and ``report``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        from pyspark.sql.pandas.types import to_arrow_schema

        targets = [Target(**one | {"columns": tuple(map(tuple, one["columns"])), "types": tuple(one["types"])}) for one in json.loads(self.options["targets"])]
        store, inner = store_of(self.options["hidden"])
        store.create_dir(inner, recursive=True)
        return _Writer(targets, to_arrow_schema(schema), self.options["hidden"], self.options["report"])


def write_targets(rows: DataFrame, targets: Sequence[Target]) -> list[tuple[int, int]]:
    """Write rows to their targets in one job and return ``(features, without geometry)`` of each.

    With several targets the column ``TARGET`` numbers the one of each row.

    Raises:
        FileExistsError: A target holds something already.
    """
    import pyarrow.fs as fs

    spark = rows.sparkSession
    for target in targets:
        store, inner = store_of(target.path)
        if store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            raise FileExistsError(f"There is something at {target.path} already")
    ship_package(spark)
    spark.dataSource.register(GeoParquetSink)
    report = f"{scratch_path(spark, 'report')}/counts.json"
    parent = targets[0].path.rstrip("/").rsplit("/", 1)[0]
    options = {
        "targets": json.dumps([target.__dict__ for target in targets]),
        "hidden": f"{parent}/.writing-{uuid.uuid4().hex[:12]}",
        "report": report,
    }
    rows.write.format(FORMAT).mode("append").options(**options).save()
    return _report(spark, report, len(targets))


def _report(spark: SparkSession, path: str, count: int) -> list[tuple[int, int]]:
    found = {row["target"]: (row["features"], row["refused"]) for row in spark.read.schema("target int, features bigint, refused bigint").json(path).collect()}
    return [found.get(number, (0, 0)) for number in range(count)]
