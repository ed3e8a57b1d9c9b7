"""A feature file or table, and the lazily built rows that a clip, a filter and a choice keep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquarry.functions import wkb
from geoquarry.functions.conditions import Condition, condition_of, named
from geoquarry.functions.projections import as_polygons, clip_for
from geoquarry.model import (
    MULTI_OF,
    NO_GEOMETRY,
    UNKNOWN,
    WHOLE_FILE,
    Clip,
    ConfirmationNeeded,
    CopySpec,
    FeatureFileError,
    QueryError,
    ReadPlan,
    Scope,
    free_name,
)
from geoquarry.plans.custom_select import custom_rows
from geoquarry.sources.geoparquet_sink import TARGET, Target, write_targets
from geoquarry.sources.parquet import glob_folder, read_plan, result_plan

PREVIEW_ROWS = 100
# Loads that are larger ask first.
CONFIRM_FEATURES = 1_000_000
CONFIRM_FILES = 500
# Edges up to which the point test is written out as column arithmetic.
COLUMN_EDGES = 64


def path_column(parts: Sequence[str]) -> Column:
    """Return a column, or a field of a struct column, by its path."""
    return F.col(".".join("`" + part.replace("`", "``") + "`" for part in parts))


def _one_step_in(box: Sequence[float]) -> tuple[float, ...]:
    """Return a box whose sides lie inside another one by a step of single precision."""
    moved = []
    for side, inward in zip(box, (np.inf, np.inf, -np.inf, -np.inf), strict=True):
        near = np.float32(side)
        if (near < side) if inward > 0 else (near > side):
            near = np.nextafter(near, np.float32(inward))
        moved.append(float(np.nextafter(near, np.float32(inward))))
    return tuple(moved)


def escaped(value: Column) -> Column:
    """Return bytes as text: printable ASCII as it is, all others as ``\\xHH``."""

    def shown(place: Column) -> Column:
        byte = F.substring(value, place, F.lit(1))
        plain = (byte >= F.lit(b" ")) & (byte <= F.lit(b"~")) & ~byte.isin(b"\\", b"'", b'"')
        return F.when(plain, byte.cast("string")).otherwise(F.concat(F.lit("\\x"), F.hex(byte)))

    empty = F.octet_length(value) == 0
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(value), F.lit(1)))
    text = F.when(empty, "").otherwise(F.array_join(F.transform(places, shown), ""))
    return F.when(value.isNotNull(), text)


def output_name(name: str) -> str:
    """Return the written name of an attribute; one reserved name changes its case."""
    return "ogc_fid" if name == "OGC_FID" else name


@dataclass(frozen=True)
class Written:
    """What a copy holds."""

    features: int
    geometry_type: str
    refused: int


@dataclass(frozen=True)
class GeoDataset:
    """Rows of a feature file, with what to keep of them. Nothing runs until asked."""

    spark: SparkSession
    frame: DataFrame
    plan: ReadPlan
    sources: tuple[str, ...] = ()
    clip: Clip = WHOLE_FILE
    condition: Condition | None = None
    columns: tuple[str, ...] | None = None
    sql_text: str | None = None
    base: GeoDataset | None = None

    @classmethod
    def read(
        cls, spark: SparkSession, source: str | Sequence[str], *, confirmed: bool = False
    ) -> GeoDataset:
        """Open a file, a list of files or a glob.

        Raises:
            ConfirmationNeeded: The list is longer than the limit that asks first.
        """
        sources = (source,) if isinstance(source, str) else tuple(source)
        if len(sources) > CONFIRM_FILES and not confirmed:
            raise ConfirmationNeeded(f"{len(sources)} files; pass confirmed=True to read them")
        frame, plan = read_plan(spark, source)
        return cls(spark, frame, plan, sources)

    @classmethod
    def over(cls, frame: DataFrame, plan: ReadPlan) -> GeoDataset:
        """Wrap rows that are already a DataFrame."""
        return cls(frame.sparkSession, frame, plan)

    def within(self, part: Clip | Scope) -> GeoDataset:
        """Keep the features that touch a clip in the file's CRS, or a scope in degrees."""
        clip = part if isinstance(part, Clip) else clip_for(part, self.plan.crs)
        return replace(self, clip=clip)

    def where(self, condition: Condition) -> GeoDataset:
        """Keep the rows that a condition holds for.

        Raises:
            QueryError: The condition names a column the file does not hold.
        """
        condition.column(self.plan.names)
        return replace(self, condition=condition)

    def select(self, *names: str) -> GeoDataset:
        """Keep some attribute columns; the file order stays and the geometry too."""
        for name in names:
            named(name, frozenset(self.plan.names))
        return replace(self, columns=tuple(names))

    def sql(self, text: str, view: str = "features") -> GeoDataset:
        """Replace filter, columns and clip by the rows of a SELECT over the file."""
        rows = custom_rows(self.spark, text, self.frame, view)
        return replace(
            self,
            frame=rows,
            plan=result_plan(self.plan, rows.schema),
            clip=WHOLE_FILE,
            condition=None,
            columns=None,
            sql_text=text,
            base=self,
        )

    def _geometry(self) -> Column:
        if self.plan.geometry is None:
            raise FeatureFileError("A table has no geometry column")
        return path_column([self.plan.geometry])

    def _covered(self) -> Column | None:
        """Return whether the covering box of a row meets the clip, edges included.

        The bounds are literals, so the Parquet reader skips row groups by them.
        """
        if self.plan.covering is None or self.clip.bbox is None:
            return None
        west, south, east, north = (float(side) for side in self.clip.bbox)
        sides = self.plan.covering
        return (
            (path_column(sides.west) <= east)
            & (path_column(sides.east) >= west)
            & (path_column(sides.south) <= north)
            & (path_column(sides.north) >= south)
        )

    def _settled(self) -> tuple[Column, Column] | None:
        """Return where the covering box alone decides the exact test, and how it decides.

        A box inside a clip box means yes. A box that is one exact point is
        tested by column arithmetic. The UDF then sees only the other rows.
        Boxes of single precision are rounded, so they settle a row only with
        one step of that precision to spare.
        """
        sides = self.plan.covering
        if sides is None or self.clip.bbox is None:
            return None
        xmin, ymin, xmax, ymax = (
            path_column(path) for path in sides
        )
        exact = all(isinstance(self._type_at(path), T.DoubleType) for path in sides)
        if self.clip.area is None:
            west, south, east, north = self.clip.bbox if exact else _one_step_in(self.clip.bbox)
            inside = (xmin >= west) & (xmax <= east) & (ymin >= south) & (ymax <= north)
            return F.coalesce(inside, F.lit(False)), F.lit(True)
        area = as_polygons(self.clip)
        if area is None or len(area.edges) > COLUMN_EDGES or not exact:
            return None
        verdict = wkb.point_inside(xmin, ymin, area)
        is_point = F.coalesce((xmin == xmax) & (ymin == ymax), F.lit(False))
        return is_point & verdict.isNotNull(), verdict

    def _type_at(self, path: Sequence[str]) -> T.DataType:
        found: T.DataType = self.frame.schema
        for part in path:
            found = found[part].dataType  # type: ignore[index]
        return found

    def kept(self, *, exact: bool = True) -> DataFrame:
        """Return the source rows that the clip and the condition keep.

        Cheap tests come first: the covering box, then the condition. The
        exact test runs on the survivors that the covering does not settle.
        """
        rows = self.frame
        if self.plan.has_geometry and exact:
            rows = rows.where(self._geometry().isNotNull())
        if self.plan.has_geometry:
            covered = self._covered()
            rows = rows if covered is None else rows.where(covered)
        if self.condition is not None:
            rows = rows.where(self.condition.column(self.plan.names))
        area = as_polygons(self.clip) if self.plan.has_geometry and exact else None
        if area is None:
            return rows
        touches = wkb.intersects_test(area)
        settled = self._settled()
        if settled is None:
            return rows.where(touches(self._geometry()))
        known, verdict = settled
        open_geometry = F.when(~known, self._geometry())
        return rows.where((known & verdict) | F.coalesce(touches(open_geometry), F.lit(False)))

    def estimate(self) -> int | None:
        """Return about how many features the copy holds, with no geometry read.

        Exact for tables, whole files and custom SQL; an upper bound under a
        box; None when the file has no covering to count a box with.
        """
        counted = self.estimate_frame()
        return None if counted is None else counted.first().features

    def estimate_frame(self) -> DataFrame | None:
        """Return the estimate as a one-row DataFrame, None when there is no covering."""
        boxed = self.clip.bbox is not None and self.plan.has_geometry
        if boxed and self.plan.covering is None:
            return None
        return self.kept(exact=False).agg(F.count("*").alias("features"))

    def first_type(self) -> str:
        """Return the layer type that the first kept geometry gives, ``Point`` without any.

        First means path order, then row order. Files are tried in growing
        groups, so the usual answer reads one file and not the whole source.
        """
        listed = self.frame.inputFiles() if self.sql_text is None else []
        files = sorted(unquote(name) for name in listed)
        start, step = 0, 1
        while len(files) > 1 and start < len(files):
            group = files[start : start + step]
            reader = self.spark.read.schema(self.frame.schema)
            if len(self.sources) == 1:
                # Keeps the columns that come from folder names.
                reader = reader.option("basePath", glob_folder(self.sources[0]))
            found = replace(self, frame=reader.parquet(*group))._first_of_all()
            if found is not None:
                return found
            start, step = start + step, step * 16
        return (None if len(files) > 1 else self._first_of_all()) or "Point"

    def first_type_frame(self) -> DataFrame:
        """Return type and Z flag of the first kept geometry as one row."""
        place = F.monotonically_increasing_id().alias("_row")
        rows = self.frame
        if self.sql_text is None and rows.inputFiles():
            place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")
        placed = replace(self, frame=rows.select("*", place)).kept()
        shape = F.struct(
            wkb.geometry_type(self._geometry()).alias("family"),
            wkb.has_z(self._geometry()).alias("z"),
        )
        return placed.agg(F.min_by(shape, "_row").alias("first")).select("first.family", "first.z")

    def _first_of_all(self) -> str | None:
        row = self.first_type_frame().first()
        return None if row is None else _type_name(row.family, row.z)

    def layer_type(self) -> str:
        """Return the geometry type of the copy: declared, else from the first kept geometry."""
        if not self.plan.has_geometry:
            return NO_GEOMETRY
        return self.first_type() if self.plan.geometry_type == UNKNOWN else self.plan.geometry_type

    def attributes(self) -> list[Column]:
        """Return the chosen attributes in file order, cast to their field kinds."""
        chosen = []
        for column in self.plan.columns:
            if self.columns is not None and column.name not in self.columns:
                continue
            value = path_column([column.name])
            dtype = self._type_at([column.name])
            if column.kind == "double" and isinstance(dtype, T.DecimalType):
                value = value.cast("double")
            elif column.kind == "int" and isinstance(dtype, T.DecimalType):
                value = value.cast("bigint")  # too large a number is an error, not another number
            elif column.kind == "string" and isinstance(dtype, T.BinaryType):
                value = escaped(value)
            elif column.kind == "string" and isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
                value = F.to_json(value)
            elif column.kind == "string" and not isinstance(dtype, T.StringType):
                value = value.cast("string")
            chosen.append(value.alias(output_name(column.name)))
        return chosen

    def rows(self, layer_type: str | None = None) -> DataFrame:
        """Return the rows of the copy: geometry first, then the attributes.

        A geometry that does not fit the layer type is NULL; its row stays.
        """
        kept = self.kept()
        if self.plan.geometry is None:
            return kept.select(*self.attributes())
        kind = layer_type or self.plan.geometry_type
        shape = wkb.normalised(self._geometry(), kind).alias(self.plan.geometry)
        return kept.select(shape, *self.attributes())

    def preview(self, limit: int = PREVIEW_ROWS) -> DataFrame:
        """Return the first rows, with each geometry shown as its type name."""
        rows = self.frame if self.sql_text is not None else self.rows(self.plan.geometry_type)
        shown = [
            F.upper(wkb.geometry_type(path_column([name]))).alias(name)
            if name == self.plan.geometry
            else path_column([name])
            for name in rows.columns
        ]
        return rows.select(*shown).limit(limit)

    @property
    def fid_name(self) -> str:
        """Return a feature id name that no attribute uses."""
        return free_name("fid", set(self.plan.names))

    @property
    def geometry_name(self) -> str:
        """Return a geometry name that neither an attribute nor the feature id uses."""
        return free_name("geom", {*self.plan.names, self.fid_name})

    def written_rows(self, layer_type: str) -> DataFrame:
        """Return the rows as they are stored, with a ``bbox`` struct for later pruning."""
        rows = self.rows(layer_type)
        if self.plan.geometry is None:
            return rows
        shape = path_column([self.plan.geometry])
        covering = free_name("bbox", {*self.plan.names, self.geometry_name})
        attributes = [path_column([name]) for name in rows.columns[1:]]
        boxed = rows.select(shape.alias(self.geometry_name), *attributes, wkb.envelope(shape).alias(covering))
        return boxed

    def write(self, path: str, *, confirmed: bool = False, clustered: bool = False) -> Written:
        """Write the copy as GeoParquet and return what it holds.

        The counts come from the write job itself, and every footer has the CRS, type and box columns. ``clustered`` sorts the
        features along a space-filling curve first, one extra shuffle that
        makes later box reads skip more row groups.

        Raises:
            ConfirmationNeeded: The estimate is above the limit that asks first.
        """
        if not confirmed:
            count = self.estimate()
            if count is not None and count > CONFIRM_FEATURES:
                raise ConfirmationNeeded(f"About {count} features; pass confirmed=True to write them")
        layer_type = self.layer_type()
        rows = self.written_rows(layer_type)
        if self.plan.has_geometry and clustered:
            rows = along_curve(rows, rows.columns[-1])
        features, refused = write_targets(rows, [self.target(path, layer_type, rows.columns)])[0]
        return Written(features, layer_type, refused)

    def target(self, path: str, layer_type: str, columns: Sequence[str], stored: Sequence[str] | None = None) -> Target:
        """Return what the footers of a copy say; ``stored`` names its columns among the rows of several copies."""
        pairs = tuple(zip(stored or columns, columns, strict=True))
        if not self.plan.has_geometry:
            return Target(path, pairs)
        types = () if layer_type == UNKNOWN else (layer_type[:-1] + " Z" if layer_type.endswith("Z") else layer_type,)
        return Target(path, pairs, self.geometry_name, columns[-1], self.plan.crs, types)

    def spec(self) -> CopySpec:
        """Return what is needed to run the same copy again later."""
        condition = None if self.condition is None else self.condition.to_dict()
        return CopySpec(self.sources, self.clip, condition, self.columns, self.sql_text)


def write_together(copies: Sequence[tuple[GeoDataset, str]]) -> list[Written]:
    """Write several copies, each to its own path, in one job.

    Types that no footer declares are looked up before, all at once. A
    column of the joined rows serves all copies that have one of its name
    and type.
    """
    if not copies:
        return []
    types = _layer_types([data for data, _ in copies])
    parts, targets, known = [], [], {}
    for (data, path), kind in zip(copies, types, strict=True):
        rows = data.written_rows(kind)
        stored = [known.setdefault((name, dtype), f"c{len(known)}") for name, dtype in rows.dtypes]
        number = F.lit(len(targets)).cast("int").alias(TARGET)
        parts.append(rows.select(number, *(path_column([name]).alias(place) for name, place in zip(rows.columns, stored, strict=True))))
        targets.append(data.target(path, kind, rows.columns, stored))
    together = parts[0]
    for rows in parts[1:]:
        together = together.unionByName(rows, allowMissingColumns=True)
    counts = write_targets(together, targets)
    return [Written(features, kind, refused) for (features, refused), kind in zip(counts, types, strict=True)]


def _layer_types(copies: Sequence[GeoDataset]) -> list[str]:
    """Return the layer type of each copy; one job finds all that are not declared."""
    types = [data.plan.geometry_type if data.plan.has_geometry else NO_GEOMETRY for data in copies]
    asked = [number for number, kind in enumerate(types) if kind == UNKNOWN]
    firsts = None
    for number in asked:
        row = copies[number].first_type_frame().withColumn("_number", F.lit(number))
        firsts = row if firsts is None else firsts.unionByName(row)
    for row in firsts.collect() if firsts is not None else []:
        types[row._number] = _type_name(row.family, row.z) or "Point"
    return types


def _type_name(family: str | None, z: bool | None) -> str | None:
    return None if family is None else MULTI_OF.get(family, family) + ("Z" if z else "")


def along_curve(rows: DataFrame, covering: str) -> DataFrame:
    """Range-partition and sort rows by the Morton code of their covering's middle."""

    def spread(value: Column) -> Column:
        cell = value.cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
        return cell

    def scaled(low: str, high: str, edge: float) -> Column:
        middle = (F.col(f"{covering}.{low}") + F.col(f"{covering}.{high}")) / 2
        unit = (middle + edge) / (2 * edge)
        return F.floor(F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * 65535)

    key = spread(scaled("xmin", "xmax", 180.0)).bitwiseOR(F.shiftleft(spread(scaled("ymin", "ymax", 90.0)), 1))
    keyed = rows.withColumn("_curve", key)
    return keyed.repartitionByRange(F.col("_curve")).sortWithinPartitions("_curve").drop("_curve")


def rerun(spark: SparkSession, spec: CopySpec) -> GeoDataset:
    """Rebuild the dataset of a stored copy."""
    source = spec.sources[0] if len(spec.sources) == 1 else spec.sources
    dataset = GeoDataset.read(spark, source, confirmed=True)
    if spec.sql is not None:
        return dataset.sql(spec.sql)
    dataset = dataset.within(spec.clip)
    condition = condition_of(spec.condition)
    if condition is not None:
        dataset = dataset.where(condition)
    return dataset if spec.columns is None else dataset.select(*spec.columns)


__all__ = ["GeoDataset", "QueryError", "Written", "along_curve", "rerun", "write_together"]
