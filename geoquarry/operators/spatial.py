"""Features that touch any polygon of a layer: an exact spatial semi join.

A small layer travels to the features inside the task closure, so nothing is
shuffled. A layer beyond the checked size is cut into cells of a quadtree, each
polygon at its own size: cells that lie inside a polygon settle their features
at once, other cells keep the few edges that come near them. Features are tried
with the pieces of their cells in memory, by box, as points, and by geometry;
few pieces travel to the features as well, many meet them in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquarry.functions import pieces, shapes
from geoquarry.functions.wkb import envelope, geometry_type
from geoquarry.session import scratch_path

# A layer up to this many bytes and polygons is sent along with the tasks.
CARRIED_BYTES = 8 * 1024 * 1024
CARRIED_POLYGONS = 2_000
BOX = ["x0", "y0", "x1", "y1"]
TILE = ["e", "tx", "ty"]
# Polygons that are cut at once.
CUT_ROWS = 256
# Features, and pieces, that a task holds at once; one counts again for so many bytes of geometry.
BLOCK_ROWS = 20_000
ROW_BYTES = 512
# Tiles along the longer side of a layer, how often crowded ones are split, and
# the exponent by which a tile is at least wider than its features.
TILES = 64
SPLIT_ROUNDS = 8
ROOM = 3
# The exponent of a box without any width: below that of all numbers.
FINEST = -2_000
# Tables derived from files look smaller than they are: what grows with the features is never broadcast.
SORTED = "merge"
# Relative step between neighbouring floats.
FLOAT_STEP = 2.0**-23


def layer_envelope(areas: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Return the envelope of a polygon layer and its counts as one row.

    ``polygons`` counts its areas; 0 means that there is no area to use.
    """
    kind = geometry_type(F.col(geometry))
    boxed = areas.where(F.col(geometry).isNotNull()).select(envelope(F.col(geometry)).alias("b"), kind.alias("kind"))
    return boxed.agg(
        F.min("b.xmin").alias("west"),
        F.min("b.ymin").alias("south"),
        F.max("b.xmax").alias("east"),
        F.max("b.ymax").alias("north"),
        F.count_if(F.col("kind").isin("Polygon", "MultiPolygon") & F.col("b").isNotNull()).alias("polygons"),
        F.count("*").alias("geometries"),
    )


def touching(
    features: DataFrame,
    areas: DataFrame,
    key: str,
    *,
    geometry: str = "geometry",
    covering: str = "bbox",
    area_geometry: str = "geometry",
    carried_bytes: int = CARRIED_BYTES,
) -> DataFrame:
    """Return the features that touch any polygon of ``areas``, boundary included, each once.

    ``key`` names the unique id of the features, ``covering`` their box struct.
    """
    # An empty polygon has no envelope and touches nothing.
    shape = F.col(area_geometry)
    polygons = areas.where(geometry_type(shape).isin("Polygon", "MultiPolygon") & envelope(shape).isNotNull())
    size = polygons.agg(
        F.count("*").alias("count"), F.coalesce(F.sum(F.length(area_geometry)), F.lit(0)).alias("bytes")
    ).first()
    if size["count"] == 0:
        raise ValueError("The layer has no polygon")
    if size["bytes"] <= carried_bytes and size["count"] <= CARRIED_POLYGONS:
        return _carried(features, polygons, geometry, covering, area_geometry)
    return _by_cells(features, polygons, key, geometry, covering, area_geometry)


def _carried(
    features: DataFrame, areas: DataFrame, geometry: str, covering: str, area_geometry: str
) -> DataFrame:
    """Test every feature against a layer of checked size, with no shuffle."""
    layer = [shapes.polygons_of_wkb(bytes(row[0])) for row in areas.select(area_geometry).collect()]
    boxes = np.array([area.box for area in layer])
    west, south = boxes[:, :2].min(axis=0).tolist()
    east, north = boxes[:, 2:].max(axis=0).tolist()

    @F.arrow_udf(T.BooleanType())
    def touches_any(wkb: pa.Array) -> pa.Array:
        flat = shapes.decode(wkb)
        own, filled = shapes.envelopes(flat)
        hit = np.zeros(flat.rows, bool)
        for area, box in zip(layer, boxes, strict=True):
            near = filled & ~hit & (own[:, 0] <= box[2]) & (own[:, 2] >= box[0])
            near &= (own[:, 1] <= box[3]) & (own[:, 3] >= box[1])
            if near.any():
                hit |= shapes.intersects(flat.rows_only(near), area)
        return pa.array(hit)

    box = F.col(covering)
    near = (box["xmin"] <= east) & (box["xmax"] >= west) & (box["ymin"] <= north) & (box["ymax"] >= south)
    return features.where(F.col(geometry).isNotNull() & near).where(touches_any(F.col(geometry)))


def area_pieces(areas: DataFrame, area_geometry: str = "geometry") -> DataFrame:
    """Cut polygons into cells of a quadtree (``functions/pieces``); equal polygons are cut once."""
    distinct = areas.select(F.col(area_geometry).alias("area")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CUT_ROWS):
                yield from pieces.cut(batch.column(0).slice(start, CUT_ROWS))

    cut = distinct.mapInArrow(run, pieces.PIECE_FIELDS)
    # One swallowing polygon is enough for a cell.
    whole = cut.where("inside").groupBy("e", "ix", "iy", "inside").agg(
        *(edge(name).alias(name) for name, edge in (("px0", F.min), ("py0", F.min), ("px1", F.max), ("py1", F.max))),
        F.lit(None).cast("binary").alias("body"),
    )
    return cut.where("not inside").unionByName(whole)


def _exact_box(features: DataFrame, covering: str) -> list[Column]:
    """Return the box as doubles; one of floats is widened, as it may have been rounded."""
    box = features.schema[covering].dataType
    found = []
    for name, away in (("xmin", -1.0), ("ymin", -1.0), ("xmax", 1.0), ("ymax", 1.0)):
        value = F.col(covering)[name].cast("double")
        if not isinstance(box[name].dataType, T.DoubleType):
            value = value + away * F.abs(value) * FLOAT_STEP
        found.append(value.alias({"xmin": "x0", "ymin": "y0", "xmax": "x1", "ymax": "y1"}[name]))
    return found


def _by_cells(
    features: DataFrame, areas: DataFrame, key: str, geometry: str, covering: str, area_geometry: str
) -> DataFrame:
    """Find features that touch pieces of polygons; what is written are the ids of those that do, never pairs.

    Few pieces go along with the tasks. Otherwise features and pieces meet in
    tiles. Features are read twice, or three times and once more for each
    round in which crowded tiles are split.
    """
    spark = features.sparkSession
    path = scratch_path(spark, "pieces")
    area_pieces(areas, area_geometry).write.parquet(path)
    cut = spark.read.parquet(path)
    layer = cut.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("bytes"),
        F.min("px0").alias("west"), F.min("py0").alias("south"), F.max("px1").alias("east"), F.max("py1").alias("north"),
    ).first()
    if not layer["n"]:
        return features.limit(0)
    point = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    boxed = features.where(F.col(geometry).isNotNull() & F.col(covering).isNotNull()).select(
        F.col(key).alias("_id"), *_exact_box(features, covering), F.col(geometry).alias("_shape")
    )
    boxed = boxed.where("x0 <= x1 AND y0 <= y1").where(
        (F.col("x0") <= layer["east"]) & (F.col("x1") >= layer["west"]) & (F.col("y0") <= layer["north"]) & (F.col("y1") >= layer["south"])
    )
    # Points are settled by their box.
    boxed = boxed.withColumn("_shape", F.when(~point, F.col("_shape")))
    found = T.StructType([T.StructField("_id", features.schema[key].dataType)])
    if layer["bytes"] + 100 * layer["n"] <= CARRIED_BYTES:
        hits = boxed.mapInArrow(_hits_of(cut.toArrow()), found)
    else:
        hits = _in_tiles(boxed, cut, [layer[name] for name in ("west", "south", "east", "north")], found)
    path = scratch_path(spark, "met")
    hits.write.parquet(path)
    hits = spark.read.parquet(path)
    return features.join(hits.distinct().withColumnRenamed("_id", key).hint(SORTED), key, "left_semi")


def _touched(layer: pieces.Layer, rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch | pa.Table:
    """Return the ids of the features that touch a piece."""
    boxes = [rows.column(name).to_numpy() for name in BOX]
    shape = rows.column("_shape")
    if isinstance(shape, pa.ChunkedArray):
        shape = shape.cast(pa.large_binary()).combine_chunks()
    return rows.select(["_id"]).filter(pa.array(layer.touched(boxes, shape)))


def _hits_of(cut: pa.Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer = pieces.Layer(cut)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                yield _touched(layer, batch.slice(start, BLOCK_ROWS))

    return run


def _in_tiles(boxed: DataFrame, cut: DataFrame, envelope: list[float], found: T.StructType) -> DataFrame:
    """Return the ids of features that touch a piece; both go to the tiles that they touch, once each.

    A feature goes to tiles much wider than it, a piece to those of all sizes
    that have features. Tiles of many features and many pieces are split, and
    what is still crowded is dealt in blocks of both: a task holds one block
    of each at a time, whatever the layer and the features are.
    """
    west, south, east, north = envelope
    extent, reach = max(east - west, north - south), max(map(abs, envelope))
    # Tile numbers stay far below 53 bits.
    base = math.ceil(math.log2(max(extent / TILES, reach * 2.0**-40, 1e-300)))
    top = base + math.ceil(math.log2(TILES))
    wide = F.greatest(F.least("x1", F.lit(east)) - F.greatest("x0", F.lit(west)), F.least("y1", F.lit(north)) - F.greatest("y0", F.lit(south)))
    # The logarithm of zero is null.
    own = F.coalesce(F.ceil(F.log2(wide)).cast("int") + ROOM, F.lit(FINEST))
    size = F.length(F.coalesce("_shape", F.lit(b"")))
    one = boxed.withColumn("_own", own).withColumn("_weight", 1 + F.floor(size / ROW_BYTES))
    one = one.withColumn("e", F.least(F.lit(top), F.greatest(F.lit(base), "_own")))
    size = F.length(F.coalesce("body", F.lit(b"")))
    two = cut.select(
        F.struct("e", "ix", "iy").alias("cell"), "inside", *(F.col(f"p{name}").alias(name) for name in BOX), "body",
        F.lit(None).cast("int").alias("_own"), (1 + F.floor(size / ROW_BYTES)).alias("_weight"),
        F.explode(F.sequence(F.lit(base), F.lit(top))).alias("e"),
    )
    one, two = (_in_each(rows, _tiles(F.col("e"), envelope)) for rows in (one, two))
    spark, split = boxed.sparkSession, set()
    for turn in range(SPLIT_ROUNDS + 1):
        path = scratch_path(spark, "tiles")
        widest = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        counts = one.groupBy(*TILE).agg(F.sum("_weight").alias("_features")).join(
            two.groupBy(*TILE).agg(F.sum("_weight").alias("_pieces"), F.avg(widest).alias("_wide")).hint(SORTED), TILE
        )
        counts.write.parquet(path)
        tiles = spark.read.parquet(path)
        # Pieces must fit well into the smaller tiles, or there would be more copies and not less work.
        side = F.pow(F.lit(2.0), F.col("e") - pieces.STEP)
        crowded = tiles.where((F.col("_features") > BLOCK_ROWS) & (F.col("_pieces") > BLOCK_ROWS) & (side >= 2 * F.col("_wide")) & (side >= reach * 2.0**-40))
        # There is less than one crowded tile for each BLOCK_ROWS features.
        fresh = {tuple(row) for row in crowded.select(*TILE).collect()} - split if turn < SPLIT_ROUNDS else set()
        if not fresh:
            break
        split |= fresh
        marks = spark.createDataFrame(sorted(fresh), "e int, tx bigint, ty bigint").withColumn("_split", F.lit(True))
        one, two = (_split(rows, marks, envelope) for rows in (one, two))
    dealt = F.broadcast(tiles.select(*TILE, *(F.ceil(F.col(name) / BLOCK_ROWS).alias(name) for name in ("_features", "_pieces"))))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    block = F.xxhash64(*TILE, "_i", "_j").alias("_block")
    one = one.join(dealt, TILE).withColumn("_i", F.pmod(F.xxhash64("_id", *BOX), F.col("_features"))).withColumn("_j", every("_pieces"))
    two = two.join(dealt, TILE).withColumn("_j", F.pmod(F.xxhash64("cell", *BOX, "body"), F.col("_pieces"))).withColumn("_i", every("_features"))
    one = one.select(block, "_id", *BOX, "_shape").groupBy("_block")
    two = two.select(block, "cell.e", "cell.ix", "cell.iy", "inside", *(F.col(name).alias(f"p{name}") for name in BOX), "body").groupBy("_block")

    def meet(rows: pa.Table, layer: pa.Table) -> pa.Table:
        return _touched(pieces.Layer(layer), rows) if rows.num_rows and layer.num_rows else rows.select(["_id"]).slice(0, 0)

    return one.cogroup(two).applyInArrow(meet, found)


def _tiles(level: Column, envelope: list[float], within: bool = False) -> Column:
    """Return the tiles of a level that a box touches inside of the envelope; ``within`` keeps those in the row's own tile."""
    side, fan = F.pow(F.lit(2.0), level), 1 << pieces.STEP

    def numbers(low: str, high: str, edge: int, own: str) -> Column:
        begin = F.floor(F.greatest(F.col(low), F.lit(envelope[edge])) / side)
        end = F.floor(F.least(F.col(high), F.lit(envelope[edge + 2])) / side)
        if within:
            begin, end = F.greatest(begin, F.col(own) * fan), F.least(end, F.col(own) * fan + (fan - 1))
        return F.sequence(begin, end)

    columns, lines = numbers("x0", "x1", 0, "tx"), numbers("y0", "y1", 1, "ty")
    return F.flatten(F.transform(columns, lambda x: F.transform(lines, lambda y: F.struct(
        level.alias("e"), x.alias("tx"), y.alias("ty")
    ))))


def _in_each(rows: DataFrame, places: Column) -> DataFrame:
    """Repeat rows for each of their tiles."""
    rows = rows.withColumn("_t", F.explode(places))
    return rows.select(*(name for name in rows.columns if name not in (*TILE, "_t")), *(F.col(f"_t.{name}").alias(name) for name in TILE))


def _split(rows: DataFrame, marks: DataFrame, envelope: list[float]) -> DataFrame:
    """Move features of marked tiles to the tiles below that are wide enough for them; pieces go to both."""
    marked = rows.join(F.broadcast(marks), TILE, "left")
    here, below = F.array(F.struct(*TILE)), F.col("e") - pieces.STEP
    inner = _tiles(below, envelope, within=True)
    piece = F.col("_own").isNull()
    places = F.when(F.col("_split").isNull() | (F.col("_own") > below), here).when(piece, F.concat(here, inner)).otherwise(inner)
    return _in_each(marked, places).drop("_split")
