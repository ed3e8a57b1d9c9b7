"""Registration of queries, and the tables derived from the benchmark data.

Coordinates are multiples of 1/8 so that Spark and the checking engine do the
same exact arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions.wkb import point_wkb
from geoquarry.plans.dataset import GeoDataset
from geoquarry.session import scratch_path
from geoquarry.sources.parquet import plan_read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOST = "https://cat.test"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Open one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> str:
    """Return the path of a table that a query reads, written once for each application and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def flag(value: Column) -> Column:
    """Return a boolean as 0 or 1."""
    return value.cast("bigint")


# orders as points: x in [-180, 180), y in [-85, 85).
PLACES_SQL = """places AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
         CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8.0 - 180.0 AS x,
         CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8.0 - 85.0 AS y
  FROM orders)"""


def place_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Return orders with their point as ``x`` and ``y``."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        ((F.col("o_orderkey") * 37 % 2880).cast("double") / 8.0 - 180.0).alias("x"),
        ((F.col("o_orderkey") * 53 % 1360).cast("double") / 8.0 - 85.0).alias("y"),
    )


def covering(xmin: str, ymin: str, xmax: str, ymax: str) -> Column:
    """Return the covering struct of four columns."""
    names = zip(("xmin", "ymin", "xmax", "ymax"), (xmin, ymin, xmax, ymax), strict=True)
    return F.struct(*(F.col(value).alias(name) for name, value in names))


def place_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Return orders as point features with a covering."""
    rows = place_columns(spark, folder)
    return rows.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "day",
        covering("x", "y", "x", "y").alias("bbox"),
        point_wkb("x", "y").alias("geometry"),
    )


def places(spark: SparkSession, folder: str) -> GeoDataset:
    """Return the point features as a dataset."""
    rows = place_rows(spark, folder)
    return GeoDataset.over(rows, plan_read(rows.schema, None))


# orders as points, bent lines, triangles and pairs of points.
SHAPES_SQL = """shapes AS (
  SELECT o_orderkey, o_orderkey % 4 AS kind, o_orderstatus,
         CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8.0 - 180.0 AS x,
         CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8.0 - 85.0 AS y,
         CAST(o_orderkey % 16 + 1 AS DOUBLE) / 4.0 AS w,
         CAST(o_orderkey % 12 + 1 AS DOUBLE) / 4.0 AS h
  FROM orders)"""


def _xy(x: Column, y: Column) -> Column:
    return F.substring(point_wkb(x, y), 6, 16)


def _words(*numbers: int) -> Column:
    return F.unhex(F.lit("".join(number.to_bytes(4, "little").hex() for number in numbers)))


def shape_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Return orders as features of four kinds, with a covering."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 4).alias("kind"),
        "o_orderstatus",
        ((F.col("o_orderkey") * 37 % 2880).cast("double") / 8.0 - 180.0).alias("x"),
        ((F.col("o_orderkey") * 53 % 1360).cast("double") / 8.0 - 85.0).alias("y"),
        ((F.col("o_orderkey") % 16 + 1).cast("double") / 4.0).alias("w"),
        ((F.col("o_orderkey") % 12 + 1).cast("double") / 4.0).alias("h"),
    )
    corners = rows.select(
        "*",
        _xy(F.col("x"), F.col("y")).alias("a"),
        _xy(F.col("x") + F.col("w"), F.col("y")).alias("b"),
        _xy(F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("c"),
        _xy(F.col("x"), F.col("y") + F.col("h")).alias("d"),
    )
    one = F.unhex(F.lit("01"))
    shape = (
        F.when(F.col("kind") == 0, F.concat(one, _words(1), "a"))
        .when(F.col("kind") == 1, F.concat(one, _words(2, 3), "a", "b", "c"))
        .when(F.col("kind") == 2, F.concat(one, _words(3, 1, 4), "a", "b", "d", "a"))
        .otherwise(F.concat(one, _words(4, 2), one, _words(1), "a", one, _words(1), "c"))
    )
    point = F.col("kind") == 0
    box = F.struct(
        F.col("x").alias("xmin"),
        F.col("y").alias("ymin"),
        F.when(point, F.col("x")).otherwise(F.col("x") + F.col("w")).alias("xmax"),
        F.when(point, F.col("y")).otherwise(F.col("y") + F.col("h")).alias("ymax"),
    )
    return corners.select("o_orderkey", "kind", "o_orderstatus", box.alias("bbox"), shape.alias("geometry"))


def stored_shapes(spark: SparkSession, folder: str) -> str:
    """Return the path of the mixed features as Parquet."""
    return stored(spark, folder, "shapes", lambda path: shape_rows(spark, folder).write.parquet(path))


def shapes(spark: SparkSession, folder: str) -> GeoDataset:
    """Return the mixed features as a dataset."""
    rows = shape_rows(spark, folder)
    return GeoDataset.over(rows, plan_read(rows.schema, None))


BOX = (-40.0, -20.0, 60.5, 40.25)
BOX_SQL = "x <= 60.5 AND x >= -40.0 AND y <= 40.25 AND y >= -20.0"
# Whether a shape touches the box, per kind, by arithmetic.
SHAPE_BOX_SQL = """CASE kind
  WHEN 0 THEN x BETWEEN -40 AND 60.5 AND y BETWEEN -20 AND 40.25
  WHEN 1 THEN (y BETWEEN -20 AND 40.25 AND x <= 60.5 AND x + w >= -40)
           OR (x + w BETWEEN -40 AND 60.5 AND y <= 40.25 AND y + h >= -20)
  WHEN 2 THEN x <= 60.5 AND y <= 40.25 AND greatest(0.0, -40 - x) <= w AND greatest(0.0, -20 - y) <= h
           AND greatest(0.0, -40 - x) * h + greatest(0.0, -20 - y) * w <= w * h
  ELSE (x BETWEEN -40 AND 60.5 AND y BETWEEN -20 AND 40.25)
    OR (x + w BETWEEN -40 AND 60.5 AND y + h BETWEEN -20 AND 40.25) END"""
SHAPE_COVER_SQL = """x <= 60.5 AND y <= 40.25
  AND CASE WHEN kind = 0 THEN x ELSE x + w END >= -40 AND CASE WHEN kind = 0 THEN y ELSE y + h END >= -20"""

# A concave polygon with a hole.
RINGS = (
    ((-60.0, -30.0), (50.0, -45.0), (80.0, 40.0), (10.0, 5.0), (-50.0, 60.0), (-60.0, -30.0)),
    ((-10.0, -20.0), (15.0, -20.0), (0.0, 0.0), (-10.0, -20.0)),
)
AREA = "POLYGON(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in ring) + ")" for ring in RINGS) + ")"
AREA_BOX = (-60.0, -45.0, 80.0, 60.0)
EDGES_SQL = "edges(ax, ay, bx, bt) AS (VALUES " + ", ".join(
    f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)"
    for ring in RINGS
    for a, b in zip(ring, ring[1:], strict=False)
) + ")"
# Even-odd count over the edges, or a point on an edge.
IN_AREA_SQL = """EXISTS (SELECT 1 FROM (
  SELECT sum(CASE WHEN (ay <= y AND y < bt AND (bx - ax) * (y - ay) - (bt - ay) * (x - ax) > 0)
                    OR (bt <= y AND y < ay AND (bx - ax) * (y - ay) - (bt - ay) * (x - ax) < 0)
                  THEN 1 ELSE 0 END) AS odd,
         bool_or((bx - ax) * (y - ay) - (bt - ay) * (x - ax) = 0 AND least(ax, bx) <= x AND x <= greatest(ax, bx)
                 AND least(ay, bt) <= y AND y <= greatest(ay, bt)) AS edge
  FROM edges) t WHERE odd % 2 = 1 OR edge)"""
