"""The item index of a collection (stac-geoparquet) as a source of item files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquarry.functions import extents, variants, wkb
from geoquarry.functions.assets import MIRROR_ROLE
from geoquarry.functions.bindings import let
from geoquarry.functions.shapes import polygons_of_text
from geoquarry.functions.urls import as_column, asset_href, last_segment, url_path
from geoquarry.model import Area, FeatureFileError, Scope, scope_box
from geoquarry.operators.catalog import item_hrefs
from geoquarry.operators.ranking import first_by
from geoquarry.sources.documents import RAW_TYPE, assets_of
from geoquarry.sources.parquet import implicit_covering, plan_read


def mirror_hrefs(assets: DataFrame) -> DataFrame:
    """Return the item index of each collection: its first asset with that role."""
    return first_by(assets.where(F.array_contains("roles", MIRROR_ROLE)), ["url"], ["pos"], ["href"])


def item_documents(edges: DataFrame) -> DataFrame:
    """Return ``(id, href)`` of item documents: the id is the file name without ``.json``."""
    name = F.regexp_replace(last_segment(url_path(F.col("child"))), r"\.json$", "")
    items = edges.where(F.col("kind") == "item").select(
        name.alias("id"), "pos", F.col("child").alias("href")
    )
    return first_by(items, ["id"], ["pos"], ["href"])


def _corners(schema: T.StructType) -> list[Column]:
    names = schema.fieldNames()
    if "assets" not in names or "bbox" not in names:
        raise FeatureFileError("The file has no bbox or assets column")
    covering = implicit_covering(schema)
    if covering is not None:
        return [F.col(".".join(side)) for side in covering]
    if not isinstance(schema["bbox"].dataType, T.ArrayType):
        raise FeatureFileError("The file has no bbox or assets column")
    half = F.floor(F.size("bbox") / 2).cast("int")
    places = (F.lit(0), F.lit(1), half, half + 1)
    return [F.get(F.col("bbox"), place) for place in places]


def _as_json(frame: DataFrame, name: str) -> Column:
    if name not in frame.columns:
        return F.lit(None).cast("string")
    if isinstance(frame.schema[name].dataType, T.StringType):
        return F.col(name)
    return F.to_json(F.col(name))


def scan_mirror(frame: DataFrame, scope: Scope) -> DataFrame:
    """Return the items in a scope: ``(place, bbox, assets, links, id)``.

    Boxes that cross 180 degrees stay for the exact extent test that follows,
    as every row does under a scope that crosses it. A NULL box is dropped
    under a box and kept without one.
    """
    xmin, ymin, xmax, ymax = _corners(frame.schema)
    rows = frame
    sides = scope_box(scope)
    if sides is not None and sides[0] <= sides[2]:
        west, south, east, north = (float(side) for side in sides)
        crossing = xmin > xmax
        rows = rows.where(crossing | ((xmax >= west) & (xmin <= east)))
        rows = rows.where((ymax >= south) & (ymin <= north))
        plan = plan_read(frame.schema, None)
        if isinstance(scope, Area) and plan.geometry is not None:
            touches = wkb.intersects_test(polygons_of_text(scope.wkt))
            shape = F.when(~crossing, F.col(plan.geometry))
            rows = rows.where(crossing | F.coalesce(touches(shape), F.lit(False)))
    item_id = F.col("id").cast("string") if "id" in frame.columns else F.lit(None).cast("string")
    listed = rows.select(
        F.monotonically_increasing_id().alias("place"),
        extents.box(xmin, ymin, xmax, ymax).alias("bbox"),
        _as_json(frame, "assets").alias("assets"),
        _as_json(frame, "links").alias("links"),
        item_id.alias("id"),
    )
    return listed.where(extents.meets_scope(F.col("bbox"), scope))


def self_href(links: Column, base: Column) -> Column:
    """Return the first ``self`` link of a JSON list of links, resolved, else NULL."""
    items = variants.list_at(variants.parse_json(links))
    own = F.filter(
        items,
        lambda link: (variants.text_at(link, "rel") == "self")
        & variants.filled_text_at(link, "href").isNotNull(),
    )
    return let(
        variants.text_at(F.get(own, F.lit(0)), "href"),
        lambda href: F.when(href.isNotNull(), asset_href(href, base)),
    )


def with_bases(rows: DataFrame, mirror_url: str, items: DataFrame | None = None) -> DataFrame:
    """Add the URL that each row's relative hrefs resolve against, as ``base``.

    The ``self`` link, else the item document with the row's id, else the index itself.
    """
    own = self_href(F.col("links"), as_column(mirror_url))
    if items is None:
        return rows.withColumn("base", F.coalesce(own, F.lit(mirror_url)))
    known = items.select("id", F.col("href").alias("_document"))
    # Rows without an id stay where they are: a join would send them all to one task.
    named = rows.where(F.col("id").isNotNull()).join(known, "id", "left")
    unnamed = rows.where(F.col("id").isNull()).withColumn("_document", F.lit(None).cast("string"))
    return named.unionByName(unnamed).select(
        *rows.columns, F.coalesce(own, F.col("_document"), F.lit(mirror_url)).alias("base")
    )


def mirror_files(rows: DataFrame) -> DataFrame:
    """Return the files of the index rows, each once: ``(href, place)``."""
    text = F.concat(F.lit('{"assets":'), F.coalesce("assets", F.lit("null")), F.lit("}"))
    documents = rows.select(
        F.lpad(F.col("place").cast("string"), 20, "0").alias("url"),
        "base",
        text.alias("body"),
        F.from_json(text, RAW_TYPE).alias("raw"),
    )
    found = item_hrefs(assets_of(documents))
    return found.groupBy("href").agg(F.min("url").cast("bigint").alias("place"))
