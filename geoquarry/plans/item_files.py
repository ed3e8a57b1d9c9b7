"""The data files of a collection's items in a scope, from the index or from the walk."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions.assets import asset_format
from geoquarry.functions.extents import meets_scope
from geoquarry.model import Scope
from geoquarry.operators.catalog import item_hrefs
from geoquarry.operators.walk import truncated, walk
from geoquarry.plans.dataset import GeoDataset
from geoquarry.session import ensure_checkpoints
from geoquarry.sources import mirror
from geoquarry.sources.parquet import scan

log = logging.getLogger(__name__)


def walked_files(
    documents: DataFrame, edges: DataFrame, assets: DataFrame, start: str, scope: Scope, budget: int | None = None
) -> DataFrame:
    """Walk the items below a start and return the files of those in scope: ``(href, depth, place, truncated)``.

    ``truncated`` tells on every row whether a budget stopped the walk.
    """
    visited = walk(documents, edges, start, budget)
    seen = visited.where("error is null and kind = 'item'")
    items = documents.select(F.col("url").alias("href"), "bbox")
    inside = seen.join(items, "href").where(meets_scope(F.col("bbox"), scope))
    files = item_hrefs(assets).withColumnRenamed("href", "file").withColumnRenamed("url", "href")
    picked = inside.join(files, "href").select(F.col("file").alias("href"), F.struct("depth", "place").alias("turn"))
    first = picked.groupBy("href").agg(F.min("turn").alias("turn"))
    # One row: the walk has one root.
    stopped = F.broadcast(truncated(visited, budget).select("truncated", F.lit(1).alias("_one")))
    return first.withColumn("_one", F.lit(1)).join(stopped, "_one").select("href", "turn.depth", "turn.place", "truncated")


def indexed_files(frame: DataFrame, url: str, scope: Scope, edges: DataFrame | None = None) -> DataFrame:
    """Return the files of an item index in scope: ``(href, place)``."""
    items = None if edges is None else mirror.item_documents(edges)
    rows = mirror.with_bases(mirror.scan_mirror(frame, scope), url, items)
    return mirror.mirror_files(rows)


def files_in_scope(
    spark: SparkSession,
    documents: DataFrame,
    edges: DataFrame,
    assets: DataFrame,
    collection: str,
    scope: Scope,
    budget: int | None = None,
) -> DataFrame:
    """Return the files of a collection's items in scope as ``(href)``.

    The collection's index answers when it can be opened and read to its end;
    else the items are walked. What the index gives is staged at once: a file
    that fails only while tasks read it is found here and not later. All its
    boxes are read first, since a scope alone skips row groups by their
    statistics and would not notice that they are damaged.
    """
    own = assets.where(F.col("url") == collection)
    index = mirror.mirror_hrefs(own).first()
    if index is not None:
        try:
            frame = scan(spark, index.href)
            links = edges.where(F.col("parent") == collection)
            ensure_checkpoints(spark)
            found = indexed_files(frame, index.href, scope, links).select("href")
            frame.select(F.xxhash64("bbox").alias("box")).agg(F.max("box")).first()
            return found.checkpoint(eager=True)
        except (PySparkException, Py4JJavaError, ValueError) as error:
            log.warning("The index %s cannot be read, its items are walked: %s", index.href, str(error).split("\n", 1)[0])
    return walked_files(documents, edges, assets, collection, scope, budget).select("href")


def split_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split item files into rasters and GeoParquet tables."""
    table = F.coalesce(asset_format(F.col("href"), F.lit(None).cast("string")) == "parquet", F.lit(False))
    return files.where(~table), files.where(table)


def items_as_one(spark: SparkSession, files: DataFrame, *, confirmed: bool = False) -> GeoDataset:
    """Open the GeoParquet files of many items as one table.

    Spark's own file listing needs every path on the driver, so the paths
    (not the data) are collected; above the file limit the call asks first.
    """
    tables = split_files(files)[1].select("href").distinct().orderBy("href")
    return GeoDataset.read(spark, [row.href for row in tables.toLocalIterator()], confirmed=confirmed)
