"""The audit of whole catalogs: walk each one and run every check that applies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.operators import audit, catalog, manifest
from geoquarry.operators.ranking import first_by
from geoquarry.operators.walk import truncated, walk
from geoquarry.sources.mirror import mirror_hrefs


def sweep(
    documents: DataFrame,
    edges: DataFrame,
    assets: DataFrame,
    tile_links: DataFrame,
    roots: DataFrame,
    style_files: DataFrame,
    probes: DataFrame,
    footers: DataFrame,
    budget: int | None = None,
) -> DataFrame:
    """Return every check on the catalogs of ``roots(catalog, root)``.

    The walk follows catalogs, collections and the first item of each
    collection. ``probes`` holds ``(url, size, head)``, ``footers`` ``(url,
    geometry, rows)``, ``style_files`` ``(style, body)``. A ``budget`` that
    stops the walk of a catalog gives it a failed check of its own.
    """
    visited = walk(documents, edges, roots.select("root"), budget, first_item_only=True)
    stopped = truncated(visited, budget).where("truncated").join(roots, "root").select("catalog", F.col("root").alias("document"))
    named = visited.join(roots.select(F.col("catalog").alias("_name"), "root"), "root").withColumn("root", F.col("_name")).drop("_name")
    within = named.where("error is null").select(F.col("root").alias("catalog"), F.col("href").alias("url"))
    read = documents.where("error is null").join(within.select("url").distinct(), "url", "left_semi")
    own = assets.join(within.select("url").distinct(), "url", "left_semi")
    links = tile_links.join(within.select("url").distinct(), "url", "left_semi")
    files = catalog.loadable(own, links)
    described = read.where("kind <> 'catalog'").select("url")
    targets = catalog.pick_targets(files).join(described, "url", "left_semi")
    blocked = catalog.reads_items(files, edges)
    indexes = mirror_hrefs(own).join(described, "url", "left_semi").join(within, "url")
    mirrored = indexes.select("catalog", F.col("url").alias("document"), F.col("href").alias("url")).join(footers, "url", "left")
    planned = _own_paths(read, own, links)
    parts = [
        audit.read_checks(named, documents),
        audit.dropped_assets(audit.raw_assets(read), own, within),
        audit.empty_collections(read, files, edges, within),
        audit.target_checks(targets, blocked, probes, footers, within, first_item_files(edges, assets)),
        audit.style_checks(read, own, links, style_files, within),
        audit.thumbnail_checks(read, own, probes, within),
        audit.download_checks(planned.join(described.withColumnRenamed("url", "doc"), "doc", "left_semi"), within),
        audit.checks(mirrored, "mirror", F.col("rows").isNotNull(), audit.footer_detail()),
    ]
    if budget is not None:
        parts.append(audit.flags(stopped, F.lit("truncated"), F.lit(f"Only {budget} documents were read")))
    return reduce(DataFrame.unionByName, parts)


def first_item_files(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Return the data file of the first item of each document: ``(document, item_file)``."""
    items = first_by(edges.where("kind = 'item'"), ["parent"], ["pos"], ["child"])
    named = catalog.item_hrefs(assets).select(F.col("url").alias("child"), F.col("href").alias("item_file"))
    return items.join(named, "child").select(F.col("parent").alias("document"), "item_file")


def _own_paths(documents: DataFrame, assets: DataFrame, tile_links: DataFrame) -> DataFrame:
    """Return manifest rows whose paths are relative to their own document."""
    return manifest.files_of(documents, assets, tile_links, F.col("doc"))
