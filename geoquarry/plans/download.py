"""The plan of a download: the walk, the files of each document, and what is left out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.extents import meets_scope
from geoquarry.functions.urls import clipped_path
from geoquarry.model import Everything, Scope
from geoquarry.operators import manifest
from geoquarry.operators.ranking import side_by_side
from geoquarry.operators.walk import failures, walk
from geoquarry.plans.dataset import GeoDataset, Written, write_together


@dataclass(frozen=True)
class DownloadPlan:
    """The tables of one planned download."""

    visited: DataFrame
    files: DataFrame
    failures: DataFrame
    unlisted: DataFrame
    outside: DataFrame
    budget: int | None

    def summary(self) -> DataFrame:
        """Return the totals that a confirmation shows, as one row."""
        totals = manifest.manifest_totals(self.files)
        reads = self.visited.agg(F.count("*").alias("reads"))
        limit = F.lit(False) if self.budget is None else F.col("reads") >= self.budget
        counts = [
            self.failures.agg(F.count("*").alias("failures")),
            self.unlisted.agg(F.count("*").alias("unlisted")),
            self.outside.agg(F.count("*").alias("outside")),
            reads.select(limit.alias("truncated")),
        ]
        return side_by_side(totals, *counts)


def plan_download(
    documents: DataFrame,
    edges: DataFrame,
    assets: DataFrame,
    tile_links: DataFrame,
    start: str,
    root: str | None = None,
    scope: Scope = Everything(),
    budget: int | None = None,
    *,
    partitions: bool = True,
) -> DownloadPlan:
    """Plan the download of a document and everything below it.

    Items outside the scope count as read and still expand, they only lose
    their files. ``files`` holds each URL once, at its first mention, with
    ``(depth, place, part, pos)`` as the order.
    """
    base = root or start
    visited = walk(documents, edges, start, budget)
    read = visited.where("error is null").join(
        documents.select(F.col("url").alias("href"), "bbox"), "href"
    )
    outside = (F.col("kind") == "item") & ~meets_scope(F.col("bbox"), scope)
    inside = read.where(~outside).select(F.col("href").alias("doc"), "depth", "place")
    chosen = [frame.join(inside.select(F.col("doc").alias("url")), "url", "left_semi") for frame in (documents, assets, tile_links)]
    files = manifest.files_of(*chosen, base)
    unlisted = documents.sparkSession.createDataFrame([], "doc string, glob string, reason string")
    if partitions:
        more, unlisted = manifest.partition_files(chosen[1], edges, base)
        files = files.unionByName(more)
    ordered = files.join(inside, "doc")
    once = manifest.first_per_url(ordered, ["depth", "place", "part", "pos", "url"])
    return DownloadPlan(visited, once, failures(visited), unlisted, read.where(outside).select("href"), budget)


def assets_to_clip(files: DataFrame, scope: Scope, queried: str | None = None) -> DataFrame:
    """Return the GeoParquet files that a scoped download clips.

    ``files`` is the loadable listing. The file with a query always clips; a
    table has nothing to clip and downloads whole.
    """
    scoped: Column = F.lit(not isinstance(scope, Everything)) & ~F.col("tabular")
    asked = F.col("href") == F.lit(queried) if queried is not None else F.lit(False)
    readable = F.col("is_asset") & (F.col("format") == "parquet") & F.col("read_url").isNotNull()
    return files.where(readable & (asked | scoped))


def clipped_targets(clip: DataFrame, root: str, suffix: str = ".clipped.parquet") -> DataFrame:
    """Return what each clipped file reads and where its copy goes."""
    source = F.coalesce("glob", "href")
    return clip.select("url", "href", "read_url", clipped_path(source, root, suffix).alias("path"))


def write_clipped(
    dataset: GeoDataset, scope: Scope, target: str, queried: GeoDataset | None = None, **options: bool
) -> Written:
    """Write one clipped copy: the queried dataset keeps its filter, others only the scope."""
    chosen = dataset if queried is None else queried
    return chosen.within(scope).write(target, **options)


def write_all_clipped(datasets: Sequence[tuple[GeoDataset, str]], scope: Scope) -> list[Written]:
    """Write the clipped copies of all files of a document in one job; each keeps a filter that it has."""
    return write_together([(data.within(scope), target) for data, target in datasets])
