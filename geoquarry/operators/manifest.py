"""Download manifests: which files, where they go, which clash, and which verify."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.multihash import content_matches, decode
from geoquarry.functions.urls import as_column, asset_href, local_path, target_path
from geoquarry.operators.ranking import first_by
from geoquarry.sources.registry import casefold

LISTED = "glob string, listed string, size bigint, reason string"
# Listed files that leave a task in one batch.
LISTING_BATCH = 10_000
FILE_COLUMNS = ("doc", "part", "pos", "url", "path", "size", "checksum")


def files_of(
    documents: DataFrame, assets: DataFrame, tile_links: DataFrame, root: Column | str
) -> DataFrame:
    """Return each document itself, its assets and its tile links as manifest rows.

    Columns ``doc, part, pos, url, path, size, checksum``; ``part`` keeps the
    order document, assets, links. An archive that is both asset and link
    counts as the asset, which declares size and checksum.
    """
    size, checksum = F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("checksum")
    own = documents.where("error is null").select(
        F.col("url").alias("doc"), F.lit(0).alias("part"), F.lit(0).alias("pos"), "url", size, checksum
    )
    direct = assets.where(F.col("href").rlike("^https?://") & F.col("glob").isNull()).select(
        F.col("url").alias("doc"), F.lit(1).alias("part"), "pos", F.col("href").alias("url"), "size", "checksum"
    )
    linked = tile_links.join(assets.select("url", "href").distinct(), ["url", "href"], "left_anti").select(
        F.col("url").alias("doc"), F.lit(2).alias("part"), "pos", F.col("href").alias("url"), size, checksum
    )
    every = own.unionByName(direct).unionByName(linked)
    return every.withColumn("path", local_path(F.col("url"), as_column(root))).select(*FILE_COLUMNS)


def list_globs(globs: DataFrame) -> DataFrame:
    """List the files of every glob in ``globs.glob``, each glob in its own task row.

    Returns ``(glob, listed, size, reason)``; a glob that cannot be listed
    gives one row with the reason.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from geoquarry.sources.listing import matches

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(column), kind) for column, kind in zip(columns, kinds, strict=True)],
                names=["glob", "listed", "size", "reason"],
            )

        rows: list[tuple] = []
        for batch in batches:
            for glob in batch.column(0).to_pylist():
                try:
                    for name, size in matches(glob):
                        rows.append((glob, name, size, None))
                        if len(rows) >= LISTING_BATCH:
                            yield packed(rows)
                            rows = []
                except (OSError, ValueError, NotImplementedError) as error:
                    rows.append((glob, None, None, str(error).splitlines()[0] if str(error) else type(error).__name__))
        if rows:
            yield packed(rows)

    return globs.select("glob").mapInArrow(listed, LISTED)


def partition_files(
    assets: DataFrame, edges: DataFrame, root: Column | str
) -> tuple[DataFrame, DataFrame]:
    """Return the files of partitioned assets, and the globs that cannot be listed.

    A glob that only HTTPS serves adds nothing when the document has
    children, because the walk reads the items; else it is reported.
    """
    parents = edges.select(F.col("parent").alias("url")).distinct()
    globbed = assets.where("glob is not null").select("url", "pos", "glob", "read_url")
    blocked = globbed.where("read_url is null").join(parents, "url", "left_anti")
    open_to = globbed.where("read_url is not null")
    found = list_globs(open_to.select(F.col("read_url").alias("glob")).distinct()).withColumnRenamed("glob", "read_url")
    joined = open_to.join(found, "read_url")
    files = joined.where("reason is null").select(
        F.col("url").alias("doc"),
        F.lit(3).alias("part"),
        "pos",
        asset_href(F.col("listed"), F.col("listed")).alias("url"),
        F.lit(None).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("checksum"),
    )
    placed = files.withColumn("path", local_path(F.col("url"), as_column(root))).select(*FILE_COLUMNS)
    silent = blocked.select(
        F.col("url").alias("doc"), "glob", F.concat(F.lit("HTTPS cannot list the files of "), "glob").alias("reason")
    )
    failed = joined.where("reason is not null").select(F.col("url").alias("doc"), "glob", "reason")
    return placed, silent.unionByName(failed)


def first_per_url(files: DataFrame, order: list[str]) -> DataFrame:
    """Return the first manifest row of each URL."""
    keep = [name for name in files.columns if name != "url"]
    return first_by(files, ["url"], order, keep).select(*files.columns)


def split_collisions(files: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split a manifest into the files to keep and the later ones that share a path, ignoring case.

    ``files`` holds each URL once. The clashes come back as rows, so that a
    report can name them.
    """
    folded = files.withColumn("_folded", casefold(F.col("path")))
    kept = first_by(folded, ["_folded"], order, files.columns).select(*files.columns)
    clashes = files.join(kept.select("url"), "url", "left_anti")
    return kept, clashes


def without_clipped(files: DataFrame, clipped: DataFrame) -> DataFrame:
    """Return a manifest without the files that are clipped instead (``clipped.href``)."""
    return files.join(clipped.select(F.col("href").alias("url")).distinct(), "url", "left_anti")


def manifest_totals(files: DataFrame) -> DataFrame:
    """Return file count, known bytes and files of unknown size as one row."""
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("known_bytes"),
        F.count_if(F.col("size").isNull()).alias("unknown_sizes"),
    )


def decide(files: DataFrame, stored: DataFrame, folder: str) -> DataFrame:
    """Decide what to do with each file of a manifest, given what is stored already.

    ``stored`` holds ``(path, size, matches)`` of the files below ``folder``;
    ``matches`` is the checksum's verdict, NULL for an unreadable one. Adds
    ``target``, ``verified`` and ``outcome``: ``failed`` (the path leaves the
    folder), ``skipped`` or ``fetch``.
    """
    there = stored.select(F.col("path"), F.col("size").alias("_size"), "matches", F.lit(True).alias("_there"))
    joined = files.join(there, "path", "left").withColumn("target", target_path(folder, F.col("path")))
    exists = F.col("_there").isNotNull()
    checked = F.coalesce(F.col("checksum"), F.lit("")) != ""
    outcome = (
        F.when(F.col("target").isNull(), "failed")
        .when(exists & checked, F.when(F.coalesce("matches", F.lit(True)), "skipped").otherwise("fetch"))
        .when(exists & (F.col("_size") == F.col("size")), "skipped")
        .otherwise("fetch")
    )
    verified = F.coalesce(exists & checked & F.col("matches") & F.col("target").isNotNull(), F.lit(False))
    return joined.select(*files.columns, "target", outcome.alias("outcome"), verified.alias("verified"))


def settle(fetched: DataFrame) -> DataFrame:
    """Judge fetched files ``(path, checksum, matches)``: a wrong digest fails, the rest stay."""
    checked = F.coalesce(F.col("checksum"), F.lit("")) != ""
    wrong = checked & ~F.coalesce(F.col("matches"), F.lit(True))
    return fetched.withColumn("outcome", F.when(wrong, "failed").otherwise("downloaded")).withColumn(
        "verified", checked & F.coalesce(F.col("matches"), F.lit(False))
    )


def with_matches(contents: DataFrame) -> DataFrame:
    """Add the checksum's verdict to rows with ``content`` and ``checksum``, as ``matches``."""
    decoded = contents.withColumn("_decoded", decode(F.col("checksum")))
    return decoded.withColumn("matches", content_matches(F.col("content"), F.col("_decoded"))).drop("_decoded")


def fetch_report(outcomes: DataFrame) -> DataFrame:
    """Return how many files were downloaded, skipped, failed and verified."""
    return outcomes.agg(
        *(F.count_if(F.col("outcome") == name).alias(name) for name in ("downloaded", "fetch", "skipped", "failed")),
        F.count_if("verified").alias("verified"),
    )


def progress(files: DataFrame) -> DataFrame:
    """Return the share of a job that is done: by bytes when every size is known, else by files.

    ``files`` holds ``(size, received, settled)``.
    """
    total = F.sum("size")
    by_bytes = F.least(F.sum(F.when(F.col("settled"), F.col("size")).otherwise(F.coalesce("received", F.lit(0)))) / total, F.lit(1.0))
    by_files = F.count_if("settled") / F.count("*")
    known = (F.count_if(F.col("size").isNull()) == 0) & (total > 0)
    return files.agg(F.when(known, by_bytes).otherwise(F.when(F.count("*") > 0, by_files)).alias("fraction"))
