"""Picks over documents, links and assets: what to view, load, show and size.

"First" always means document order, carried in ``pos``. Every pick is one
``min_by`` aggregate, so a document with very many assets is combined on the
map side and never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import assets as rules
from geoquarry.functions.urls import is_image
from geoquarry.operators.ranking import first_by, numbered
from geoquarry.session import scratch_path


def only_data(assets: DataFrame) -> DataFrame:
    """Return the assets other than styles, thumbnails, overviews and metadata."""
    return assets.where(rules.is_data(F.col("roles"), F.col("type")))


def tile_duplicates(assets: DataFrame, tile_links: DataFrame) -> DataFrame:
    """Return the ``(url, href)`` pairs that a tile link and an asset both name."""
    return tile_links.select("url", "href").intersect(assets.select("url", "href"))


def loadable(assets: DataFrame, tile_links: DataFrame) -> DataFrame:
    """Return the files that can be added: tile links first, then data assets.

    Columns ``url, is_asset, pos, href, title, format, key, tabular, glob,
    read_url, layers``. An archive that is both shows once, as the link.
    """
    none = F.lit(None)
    linked = tile_links.select(
        "url",
        F.lit(False).alias("is_asset"),
        "pos",
        "href",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Vector tiles")).alias("title"),
        F.lit("pmtiles").alias("format"),
        none.cast("string").alias("key"),
        F.lit(False).alias("tabular"),
        none.cast("string").alias("glob"),
        F.col("href").alias("read_url"),
        "layers",
    )
    kept = assets.where(rules.is_loadable(F.col("roles"), F.col("type"), F.col("format")))
    own = kept.join(tile_links.select("url", "href").distinct(), ["url", "href"], "left_anti").select(
        "url",
        F.lit(True).alias("is_asset"),
        "pos",
        "href",
        rules.asset_label(F.col("title"), F.col("key")).alias("title"),
        "format",
        "key",
        "tabular",
        "glob",
        "read_url",
        F.array().cast("array<string>").alias("layers"),
    )
    return linked.unionByName(own)


def _first_format(
    files: DataFrame, order: Sequence[str], keep: Sequence[str], place: Sequence[str] = ("is_asset", "pos")
) -> DataFrame:
    ranked = files.withColumn("_rank", rules.rank_of(F.col("format"), tuple(order))).where("_rank is not null")
    return first_by(ranked, ["url"], ["_rank", *place], keep)


def preferred_file(files: DataFrame, *, parquet: bool = True) -> DataFrame:
    """Return the file to add when nothing is chosen: ``(url, href, format)``.

    The first tile link wins, then the first data file in preference order.
    """
    order = [name for name in rules.PREFERRED if parquet or name != "parquet"]
    place = rules.rank_of(F.col("format"), tuple(order))
    ranked = files.withColumn("_rank", F.when(~F.col("is_asset"), 0).otherwise(place))
    return first_by(ranked.where("_rank is not null"), ["url"], ["_rank", "is_asset", "pos"], ["href", "format"])


def pick_targets(files: DataFrame, *, parquet: bool = True) -> DataFrame:
    """Return the file to view and the file to load, NULL where there is none.

    Columns ``url, view_href, view_format, load_href, load_format``. Without a
    Parquet reader the other load formats go first and Parquet goes last.
    """
    load_order = rules.LOADED if parquet else (*rules.LOADED[1:], rules.LOADED[0])
    view_rank = rules.rank_of(F.col("format"), rules.VIEWED)
    load_rank = rules.rank_of(F.col("format"), load_order)
    target = F.struct("href", "format")

    def best(rank: Column) -> Column:
        return F.min_by(target, F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("is_asset"), F.col("pos"))))

    # One pass for both picks: rows without a rank have a NULL order and lose.
    picked = files.groupBy("url").agg(best(view_rank).alias("view"), best(load_rank).alias("load"))
    return picked.where("view is not null or load is not null").select(
        "url",
        F.col("view.href").alias("view_href"),
        F.col("view.format").alias("view_format"),
        F.col("load.href").alias("load_href"),
        F.col("load.format").alias("load_format"),
    )


def item_hrefs(assets: DataFrame) -> DataFrame:
    """Return the file that stands for an item in a joined layer: ``(url, href)``.

    The first COG data asset, else the first GeoParquet that is no glob.
    """
    data = only_data(assets).where((F.col("format") == "cog") | ((F.col("format") == "parquet") & F.col("glob").isNull()))
    return first_by(data, ["url"], [F.col("format") != "cog", F.col("pos")], ["href"])


def item_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Return the file an item lists: its first data file in preference order, titled as the item."""
    picked = _first_format(files.where("is_asset"), rules.PREFERRED, ["href", "format"], ["pos"])
    items = documents.where(F.col("kind") == "item").select("url", "title")
    return picked.join(items, "url")


def styles_of(assets: DataFrame) -> DataFrame:
    """Return the style assets numbered per document, default styles first, with the default marked.

    ``is_default`` marks the document's default style: the first one marked
    ``default``, or the only style there is.
    """
    path = scratch_path(assets.sparkSession, "styles")
    found = assets.where(rules.is_style(F.col("roles"), F.col("type")))
    # Numbering reads its rows several times; documents are read once.
    found.select("url", "pos", "key", "href", "title", F.array_contains("roles", "default").alias("marked")).write.parquet(path)
    styles = assets.sparkSession.read.parquet(path)
    # Default styles keep their positions, the others move behind every position.
    placed = styles.withColumn(
        "_place", F.col("pos").cast("bigint") + F.when(F.col("marked"), 0).otherwise(2**31)
    )
    ranked = numbered(placed, ["url"], "_place", alias="number", bits=32)
    # Files look smaller than what is read from them.
    counts = styles.groupBy("url").agg(F.count("*").alias("styles")).hint("merge")
    return (
        ranked.join(counts, "url")
        .withColumn("is_default", (F.col("number") == 1) & (F.col("marked") | (F.col("styles") == 1)))
        .select("url", "number", "pos", "key", "href", "title", "marked", "styles", "is_default")
    )


def icons(links: DataFrame) -> DataFrame:
    """Return the first ``icon`` link of each document that names an image: ``(url, href)``."""
    images = links.where((F.col("rel") == "icon") & is_image(F.col("href"), F.col("type")))
    return first_by(images, ["url"], ["pos"], ["href"])


def thumbnails(assets: DataFrame) -> DataFrame:
    """Return the first image with the thumbnail role, else with the overview role."""
    role = F.when(F.array_contains("roles", "thumbnail"), 0).when(F.array_contains("roles", "overview"), 1)
    # Few assets have such a role: it is asked first.
    images = assets.withColumn("_role", role).where("_role is not null").where(is_image(F.col("href"), F.col("type")))
    return first_by(images, ["url"], ["_role", "pos"], ["key", "href"])


def document_sizes(assets: DataFrame) -> DataFrame:
    """Return the sum of declared sizes per document; NULL when none is declared."""
    return assets.groupBy("url").agg(F.sum("size").alias("size"))


def document_facts(documents: DataFrame, assets: DataFrame, registry: DataFrame) -> DataFrame:
    """Return extent and size per document, with the registry's values where its own are missing."""
    entries = first_by(
        registry, ["url"], ["pos"], ["bbox", "total_size_bytes"]
    ).select("url", F.col("bbox").alias("_bbox"), F.col("total_size_bytes").alias("_size"))
    joined = documents.select("url", "kind", "bbox").join(document_sizes(assets), "url", "left").join(entries, "url", "left")
    return joined.select(
        "url", "kind", F.coalesce("bbox", "_bbox").alias("bbox"), F.coalesce("size", "_size").alias("size")
    )


def child_summary(edges: DataFrame) -> DataFrame:
    """Return per document how many children and items it has, and whether all are items."""
    is_item = F.col("kind") == "item"
    return edges.groupBy(F.col("parent").alias("url")).agg(
        F.count("*").alias("children"), F.count_if(is_item).alias("items"), F.bool_and(is_item).alias("only_items")
    )


def has_parquet(files: DataFrame) -> DataFrame:
    """Return per document whether any GeoParquet file with geometry can be added."""
    return files.groupBy("url").agg(
        F.bool_or((F.col("format") == "parquet") & ~F.col("tabular")).alias("has_parquet")
    )


def links_once(links: DataFrame, rel: str) -> DataFrame:
    """Return the links of one relation, once per document and href, in link order."""
    chosen = links.where(F.col("rel") == rel)
    return first_by(chosen, ["url", "href"], ["pos"], ["pos", "title"])


def archive_urls(assets: DataFrame, tile_links: DataFrame) -> DataFrame:
    """Return each document's tile archives once, links before assets: ``(url, href, is_asset, pos)``."""
    linked = tile_links.select("url", "href", F.lit(False).alias("is_asset"), "pos")
    own = assets.where(F.col("format") == "pmtiles").select("url", "href", F.lit(True).alias("is_asset"), "pos")
    both = linked.unionByName(own)
    return first_by(both, ["url", "href"], ["is_asset", "pos"], ["is_asset", "pos"])


def reads_items(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Return the GeoParquet globs nobody can list, with whether the items are read instead."""
    blocked = files.where("is_asset and format = 'parquet' and read_url is null")
    parents = edges.select(F.col("parent").alias("url")).distinct().withColumn("through_items", F.lit(True))
    return blocked.join(parents, "url", "left").select(
        "url", "href", "glob", F.coalesce("through_items", F.lit(False)).alias("through_items")
    )
