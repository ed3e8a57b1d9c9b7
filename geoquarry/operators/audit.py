"""Checks over whole catalogs: one row ``(catalog, document, check, ok, detail)`` per check.

What a live audit would fetch is a table here: ``probes`` holds ``(url, size,
head)`` of stored files, ``footers`` what Parquet footers say.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import variants
from geoquarry.functions.urls import last_segment, url_path
from geoquarry.model import GEOMETRY_NAMES
from geoquarry.operators import catalog, styles
from geoquarry.operators.ranking import first_by

CHECK_COLUMNS = ("catalog", "document", "check", "ok", "detail")
DETAIL_LENGTH = 300
PROBE_BYTES = 127
# How image files and tile archives start.
IMAGE_MAGIC = (b"\x89PNG", b"\xff\xd8\xff", b"RIFF", b"GIF8")
ARCHIVE_MAGIC = b"PMTiles"


def checks(rows: DataFrame, check: Column | str, ok: Column, detail: Column) -> DataFrame:
    """Shape rows with ``catalog`` and ``document`` as checks; a detail is one short line."""
    named = F.lit(check) if isinstance(check, str) else check
    line = F.regexp_extract(F.coalesce(detail, F.lit("")), r"^[^\r\n]*", 0)
    return rows.select(
        "catalog",
        "document",
        named.alias("check"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.substring(line, 1, DETAIL_LENGTH).alias("detail"),
    )


def flags(rows: DataFrame, check: Column | str, detail: Column) -> DataFrame:
    """Shape rows as failed checks."""
    return checks(rows, check, F.lit(False), detail)


def read_checks(visited: DataFrame, documents: DataFrame) -> DataFrame:
    """Report documents of a walk that could not be read, and ones served from another URL."""
    seen = visited.select(F.col("root").alias("catalog"), F.col("href").alias("document"), "error")
    unread = flags(seen.where("error is not null"), "read", F.col("error"))
    bases = documents.where("base <> url").select(F.col("url").alias("document"), "base")
    moved = seen.where("error is null").join(bases, "document")
    text = F.concat(F.lit("fetched from "), F.col("base"), F.lit("; hrefs resolve against "), F.col("document"))
    return unread.unionByName(flags(moved, "redirect", text))


def raw_assets(documents: DataFrame) -> DataFrame:
    """Return every entry of the ``assets`` objects, well formed or not: ``(url, key, href)``."""
    entries = documents.where("error is null").select(
        "url", F.explode(variants.ordered_object(F.col("body"), "$.assets")).alias("key", "asset")
    )
    return entries.select("url", "key", F.coalesce(variants.text_at(F.col("asset"), "href"), F.lit("")).alias("href"))


def dropped_assets(raw: DataFrame, assets: DataFrame, within: DataFrame) -> DataFrame:
    """Report the raw assets that the reader left out."""
    lost = raw.join(assets.select("url", "key"), ["url", "key"], "left_anti")
    placed = lost.join(within, "url").withColumnRenamed("url", "document")
    return flags(placed, "asset dropped", F.concat_ws(": ", "key", "href"))


def empty_collections(documents: DataFrame, files: DataFrame, edges: DataFrame, within: DataFrame) -> DataFrame:
    """Report collections with nothing to load and no children."""
    bare = (
        documents.where("kind = 'collection'")
        .select("url")
        .join(files.select("url"), "url", "left_anti")
        .join(edges.select(F.col("parent").alias("url")), "url", "left_anti")
    )
    placed = bare.join(within, "url").withColumnRenamed("url", "document")
    return flags(placed, "no data", F.lit("nothing to load and no items"))


def probe_files(paths: DataFrame) -> DataFrame:
    """Read size and first bytes of stored files: ``(url, path)`` to ``(url, size, head)``."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from geoquarry.sources.object_store import open_input

        for batch in batches:
            sizes, heads = [], []
            for path in batch.column(1).to_pylist():
                try:
                    with open_input(path) as handle:
                        sizes.append(handle.size())
                        heads.append(handle.read(PROBE_BYTES))
                except OSError:
                    sizes.append(None)
                    heads.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())],
                names=["url", "size", "head"],
            )

    return paths.select("url", "path").mapInArrow(probe, "url string, size bigint, head binary")


def probe_verdict(kind: Column) -> tuple[Column, Column]:
    """Return verdict and detail of a probed file from its ``size`` and ``head``."""
    known = F.col("size").isNotNull()
    magic = F.substring(F.col("head"), 1, len(ARCHIVE_MAGIC)) == F.lit(ARCHIVE_MAGIC)
    wrong = F.coalesce((kind == "pmtiles") & ~magic, F.lit(False))
    detail = (
        F.when(~known, "The length of the file is not known")
        .when(wrong, "not a tile archive")
        .otherwise(F.concat(F.col("size").cast("string"), F.lit(" bytes")))
    )
    return known & ~wrong, detail


def target_checks(
    targets: DataFrame,
    blocked: DataFrame,
    probes: DataFrame,
    footers: DataFrame,
    within: DataFrame,
    item_files: DataFrame | None = None,
) -> DataFrame:
    """Check the files to view and to load: probed bytes, Parquet footers, or a glob nobody lists.

    ``targets`` comes from ``pick_targets``, ``blocked`` from ``reads_items``.
    A glob that is read through its items is checked by the footer of the
    first item's file, from ``item_files(document, item_file)``; without such
    a file the check fails.
    """
    placed = targets.join(within, "url").withColumnRenamed("url", "document")
    viewed = placed.where("view_href is not null").select("catalog", "document", F.lit("view").alias("use"), F.col("view_href").alias("url"), F.col("view_format").alias("kind"))
    loaded = placed.where("load_href is not null").select("catalog", "document", F.lit("load").alias("use"), F.col("load_href").alias("url"), F.col("load_format").alias("kind"))
    named = F.concat_ws(" ", "use", "kind")
    globs = blocked.select(F.col("url").alias("document"), F.col("href").alias("url"), "glob", "through_items")
    every = viewed.unionByName(loaded).join(globs, ["document", "url"], "left")
    unlisted = every.where("kind = 'parquet' and through_items = false")
    open_to = every.where("through_items is null or kind <> 'parquet'")
    probed = open_to.where("kind <> 'parquet'").join(probes, "url", "left")
    ok, detail = probe_verdict(F.col("kind"))
    tables = open_to.where("kind = 'parquet'").join(footers.select("url", "geometry", "rows"), "url", "left")
    through = every.where("kind = 'parquet' and through_items").drop("url")
    if item_files is None:
        through = through.withColumn("url", F.lit(None).cast("string"))
    else:
        through = through.join(item_files.select("document", F.col("item_file").alias("url")), "document", "left")
    through = through.join(footers.select("url", "geometry", "rows"), "url", "left")
    tables = tables.unionByName(through.select(*tables.columns))
    return (
        checks(probed, named, ok, detail)
        .unionByName(checks(tables, named, F.col("rows").isNotNull(), footer_detail()))
        .unionByName(flags(unlisted, named, F.concat(F.lit("HTTPS cannot list "), F.col("glob"))))
    )


def footer_detail() -> Column:
    """Return geometry name and row count as the detail of a Parquet check."""
    return F.when(
        F.col("rows").isNotNull(),
        F.concat(F.lit("geometry="), F.coalesce("geometry", F.lit("none")), F.lit(" estimate="), F.col("rows").cast("string")),
    ).otherwise("The footer could not be read")


def footer_geometry(geo: Column, names: Column) -> Column:
    """Return the geometry column that a footer's ``geo`` text or its column names give."""
    primary = variants.text_at(variants.parse_json(geo), "primary_column")
    common = F.get(F.filter(names, lambda name: F.lower(name).isin(*GEOMETRY_NAMES)), F.lit(0))
    return F.when(F.array_contains(names, primary), primary).otherwise(common)


def style_checks(
    documents: DataFrame,
    assets: DataFrame,
    tile_links: DataFrame,
    style_files: DataFrame,
    within: DataFrame,
) -> DataFrame:
    """Check default styles, and that the sources of the chosen style name the document's archives.

    ``style_files`` holds ``(style, body)`` of style files by their href.
    """
    own = catalog.styles_of(assets)
    archives = catalog.archive_urls(assets, tile_links)
    per_style = own.groupBy("url").agg(F.count("*").alias("styles"), F.bool_or("is_default").alias("has_default"))
    per_archive = archives.groupBy("url").agg(F.count("*").alias("archives"), F.min("href").alias("only"))
    facts = (
        documents.where("error is null and kind <> 'catalog'")
        .select("url", "kind")
        .join(within, "url")
        .join(per_style, "url", "left")
        .join(per_archive, "url", "left")
        .withColumnRenamed("url", "document")
    )
    missing = facts.where("kind = 'collection' and archives > 0 and styles is null")
    undecided = facts.where("styles > 1 and not has_default")
    chosen = first_by(own, ["url"], [~F.col("is_default"), F.col("number")], ["href"]).select(
        F.col("url").alias("document"), F.col("href").alias("style")
    )
    picked = facts.join(chosen, "document").select(
        "catalog", "document", "style", F.when(F.col("archives") == 1, F.col("only")).alias("fallback")
    )
    parsed = styles.parse_styles(picked.join(style_files, "style", "left"))
    broken = parsed.where("error is not null")
    styled = styles.with_sources(parsed).select("catalog", "document", "style", "sources")
    named = styled.select("document", F.explode("sources.archive").alias("archive")).distinct()
    stray = styles.stray_archives(named.select(F.col("document").alias("url"), "archive"), archives)
    counts = stray.groupBy(F.col("url").alias("document")).agg(F.count("*").alias("stray"))
    sized = styled.join(counts, "document", "left")
    found = F.size("sources")
    detail = F.when(found == 0, "no tile source in the style").otherwise(
        F.concat(found.cast("string"), F.lit(" sources, "), F.coalesce("stray", F.lit(0)).cast("string"), F.lit(" outside the collection links"))
    )
    return (
        flags(missing, "style", F.lit("tile archives with no style asset"))
        .unionByName(flags(undecided, "style", F.concat(F.col("styles").cast("string"), F.lit(" styles and none has role default"))))
        .unionByName(flags(broken, "style", F.col("error")))
        .unionByName(checks(sized, "style", found > 0, detail))
    )


def thumbnail_checks(documents: DataFrame, assets: DataFrame, probes: DataFrame, within: DataFrame) -> DataFrame:
    """Check that a thumbnail holds image bytes, and that each collection has one."""
    own = catalog.thumbnails(assets).withColumnRenamed("href", "picture")
    asked = documents.where("error is null and kind <> 'catalog'").select("url", "kind").join(within, "url")
    joined = asked.join(own, "url", "left").withColumnRenamed("url", "document")
    missing = joined.where("picture is null and kind = 'collection'")
    probed = joined.where("picture is not null").join(probes.withColumnRenamed("url", "picture"), "picture", "left")
    image = reduce(
        Column.__or__, (F.substring(F.col("head"), 1, len(magic)) == F.lit(magic) for magic in IMAGE_MAGIC)
    )
    detail = F.when(image, F.concat(F.col("size").cast("string"), F.lit(" bytes"))).otherwise("not an image")
    return flags(missing, "thumbnail", F.lit("no thumbnail asset")).unionByName(
        checks(probed, "thumbnail", image, F.coalesce(detail, F.lit("not an image")))
    )


def download_checks(files: DataFrame, within: DataFrame) -> DataFrame:
    """Report manifest paths with a glob or without a file name."""
    name = last_segment(F.col("path"))
    odd = url_path(F.col("url")).rlike(r"[*?\[]") | (name == "") | (name == "index")
    rows = files.where(odd).select(F.col("doc").alias("document"), "url", "path")
    placed = rows.join(within.withColumnRenamed("url", "document"), "document")
    return flags(placed, "download path", F.concat(F.col("url"), F.lit(" -> "), F.col("path")))


def failures_per_check(results: DataFrame) -> DataFrame:
    """Return the failures of each check, most frequent first."""
    counted = results.where(~F.col("ok")).groupBy("check").agg(F.count("*").alias("failures"))
    return counted.orderBy(F.desc("failures"), "check")


def ordered_failures(results: DataFrame) -> DataFrame:
    """Return the failures by check, catalog and document."""
    return results.where(~F.col("ok")).orderBy("check", "catalog", "document")


def report_lines(results: DataFrame) -> DataFrame:
    """Return the Markdown summary as ordered lines ``(part, line)``: totals, counts, failures."""

    def cell(name: str) -> Column:
        return F.replace(F.col(name), F.lit("|"), F.lit("/"))

    totals = results.agg(F.count_if(~F.col("ok")).alias("bad"), F.count("*").alias("every")).select(
        F.lit(0).alias("part"),
        F.lit(0).cast("bigint").alias("rank"),
        F.concat(F.lit("# Catalog audit: "), F.col("bad"), F.lit(" failures in "), F.col("every"), F.lit(" checks")).alias("line"),
    )
    spark = results.sparkSession
    heads = spark.createDataFrame(
        [(1, 0, ""), (1, 1, "| Check | Failures |"), (1, 2, "|---|---|"), (3, 0, ""), (3, 1, "| Catalog | Document | Check | Detail |"), (3, 2, "|---|---|---|---|")],
        "part int, rank bigint, line string",
    )
    counts = failures_per_check(results).select(
        F.lit(2).alias("part"), (-F.col("failures")).alias("rank"), F.concat(F.lit("| "), F.col("check"), F.lit(" | "), F.col("failures").cast("string"), F.lit(" |")).alias("line")
    )
    rows = results.where(~F.col("ok")).select(
        F.lit(4).alias("part"),
        F.lit(0).cast("bigint").alias("rank"),
        F.concat_ws(" | ", F.concat(F.lit("| "), F.col("catalog")), "document", "check", F.concat(cell("detail"), F.lit(" |"))).alias("line"),
        "check",
        "catalog",
        "document",
    )
    none = F.lit(None).cast("string")
    padded = [frame.select("part", "rank", "line", *(none.alias(name) for name in ("check", "catalog", "document"))) for frame in (totals, heads, counts)]
    return reduce(DataFrame.unionByName, [*padded, rows]).orderBy("part", "rank", "check", "catalog", "document", "line")


def write_report(results: DataFrame, folder: str) -> int:
    """Write the checks as JSON and the summary as Markdown lines; return 1 when a check failed."""
    results.write.mode("overwrite").json(f"{folder}/checks")
    stored = results.sparkSession.read.schema(results.schema).json(f"{folder}/checks")
    report_lines(stored).select("line").write.mode("overwrite").text(f"{folder}/summary")
    return 1 if stored.where(~F.col("ok")).limit(1).count() else 0
