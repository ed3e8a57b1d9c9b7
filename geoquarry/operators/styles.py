"""Map styles: their tile sources, the layers of each archive, and unique names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import variants
from geoquarry.functions.bindings import let, record
from geoquarry.functions.urls import absolute_href, last_segment, url_path
from geoquarry.operators.ranking import numbered, running_sums

SCHEME = "pmtiles://"
TEMPLATE = r"/\{z\}/\{x\}/\{y\}[^/]*$"
STYLE_VERSION = 8


def parse_styles(files: DataFrame) -> DataFrame:
    """Read style files ``(style, body)``: adds ``raw``, and ``error`` for anything but version 8."""
    parsed = files.withColumn("raw", variants.parse_json(F.col("body")))
    fine = variants.object_at(F.col("raw")).isNotNull() & (
        variants.integer_at(F.col("raw"), "version") == STYLE_VERSION
    )
    return parsed.withColumn(
        "error", F.when(~F.coalesce(fine, F.lit(False)), "Not a map style (version 8)")
    )


def _archive(source: Column, style: Column, fallback: Column) -> Column:
    """Return the archive of one source, NULL when it reads something else."""
    named = variants.member(source, "url")
    tiles = variants.text_at(F.get(variants.list_at(source, "tiles"), F.lit(0)))
    from_tiles = F.when(tiles.startswith(SCHEME), F.regexp_replace(tiles, TEMPLATE, ""))
    unnamed = named.isNull() | (variants.kind_of(named) == "VOID")
    address = F.when(unnamed, from_tiles).otherwise(variants.text_at(source, "url"))

    def resolved(text: Column) -> Column:
        bare = F.regexp_replace(text, "^" + SCHEME, "")
        usable = text.startswith(SCHEME) | F.lower(url_path(text)).endswith(".pmtiles")
        return F.when(usable, absolute_href(bare, style))

    silent = unnamed & from_tiles.isNull() & variants.member(source, "tiles").isNull()
    found = F.when(silent, fallback).otherwise(let(address, lambda text: F.when(text.isNotNull(), resolved(text))))
    return F.when(variants.text_at(source, "type") == "vector", found)


def with_sources(styles: DataFrame) -> DataFrame:
    """Add ``sources``: the archive of each tile source, in style order.

    ``styles`` holds ``(style, body, raw, fallback)``; a source that names no
    address reads ``fallback``.
    """
    fallback = F.col("fallback") if "fallback" in styles.columns else F.lit(None).cast("string")
    entries = F.map_entries(variants.ordered_object(F.col("body"), "$.sources"))
    built = F.transform(
        F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>")),
        lambda entry: record(id=entry["key"], archive=_archive(entry["value"], F.col("style"), fallback)),
    )
    read = styles.where("error is null").select(*(name for name in styles.columns if name != "error"), built.alias("_all"))
    return read.withColumn("sources", F.filter("_all", lambda source: source["archive"].isNotNull())).drop("_all")


def sources_of(styled: DataFrame) -> DataFrame:
    """Return ``(style, pos, source, archive)`` of the tile sources."""
    return styled.select("style", F.posexplode("sources").alias("pos", "found")).select(
        "style", "pos", F.col("found.id").alias("source"), F.col("found.archive").alias("archive")
    )


def split_layers(styled: DataFrame) -> DataFrame:
    """Return each style layer with the archive it reads: ``(style, pos, layer, source, archive)``.

    Background layers go with the first archive. A layer on any other source
    has no archive and is reported as skipped. The lookup happens inside the
    row of the style, so no join moves the layers.
    """
    layers = F.filter(variants.list_at(F.col("raw"), "layers"), lambda layer: variants.object_at(layer).isNotNull())
    exploded = styled.select("style", "sources", F.posexplode(layers).alias("pos", "raw"))
    layer = F.col("raw")
    source = F.try_variant_get(layer, "$.source", "string")
    first = F.get("sources", F.lit(0))["archive"]
    own = F.get(F.filter("sources", lambda item: item["id"] == F.col("source")), F.lit(0))["archive"]
    shaped = exploded.select(
        "style", "pos", variants.text_at(layer, "id").alias("layer"), source.alias("source"), "sources",
        variants.text_at(layer, "type").alias("type"),
    )
    background = F.coalesce(F.col("type") == "background", F.lit(False)) & first.isNotNull()
    return shaped.select("style", "pos", "layer", "source", F.when(background, first).otherwise(own).alias("archive"))


def match_archives(named: DataFrame, archives: DataFrame) -> DataFrame:
    """Match the archives that styles name with a document's own: ``(url, archive, href)``.

    ``named`` holds ``(url, archive)``, ``archives`` ``(url, href)`` per
    document. The same URL wins, else the file name when only one archive has it.
    """
    wanted = named.select("url", "archive").distinct()
    exact = archives.select("url", F.col("href").alias("archive"), F.col("href").alias("_exact")).distinct()
    name = last_segment(url_path(F.col("href")))
    by_name = (
        archives.select("url", "href")
        .distinct()
        .groupBy("url", name.alias("_name"))
        .agg(F.count("*").alias("_count"), F.min("href").alias("_named"))
        .where("_count = 1")
    )
    keyed = wanted.withColumn("_name", last_segment(url_path(F.col("archive"))))
    # Files look smaller than what is read from them: neither side is broadcast by their sizes.
    joined = keyed.join(exact.hint("merge"), ["url", "archive"], "left").join(by_name.hint("merge"), ["url", "_name"], "left")
    return joined.select("url", "archive", F.coalesce("_exact", "_named").alias("href"))


def stray_archives(named: DataFrame, archives: DataFrame) -> DataFrame:
    """Return the archives that styles name and the document does not list."""
    listed = archives.select(F.col("url").alias("_url"), F.col("href").alias("_href")).hint("merge")
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("archive").eqNullSafe(F.col("_href"))
    return named.select("url", "archive").join(listed, same, "left_anti").distinct()


# A name that a repeat may get: another name and a number from 2.
NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,17})\)$"
NUMBERS = r"((?: \((?:[2-9]|[1-9][0-9]{1,17})\))*)$"


def unique_names(rows: DataFrame, keys: list[str], name: str, position: str, reserved: str | None = None) -> DataFrame:
    """Give each row a name of its own in its group, in order: a repeat becomes ``name (2)``.

    A row takes its name if it is free, else the name with the smallest free
    number. A ``reserved`` name counts as taken from the start. ``position``
    is an integer from 0, unique in its group.

    Repeats and rows that are themselves called ``name (n)`` compete for
    numbers. The claims of one name are settled in the order of their
    numbers, names with one number at their end before those with two. Jobs
    are a fixed number for each such step and do not depend on the clashes.
    """
    own = rows.select(*keys, (F.col(position).cast("bigint") + 1).alias("_at"), F.col(name).alias("_own"), F.struct(*(rows[column] for column in rows.columns)).alias("_all"))
    if reserved is not None:
        first = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("_at"), F.lit(reserved).alias("_own"))
        own = own.unionByName(first, allowMissingColumns=True)
    placed = numbered(own, [*keys, "_own"], "_at", alias="_turn", bits=33).checkpoint()
    groups = [*keys, "_base"]
    claims = placed.where(F.col("_own").rlike(NUMBERED) & (F.col("_turn") == 1)).select(
        *keys, "_at", "_own", F.regexp_extract("_own", NUMBERED, 1).alias("_base"),
        F.regexp_extract("_own", NUMBERED, 2).cast("bigint").alias("_slot"),
        F.length(F.regexp_replace(F.regexp_extract("_own", NUMBERS, 1), r"[^(]", "")).alias("_depth"),
    )
    # Only names that some row has can have repeats.
    named = placed.select(*keys, F.col("_own").alias("_base"), "_at")
    claims = _matching(claims, named.select(*groups).distinct(), groups, "left_semi").checkpoint()
    deepest = claims.agg(F.max("_depth")).first()[0] or 0
    settled = None
    for depth in range(1, deepest + 1):
        level = _settled(claims.where(F.col("_depth") == depth), named, settled, keys).checkpoint()
        settled = level if settled is None else settled.unionByName(level)
    if settled is None:
        named_ = placed.withColumn("_number", F.col("_turn"))
    else:
        named_ = _numbers(placed, settled, keys)
    shown = F.when(F.col("_number") < 2, F.col("_own")).otherwise(F.concat("_own", F.lit(" ("), F.col("_number").cast("string"), F.lit(")")))
    return named_.where("_at > 0").select("_all.*", shown.alias("unique_name"))


def _matching(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null on both sides."""
    other = right.select(*(F.col(key).alias(f"_r_{key}") for key in keys), *(name for name in right.columns if name not in keys))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(other, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_r_{key}" for key in keys))


def _settled(claims: DataFrame, named: DataFrame, before: DataFrame | None, keys: list[str]) -> DataFrame:
    """Return ``_base, _own, _free, _won`` of claims on names whose own claims are settled.

    With w claims won on smaller numbers, n - 2 - w smaller numbers go to
    repeats. The claim on n wins if so many repeats did not come before it.
    """
    groups = [*keys, "_base"]
    asked = claims.select(*groups, "_at", "_own", "_slot", F.lit(0).alias("_row"))
    none = [F.lit(None).cast("string").alias("_own"), F.lit(None).cast("bigint").alias("_slot")]
    wanted = _matching(named, claims.select(*groups).distinct(), groups, "left_semi")
    others = wanted.select(*groups, "_at", *none, F.lit(1).alias("_row"))
    counted = running_sums(asked.unionByName(others), groups, "_at", {"_rows": F.col("_row")}, bits=33).where("_row = 0")
    repeats = F.greatest(F.col("_rows") - 1, F.lit(0))
    if before is not None:
        lost = before.where("NOT _won").select(*keys, F.col("_own").alias("_base"), F.lit(1).alias("_lost"))
        counted = _matching(counted, lost, groups, "left")
        repeats = F.when(F.col("_lost") == 1, F.col("_rows")).otherwise(repeats)
    fields = [*groups, "_own", "_slot"]
    lined = counted.select(*fields, repeats.alias("_before")).repartition(*groups).sortWithinPartitions(*groups, "_slot")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, won = None, 0
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in (*groups, "_slot", "_before")}
            free, wins = [], []
            for here, slot, repeats in zip(zip(*(columns[key] for key in groups), strict=True), columns["_slot"], columns["_before"], strict=True):
                if here != group:
                    group, won = here, 0
                free.append(slot - 2 - won)
                wins.append(free[-1] >= repeats)
                won += wins[-1]
            kept = [batch.column(name) for name in (*groups, "_own")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(free, pa.int64()), pa.array(wins, pa.bool_())], [*groups, "_own", "_free", "_won"])

    kinds = dict(lined.dtypes)
    schema = ", ".join(f"`{name}` {kinds[name]}" for name in (*groups, "_own"))
    return lined.mapInArrow(scan, f"{schema}, `_free` bigint, `_won` boolean")


def _numbers(placed: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """Return the number of each row; the k-th repeat passes over the claims that were won below its number."""
    lost = settled.where("NOT _won").select(*keys, "_own", F.lit(1).alias("_lost"))
    turned = _matching(placed, lost, [*keys, "_own"], "left").withColumn("_repeat", F.col("_turn") - 1 + F.coalesce("_lost", F.lit(0)))
    gaps = settled.where("_won").groupBy(*keys, F.col("_base").alias("_own"), F.col("_free")).agg(F.count("*").alias("_passed"))
    names = gaps.select(*keys, "_own").distinct()
    plain = _matching(turned, names, [*keys, "_own"], "left_anti")
    among = _matching(turned, names, [*keys, "_own"], "left_semi").withColumn("_place", 2 * F.col("_repeat") + 1).withColumn("_passed", F.lit(0).cast("bigint"))
    passed = gaps.select(*keys, "_own", "_passed", (2 * (F.col("_free") + 1)).alias("_place"))
    # A gap far beyond all repeats passes over none of them.
    most = among.agg(F.max("_place")).first()[0]
    passed = passed.where(F.col("_place") < F.lit(most))
    lined = among.unionByName(passed, allowMissingColumns=True)
    summed = running_sums(lined, [*keys, "_own"], "_place", {"_over": F.col("_passed")}, bits=35).where("_at IS NOT NULL")
    kept = [*keys, "_at", "_own", "_all"]
    return plain.select(*kept, (F.col("_repeat") + 1).alias("_number")).unionByName(
        summed.select(*kept, F.when(F.col("_repeat") > 0, F.col("_repeat") + 1 + F.col("_over")).otherwise(F.lit(1).cast("bigint")).alias("_number"))
    )
