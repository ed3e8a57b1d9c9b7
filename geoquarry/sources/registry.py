"""The registry of catalogs as rows: its facts, searches and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import extents, variants
from geoquarry.functions.urls import absolute_href, is_http_url
from geoquarry.model import Box, CatalogError
from geoquarry.functions.bindings import let

PAGE = 25
NODE_PAGE = 50


def casefold(text: Column) -> Column:
    """Fold case so that letters with two lower-case forms compare as equal."""
    return F.lower(F.upper(text))


def read_registry(documents: DataFrame, prefix: str) -> DataFrame:
    """Return one row per registered catalog.

    ``documents`` holds ``(url, body)`` of registry documents. ``prefix`` is
    the namespace of the registry's own link keys, with its colon.
    """
    raw = F.col("raw")
    parsed = documents.select("url", variants.parse_json(F.col("body")).alias("raw")).select(
        "url", variants.text_at(raw, "type").alias("kind"), variants.list_at(raw, "links").alias("links")
    )
    checked = parsed.select(
        "url",
        F.when(
            (F.col("kind") == "Catalog") & F.col("links").isNotNull(), F.col("links")
        ).otherwise(F.raise_error(F.lit("The registry is not a catalog with a list of links"))).alias("links"),
    )
    link = F.col("link")
    entries = checked.select("url", F.posexplode("links").alias("pos", "link")).select(
        F.col("url").alias("registry"),
        "pos",
        variants.text_at(link, "rel").alias("rel"),
        let(
            variants.filled_text_at(link, "href"),
            lambda href: F.when(href.isNotNull(), absolute_href(href, F.col("url"))),
        ).alias("href"),
        "link",
    ).where((F.col("rel") == "child") & is_http_url(F.col("href")))

    def text(name: str) -> Column:
        return variants.filled_text_at(link, prefix + name)

    licenses = variants.object_at(link, prefix + "licenses")
    return entries.select(
        "registry",
        "pos",
        F.coalesce(text("id"), F.col("href")).alias("id"),
        F.coalesce(variants.filled_text_at(link, "title"), F.col("href")).alias("title"),
        F.col("href").alias("url"),
        F.coalesce(text("status"), F.lit("unknown")).alias("status"),
        extents.horizontal_box(variants.member(link, "bbox")).alias("bbox"),
        F.coalesce(F.array_sort(F.map_keys(licenses)), F.array().cast("array<string>")).alias("licenses"),
        variants.integer_at(link, prefix + "collection_count").alias("collection_count"),
        variants.integer_at(link, prefix + "feature_count").alias("feature_count"),
        variants.integer_at(link, prefix + "total_size_bytes").alias("total_size_bytes"),
        text("updated").alias("updated"),
        variants.filled_text_at(link, prefix + "logo", "href").alias("logo_url"),
        text("failure_reason").alias("failure_reason"),
    )


def require_registry(documents: DataFrame) -> None:
    """Refuse documents that are no registry before anything is built on them.

    Raises:
        CatalogError: A document is no catalog with a list of links.
    """
    raw = variants.parse_json(F.col("body"))
    fine = F.coalesce((variants.text_at(raw, "type") == "Catalog") & variants.list_at(raw, "links").isNotNull(), F.lit(False))
    if documents.where(~fine).limit(1).count():
        raise CatalogError("The registry is not a catalog with a list of links")


def registered(entries: DataFrame) -> DataFrame:
    """Return the catalogs to which the registry gave an id of their own."""
    return entries.where(F.col("id") != F.col("url"))


def text_matches(text: str) -> Column:
    """Return whether a text occurs in title, id, URL or licenses, ignoring case and outer blanks."""
    needle = text.strip()
    if not needle:
        return F.lit(True)
    hay = F.concat_ws(" ", "title", "id", "url", "licenses")
    return F.contains(casefold(hay), casefold(F.lit(needle)))


def filter_entries(
    entries: DataFrame,
    text: str = "",
    status: str | None = None,
    bbox: Box | None = None,
    ids: list[str] | None = None,
) -> DataFrame:
    """Return the catalogs that match every filter given; an unknown extent is kept."""
    kept = entries.where(text_matches(text))
    if status is not None:
        kept = kept.where(F.col("status") == status)
    if bbox is not None:
        kept = kept.where(extents.plain_overlap(F.col("bbox"), bbox))
    return kept if not ids else kept.where(F.col("id").isin(*ids))


def by_title(entries: DataFrame) -> DataFrame:
    """Return the catalogs by case-folded title, ties in registry order."""
    return entries.orderBy(casefold(F.col("title")), "pos")


def page(entries: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Return one page of the title order, counted from 0."""
    return by_title(entries).offset(number * size).limit(size)


def statuses(entries: DataFrame) -> DataFrame:
    """Return the distinct statuses in order."""
    return entries.select("status").distinct().orderBy("status")
