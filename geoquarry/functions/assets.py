"""Rules on one asset: its format, its roles, its columns and its labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoquarry.functions import variants
from geoquarry.functions.urls import folder_name, glob_root, is_http_url, last_segment, url_path
from geoquarry.model import GEOMETRY_NAMES

# Format, media type fragment, file name pattern - in the order of the test.
FORMATS = (
    ("pmtiles", "pmtiles", r"(?i)\.pmtiles($|\?)"),
    ("geojson", "geo+json", r"(?i)\.geojson($|\?)"),
    ("cog", "geotiff", r"(?i)\.tiff?($|\?)"),
    ("parquet", "parquet", r"(?i)\.(geo)?parquet($|\?)"),
    ("flatgeobuf", "flatgeobuf", r"(?i)\.fgb($|\?)"),
    ("copc", "copc", r"(?i)\.copc\.la[sz]($|\?)"),
    ("csv", "text/csv", r"(?i)\.csv($|\?)"),
)
# The orders of preference when one file must be picked.
PREFERRED = ("pmtiles", "cog", "copc", "parquet", "flatgeobuf", "geojson", "csv")
VIEWED = ("pmtiles", "cog")
LOADED = ("parquet", "flatgeobuf", "geojson", "csv")
# Roles of assets that hold no data, or data that is not loaded.
SIDECAR_ROLES = ("thumbnail", "overview", "metadata")
UNLOADED_ROLES = ("source", "collection-mirror", "archive")
MIRROR_ROLE = "collection-mirror"
STYLE_MEDIA = "application/vnd.mapbox.style+json"
# Type names of geometry columns in a column listing.
GEOMETRY_TYPES = (
    "geometry", "geography", "wkb", "point", "linestring", "polygon",
    "multipoint", "multilinestring", "multipolygon",
)


# The file name endings of the patterns above, for the usual href without a query.
ENDINGS = {
    "pmtiles": "pmtiles", "geojson": "geojson", "tif": "cog", "tiff": "cog", "parquet": "parquet",
    "geoparquet": "parquet", "fgb": "flatgeobuf", "copc.las": "copc", "copc.laz": "copc", "csv": "csv",
}
_ENDING = r"\.((?:copc\.la[sz])|[a-z]+)$"
_BEFORE_QUERY = r"\.(copc\.la[sz]|pmtiles|geojson|tiff?|(?:geo)?parquet|fgb|csv)(?=$|\?)"


def asset_format(href: Column, media_type: Column) -> Column:
    """Return the format of an http(s) href: by media type, then by file name, else NULL.

    Without a ``?`` only the end of the name can match, so one lookup decides;
    otherwise the foremost format of all endings before a ``?`` or the end.
    Short code matters more than branches here: a generated method beyond 8,000
    bytes is never compiled.
    """
    names = [name for name, _fragment, _pattern in FORMATS]
    known = F.create_map(*(F.lit(part) for pair in ENDINGS.items() for part in pair))
    by_ending = F.try_element_at(known, F.regexp_extract(F.lower(href), _ENDING, 1))
    places = F.create_map(*(F.lit(part) for ending, name in ENDINGS.items() for part in (ending, names.index(name))))
    found = F.regexp_extract_all(F.lower(href), F.lit(_BEFORE_QUERY), F.lit(1))
    first = F.array_min(F.transform(found, lambda ending: F.try_element_at(places, ending)))
    by_pattern = F.get(F.array(*(F.lit(name) for name in names)), first)
    media = F.lower(media_type)
    fragments = F.array(*(F.struct(F.lit(fragment).alias("part"), F.lit(name).alias("name")) for name, fragment, _pattern in FORMATS))
    by_media = F.get(F.filter(fragments, lambda one: media.contains(one["part"])), F.lit(0))["name"]
    by_name = F.when(href.contains("?"), by_pattern).otherwise(by_ending)
    return F.when(is_http_url(href), F.coalesce(F.when(media_type != "", by_media), by_name))


def is_style(roles: Column, media_type: Column) -> Column:
    """Return whether an asset is a map style."""
    media = F.lower(F.coalesce(media_type, F.lit("")))
    return F.array_contains(roles, "style") | media.startswith(STYLE_MEDIA)


def has_role(roles: Column, names: tuple[str, ...]) -> Column:
    """Return whether any of the named roles is present."""
    return F.arrays_overlap(roles, F.array(*(F.lit(name) for name in names)))


def is_data(roles: Column, media_type: Column) -> Column:
    """Return whether an asset holds data: no style, thumbnail, overview or metadata."""
    return ~is_style(roles, media_type) & ~has_role(roles, SIDECAR_ROLES)


def is_loadable(roles: Column, media_type: Column, file_format: Column) -> Column:
    """Return whether a data asset has a known format and is no source, mirror or archive."""
    return is_data(roles, media_type) & file_format.isNotNull() & ~has_role(roles, UNLOADED_ROLES)


def is_geometry_column(column: Column) -> Column:
    """Return whether one entry of a column listing describes a geometry."""
    name = F.lower(F.coalesce(F.try_variant_get(column, "$.name", "string"), F.lit("")))
    kind = F.lower(F.coalesce(F.try_variant_get(column, "$.type", "string"), F.lit("")))
    prefix = "^(" + "|".join(GEOMETRY_TYPES) + ")"
    return variants.object_at(column).isNotNull() & (name.isin(*GEOMETRY_NAMES) | kind.rlike(prefix))


def is_tabular(columns: Column) -> Column:
    """Return whether a column listing is there, not empty, and names no geometry."""
    listed = variants.list_at(columns)
    named = F.when(F.size(listed) > 0, ~F.exists(listed, is_geometry_column))
    return F.coalesce(named, F.lit(False))


def rank_of(file_format: Column, order: tuple[str, ...]) -> Column:
    """Return the place of a format in an order, NULL when it is not there."""
    places = F.create_map(*(F.lit(part) for place, name in enumerate(order, 1) for part in (name, place)))
    return F.try_element_at(places, file_format)


def asset_label(title: Column, key: Column) -> Column:
    """Return the title of an asset, else its key."""
    return F.coalesce(F.nullif(title, F.lit("")), key)


def layer_name(title: Column, glob: Column, href: Column) -> Column:
    """Return the layer name of a GeoParquet file: title, glob folder, or file stem."""
    stem = F.regexp_replace(last_segment(url_path(href)), r"\.parquet$", "")
    return (
        F.when(F.coalesce(title, F.lit("")) != "", title)
        .when(glob.isNotNull(), folder_name(glob_root(glob)))
        .otherwise(stem)
    )
