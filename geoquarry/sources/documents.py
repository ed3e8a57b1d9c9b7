"""STAC documents as rows, and their links, children and assets as more rows.

Every function takes and returns DataFrames. A document row carries its JSON
text (``body``), the parsed VARIANT (``raw``) and the columns read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.functions import extents, urls, variants
from geoquarry.functions.assets import asset_format, is_data, is_tabular
from geoquarry.functions.bindings import let, record

# The document types of the STAC specification.
KINDS = {"Catalog": "catalog", "Collection": "collection", "Feature": "item"}
COLLECTION_HREF = r"(?i)/collection\.json($|[?#])"
PARQUET_MEDIA = "application/vnd.apache.parquet"
# Sorts the partition asset of a collection behind its declared assets.
LAST_POSITION = 2**31 - 1


def load_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Read JSON files as ``(url, base, body)``, one row per file."""
    files = spark.read.text(list(paths), wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("url"),
        F.lit(None).cast("string").alias("base"),
        F.col("value").alias("body"),
    )


# The members a reader looks at. One parse per document finds them all and
# keeps their JSON types; everything else in the document is skipped.
MEMBERS = (
    "type", "id", "title", "description", "license", "bbox", "extent", "properties", "links",
    "table:columns", "partition:glob",
)
RAW_TYPE = "struct<" + ",".join(f"`{name}`:variant" for name in MEMBERS) + ">"


def read_documents(fetched: DataFrame) -> DataFrame:
    """Read ``(url, base, body)`` rows into document columns.

    ``base`` is the URL after redirects; NULL means the document came from
    ``url`` itself. A row that is no STAC document keeps its URL and gets the
    reason in ``error``; its ``raw`` is NULL.
    """
    parsed = fetched.select(
        "url",
        F.coalesce("base", "url").alias("base"),
        "body",
        F.from_json("body", RAW_TYPE).alias("raw"),
    )
    raw = F.col("raw")
    declared = variants.text(raw["type"])
    mapping = F.create_map(*(F.lit(part) for pair in KINDS.items() for part in pair))
    shaped = parsed.withColumn("kind", F.try_element_at(mapping, declared)).withColumn(
        "error",
        F.when(F.col("body").isNull(), "The document could not be read")
        .when(~F.ltrim("body").startswith("{"), "The link did not return a STAC document")
        .when(
            F.col("kind").isNull(),
            F.concat(
                F.lit("Not a STAC catalog, collection, or item (type is "),
                F.coalesce(declared, F.lit("missing")),
                F.lit(")"),
            ),
        ),
    )
    identifier = F.coalesce(variants.filled_text(raw["id"]), urls.folder_name(F.col("url")))
    known = shaped.withColumn("id", F.when(F.col("error").isNull(), identifier))
    properties = raw["properties"]
    return known.select(
        "url",
        "base",
        "kind",
        "id",
        _when_read(
            F.coalesce(
                variants.filled_text(raw["title"]),
                variants.filled_text_at(properties, "title"),
                F.col("id"),
            )
        ).alias("title"),
        _when_read(
            F.coalesce(
                variants.filled_text(raw["description"]),
                variants.filled_text_at(properties, "description"),
                F.lit(""),
            )
        ).alias("description"),
        _when_read(
            F.when(raw["license"].isNotNull(), variants.text(raw["license"])).otherwise(
                variants.text_at(properties, "license")
            )
        ).alias("license"),
        _when_read(extents.document_box(raw["bbox"], raw["extent"], F.col("kind"))).alias("bbox"),
        "error",
        "body",
        _when_read(raw).alias("raw"),
    )


def _when_read(value: Column) -> Column:
    return F.when(F.col("error").isNull(), value)


def links_of(documents: DataFrame) -> DataFrame:
    """Return the well-formed links: ``(url, base, pos, rel, href, title, type, raw)``."""
    # An unreadable document has a NULL ``raw`` and so no links. A filter on
    # its error would be pushed down and parse every document again.
    exploded = documents.select(
        "url", "base", F.posexplode(variants.list_at(F.col("raw")["links"])).alias("pos", "link")
    )
    link = F.col("link")
    target = variants.member(link, "href")
    usable = F.when(
        variants.kind_of(target).rlike("^(STRING|BIGINT)"),
        F.nullif(F.try_variant_get(target, "$", "string"), F.lit("")),
    )
    return (
        exploded.select(
            "url",
            "base",
            "pos",
            variants.text_at(link, "rel").alias("rel"),
            usable.alias("target"),
            variants.text_at(link, "title").alias("title"),
            variants.text_at(link, "type").alias("type"),
            link.alias("raw"),
        )
        .where("rel is not null and target is not null")
        .select(
            "url",
            "base",
            "pos",
            "rel",
            urls.absolute_href(F.col("target"), F.col("base")).alias("href"),
            "title",
            "type",
            "raw",
        )
    )


def children_of(links: DataFrame) -> DataFrame:
    """Return the edges of the catalog graph: ``(parent, pos, child, kind, title)``."""
    kind = F.when(
        F.col("rel") == "child",
        F.when(F.col("href").rlike(COLLECTION_HREF), "collection").otherwise("catalog"),
    ).otherwise("item")
    return links.where(
        F.col("rel").isin("child", "item") & urls.is_http_url(F.col("href"))
    ).select(
        F.col("url").alias("parent"),
        "pos",
        F.col("href").alias("child"),
        kind.alias("kind"),
        F.coalesce(F.nullif("title", F.lit("")), urls.folder_name(F.col("href"))).alias("title"),
    )


def tile_links(links: DataFrame) -> DataFrame:
    """Return the vector-tile links: ``(url, pos, href, title, layers)``."""
    layers = variants.texts_of(variants.list_at(F.col("raw"), "pmtiles:layers"))
    return links.where((F.col("rel") == "pmtiles") & urls.is_http_url(F.col("href"))).select(
        "url",
        "pos",
        "href",
        "title",
        F.coalesce(layers, F.array().cast("array<string>")).alias("layers"),
    )


def _glob(text: Column, base: Column) -> Column:
    return let(text, lambda glob: F.when(glob.isNotNull(), urls.asset_href(glob, base)))


def assets_of(documents: DataFrame) -> DataFrame:
    """Return the assets of each document in document order.

    Columns: ``url, pos, key, href, title, type, roles, size, checksum,
    format, tabular, glob, read_url``. ``read_url`` is what a scan reads: the
    href, or the bucket form of the glob, NULL when only HTTPS serves it.

    Keys and values are listed inside the row of their document, so the rule
    that looks at all assets of a document needs no join. The rest is read from
    each asset's value after that: only for the columns and rows that are used.
    """
    raw = F.col("raw")
    properties = raw["properties"]
    shared = F.coalesce(
        _unless_null(raw["table:columns"]), variants.member(properties, "table:columns")
    )
    account = variants.text_at(properties, "table:storage_options", "account_name")
    prepared = documents.select(
        "url",
        "base",
        account.alias("account"),
        shared.alias("shared"),
        is_tabular(raw["table:columns"]).alias("shared_tabular"),
        _glob(variants.filled_text(raw["partition:glob"]), F.col("base")).alias("shared_glob"),
        F.when(
            raw.isNotNull(), F.map_entries(variants.ordered_object(F.col("body"), "$.assets"))
        ).alias("entries"),
    )
    listed = F.transform(
        F.coalesce(F.col("entries"), F.array().cast("array<struct<key:string,value:variant>>")),
        lambda entry, place: record(
            pos=place, key=entry["key"], value=entry["value"], text=variants.text_at(entry["value"], "href")
        ),
    )
    context = ["url", "base", "account", "shared", "shared_glob", "shared_tabular"]
    # An address is NULL only where its text is.
    known = prepared.select(*context, F.filter(listed, lambda asset: asset["text"].isNotNull()).alias("own"))
    holds_parquet = F.exists(
        F.col("own"),
        lambda asset: let(
            variants.text_at(asset["value"], "type"),
            lambda media: F.coalesce(asset_format(_asset_address(asset["text"], asset["value"]), media) == "parquet", F.lit(False))
            & is_data(_roles(asset["value"]), media),
        ),
    )
    stand_in = F.array(
        record(
            pos=F.lit(LAST_POSITION), key=F.lit("partition:glob"),
            value=F.lit(None).cast("variant"), text=F.col("shared_glob"),
        )
    )
    every = F.when(
        F.col("shared_glob").isNotNull() & ~holds_parquet, F.concat(F.col("own"), stand_in)
    ).otherwise(F.col("own"))
    return _asset_columns(known.select(*context, F.explode(every).alias("asset")).select(*context, "asset.*"))


def _asset_address(text: Column, value: Column) -> Column:
    """Resolve the address of an asset; its account is looked up only where the address needs one."""
    account = F.coalesce(
        variants.text_at(value, "table:storage_options", "account_name"), F.col("account")
    )
    return urls.asset_href(text, F.col("base"), account)


def _roles(value: Column) -> Column:
    return F.coalesce(variants.texts_of(variants.list_at(value, "roles")), F.array().cast("array<string>"))


def _asset_columns(rows: DataFrame) -> DataFrame:
    """Read the columns of assets; the one at ``LAST_POSITION`` reads its document's own glob.

    Each column is bound on its own: it is left out where nobody asks for it,
    and the generated code stays short enough to be compiled.
    """
    stand_in = F.col("pos") == LAST_POSITION
    own = F.col("value")
    address = F.when(stand_in, F.col("text")).otherwise(_asset_address(F.col("text"), own))
    read = rows.withColumn("href", address).withColumn("media", F.when(stand_in, F.lit(PARQUET_MEDIA)).otherwise(let(own, lambda value: variants.text_at(value, "type"))))
    found = let(record(href=F.col("href"), media=F.col("media")), lambda asset: asset_format(asset["href"], asset["media"]))
    read = read.withColumn("format", F.when(stand_in, F.lit("parquet")).otherwise(found))
    columns = F.coalesce(variants.member(own, "table:columns"), F.col("shared"))
    tabular = let(columns, is_tabular)
    shared = let(F.col("shared_glob"), lambda glob: record(glob=glob, read_url=urls.bucket_url(glob)))
    read = read.withColumn("place", F.when(stand_in, shared).otherwise(_place(own)))
    return read.select(
        "url",
        "pos",
        "key",
        "href",
        F.when(stand_in, F.lit("All partitions")).otherwise(let(own, lambda value: variants.text_at(value, "title"))).alias("title"),
        F.col("media").alias("type"),
        F.when(stand_in, F.array(F.lit("data"))).otherwise(let(own, _roles)).alias("roles"),
        let(own, lambda value: variants.integer_at(value, "file:size")).alias("size"),
        let(own, lambda value: variants.text_at(value, "file:checksum")).alias("checksum"),
        "format",
        F.when(stand_in, F.col("shared_tabular"))
        .otherwise(F.coalesce(F.col("format") == "parquet", F.lit(False)) & tabular)
        .alias("tabular"),
        F.col("place.glob").alias("glob"),
        F.col("place.read_url").alias("read_url"),
    )


def _place(own: Column) -> Column:
    """Return glob and read URL of an asset; a glob nobody can list gives way to the document's own."""
    declared = _glob(variants.filled_text_at(own, "partition:glob"), F.col("base"))

    def place_of(found: Column) -> Column:
        shared = F.col("shared_glob")
        unlisted = found["glob"].isNotNull() & found["url"].isNull() & shared.isNotNull()
        return (
            F.when(unlisted, record(glob=shared, read_url=urls.bucket_url(shared)))
            .when(found["glob"].isNull(), record(glob=found["glob"], read_url=found["href"]))
            .otherwise(record(glob=found["glob"], read_url=found["url"]))
        )

    def placed(asset: Column) -> Column:
        glob = F.coalesce(asset["declared"], F.when(urls.is_glob(asset["href"]), asset["href"]))
        listed = let(glob, lambda text: record(href=asset["href"], glob=text, url=urls.bucket_url(text)))
        return let(listed, place_of)

    return let(record(href=F.col("href"), declared=declared), placed)


def _unless_null(value: Column) -> Column:
    return F.when(variants.kind_of(value) != "VOID", value)
