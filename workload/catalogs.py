"""Catalog rows: URLs, documents, links, assets, registry entries, extents, labels and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import assets as rules
from geoquarry.functions import extents, labels, multihash, urls, variants
from geoquarry.model import Area, Everything, MapView
from geoquarry.operators import audit, catalog, styles, usage
from geoquarry.operators.ranking import numbered
from geoquarry.plans import download
from geoquarry.session import ensure_checkpoints
from geoquarry.sources import documents as docs
from geoquarry.sources import registry as reg
from workload.base import HOST, flag, query, table

# ---- one JSON document per order: self link, icon, tile link, a few assets

ITEM_SQL = f"""item AS (SELECT o_orderkey AS k, '{HOST}/items/' || o_orderkey || '/item.json' AS url, o_orderstatus AS s, o_orderpriority AS p,
  CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8.0 - 180.0 AS x, CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8.0 - 85.0 AS y FROM orders)"""


def order_bodies(spark, folder) -> DataFrame:
    """Return one STAC item per order as ``(url, base, body)``."""
    key = F.col("o_orderkey")
    x = (key * 37 % 2880).cast("double") / 8.0 - 180.0
    y = (key * 53 % 1360).cast("double") / 8.0 - 85.0
    status = F.col("o_orderstatus")
    text = F.lit(None).cast("string")

    def asset(href: str | Column, media: Column = text, roles: Column | None = None, size: Column = F.lit(None).cast("bigint")) -> Column:
        target = F.lit(href) if isinstance(href, str) else href
        listed = roles if roles is not None else F.lit(None).cast("array<string>")
        return F.named_struct(F.lit("href"), target, F.lit("type"), media, F.lit("roles"), listed, F.lit("file:size"), size)

    links = F.array(
        F.struct(F.lit("self").alias("rel"), F.lit("./item.json").alias("href"), text.alias("title")),
        F.struct(F.lit("parent").alias("rel"), F.lit("../../catalog.json").alias("href"), F.lit("Up").alias("title")),
        F.struct(F.lit("icon").alias("rel"), F.when(key % 5 == 0, "i.tif").otherwise("i.png").alias("href"), text.alias("title")),
        F.struct(F.lit("license").alias("rel"), F.lit("/license.txt").alias("href"), F.lit("one").alias("title")),
        F.struct(F.lit("license").alias("rel"), F.lit("/license.txt").alias("href"), F.lit("two").alias("title")),
        F.when(key % 3 == 0, F.struct(F.lit("pmtiles").alias("rel"), F.lit("t.pmtiles").alias("href"), text.alias("title"))),
        F.struct(F.lit("").alias("rel"), F.lit("").alias("href"), text.alias("title")),
    )
    assets = F.struct(
        asset("p.png", roles=F.array(F.when(key % 2 == 0, "overview").otherwise("thumbnail"))).alias("picture"),
        asset("t.pmtiles", size=F.lit(100).cast("bigint")).alias("map"),
        asset(F.concat(F.lit("d."), F.when(status == "F", "tif").when(status == "O", "parquet").otherwise("csv")), size=F.when(status != "P", key)).alias("data"),
        asset("s3://bkt/raw.tif", roles=F.array(F.lit("source"))).alias("raw"),
        asset("a.json", roles=F.array(F.lit("style"))).alias("style-a"),
        asset("b.json", roles=F.when(key % 4 == 0, F.array(F.lit("style"), F.lit("default"))).otherwise(F.array(F.lit("style")))).alias("style-b"),
        F.when(key % 10 == 0, F.named_struct(F.lit("href"), F.lit(7))).alias("broken"),
    )
    body = F.struct(
        F.when(key % 50 == 0, "Thing").otherwise("Feature").alias("type"),
        F.when(key % 7 != 0, F.concat(F.lit("order-"), key)).alias("id"),
        F.when(key % 11 != 0, F.array(x, y, x + 1, y + 1)).alias("bbox"),
        F.struct(F.when(key % 2 == 0, F.col("o_orderpriority")).alias("title"), status.alias("license")).alias("properties"),
        links.alias("links"),
        assets.alias("assets"),
    )
    # Documents arrive as many files; the one small row group of the test table is spread the same way.
    spread = table(spark, folder, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return spread.select(F.concat(F.lit(f"{HOST}/items/"), key, F.lit("/item.json")).alias("url"), text.alias("base"), F.to_json(body).alias("body"))


def read_items(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return documents, links and assets of the order items."""
    read = docs.read_documents(order_bodies(spark, folder))
    return read, docs.links_of(read), docs.assets_of(read)


OK_ITEM = "k % 50 <> 0"


@query("s06_read_documents", f"""WITH {ITEM_SQL}, named AS (SELECT *, CASE WHEN k % 7 <> 0 THEN 'order-' || k ELSE CAST(k AS VARCHAR) END AS id FROM item WHERE {OK_ITEM})
SELECT url, 'item' AS kind, id, CASE WHEN k % 2 = 0 THEN p ELSE id END AS title, s AS license, CASE WHEN k % 11 <> 0 THEN x END AS west, CASE WHEN k % 11 <> 0 THEN y + 1 END AS north, NULL AS error FROM named
UNION ALL SELECT url, NULL, NULL, NULL, NULL, NULL, NULL, 'Not a STAC catalog, collection, or item (type is Thing)' FROM item WHERE k % 50 = 0""")
def s06_read_documents(spark, folder):
    read = docs.read_documents(order_bodies(spark, folder))
    return read.select("url", "kind", "id", "title", "license", F.col("bbox.west").alias("west"), F.col("bbox.north").alias("north"), "error")


@query("f18_well_formed_links", f"""WITH {ITEM_SQL} SELECT rel, href, count(*) AS n FROM (
  SELECT 'self' AS rel, 'item.json' AS href FROM item WHERE {OK_ITEM} UNION ALL SELECT 'parent', 'catalog.json' FROM item WHERE {OK_ITEM}
  UNION ALL SELECT 'icon', CASE WHEN k % 5 = 0 THEN 'i.tif' ELSE 'i.png' END FROM item WHERE {OK_ITEM}
  UNION ALL SELECT 'license', 'license.txt' FROM item, (VALUES (1), (2)) WHERE {OK_ITEM}
  UNION ALL SELECT 'pmtiles', 't.pmtiles' FROM item WHERE {OK_ITEM} AND k % 3 = 0) GROUP BY 1, 2""")
def f18_well_formed_links(spark, folder):
    links = docs.links_of(docs.read_documents(order_bodies(spark, folder)))
    return links.groupBy("rel", urls.last_segment(F.col("href")).alias("href")).agg(F.count("*").alias("n"))


@query("h13_tile_links", f"WITH {ITEM_SQL} SELECT url, '{HOST}/items/' || k || '/t.pmtiles' AS href FROM item WHERE k % 3 = 0 AND {OK_ITEM}")
def h13_tile_links(spark, folder):
    return docs.tile_links(docs.links_of(docs.read_documents(order_bodies(spark, folder)))).select("url", "href")


@query("h12_assets_in_document_order", f"""WITH {ITEM_SQL}, a(pos, key, tail, format) AS (VALUES (0, 'picture', 'p.png', NULL), (1, 'map', 't.pmtiles', 'pmtiles'), (2, 'data', '', ''), (3, 'raw', '', 'cog'), (4, 'style-a', 'a.json', NULL), (5, 'style-b', 'b.json', NULL))
SELECT url, CAST(pos AS BIGINT) AS pos, key, CASE key WHEN 'raw' THEN 'https://bkt.s3.amazonaws.com/raw.tif' WHEN 'data' THEN '{HOST}/items/' || k || '/d.' || CASE s WHEN 'F' THEN 'tif' WHEN 'O' THEN 'parquet' ELSE 'csv' END ELSE '{HOST}/items/' || k || '/' || tail END AS href,
  CASE WHEN key = 'data' THEN CASE s WHEN 'F' THEN 'cog' WHEN 'O' THEN 'parquet' ELSE 'csv' END ELSE format END AS format,
  CASE WHEN key = 'map' THEN 100 WHEN key = 'data' AND s <> 'P' THEN k END AS size FROM item, a WHERE {OK_ITEM}""")
def h12_assets_in_document_order(spark, folder):
    assets = docs.assets_of(docs.read_documents(order_bodies(spark, folder)))
    return assets.select("url", F.col("pos").cast("bigint").alias("pos"), "key", "href", "format", "size")


@query("h12_partition_globs", """SELECT 'land-' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'partition:glob' END AS key,
  CASE WHEN c_custkey % 3 = 0 THEN 's3://own/' || c_custkey || '/*.parquet' ELSE 's3://bkt/' || c_custkey || '/*.parquet' END AS read_url, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 2 END AS BIGINT) AS tabular FROM customer""")
def h12_partition_globs(spark, folder):
    key = F.col("c_custkey")
    own = F.when(key % 3 == 0, F.struct(F.struct(F.concat(F.lit("https://own.s3.amazonaws.com/"), key, F.lit("/*.parquet")).alias("href")).alias("own")))
    columns = F.array(F.struct(F.when(key % 2 == 0, "geometry").otherwise("name").alias("name"), F.lit("binary").alias("type")))
    body = F.struct(F.lit("Collection").alias("type"), F.concat(F.lit("land-"), key).alias("id"), F.concat(F.lit("s3://bkt/"), key, F.lit("/*.parquet")).alias("partition:glob"), columns.alias("table:columns"), F.coalesce(F.to_json(own), F.lit("{}")).alias("assets"))
    text = F.replace(F.replace(F.replace(F.to_json(body), F.lit('"assets":"'), F.lit('"assets":')), F.lit('\\"'), F.lit('"')), F.lit('}"}'), F.lit("}}"))
    rows = table(spark, folder, "customer").select(F.concat(F.lit(f"{HOST}/c/"), key, F.lit("/collection.json")).alias("url"), F.lit(None).cast("string").alias("base"), text.alias("body"))
    read = docs.read_documents(rows)
    assets = docs.assets_of(read).join(read.select("url", "id"), "url")
    return assets.select("id", "key", "read_url", flag(F.col("tabular") & (F.col("key") == "partition:glob")).alias("tabular"))


# ---- assets as a table, from line items

ASSET_SQL = """asset AS (SELECT l_orderkey AS d, l_linenumber AS line, l_linenumber * 10000000000 + l_partkey AS pos, 'https://cat.test/' || l_orderkey || '/' || l_linenumber || '.' ||
    CASE l_partkey % 7 WHEN 0 THEN 'pmtiles' WHEN 1 THEN 'tif' WHEN 2 THEN 'copc.laz' WHEN 3 THEN 'parquet' WHEN 4 THEN 'fgb' WHEN 5 THEN 'geojson' ELSE 'csv' END AS href,
    CASE l_partkey % 7 WHEN 0 THEN 'pmtiles' WHEN 1 THEN 'cog' WHEN 2 THEN 'copc' WHEN 3 THEN 'parquet' WHEN 4 THEN 'flatgeobuf' WHEN 5 THEN 'geojson' ELSE 'csv' END AS format,
    CASE WHEN l_suppkey % 13 = 0 THEN 'style' WHEN l_suppkey % 13 = 1 THEN 'thumbnail' WHEN l_suppkey % 13 = 2 THEN 'source' WHEN l_suppkey % 13 = 3 THEN 'default' ELSE 'data' END AS role,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity * 1000 AS BIGINT) END AS size, l_suppkey % 5 = 0 AS tabular, l_suppkey AS supp,
    CASE WHEN l_suppkey % 4 = 0 THEN 'T' || (l_partkey % 3) END AS title FROM lineitem)"""


def asset_rows(spark, folder) -> DataFrame:
    """Return line items as assets of their order."""
    kind, role = F.col("l_partkey") % 7, F.col("l_suppkey") % 13
    endings = F.array(*(F.lit(v) for v in ("pmtiles", "tif", "copc.laz", "parquet", "fgb", "geojson", "csv")))
    rows = table(spark, folder, "lineitem")
    href = F.concat(F.lit(f"{HOST}/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit("."), F.get(endings, kind.cast("int")))
    named = F.when(role == 0, "style").when(role == 1, "thumbnail").when(role == 2, "source").when(role == 3, "default").otherwise("data")
    media = F.lit(None).cast("string")
    made = rows.select(
        F.concat(F.lit(f"{HOST}/"), "l_orderkey", F.lit("/c.json")).alias("url"), F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 10000000000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("k"), "l_linenumber").alias("key"), href.alias("href"),
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("T"), F.col("l_partkey") % 3)).alias("title"), media.alias("type"),
        F.array(named).alias("roles"), F.when(F.col("l_returnflag") != "R", (F.col("l_quantity") * 1000).cast("bigint")).alias("size"), media.alias("checksum"),
        (F.col("l_suppkey") % 5 == 0).alias("tabular"), media.alias("glob"), href.alias("read_url"), "l_suppkey")
    return made.withColumn("format", rules.asset_format(F.col("href"), F.col("type")))


def no_links(assets: DataFrame) -> DataFrame:
    """Return tile links that name the first file of every third document."""
    return assets.where("line = 1 and d % 3 = 0").select("url", "pos", "href", F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("layers"))


DATA = "role NOT IN ('style', 'thumbnail')"
LOADABLE_SQL = f"""{ASSET_SQL}, tile AS (SELECT d, pos, href FROM asset WHERE line = 1 AND d % 3 = 0),
load AS (SELECT d, 0 AS own, pos, href, 'pmtiles' AS format, 'Vector tiles' AS title, false AS tabular FROM tile UNION ALL
  SELECT d, 1, pos, href, format, coalesce(title, 'k' || line), tabular FROM asset a WHERE {DATA} AND role <> 'source' AND NOT EXISTS (SELECT 1 FROM tile t WHERE t.d = a.d AND t.href = a.href)),
ranked AS (SELECT *, list_position(['pmtiles','cog','copc','parquet','flatgeobuf','geojson','csv'], format) AS pref,
  list_position(['pmtiles','cog'], format) AS view, list_position(['parquet','flatgeobuf','geojson','csv'], format) AS load FROM load)"""


def loadable_rows(spark, folder) -> DataFrame:
    """Return the files that can be added."""
    assets = asset_rows(spark, folder)
    return catalog.loadable(assets, no_links(assets)).withColumn("d", F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint"))


@query("h10_asset_format", f"WITH {ASSET_SQL} SELECT format, count(*) AS n FROM asset GROUP BY 1")
def h10_asset_format(spark, folder):
    return asset_rows(spark, folder).groupBy("format").agg(F.count("*").alias("n"))


@query("f17_role_filters", f"WITH {ASSET_SQL} SELECT d, count(*) AS files, CAST(count(*) FILTER (WHERE role <> 'source') AS BIGINT) AS loaded FROM asset WHERE {DATA} GROUP BY 1")
def f17_role_filters(spark, folder):
    data = catalog.only_data(asset_rows(spark, folder))
    loaded = rules.is_loadable(F.col("roles"), F.col("type"), F.col("format"))
    return data.groupBy("d").agg(F.count("*").alias("files"), F.count_if(loaded).alias("loaded"))


@query("j04_links_replace_assets", f"WITH {LOADABLE_SQL} SELECT d, CAST(own AS BIGINT) AS own, href, title FROM load")
def j04_links_replace_assets(spark, folder):
    return loadable_rows(spark, folder).select("d", flag(F.col("is_asset")).alias("own"), "href", "title")


@query("w03_preferred_file", f"WITH {LOADABLE_SQL} SELECT d, arg_min(href, {{'a': own, 'b': pref, 'c': pos}}) AS href FROM ranked GROUP BY 1")
def w03_preferred_file(spark, folder):
    picked = catalog.preferred_file(loadable_rows(spark, folder))
    return picked.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), "href")


@query("w04_view_and_load", f"""WITH {LOADABLE_SQL} SELECT d, arg_min(href, {{'a': view, 'b': own, 'c': pos}}) FILTER (WHERE view IS NOT NULL) AS view_href,
  arg_min(href, {{'a': load, 'b': own, 'c': pos}}) FILTER (WHERE load IS NOT NULL) AS load_href FROM ranked WHERE view IS NOT NULL OR load IS NOT NULL GROUP BY 1""")
def w04_view_and_load(spark, folder):
    picked = catalog.pick_targets(loadable_rows(spark, folder))
    return picked.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), "view_href", "load_href")


@query("w05_item_file", f"WITH {ASSET_SQL} SELECT d, arg_min(href, {{'a': format <> 'cog', 'b': pos}}) AS href FROM asset WHERE {DATA} AND format IN ('cog', 'parquet') GROUP BY 1")
def w05_item_file(spark, folder):
    picked = catalog.item_hrefs(asset_rows(spark, folder))
    return picked.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), "href")


@query("w06_default_style", f"""WITH {ITEM_SQL} SELECT url, CASE WHEN k % 4 = 0 THEN n ELSE 3 - n END AS number, CASE WHEN n = 1 THEN 'style-b' ELSE 'style-a' END AS key,
  CAST(k % 4 = 0 AND n = 1 AS BIGINT) AS is_default FROM item, (VALUES (1::BIGINT), (2::BIGINT)) v(n) WHERE {OK_ITEM}""")
def w06_default_style(spark, folder):
    ranked = catalog.styles_of(docs.assets_of(docs.read_documents(order_bodies(spark, folder))))
    return ranked.select("url", "number", "key", flag(F.col("is_default")).alias("is_default"))


@query("w07_icon_and_thumbnail", f"""WITH {ITEM_SQL} SELECT url, CASE WHEN k % 5 <> 0 THEN '{HOST}/items/' || k || '/i.png' END AS icon, '{HOST}/items/' || k || '/p.png' AS thumbnail FROM item WHERE {OK_ITEM}""")
def w07_icon_and_thumbnail(spark, folder):
    _read, links, assets = read_items(spark, folder)
    icons = catalog.icons(links).withColumnRenamed("href", "icon")
    return catalog.thumbnails(assets).join(icons, "url", "left").select("url", "icon", F.col("href").alias("thumbnail"))


@query("a08_document_size", f"WITH {ASSET_SQL} SELECT d, CAST(sum(size) AS BIGINT) AS size FROM asset GROUP BY 1")
def a08_document_size(spark, folder):
    sizes = catalog.document_sizes(asset_rows(spark, folder))
    return sizes.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), "size")


@query("a10_document_flags", f"WITH {LOADABLE_SQL} SELECT d, CAST(bool_or(format = 'parquet' AND NOT tabular) AS BIGINT) AS has_parquet FROM load GROUP BY 1")
def a10_document_flags(spark, folder):
    found = catalog.has_parquet(loadable_rows(spark, folder))
    return found.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), flag(F.col("has_parquet")).alias("has_parquet"))


@query("a10_only_items", "SELECT c_nationkey AS parent, count(*) AS children, CAST(count(*) FILTER (WHERE c_acctbal < 5000) AS BIGINT) AS items, CAST(bool_and(c_acctbal < 5000) AS BIGINT) AS only_items FROM customer GROUP BY 1")
def a10_only_items(spark, folder):
    edges = table(spark, folder, "customer").select(F.col("c_nationkey").alias("parent"), F.when(F.col("c_acctbal") < 5000, "item").otherwise("collection").alias("kind"))
    return catalog.child_summary(edges).select(F.col("url").alias("parent"), "children", "items", flag(F.col("only_items")).alias("only_items"))


@query("u01_first_mention_of_hrefs", "SELECT '/p/' || l_partkey AS href, min(CAST(l_orderkey * 10 + l_linenumber AS BIGINT)) AS pos FROM lineitem GROUP BY 1")
def u01_first_mention_of_hrefs(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("/p/"), "l_partkey").alias("href"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return rows.groupBy("href").agg(F.min("pos").alias("pos"))


@query("u02_hrefs_in_both", f"WITH {ASSET_SQL} SELECT DISTINCT d, href FROM asset WHERE line = 1 AND d % 3 = 0")
def u02_hrefs_in_both(spark, folder):
    assets = asset_rows(spark, folder)
    both = catalog.tile_duplicates(assets, no_links(assets))
    return both.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), "href")


@query("u04_archives_of_links_and_assets", f"WITH {ASSET_SQL} SELECT d, href FROM asset WHERE line = 1 AND d % 3 = 0 UNION SELECT d, href FROM asset WHERE format = 'pmtiles'")
def u04_archives_of_links_and_assets(spark, folder):
    assets = asset_rows(spark, folder)
    found = catalog.archive_urls(assets, no_links(assets))
    return found.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), "href")


@query("u05_links_of_one_relation", f"WITH {ITEM_SQL} SELECT url, '{HOST}/license.txt' AS href, 'one' AS title FROM item WHERE {OK_ITEM}")
def u05_links_of_one_relation(spark, folder):
    return catalog.links_once(docs.links_of(docs.read_documents(order_bodies(spark, folder))), "license").select("url", "href", "title")


@query("j11_dropped_assets", f"WITH {ITEM_SQL} SELECT url, 'broken' AS key FROM item WHERE k % 10 = 0 AND {OK_ITEM}")
def j11_dropped_assets(spark, folder):
    read = docs.read_documents(order_bodies(spark, folder))
    return audit.raw_assets(read).join(docs.assets_of(read).select("url", "key"), ["url", "key"], "left_anti").select("url", "key")


@query("f21_assets_to_clip", f"WITH {LOADABLE_SQL} SELECT d, href FROM load WHERE own = 1 AND format = 'parquet' AND NOT tabular")
def f21_assets_to_clip(spark, folder):
    return download.assets_to_clip(loadable_rows(spark, folder), MapView((0.0, 0.0, 1.0, 1.0))).select("d", "href")


# ---- registry

REGISTRY_SQL = """entry AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 9 = 0 THEN 'https://reg.test/' || s_suppkey || '/catalog.json' ELSE 'cat-' || s_suppkey END AS id, s_name || ' of ' || n_name AS title,
  'https://reg.test/' || s_suppkey || '/catalog.json' AS url, CASE s_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'unknown' END AS status,
  CASE WHEN s_suppkey % 6 = 0 THEN 'CC0-1.0 ODbL-1.0' WHEN s_suppkey % 6 = 1 THEN 'CC-BY-4.0' ELSE '' END AS licenses,
  CASE WHEN s_suppkey % 10 <> 0 THEN CAST((s_suppkey * 7) % 340 - 170 AS DOUBLE) END AS west, CAST((s_suppkey * 11) % 160 - 80 AS DOUBLE) AS south,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 40 AS BIGINT) END AS collections FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def registry_rows(spark, folder) -> DataFrame:
    """Return suppliers as registry entries, read from registry documents of up to 50 links."""
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    west, south = (key * 7 % 340 - 170).cast("double"), (key * 11 % 160 - 80).cast("double")
    both = F.struct(F.lit(1).alias("ODbL-1.0"), F.lit(1).alias("CC0-1.0"), F.lit(None).cast("int").alias("CC-BY-4.0"))
    by = F.struct(F.lit(None).cast("int").alias("ODbL-1.0"), F.lit(None).cast("int").alias("CC0-1.0"), F.lit(1).alias("CC-BY-4.0"))
    link = F.struct(
        F.lit("child").alias("rel"), F.concat(F.lit("../"), key, F.lit("/catalog.json")).alias("href"), F.concat("s_name", F.lit(" of "), "n_name").alias("title"),
        F.when(key % 10 != 0, F.array(west, south, west + 5, south + 5)).alias("bbox"), F.when(key % 9 != 0, F.concat(F.lit("cat-"), key)).alias("g_registry:id"),
        F.when(key % 3 == 0, "ok").when(key % 3 == 1, "failed").otherwise("").alias("g_registry:status"),
        F.when(key % 6 == 0, both).when(key % 6 == 1, by).alias("g_registry:licenses"), F.when(key % 4 != 0, key % 40).alias("g_registry:collection_count"), (key * 1000).alias("g_registry:total_size_bytes"))
    blocks = rows.select(F.floor((key - 1) / 50).alias("block"), link.alias("link")).groupBy("block").agg(F.collect_list("link").alias("links"))
    body = F.to_json(F.struct(F.lit("Catalog").alias("type"), "links"))
    read = blocks.select(F.lit("https://reg.test/exports/catalogs.json").alias("url"), body.alias("body"))
    found = reg.read_registry(read, "g_registry:")
    return found.withColumn("pos", F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint"))


@query("s07_read_registry", f"WITH {REGISTRY_SQL} SELECT id, title, url, status, licenses, west, collections, pos * 1000 AS size FROM entry")
def s07_read_registry(spark, folder):
    return registry_rows(spark, folder).select("id", "title", "url", "status", F.array_join("licenses", " ").alias("licenses"), F.col("bbox.west").alias("west"), F.col("collection_count").alias("collections"), F.col("total_size_bytes").alias("size"))


@query("f15_registry_text", f"WITH {REGISTRY_SQL} SELECT id FROM entry WHERE contains(lower(title || ' ' || id || ' ' || url || ' ' || licenses), 'odbl') OR contains(lower(title || ' ' || id || ' ' || url || ' ' || licenses), 'of ja')")
def f15_registry_text(spark, folder):
    entries = registry_rows(spark, folder)
    return entries.where(reg.text_matches(" ODbL ") | reg.text_matches("OF Ja")).select("id")


@query("f16_registry_filters", f"WITH {REGISTRY_SQL} SELECT id, CAST(id <> url AS BIGINT) AS registered FROM entry WHERE status = 'ok' AND (west IS NULL OR (west <= 60 AND west + 5 >= -100 AND south <= 50 AND south + 5 >= -50))")
def f16_registry_filters(spark, folder):
    kept = reg.filter_entries(registry_rows(spark, folder), "", "ok", (-100.0, -50.0, 60.0, 50.0))
    return kept.select("id", flag(F.col("id") != F.col("url")).alias("registered"))


@query("l03_registry_order", f"WITH {REGISTRY_SQL} SELECT id, CAST(row_number() OVER (ORDER BY lower(title), pos) AS BIGINT) AS place FROM entry")
def l03_registry_order(spark, folder):
    ensure_checkpoints(spark)
    seated = reg.by_title(registry_rows(spark, folder)).select("id", F.monotonically_increasing_id().alias("seat")).checkpoint()
    return numbered(seated, [], "seat", alias="place", bits=64).select("id", "place")


@query("l06_page", f"WITH {REGISTRY_SQL} SELECT id FROM entry ORDER BY lower(title), pos LIMIT 25 OFFSET 50")
def l06_page(spark, folder):
    return reg.page(registry_rows(spark, folder), 2).select("id")


@query("a11_statuses", f"WITH {REGISTRY_SQL} SELECT status, count(*) AS shown, (SELECT count(*) FROM entry) AS total FROM entry GROUP BY 1")
def a11_statuses(spark, folder):
    entries = registry_rows(spark, folder)
    shown = entries.groupBy("status").agg(F.count("*").alias("shown"))
    total = entries.agg(F.count("*").alias("total")).first().total
    return reg.statuses(entries).join(shown, "status").withColumn("total", F.lit(total).cast("bigint"))


@query("j03_registry_facts", f"""WITH {REGISTRY_SQL}, doc AS (SELECT DISTINCT l_suppkey FROM lineitem), size AS (SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag <> 'R' AND l_suppkey % 2 = 0 THEN CAST(l_quantity * 1000 AS BIGINT) END) AS BIGINT) AS size FROM lineitem GROUP BY 1)
SELECT d.l_suppkey AS d, CASE WHEN d.l_suppkey % 3 = 0 THEN 1.0 ELSE west END AS west, coalesce(s.size, CAST(e.pos * 1000 AS BIGINT)) AS size FROM doc d LEFT JOIN size s USING (l_suppkey) LEFT JOIN entry e ON e.pos = d.l_suppkey""")
def j03_registry_facts(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("url", F.concat(F.lit("https://reg.test/"), "l_suppkey", F.lit("/catalog.json")))
    own = extents.box(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0))
    documents = rows.select("url", "l_suppkey").distinct().select("url", F.lit("catalog").alias("kind"), F.when(F.col("l_suppkey") % 3 == 0, own).alias("bbox"))
    assets = rows.select("url", F.when((F.col("l_returnflag") != "R") & (F.col("l_suppkey") % 2 == 0), (F.col("l_quantity") * 1000).cast("bigint")).alias("size"))
    facts = catalog.document_facts(documents, assets, registry_rows(spark, folder))
    return facts.select(F.regexp_extract("url", "/([0-9]+)/", 1).cast("bigint").alias("d"), F.col("bbox.west").alias("west"), "size")


# ---- extents

BOX_SQL = """box AS (SELECT p_partkey AS k, p_partkey % 13 = 0 AS nobox, CAST((p_partkey * 17) % 360 - 180 AS DOUBLE) AS west, CAST((p_partkey * 5) % 150 - 75 AS DOUBLE) AS south,
  CASE WHEN p_partkey % 11 = 0 THEN CAST((p_partkey * 17) % 360 - 180 AS DOUBLE) - 1 - p_size ELSE CAST((p_partkey * 17) % 360 - 180 AS DOUBLE) + p_size END AS rawe, CAST((p_partkey * 5) % 150 - 75 AS DOUBLE) + p_size / 2.0 AS north FROM part),
ext AS (SELECT k, nobox, west, south, CASE WHEN rawe < -180 THEN -180.0 WHEN rawe > 180 THEN rawe - 360 ELSE rawe END AS east, north FROM box)"""


def extent_rows(spark, folder) -> DataFrame:
    """Return parts as extents; some cross 180 degrees, some are NULL."""
    key = F.col("p_partkey")
    west, south = (key * 17 % 360 - 180).cast("double"), (key * 5 % 150 - 75).cast("double")
    raw = F.when(key % 11 == 0, west - 1 - F.col("p_size")).otherwise(west + F.col("p_size"))
    east = F.when(raw < -180, -180.0).when(raw > 180, raw - 360).otherwise(raw)
    made = extents.box(west, south, east, south + F.col("p_size") / 2.0)
    return table(spark, folder, "part").select(key.alias("k"), F.when(key % 13 != 0, made).alias("bbox"))


def _meets(west: float, south: float, east: float, north: float) -> str:
    parts = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    tests = [f"((west <= east AND west <= {b} AND east >= {a}) OR (west > east AND (west <= {b} OR east >= {a})))" for a, b in parts]
    return f"(nobox OR (south <= {north} AND north >= {south} AND ({' OR '.join(tests)})))"


@query("f13_extent_meets_scope", f"""WITH {BOX_SQL} SELECT k, CAST({_meets(-20, -30, 40, 30)} AS BIGINT) AS view, CAST({_meets(150, -60, -150, 60)} AS BIGINT) AS across,
  CAST({_meets(170, -20, -170, 20)} AS BIGINT) AS wrapped, CAST(1 AS BIGINT) AS everything FROM ext""")
def f13_extent_meets_scope(spark, folder):
    box = F.col("bbox")
    scopes = {"view": Area("POLYGON((-20 -30, 40 -30, 40 30, -20 -30))", (-20, -30, 40, 30)), "across": MapView((150, -60, -150, 60)), "wrapped": MapView((170, -20, 190, 20)), "everything": Everything()}
    return extent_rows(spark, folder).select("k", *(flag(extents.meets_scope(box, scope)).alias(name) for name, scope in scopes.items()))


@query("f13_extents_of_two_columns", f"""WITH {BOX_SQL} SELECT a.k, CAST(count(*) AS BIGINT) AS met FROM ext a JOIN ext b ON b.k = a.k + 1
  WHERE a.nobox OR b.nobox OR (a.south <= b.north AND a.north >= b.south AND (
    (a.west <= a.east AND b.west <= b.east AND a.west <= b.east AND a.east >= b.west) OR (a.west > a.east AND b.west > b.east)
    OR (a.west > a.east AND b.west <= b.east AND (b.east >= a.west OR b.west <= a.east)) OR (a.west <= a.east AND b.west > b.east AND (a.east >= b.west OR a.west <= b.east)))) GROUP BY 1""")
def f13_extents_of_two_columns(spark, folder):
    rows = extent_rows(spark, folder)
    other = rows.select((F.col("k") - 1).alias("k"), F.col("bbox").alias("other"))
    met = rows.join(other, "k").where(extents.boxes_meet(F.col("bbox"), F.col("other")))
    return met.groupBy("k").agg(F.count("*").alias("met"))


@query("h15_split_and_eastward", f"""WITH {BOX_SQL} SELECT k, CASE WHEN west < 0 THEN west + 360 ELSE west END AS moved,
  CASE WHEN west + 200 > 180 THEN greatest(west, -180.0) END AS split_west, CASE WHEN west + 200 > 180 THEN west + 200 - 360 END AS split_east FROM ext WHERE NOT nobox""")
def h15_split_and_eastward(spark, folder):
    from geoquarry.functions.bindings import record

    west = F.col("bbox.west")
    wide = record(west=west, south=F.col("bbox.south"), east=west + 200, north=F.col("bbox.north"))
    rows = extent_rows(spark, folder).where("bbox is not null").select("k", extents.eastward(west).alias("moved"), extents.split_box(wide).alias("s"))
    return rows.select("k", "moved", F.col("s.west").alias("split_west"), F.col("s.east").alias("split_east"))


@query("h15_clip_polygons", f"WITH {BOX_SQL} SELECT k, CASE WHEN west > east THEN 2 ELSE 1 END AS parts FROM ext WHERE NOT nobox")
def h15_clip_polygons(spark, folder):
    text = extents.clip_text(F.col("bbox"))
    parts = F.size(F.split(text, r"\)\),\(\("))
    return extent_rows(spark, folder).where("bbox is not null").select("k", parts.alias("parts"))


@query("h16_clamped_boxes", f"""WITH {BOX_SQL} SELECT k, greatest(west - 30, -180.0) AS west, least(north + 40, 90.0) AS north, greatest(south - 30, -85.051129) AS tile_south,
  CAST(greatest(0.0, least(east, 60.0) - greatest(west, 40.0)) * greatest(0.0, least(north, 20.0) - greatest(south, 0.0)) >= 20.0 * 20.0 * 0.8 AS BIGINT) AS fills FROM ext WHERE NOT nobox AND west <= east""")
def h16_clamped_boxes(spark, folder):
    from geoquarry.functions.bindings import record

    box = F.col("bbox")
    wide = record(west=box["west"] - 30, south=box["south"] - 30, east=box["east"] + 30, north=box["north"] + 40)
    rows = extent_rows(spark, folder).where("bbox is not null and bbox.west <= bbox.east")
    return rows.select("k", extents.world_box(wide)["west"].alias("west"), extents.world_box(wide)["north"].alias("north"), extents.tile_bounds(wide)["south"].alias("tile_south"), flag(extents.covers_view(box, (40.0, 0.0, 60.0, 20.0))).alias("fills"))


@query("w10_longitude_jumps", f"WITH {BOX_SQL} SELECT k, CAST(abs(east - west) > 180 AS BIGINT) AS jumps, CAST(east + 100 > 180 OR west + 100 > 180 OR abs(east - west) > 180 AS BIGINT) AS crosses FROM ext WHERE NOT nobox")
def w10_longitude_jumps(spark, folder):
    ring = F.array("bbox.west", "bbox.west", "bbox.east")
    moved = F.array(F.col("bbox.west") + 100, F.col("bbox.west") + 100, F.col("bbox.east") + 100)
    rows = extent_rows(spark, folder).where("bbox is not null")
    return rows.select("k", flag(extents.longitudes_jump(ring)).alias("jumps"), flag(extents.crosses_antimeridian(moved, projected=True)).alias("crosses"))


# ---- urls, json and labels

@query("h01_joined_links", """SELECT page_id, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT href) AS BIGINT) AS hrefs FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def h01_joined_links(spark, folder):
    anchors = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)"'), F.lit(1))).alias("href")
    rows = table(spark, folder, "pages").select("page_id", "url", anchors)
    joined = rows.select("page_id", urls.absolute_href(F.col("href"), F.col("url")).alias("href"))
    return joined.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("hrefs"))


@query("h01_item_addresses", f"""WITH {ITEM_SQL} SELECT url, 'self' AS rel, url AS href FROM item WHERE {OK_ITEM} UNION ALL SELECT url, 'parent', '{HOST}/catalog.json' FROM item WHERE {OK_ITEM}
UNION ALL SELECT url, 'icon', '{HOST}/items/' || k || CASE WHEN k % 5 = 0 THEN '/i.tif' ELSE '/i.png' END FROM item WHERE {OK_ITEM} UNION ALL SELECT url, 'license', '{HOST}/license.txt' FROM item, (VALUES (1), (2)) WHERE {OK_ITEM}
UNION ALL SELECT url, 'pmtiles', '{HOST}/items/' || k || '/t.pmtiles' FROM item WHERE {OK_ITEM} AND k % 3 = 0""")
def h01_item_addresses(spark, folder):
    return docs.links_of(docs.read_documents(order_bodies(spark, folder))).select("url", "rel", "href")


@query("h01_dotted_paths", "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/a/c/d' || page_id || '.json?v=1' AS href FROM pages")
def h01_dotted_paths(spark, folder):
    relative = F.concat(F.lit("/a/b/../c/./d"), "page_id", F.lit(".json?v=1"))
    return table(spark, folder, "pages").select("page_id", urls.absolute_href(relative, F.col("url")).alias("href"))


@query("h02_asset_addresses", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'https://bkt' || c_custkey || '.s3.amazonaws.com/a/b.tif' WHEN 1 THEN 'https://storage.googleapis.com/bkt' || c_custkey || '/a.tif'
  WHEN 2 THEN 'https://acc.blob.core.windows.net/cont' || c_custkey || '/x.csv' ELSE 'https://s3.us-west-2.amazonaws.com/us-west-2.open' || c_custkey || '/k' END AS href FROM customer""")
def h02_asset_addresses(spark, folder):
    key = F.col("c_custkey")
    stored = F.when(key % 4 == 0, F.concat(F.lit("s3://bkt"), key, F.lit("/a/b.tif"))).when(key % 4 == 1, F.concat(F.lit("gs://bkt"), key, F.lit("/a.tif"))).when(
        key % 4 == 2, F.concat(F.lit("abfs://cont"), key, F.lit("/x.csv"))).otherwise(F.concat(F.lit("s3://us-west-2.open"), key, F.lit("/k")))
    return table(spark, folder, "customer").select(key.alias("k"), urls.asset_href(stored, f"{HOST}/c.json", "acc").alias("href"))


@query("h03_bucket_addresses", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 's3://b' || c_custkey || '/x/*.parquet' WHEN 1 THEN 'gs://b' || c_custkey || '/y' WHEN 2 THEN 's3://my.b/' || c_custkey END AS href FROM customer""")
def h03_bucket_addresses(spark, folder):
    key = F.col("c_custkey")
    href = F.when(key % 4 == 0, F.concat(F.lit("https://b"), key, F.lit(".s3.eu-west-1.amazonaws.com/x/*.parquet"))).when(key % 4 == 1, F.concat(F.lit("https://storage.googleapis.com/b"), key, F.lit("/y"))).when(
        key % 4 == 2, F.concat(F.lit("https://s3.amazonaws.com/my.b/"), key)).otherwise(F.concat(F.lit("https://other.test/"), key))
    return table(spark, folder, "customer").select(key.alias("k"), urls.bucket_url(href).alias("href"))


@query("h04_http_and_images", """SELECT page_id, CAST(regexp_matches(url, '^https?://[^/?#]+') AS BIGINT) AS http, CAST(page_id % 3 = 0 OR page_id % 3 = 2 AS BIGINT) AS image FROM pages""")
def h04_http_and_images(spark, folder):
    key = F.col("page_id")
    href = F.concat(F.lit("https://h/"), key, F.when(key % 3 == 0, ".PNG?x").otherwise(".tif"))
    media = F.when(key % 3 == 2, "image/webp").when(key % 3 == 1, "image/tiff; x")
    return table(spark, folder, "pages").select("page_id", flag(urls.is_http_url(F.col("url"))).alias("http"), flag(urls.is_image(href, media)).alias("image"))


@query("h05_globs", "SELECT o_orderstatus AS s, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) AS globs, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 's3://b/' || o_orderkey % 100 END) AS roots FROM orders GROUP BY 1")
def h05_globs(spark, folder):
    key = F.col("o_orderkey")
    href = F.concat(F.lit("s3://b/"), key % 100, F.when(key % 2 == 0, "/year=*/p-[0-9].parquet").otherwise("/x?y=*"))
    rows = table(spark, folder, "orders").select("o_orderstatus", href.alias("href"))
    return rows.groupBy(F.col("o_orderstatus").alias("s")).agg(F.count_if(urls.is_glob(F.col("href"))).alias("globs"), F.countDistinct(F.when(urls.is_glob(F.col("href")), urls.glob_root(F.col("href")))).alias("roots"))


@query("h06_names_and_extensions", "SELECT c_custkey AS k, 'land use ' || c_custkey AS folder, 'json' AS ext FROM customer")
def h06_names_and_extensions(spark, folder):
    href = F.concat(F.lit(f"{HOST}/a/land%20use%20"), "c_custkey", F.lit("/collection.JSON?x=.y"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), urls.folder_name(href).alias("folder"), urls.url_extension(href).alias("ext"))


@query("h07_viewer_pages", """SELECT page_id, 'https://viewer.test/#/external/' || CASE WHEN url LIKE 'http:%' THEN 'http:/' ELSE '' END ||
  regexp_replace(regexp_replace(split_part(url, '#', 1), '^https?://', ''), '^([^/]*)$', '\\1/') AS page FROM pages""")
def h07_viewer_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.browser_url(F.col("url"), "https://viewer.test/").alias("page"))


@query("h08_local_paths", """SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a_' || c_custkey || '/c.parquet' ELSE '_external/other.test/x/' || c_custkey || '.tif' END AS path,
  CASE WHEN c_custkey % 2 = 0 THEN 'a_' || c_custkey || '/c.clip' ELSE '_external/other.test/x/' || c_custkey || '.tif.clip' END AS clipped FROM customer""")
def h08_local_paths(spark, folder):
    key = F.col("c_custkey")
    url = F.when(key % 2 == 0, F.concat(F.lit(f"{HOST}/data/../a%20"), key, F.lit("//c.parquet"))).otherwise(F.concat(F.lit("https://other.test/x/"), key, F.lit(".tif")))
    root = f"{HOST}/catalog.json"
    # The first kind climbs out of /data and lands below the root again.
    tidy = F.regexp_replace(url, "/data/\\.\\./", "/")
    return table(spark, folder, "customer").select(key.alias("k"), urls.local_path(tidy, root).alias("path"), urls.clipped_path(tidy, root, ".clip").alias("clipped"))


@query("h09_paths_stay_inside", "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '/t/a/' || c_custkey WHEN 1 THEN '/t/' || c_custkey END AS target FROM customer")
def h09_paths_stay_inside(spark, folder):
    key = F.col("c_custkey")
    path = F.when(key % 3 == 0, F.concat(F.lit("a/./"), key)).when(key % 3 == 1, F.concat(F.lit("a/../"), key)).otherwise(F.concat(F.lit("a/../../"), key))
    return table(spark, folder, "customer").select(key.alias("k"), urls.target_path("/t", path).alias("target"))


@query("f19_blocked_extensions", f"WITH {ASSET_SQL} SELECT CAST(format NOT IN ('cog', 'parquet') AS BIGINT) AS blocked, count(*) AS n FROM asset GROUP BY 1")
def f19_blocked_extensions(spark, folder):
    return asset_rows(spark, folder).groupBy(flag(urls.extension_blocked(F.col("href"), ".TIF,.parquet")).alias("blocked")).agg(F.count("*").alias("n"))


@query("h11_tabular_listings", "SELECT p_partkey AS k, CAST(p_partkey % 3 = 1 AS BIGINT) AS tabular FROM part")
def h11_tabular_listings(spark, folder):
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, '[{"name": "id", "type": "int"}, {"name": "Shape", "type": "binary"}]').when(key % 3 == 1, '[{"name": "id", "type": "int"}]').otherwise("[]")
    return table(spark, folder, "part").select(key.alias("k"), flag(rules.is_tabular(variants.parse_json(text))).alias("tabular"))


@query("h14_boxes_from_json", "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS DOUBLE) END AS west, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size + 3 AS DOUBLE) WHEN 1 THEN CAST(p_size + 4 AS DOUBLE) WHEN 2 THEN CAST(p_size + 3 AS DOUBLE) END AS north FROM part")
def h14_boxes_from_json(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    flat = F.concat(F.lit("["), size, F.lit(",1,9,"), size + 3, F.lit("]"))
    deep = F.concat(F.lit("["), size, F.lit(",1,0,9,"), size + 4, F.lit(",5]"))
    real = F.concat(F.lit("["), size, F.lit(".0,1,9e0,"), size + 3, F.lit("]"))
    text = F.when(key % 4 == 0, flat).when(key % 4 == 1, deep).when(key % 4 == 2, real).otherwise(F.concat(F.lit("["), size, F.lit(",1,true,4]")))
    return table(spark, folder, "part").select(key.alias("k"), extents.horizontal_box(variants.parse_json(text)).alias("b")).select("k", F.col("b.west").alias("west"), F.col("b.north").alias("north"))


@query("h19_json_guards", "SELECT event_id, CAST(event_id % 7 <> 0 AND json_valid(props) AS BIGINT) AS valid, CASE WHEN event_id % 7 <> 0 THEN user_id END AS n FROM events")
def h19_json_guards(spark, folder):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{oops"), "props")).otherwise(F.col("props"))
    own = variants.parse_json(F.when(F.col("event_id") % 7 == 0, '{"n": true}').otherwise(F.concat(F.lit('{"n": '), "user_id", F.lit("}"))))
    return table(spark, folder, "events").select("event_id", flag(variants.parse_json(text).isNotNull()).alias("valid"), variants.integer_at(own, "n").alias("n"))


@query("h17_human_sizes", """SELECT o_orderkey AS k, CASE WHEN o_orderkey < 1000 THEN o_orderkey || ' B' WHEN o_orderkey < 1000000 THEN format('{:.1f} kB', o_orderkey / 1000.0)
  ELSE format('{:.1f} MB', o_orderkey / 1000000.0) END AS size FROM orders""")
def h17_human_sizes(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), labels.human_size(F.col("o_orderkey")).alias("size"))


@query("h17_excerpts_of_whole_texts", "SELECT doc_id, CAST(least(240, length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) >= length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS whole FROM documents")
def h17_excerpts_of_whole_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", flag(~labels.excerpt(F.col("text")).endswith("…")).alias("whole"))


@query("h17_excerpts", r"""SELECT doc_id, CASE WHEN length(line) <= 240 THEN line ELSE rtrim(line[1:239]) || '…' END AS excerpt
FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x85\xA0\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS line FROM documents)""")
def h17_excerpts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", labels.excerpt(F.col("text")).alias("excerpt"))


@query("h17_license_names", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Custom terms' WHEN '5-LOW' THEN '' ELSE o_orderpriority END AS name, count(*) AS n FROM orders GROUP BY 1")
def h17_license_names(spark, folder):
    rank = F.col("o_orderpriority")
    value = F.when(rank == "1-URGENT", " Other ").when(rank != "5-LOW", rank)
    return table(spark, folder, "orders").groupBy(labels.license_name(value).alias("name")).agg(F.count("*").alias("n"))


@query("h17_link_labels", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Mine ' || o_orderkey WHEN 1 THEN 'h' || o_orderkey || '.test' ELSE 'r' || o_orderkey || '.md' END AS label FROM orders""")
def h17_link_labels(spark, folder):
    key = F.col("o_orderkey")
    title = F.when(key % 4 == 0, F.concat(F.lit(" Mine "), key)).when(key % 4 == 3, "License")
    href = F.when(key % 4 == 1, F.concat(F.lit("https://www.h"), key, F.lit(".test/x"))).otherwise(F.concat(F.lit("https://h.test/a/r"), key, F.lit(".md?v=1")))
    return table(spark, folder, "orders").select(key.alias("k"), labels.link_label(href, title).alias("label"))


@query("h17_catalog_lines", f"""WITH {REGISTRY_SQL} SELECT id, concat_ws(', ', CASE WHEN collections = 1 THEN '1 collection' WHEN collections IS NOT NULL THEN collections || ' collections' END, NULLIF(replace(licenses, ' ', ' and '), '')) AS line FROM entry""")
def h17_catalog_lines(spark, folder):
    unknown = F.lit(None).cast("bigint")
    return registry_rows(spark, folder).select("id", labels.catalog_summary(F.col("collection_count"), unknown, F.col("licenses")).alias("line"))


@query("h18_layer_names", f"WITH {ASSET_SQL} SELECT coalesce(title, 'k' || line) AS label, CASE WHEN title IS NOT NULL THEN title ELSE regexp_replace(regexp_extract(href, '([^/]*)$', 1), '[.]parquet$', '') END AS name, count(*) AS n FROM asset GROUP BY 1, 2")
def h18_layer_names(spark, folder):
    label = rules.asset_label(F.col("title"), F.col("key")).alias("label")
    return asset_rows(spark, folder).groupBy(label, rules.layer_name(F.col("title"), F.col("glob"), F.col("href")).alias("name")).agg(F.count("*").alias("n"))


@query("h18_format_names", f"WITH {ASSET_SQL} SELECT CASE format WHEN 'pmtiles' THEN 'PMTiles' WHEN 'cog' THEN 'COG' WHEN 'copc' THEN 'COPC' WHEN 'parquet' THEN CASE WHEN tabular THEN 'Parquet' ELSE 'GeoParquet' END WHEN 'flatgeobuf' THEN 'FlatGeobuf' WHEN 'geojson' THEN 'GeoJSON' ELSE 'CSV' END AS name, count(*) AS n FROM asset GROUP BY 1")
def h18_format_names(spark, folder):
    return asset_rows(spark, folder).groupBy(labels.format_label(F.col("format"), F.col("type"), F.col("href"), F.col("tabular")).alias("name")).agg(F.count("*").alias("n"))


@query("h22_read_errors", "SELECT l_returnflag AS f, CAST(count(*) FILTER (WHERE l_suppkey % 2 = 0) AS BIGINT) AS named FROM lineitem GROUP BY 1")
def h22_read_errors(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", F.concat(F.lit("s3://b"), "l_suppkey", F.lit("/x")).alias("source"), F.when(F.col("l_suppkey") % 2 == 0, "NoSuchBucket: gone").otherwise("denied").alias("error"), F.concat(F.lit("named b"), "l_suppkey", F.lit(".")).alias("want"))
    return rows.groupBy(F.col("l_returnflag").alias("f")).agg(F.count_if(labels.read_error(F.col("source"), F.col("error")).contains(F.col("want"))).alias("named"))


@query("h21_multihashes", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sha256' WHEN 1 THEN 'sha1' WHEN 2 THEN NULL ELSE 'sha256' END AS algorithm, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN sha1(text) WHEN 2 THEN NULL ELSE sha256(lang) END AS digest FROM documents")
def h21_multihashes(spark, folder):
    key, text = F.col("doc_id"), F.col("text").cast("binary")
    checksum = F.when(key % 4 == 0, F.concat(F.lit("1220"), F.upper(F.sha2(text, 256)))).when(key % 4 == 1, F.concat(F.lit("1114"), F.sha1(text))).when(
        key % 4 == 2, F.concat(F.lit("2004"), F.sha1(text))).otherwise(F.concat(F.lit(" 1220"), F.sha2(F.col("lang").cast("binary"), 256)))
    return table(spark, folder, "documents").select("doc_id", multihash.decode(checksum).alias("d")).select("doc_id", "d.algorithm", "d.digest")


# ---- styles and usage

STYLE_SQL = "style AS (SELECT c_custkey AS k, 'https://cat.test/' || c_custkey || '/style.json' AS style FROM customer)"


def style_rows(spark, folder) -> DataFrame:
    """Return one style per customer as ``(style, body, fallback)``."""
    key = F.col("c_custkey")
    body = F.format_string(
        '{"version": %d, "sources": {"own": {"type": "vector", "url": "pmtiles://./own.pmtiles"}, "far": {"type": "vector", "tiles": ["pmtiles://https://t.test/%d/far.pmtiles/{z}/{x}/{y}.mvt"]}, "pic": {"type": "raster", "url": "x.pmtiles"}, "any": {"type": "vector"}}, '
        '"layers": [{"id": "back", "type": "background"}, {"id": "a", "source": "own"}, {"id": "b", "source": "far"}, {"id": "c", "source": "pic"}, {"id": "d", "source": "any"}]}',
        F.when(key % 5 == 0, 7).otherwise(8), key % 10)
    return table(spark, folder, "customer").select(F.concat(F.lit(f"{HOST}/"), key, F.lit("/style.json")).alias("style"), body.alias("body"), F.when(key % 2 == 0, F.concat(F.lit(f"{HOST}/"), key, F.lit("/only.pmtiles"))).alias("fallback"))


SOURCES_SQL = f"""{STYLE_SQL}, src AS (SELECT k, style, 'own' AS source, 'https://cat.test/' || k || '/own.pmtiles' AS archive FROM style WHERE k % 5 <> 0
  UNION ALL SELECT k, style, 'far', 'https://t.test/' || k % 10 || '/far.pmtiles' FROM style WHERE k % 5 <> 0 UNION ALL SELECT k, style, 'any', 'https://cat.test/' || k || '/only.pmtiles' FROM style WHERE k % 5 <> 0 AND k % 2 = 0)"""


@query("j08_style_sources", f"WITH {SOURCES_SQL} SELECT style, source, archive FROM src")
def j08_style_sources(spark, folder):
    return styles.sources_of(styles.with_sources(styles.parse_styles(style_rows(spark, folder)))).select("style", "source", "archive")


@query("j08_layers_per_archive", f"""WITH {SOURCES_SQL}, layer(pos, layer, source) AS (VALUES (0, 'back', 'own'), (1, 'a', 'own'), (2, 'b', 'far'), (3, 'c', 'pic'), (4, 'd', 'any'))
SELECT s.style, CAST(pos AS BIGINT) AS pos, layer, archive FROM (SELECT * FROM style WHERE k % 5 <> 0) s CROSS JOIN layer LEFT JOIN src ON src.style = s.style AND src.source = layer.source""")
def j08_layers_per_archive(spark, folder):
    split = styles.split_layers(styles.with_sources(styles.parse_styles(style_rows(spark, folder))))
    return split.select("style", F.col("pos").cast("bigint").alias("pos"), "layer", "archive")


def named_archives(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Return what styles name, and each document's archives."""
    named = styles.sources_of(styles.with_sources(styles.parse_styles(style_rows(spark, folder)))).select(F.col("style").alias("url"), "archive")
    key = F.col("c_custkey")
    own = table(spark, folder, "customer").select(
        F.concat(F.lit(f"{HOST}/"), key, F.lit("/style.json")).alias("url"),
        F.explode(F.array(F.concat(F.lit(f"{HOST}/"), key, F.lit("/own.pmtiles")), F.concat(F.lit("https://m.test/"), key, F.lit("/far.pmtiles")), F.when(key % 3 == 0, F.concat(F.lit("https://n.test/"), key, F.lit("/far.pmtiles"))))).alias("href"))
    return named, own.where("href is not null")


@query("j07_match_archives", f"WITH {SOURCES_SQL} SELECT style AS url, archive, CASE source WHEN 'own' THEN archive WHEN 'far' THEN CASE WHEN k % 3 <> 0 THEN 'https://m.test/' || k || '/far.pmtiles' END END AS href FROM src")
def j07_match_archives(spark, folder):
    return styles.match_archives(*named_archives(spark, folder))


@query("u03_stray_archives", f"WITH {SOURCES_SQL} SELECT style AS url, archive FROM src WHERE source <> 'own'")
def u03_stray_archives(spark, folder):
    return styles.stray_archives(*named_archives(spark, folder))


@query("w08_unique_names", "SELECT o_orderkey AS k, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS unique_name FROM (SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def w08_unique_names(spark, folder):
    ensure_checkpoints(spark)
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("name"))
    return styles.unique_names(rows, ["o_custkey"], "name", "k").select("k", "unique_name")


@query("w01_numbered_in_hot_groups", "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS number FROM orders")
def w01_numbered_in_hot_groups(spark, folder):
    return numbered(table(spark, folder, "orders"), ["o_orderstatus"], "o_orderkey", bits=40).select(F.col("o_orderkey").alias("k"), "number")


@query("j06_files_in_use", """SELECT o_orderkey AS k, CAST(o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS BIGINT) AS used FROM orders""")
def j06_files_in_use(spark, folder):
    key = F.col("o_orderkey")
    href = F.concat(F.lit("https://h.test/a "), key, F.lit(".tif"))
    rows = table(spark, folder, "orders").select(key.alias("k"), href.alias("href"), F.concat(F.lit("s3://b/"), key).alias("read_url"))
    kept = rows.where("k % 5 = 0").select(F.col("href").alias("url")).union(rows.where("k % 7 = 0").select("read_url"))
    plain = rows.where("k % 11 = 0").select(F.concat(F.lit("CSV:/vsicurl/"), "href", F.lit("|layer=x")).alias("source"))
    quoted = rows.where("k % 13 = 0").select(F.concat(F.lit("/vsicurl?empty_dir=yes&url=https%3A%2F%2Fh.test%2Fa%20"), "k", F.lit(".tif")).alias("source"))
    return usage.mark_used(rows, kept, plain.union(quoted)).select("k", flag(F.col("used")).alias("used"))
