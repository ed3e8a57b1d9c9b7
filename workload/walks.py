"""The catalog walk, item indexes, manifests, verification and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import extents, wkb
from geoquarry.model import Area, MapView
from geoquarry.operators import audit, manifest
from geoquarry.operators.ranking import side_by_side
from geoquarry.operators.walk import failures, redirected, walk
from geoquarry.plans import item_files
from geoquarry.plans.download import DownloadPlan, plan_download
from geoquarry.plans.sweep import sweep
from geoquarry.session import scratch_path
from geoquarry.sources import mirror
from workload.base import HOST, flag, query, stored, table
from workload.features import CHECKS_SQL, check_rows

# ---- the graph: root -> regions -> nations -> customers -> orders, and links back to the root.
# Each nation also lists the customers of the next nation, after its own.

GRAPH_SQL = """edge AS (
  SELECT 'root' AS parent, CAST(r_regionkey AS BIGINT) AS pos, 'r' || r_regionkey AS child, 'catalog' AS kind FROM region
  UNION ALL SELECT 'r' || n_regionkey, CAST(n_nationkey AS BIGINT), 'n' || n_nationkey, 'catalog' FROM nation
  UNION ALL SELECT 'n' || n_nationkey, CAST(-1 AS BIGINT), 'root', 'catalog' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, c_custkey, 'c' || c_custkey, 'collection' FROM customer
  UNION ALL SELECT 'n' || (c_nationkey + 1) % 25, 10000000000 + c_custkey, 'c' || c_custkey, 'collection' FROM customer
  UNION ALL SELECT 'c' || o_custkey, o_orderkey, 'o' || o_orderkey, 'item' FROM orders),
bad AS (SELECT 'c' || c_custkey AS href FROM customer WHERE c_custkey % 17 = 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 19 = 0),
l1 AS (SELECT child AS href, kind, row_number() OVER (ORDER BY pos) AS place FROM edge WHERE parent = 'root'),
l2 AS (SELECT href, kind, row_number() OVER (ORDER BY pp, pos) AS place FROM (SELECT e.child AS href, e.kind, l1.place AS pp, e.pos, row_number() OVER (PARTITION BY e.child ORDER BY l1.place, e.pos) AS rn FROM edge e JOIN l1 ON e.parent = l1.href) WHERE rn = 1 AND href <> 'root'),
l3 AS (SELECT href, kind, row_number() OVER (ORDER BY pp, pos) AS place FROM (SELECT e.child AS href, e.kind, l2.place AS pp, e.pos, row_number() OVER (PARTITION BY e.child ORDER BY l2.place, e.pos) AS rn FROM edge e JOIN l2 ON e.parent = l2.href) WHERE rn = 1 AND href <> 'root'),
l4 AS (SELECT href, kind, row_number() OVER (ORDER BY pp, pos) AS place FROM (SELECT e.child AS href, e.kind, l3.place AS pp, e.pos FROM edge e JOIN l3 ON e.parent = l3.href WHERE l3.href NOT IN (SELECT href FROM bad))),
walked AS (SELECT href, depth, kind, row_number() OVER (ORDER BY depth, place) AS turn, href IN (SELECT href FROM bad) AS failed FROM (
  SELECT 'root' AS href, 0 AS depth, 'catalog' AS kind, 1 AS place UNION ALL SELECT href, 1, kind, place FROM l1 UNION ALL SELECT href, 2, kind, place FROM l2
  UNION ALL SELECT href, 3, kind, place FROM l3 UNION ALL SELECT href, 4, kind, place FROM l4))"""


def graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Return documents and edges of the table hierarchy; some documents cannot be read."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")

    def edges(rows: DataFrame, parent, pos, child, kind: str) -> DataFrame:
        return rows.select(parent.alias("parent"), pos.cast("bigint").alias("pos"), child.alias("child"), F.lit(kind).alias("kind"))

    def named(letter: str, column) -> F.Column:
        return F.concat(F.lit(letter), column)

    next_nation = (F.col("c_nationkey") + 1) % 25
    links = edges(region, F.lit("root"), F.col("r_regionkey"), named("r", F.col("r_regionkey")), "catalog")
    for part in (
        edges(nation, named("r", F.col("n_regionkey")), F.col("n_nationkey"), named("n", F.col("n_nationkey")), "catalog"),
        edges(nation, named("n", F.col("n_nationkey")), F.lit(-1), F.lit("root"), "catalog"),
        edges(customer, named("n", F.col("c_nationkey")), F.col("c_custkey"), named("c", F.col("c_custkey")), "collection"),
        edges(customer, named("n", next_nation), F.col("c_custkey") + 10000000000, named("c", F.col("c_custkey")), "collection"),
        edges(orders, named("c", F.col("o_custkey")), F.col("o_orderkey"), named("o", F.col("o_orderkey")), "item"),
    ):
        links = links.unionByName(part)
    none = F.lit(None).cast("string")
    empty = F.lit(None).cast(extents.BOX_TYPE)

    def documents(rows: DataFrame, url, kind: str, error=none, box=empty) -> DataFrame:
        return rows.select(url.alias("url"), F.lit(kind).alias("kind"), error.alias("error"), box.alias("bbox"), url.alias("base"))

    x, y = (F.col("o_orderkey") * 37 % 2880).cast("double") / 8.0 - 180.0, (F.col("o_orderkey") * 53 % 1360).cast("double") / 8.0 - 85.0
    found = documents(spark.range(1), F.lit("root"), "catalog")
    for part in (
        documents(region, named("r", F.col("r_regionkey")), "catalog"),
        documents(nation, named("n", F.col("n_nationkey")), "catalog"),
        documents(customer, named("c", F.col("c_custkey")), "collection", F.when(F.col("c_custkey") % 17 == 0, "broken")),
        # Every nineteenth order has no document at all.
        documents(orders.where("o_orderkey % 19 <> 0"), named("o", F.col("o_orderkey")), "item", none, F.when(F.col("o_orderkey") % 6 != 0, extents.box(x, y, x + 1, y + 1))),
    ):
        found = found.unionByName(part)
    return found, links


def turns(visited: DataFrame) -> DataFrame:
    """Number the visited documents in queue order, without one global window."""
    from geoquarry.operators.ranking import numbered

    # Depth above the place keeps the order in one integer.
    keyed = visited.withColumn("turn_key", F.col("depth").cast("bigint") * (1 << 50) + F.col("place")).withColumn("one", F.lit(1))
    return numbered(keyed, ["one"], "turn_key", alias="turn", bits=64)


@query("b01_walk", f"WITH {GRAPH_SQL} SELECT href, CAST(depth AS BIGINT) AS depth, turn, CAST(failed AS BIGINT) AS failed FROM walked")
def b01_walk(spark, folder):
    visited = turns(walk(*graph(spark, folder), "root"))
    return visited.select("href", F.col("depth").cast("bigint").alias("depth"), "turn", flag(F.col("error").isNotNull()).alias("failed"))


@query("l04_walk_budget", f"WITH {GRAPH_SQL} SELECT href, turn FROM walked WHERE turn <= 700")
def l04_walk_budget(spark, folder):
    return turns(walk(*graph(spark, folder), "root", 700)).select("href", "turn")


@query("b03_audit_walk", f"""WITH {GRAPH_SQL}, first AS (SELECT parent, min(pos) AS pos FROM edge WHERE kind = 'item' AND parent NOT IN (SELECT href FROM bad) GROUP BY 1)
SELECT kind, count(*) AS documents FROM (SELECT href, kind FROM walked WHERE depth < 4 UNION ALL SELECT 'o' || f.pos, 'item' FROM first f JOIN l3 ON l3.href = f.parent) GROUP BY 1""")
def b03_audit_walk(spark, folder):
    documents, edges = graph(spark, folder)
    visited = walk(documents, edges, "root", first_item_only=True)
    kind = F.when(F.col("href").startswith("c"), "collection").when(F.col("href").startswith("o"), "item").otherwise("catalog")
    return visited.groupBy(kind.alias("kind")).agg(F.count("*").alias("documents"))


@query("b03_redirected_documents", "SELECT 'c' || c_custkey AS url FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 17 <> 0")
def b03_redirected_documents(spark, folder):
    documents, _edges = graph(spark, folder)
    moved = documents.withColumn("base", F.when((F.col("kind") == "collection") & (F.substring("url", 2, 20).cast("bigint") % 4 == 1), F.concat(F.lit("moved/"), "url")).otherwise(F.col("url")))
    return redirected(moved).select("url")


@query("j02_one_step_of_the_walk", f"WITH {GRAPH_SQL} SELECT href, turn FROM (SELECT href, row_number() OVER (ORDER BY place) AS turn FROM l2)")
def j02_one_step_of_the_walk(spark, folder):
    visited = walk(*graph(spark, folder), "root").where("depth = 2")
    return turns(visited).select("href", "turn")


# ---- items, their files and plans

ASSETS_OF_ORDERS = """files AS (SELECT 'o' || o_orderkey AS doc, 'https://cat.test/f/' || o_orderkey % 500 || '/' || o_orderkey % 7 || CASE o_orderstatus WHEN 'F' THEN '.tif' WHEN 'O' THEN '.parquet' ELSE '.csv' END AS href, o_orderstatus AS s,
  o_orderkey % 6 = 0 OR ((CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8.0 - 180.0) <= 40 AND (CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8.0 - 180.0) + 1 >= -60 AND (CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8.0 - 85.0) <= 45 AND (CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8.0 - 85.0) + 1 >= -30 ) AS inside FROM orders)"""
VIEW = MapView((-60.0, -30.0, 40.0, 45.0))


def order_assets(spark, folder) -> DataFrame:
    """Return one data file per order; many orders share a file."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    ending = F.when(status == "F", ".tif").when(status == "O", ".parquet").otherwise(".csv")
    href = F.concat(F.lit(f"{HOST}/f/"), key % 500, F.lit("/"), key % 7, ending)
    none = F.lit(None).cast("string")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("o"), key).alias("url"), F.lit(0).alias("pos"), F.lit("data").alias("key"), href.alias("href"), none.alias("title"), none.alias("type"),
        F.array(F.lit("data")).alias("roles"), F.when(status != "P", key % 500).alias("size"), none.alias("checksum"),
        F.when(status == "F", "cog").when(status == "O", "parquet").otherwise("csv").alias("format"), F.lit(False).alias("tabular"), none.alias("glob"), href.alias("read_url"))


def empty_links(spark) -> DataFrame:
    """Return no tile links."""
    return spark.createDataFrame([], "url string, pos int, href string, title string, layers array<string>")


@query("b02_walked_item_files", f"WITH {GRAPH_SQL}, {ASSETS_OF_ORDERS} SELECT DISTINCT f.href FROM walked w JOIN files f ON f.doc = w.href WHERE NOT w.failed AND f.inside AND f.s <> 'P'")
def b02_walked_item_files(spark, folder):
    return item_files.walked_files(*graph(spark, folder), order_assets(spark, folder), "root", VIEW).select("href")


MIRROR_SQL = """idx AS (SELECT o_orderkey AS k, o_orderkey % 8 = 0 AS nobox, CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8.0 - 180.0 AS x, CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8.0 - 85.0 AS y,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://self.test/' || o_orderkey || '/' WHEN 1 THEN 'https://cat.test/items/' || o_orderkey || '/' ELSE 'https://cat.test/m/' END || 'd' || o_orderkey % 1000 || CASE o_orderstatus WHEN 'F' THEN '.tif' ELSE '.parquet' END AS href FROM orders)"""
MIRROR_URL = f"{HOST}/m/items.parquet"


def index_rows(spark, folder, as_list: bool = False) -> DataFrame:
    """Return orders as the rows of an item index; every ninth box crosses 180 degrees."""
    key = F.col("o_orderkey")
    x, y = (key * 37 % 2880).cast("double") / 8.0 - 180.0, (key * 53 % 1360).cast("double") / 8.0 - 85.0
    east = F.when(key % 9 == 0, x - 1).otherwise(x + 1)
    text = F.lit(None).cast("string")
    box = F.array(x, y, F.lit(0.0), east, y + 1, F.lit(9.0)) if as_list else F.struct(x.alias("xmin"), y.alias("ymin"), east.alias("xmax"), (y + 1).alias("ymax"))
    data = F.concat(F.lit("./d"), key % 1000, F.when(F.col("o_orderstatus") == "F", ".tif").otherwise(".parquet"))
    assets = F.struct(F.struct(F.lit("t.png").alias("href"), F.array(F.lit("thumbnail")).alias("roles")).alias("thumb"), F.struct(data.alias("href"), text.alias("type")).alias("data"))
    own = F.concat(F.lit("https://self.test/"), key, F.lit("/item.json"))
    links = F.when(key % 4 == 0, F.array(F.struct(F.lit("root").alias("rel"), F.lit("x").alias("href")), F.struct(F.lit("self").alias("rel"), own.alias("href"))))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("id-"), key).alias("id"), F.when(key % 8 != 0, box).alias("bbox"), assets.alias("assets"), links.alias("links"),
        wkb.point_wkb(x + 0.5, y + 0.5).alias("geometry"))


def index_links(spark, folder) -> DataFrame:
    """Return the item links of the collection, for every fourth order."""
    rows = table(spark, folder, "orders").where("o_orderkey % 4 = 1")
    child = F.concat(F.lit(f"{HOST}/items/"), "o_orderkey", F.lit("/id-"), "o_orderkey", F.lit(".json"))
    return rows.select(F.lit("m").alias("parent"), F.col("o_orderkey").alias("pos"), child.alias("child"), F.lit("item").alias("kind"))


def damaged_index(spark, folder) -> str:
    """Return the path of an item index whose footers are whole and whose pages are not."""
    import pyarrow.fs as fs

    from geoquarry.sources.object_store import store_of

    def write(path: str) -> None:
        index_rows(spark, folder).write.parquet(path)
        store, inner = store_of(path)
        for part in store.get_file_info(fs.FileSelector(inner)):
            if part.path.endswith(".parquet"):
                with store.open_input_file(part.path) as whole:
                    body = whole.read()
                footer = int.from_bytes(body[-8:-4], "little") + 8
                with store.open_output_stream(part.path) as out:
                    out.write(body[:4] + bytes(len(body) - footer - 4) + body[-footer:])
        for sums in store.get_file_info(fs.FileSelector(inner)):
            if sums.path.endswith(".crc"):
                store.delete_file(sums.path)

    return stored(spark, folder, "damaged", write)


@query("b02_damaged_index", f"WITH {GRAPH_SQL}, {ASSETS_OF_ORDERS} SELECT DISTINCT f.href FROM walked w JOIN files f ON f.doc = w.href WHERE NOT w.failed AND f.inside AND f.s <> 'P'")
def b02_damaged_index(spark, folder):
    assets = order_assets(spark, folder)
    index = spark.range(1).select(F.lit("root").alias("url"), F.lit(-1).alias("pos"), F.lit(damaged_index(spark, folder)).alias("href"), F.array(F.lit("collection-mirror")).alias("roles"))
    index = index.withColumn("pos", F.col("pos").cast(assets.schema["pos"].dataType))
    return item_files.files_in_scope(spark, *graph(spark, folder), assets.unionByName(index, allowMissingColumns=True), "root", VIEW)


@query("s10_item_index", f"WITH {MIRROR_SQL} SELECT DISTINCT href FROM idx WHERE NOT nobox AND y <= 45 AND y + 1 >= -30 AND (k % 9 = 0 AND (x <= 40 OR x - 1 >= -60) OR k % 9 <> 0 AND x <= 40 AND x + 1 >= -60)")
def s10_item_index(spark, folder):
    return item_files.indexed_files(index_rows(spark, folder), MIRROR_URL, VIEW, index_links(spark, folder)).select("href")


@query("s10_item_index_of_lists", f"WITH {MIRROR_SQL} SELECT DISTINCT href FROM idx")
def s10_item_index_of_lists(spark, folder):
    from geoquarry.model import Everything

    return item_files.indexed_files(index_rows(spark, folder, as_list=True), MIRROR_URL, Everything(), index_links(spark, folder)).select("href")


@query("f14_index_prefilter_by_area", f"""WITH {MIRROR_SQL} SELECT k FROM idx WHERE NOT nobox AND y <= 45 AND y + 1 >= -30 AND (k % 9 = 0 AND (x <= 40 OR x - 1 >= -60)
  OR k % 9 <> 0 AND x <= 40 AND x + 1 >= -60 AND x + 0.5 >= -60 AND y + 0.5 >= -30 AND 75 * (x + 0.5 + 60) + 100 * (y + 0.5 + 30) <= 7500)""")
def f14_index_prefilter_by_area(spark, folder):
    area = Area("POLYGON((-60 -30, 40 -30, -60 45, -60 -30))", (-60.0, -30.0, 40.0, 45.0))
    rows = mirror.scan_mirror(index_rows(spark, folder), area)
    return rows.select(F.substring("id", 4, 20).cast("bigint").alias("k"))


@query("j01_index_row_bases", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'https://self.test/' || o_orderkey || '/item.json' WHEN 1 THEN 'https://cat.test/items/' || o_orderkey || '/id-' || o_orderkey || '.json' ELSE 'https://cat.test/m/items.parquet' END AS base FROM orders")
def j01_index_row_bases(spark, folder):
    from geoquarry.model import Everything

    rows = mirror.scan_mirror(index_rows(spark, folder), Everything())
    based = mirror.with_bases(rows, MIRROR_URL, mirror.item_documents(index_links(spark, folder)))
    return based.select(F.substring("id", 4, 20).cast("bigint").alias("k"), "base")


PLAN_SQL = f"""WITH {GRAPH_SQL}, {ASSETS_OF_ORDERS}, kept AS (SELECT w.*, o_orderkey AS k, f.href AS file, f.s FROM walked w LEFT JOIN files f ON f.doc = w.href LEFT JOIN orders o ON 'o' || o_orderkey = w.href WHERE NOT failed AND coalesce(f.inside, true)),
plan AS (SELECT href AS url, NULL AS size FROM kept UNION ALL SELECT file, CAST(min(CASE WHEN s <> 'P' THEN k % 500 END) AS BIGINT) FROM kept WHERE file IS NOT NULL GROUP BY 1)"""


def scoped_plan(spark, folder) -> DownloadPlan:
    """Plan the download of the whole graph in a view."""
    documents, edges = graph(spark, folder)
    return plan_download(documents, edges, order_assets(spark, folder), empty_links(spark), "root", f"{HOST}/catalog.json", VIEW, None)


@query("m01_scoped_plan", f"{PLAN_SQL} SELECT url, size FROM plan")
def m01_scoped_plan(spark, folder):
    return scoped_plan(spark, folder).files.select("url", "size")


@query("a06_plan_summary", f"""{PLAN_SQL} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS known_bytes, CAST(count(*) - count(size) AS BIGINT) AS unknown_sizes, (SELECT count(*) FROM walked WHERE failed) AS failures,
  (SELECT count(*) FROM walked w JOIN files f ON f.doc = w.href WHERE NOT w.failed AND NOT f.inside) AS outside, CAST(0 AS BIGINT) AS truncated, CAST(0 AS BIGINT) AS unlisted FROM plan""")
def a06_plan_summary(spark, folder):
    row = scoped_plan(spark, folder).summary()
    return row.select("files", "known_bytes", "unknown_sizes", "failures", "outside", flag(F.col("truncated")).alias("truncated"), "unlisted")


@query("m01_failures", f"WITH {GRAPH_SQL} SELECT href FROM walked WHERE failed")
def m01_failures(spark, folder):
    return failures(walk(*graph(spark, folder), "root")).select("href")


@query("m02_files_of_documents", """SELECT part, count(*) AS files, count(DISTINCT url) AS urls FROM (SELECT 0 AS part, 'o' || o_orderkey AS url FROM orders WHERE o_orderkey % 19 <> 0
  UNION ALL SELECT 1, 'https://cat.test/f/' || o_orderkey % 500 || '/' || o_orderkey % 7 || CASE o_orderstatus WHEN 'F' THEN '.tif' WHEN 'O' THEN '.parquet' ELSE '.csv' END FROM orders
  UNION ALL SELECT 2, 'https://cat.test/t/' || o_orderkey FROM orders WHERE o_orderkey % 3 = 1) GROUP BY 1""")
def m02_files_of_documents(spark, folder):
    assets = order_assets(spark, folder)
    order = F.substring("url", 2, 20).cast("bigint")
    own = F.when(order % 3 == 0, F.col("href")).when(order % 3 == 1, F.concat(F.lit(f"{HOST}/t/"), order))
    links = assets.select("url", "pos", own.alias("href")).where("href is not null")
    files = manifest.files_of(graph(spark, folder)[0].where("kind = 'item'"), assets, links, f"{HOST}/catalog.json")
    return files.groupBy("part").agg(F.count("*").alias("files"), F.countDistinct("url").alias("urls"))


@query("m03_partition_files", "SELECT s, count(*) AS files FROM (SELECT DISTINCT o_orderstatus AS s, o_orderpriority FROM orders) GROUP BY 1 UNION ALL SELECT 'unlisted', count(*) FROM customer WHERE c_custkey % 3 = 1")
def m03_partition_files(spark, folder):
    path = scratch_path(spark, "parts")
    keys = ["o_orderstatus", "o_orderpriority"]
    table(spark, folder, "orders").repartition(*keys).write.partitionBy(*keys).parquet(path)
    globs = table(spark, folder, "orders").select("o_orderstatus").distinct().select(
        F.concat(F.lit("s"), "o_orderstatus").alias("url"), F.lit(0).alias("pos"), F.concat(F.lit(f"file://{path}/o_orderstatus=" if path.startswith("/") else f"{path}/o_orderstatus="), "o_orderstatus", F.lit("/*/*.parquet")).alias("glob"))
    key = F.col("c_custkey")
    blocked = table(spark, folder, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("c"), key).alias("url"), F.lit(0).alias("pos"), F.lit("https://h/*.parquet").alias("glob"), F.lit(None).cast("string").alias("read_url"))
    parents = table(spark, folder, "customer").where("c_custkey % 3 = 2").select(F.concat(F.lit("c"), key).alias("parent"))
    files, unlisted = manifest.partition_files(globs.withColumn("read_url", F.col("glob")).unionByName(blocked), parents, f"{HOST}/catalog.json")
    listed = files.groupBy(F.regexp_extract("url", "o_orderstatus=([^/]*)/", 1).alias("s")).agg(F.count("*").alias("files"))
    return listed.unionByName(unlisted.agg(F.count("*").alias("files")).select(F.lit("unlisted").alias("s"), "files"))


MANIFEST_SQL = """one AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, CASE WHEN l_suppkey % 2 = 0 THEN 'Data/' ELSE 'data/' END || l_partkey AS path,
  CAST(max(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""
PLACE = ["o", "l", "p", "s"]


def manifest_rows(spark, folder) -> DataFrame:
    """Return line items as manifest rows: few paths, many claims."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("bigint")).alias("size"))
    once = rows.groupBy(*PLACE).agg(F.max("size").alias("size"))
    path = F.concat(F.when(F.col("s") % 2 == 0, "Data/").otherwise("data/"), "p")
    return once.select(*PLACE, F.concat_ws("/", *PLACE).alias("url"), path.alias("path"), "size")


@query("w01_first_file_per_url", "SELECT l_partkey AS part, min(CAST(l_orderkey * 100 + l_linenumber AS BIGINT)) AS pos FROM lineitem GROUP BY 1")
def w01_first_file_per_url(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("u"), "l_partkey").alias("url"), F.col("l_partkey").alias("part"))
    return manifest.first_per_url(rows, ["pos"]).select("part", "pos")


@query("w02_path_collisions", f"WITH {MANIFEST_SQL} SELECT o || '/' || l || '/' || p || '/' || s AS url, CAST(row_number() OVER (PARTITION BY lower(path) ORDER BY o, l, p, s) > 1 AS BIGINT) AS clash FROM one")
def w02_path_collisions(spark, folder):
    kept, clashes = manifest.split_collisions(manifest_rows(spark, folder), PLACE)
    return kept.select("url", F.lit(0).cast("bigint").alias("clash")).unionByName(clashes.select("url", F.lit(1).cast("bigint").alias("clash")))


@query("j05_manifest_without_clipped", f"WITH {MANIFEST_SQL} SELECT count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM one WHERE p % 4 <> 0")
def j05_manifest_without_clipped(spark, folder):
    rows = manifest_rows(spark, folder)
    left = manifest.without_clipped(rows, rows.where("p % 4 = 0").select(F.col("url").alias("href")))
    return left.agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


# ---- verification of stored files: the texts of the documents

FILES_SQL = """file AS (SELECT doc_id AS k, doc_id % 5 <> 4 AS stored, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'wrong' ELSE 'right' END WHEN doc_id % 9 = 0 THEN 'unreadable' END AS sum,
  CASE WHEN doc_id % 3 = 0 THEN strlen(text) WHEN doc_id % 3 = 1 THEN 1 END AS size, strlen(text) AS actual FROM documents),
out AS (SELECT k, CASE WHEN k % 11 = 10 THEN 'failed' WHEN stored AND sum IS NOT NULL THEN CASE WHEN sum = 'wrong' THEN 'fetch' ELSE 'skipped' END WHEN stored AND size = actual THEN 'skipped' ELSE 'fetch' END AS outcome,
  coalesce(k % 11 <> 10 AND stored AND sum = 'right', false) AS verified, size FROM file)"""


def file_rows(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Return documents as manifest rows, and what is stored of them with the checksum's verdict."""
    key, content = F.col("doc_id"), F.col("text").cast("binary")
    right = F.concat(F.lit("1220"), F.sha2(content, 256))
    wrong = F.concat(F.lit("1220"), F.sha2(F.lit(b"other"), 256))
    checksum = F.when(key % 2 == 0, F.when(key % 7 == 0, wrong).otherwise(right)).when(key % 9 == 0, "zz")
    path = F.concat(F.when(key % 11 == 10, "../").otherwise("d/"), key, F.lit(".txt"))
    size = F.octet_length("text").cast("bigint")
    rows = table(spark, folder, "documents").select(key.alias("k"), path.alias("path"), F.when(key % 3 == 0, size).when(key % 3 == 1, F.lit(1).cast("bigint")).alias("size"), checksum.alias("checksum"), content.alias("content"), size.alias("actual"))
    judged = manifest.with_matches(rows.where("k % 5 <> 4"))
    return rows.select("k", "path", "size", "checksum"), judged.select("path", F.col("actual").alias("size"), "matches")


@query("m04_decide_per_file", f"WITH {FILES_SQL} SELECT k, outcome, CAST(verified AS BIGINT) AS verified FROM out")
def m04_decide_per_file(spark, folder):
    return manifest.decide(*file_rows(spark, folder), "/t").select("k", "outcome", flag(F.col("verified")).alias("verified"))


@query("m05_hash_and_compare", "SELECT doc_id AS k, CAST(doc_id % 5 <> 0 AS BIGINT) AS matches FROM documents")
def m05_hash_and_compare(spark, folder):
    key, content = F.col("doc_id"), F.col("text").cast("binary")
    hashed = F.when(key % 5 == 0, F.lit(b"x")).otherwise(content)
    checksum = F.when(key % 3 == 0, F.concat(F.lit("1220"), F.sha2(hashed, 256))).when(key % 3 == 1, F.concat(F.lit("1114"), F.sha1(hashed))).otherwise(F.concat(F.lit("1340"), F.sha2(hashed, 512)))
    rows = table(spark, folder, "documents").select(key.alias("k"), content.alias("content"), checksum.alias("checksum"))
    return manifest.with_matches(rows).select("k", flag(F.col("matches")).alias("matches"))


@query("m05_hash_stored_files", "SELECT p_brand AS brand, CAST(1 AS BIGINT) AS files, CAST(p_brand LIKE '%1' AS BIGINT) AS matches FROM (SELECT DISTINCT p_brand FROM part)")
def m05_hash_stored_files(spark, folder):
    from geoquarry.functions.multihash import library_digest, verify_paths

    path = scratch_path(spark, "brands")
    table(spark, folder, "part").repartition("p_brand").select("p_brand", "p_name").sortWithinPartitions("p_name").write.partitionBy("p_brand").text(path)
    files = spark.read.format("binaryFile").load(path + "/*/*.txt").withColumn("brand", F.regexp_extract(F.url_decode("path"), "p_brand=([^/]*)/", 1))
    digest = library_digest(F.col("content"), F.lit("blake2b"), F.lit(32))
    named = files.select("path", "brand", F.when(F.col("brand").endswith("1"), F.concat(F.lit("a0e40220"), digest)).otherwise(F.concat(F.lit("1220"), F.sha2(F.lit(b"x"), 256))).alias("checksum"))
    judged = verify_paths(named.select("path", "checksum")).join(named.select("path", "brand"), "path")
    return judged.groupBy("brand").agg(F.count("*").alias("files"), F.max(flag(F.col("matches"))).alias("matches"))


@query("m06_progress", f"WITH {FILES_SQL} SELECT round(CAST(count(*) FILTER (WHERE outcome = 'skipped') AS DOUBLE) / count(*), 9) AS by_files, round(CAST(sum(CASE WHEN outcome = 'skipped' THEN actual ELSE 0 END) AS DOUBLE) / sum(actual), 9) AS by_bytes FROM out JOIN file USING (k)")
def m06_progress(spark, folder):
    files, stored = file_rows(spark, folder)
    done = manifest.decide(files, stored, "/t").select("k", "size", F.lit(None).cast("bigint").alias("received"), (F.col("outcome") == "skipped").alias("settled"))
    sizes = table(spark, folder, "documents").select(F.col("doc_id").alias("k"), F.octet_length("text").cast("bigint").alias("size"))
    sized = done.drop("size").join(sizes, "k")
    by_bytes = manifest.progress(sized).select(F.round("fraction", 9).alias("by_bytes"))
    return side_by_side(manifest.progress(done).select(F.round("fraction", 9).alias("by_files")), by_bytes)


@query("a12_fetch_report", f"WITH {FILES_SQL} SELECT CAST(0 AS BIGINT) AS downloaded, count(*) FILTER (WHERE outcome = 'fetch') AS fetch, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE verified) AS verified FROM out")
def a12_fetch_report(spark, folder):
    return manifest.fetch_report(manifest.decide(*file_rows(spark, folder), "/t"))


# ---- audits


@query("a07_failures_per_check", f'WITH {CHECKS_SQL} SELECT "check", count(*) AS failures FROM checks WHERE NOT ok GROUP BY 1')
def a07_failures_per_check(spark, folder):
    return audit.failures_per_check(check_rows(spark, folder))


@query("l05_ordered_failures", f'WITH {CHECKS_SQL} SELECT catalog, document, "check" FROM checks WHERE NOT ok')
def l05_ordered_failures(spark, folder):
    return audit.ordered_failures(check_rows(spark, folder)).select("catalog", "document", "check")


def within(documents: DataFrame) -> DataFrame:
    """Place every document in one catalog."""
    return documents.select(F.lit("cat").alias("catalog"), "url")


@query("q02_collections_without_data", "SELECT 'c' || c_custkey AS document, 'no data' AS \"check\" FROM customer WHERE c_custkey % 10 = 0 OR (c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))")
def q02_collections_without_data(spark, folder):
    documents, edges = graph(spark, folder)
    files = documents.where("kind = 'collection'").where("try_cast(substring(url, 2, 20) as bigint) % 2 = 1")
    # Every tenth customer lists none of its orders.
    listed = edges.where("not (parent like 'c%0')")
    return audit.empty_collections(documents, files, listed, within(documents)).select("document", "check")


@query("q04_file_probes", """SELECT CASE l_partkey % 4 WHEN 0 THEN 'pmtiles' WHEN 1 THEN 'cog' WHEN 2 THEN 'pmtiles' ELSE 'csv' END AS kind, CAST(count(*) FILTER (WHERE l_partkey % 4 IN (0, 1)) AS BIGINT) AS ok, count(*) AS n FROM lineitem GROUP BY 1""")
def q04_file_probes(spark, folder):
    key = F.col("l_partkey") % 4
    kind = F.when(key.isin(0, 2), "pmtiles").when(key == 1, "cog").otherwise("csv")
    rows = table(spark, folder, "lineitem").select(kind.alias("kind"), F.when(key != 3, F.lit(5).cast("bigint")).alias("size"), F.when(key == 0, F.lit(b"PMTiles\x03")).otherwise(F.lit(b"II*")).alias("head"))
    ok, _detail = audit.probe_verdict(F.col("kind"))
    return rows.groupBy("kind").agg(F.count_if(ok).alias("ok"), F.count("*").alias("n"))


# Rows that one task writes.
WRITE_ROWS = 250_000


@query("q05_parquet_checks", "SELECT o_orderstatus AS s, 'geometry=geometry estimate=' || count(*) AS detail FROM orders GROUP BY 1")
def q05_parquet_checks(spark, folder):
    from geoquarry.sources.parquet import list_files, read_footers
    from workload.base import place_rows

    path = scratch_path(spark, "footers")
    rows = place_rows(spark, folder)
    # A task sorts what it writes by status: the number of tasks grows with the rows.
    rows.repartition(rows.count() // WRITE_ROWS + 1, "o_orderkey").write.partitionBy("o_orderstatus").parquet(path)
    footers = read_footers(list_files(spark, path + "/*/*.parquet"))
    named = footers.select(F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1).alias("s"), audit.footer_geometry(F.col("geo"), F.array(F.lit("day"), F.lit("geometry"))).alias("geometry"), "rows")
    per_file = named.groupBy("s", "geometry").agg(F.sum("rows").alias("rows"))
    return per_file.select("s", audit.footer_detail().alias("detail"))


@query("q07_thumbnail_checks", """SELECT CASE c_custkey % 3 WHEN 0 THEN 'no thumbnail asset' WHEN 1 THEN '4 bytes' ELSE 'not an image' END AS detail, count(*) AS n FROM customer WHERE c_custkey % 17 <> 0 GROUP BY 1""")
def q07_thumbnail_checks(spark, folder):
    documents = graph(spark, folder)[0].where("kind = 'collection'")
    key = F.substring("url", 2, 20).try_cast("bigint")
    href = F.concat(F.lit(f"{HOST}/"), key, F.lit(".png"))
    assets = documents.where(key % 3 != 0).select("url", F.lit(0).alias("pos"), F.lit("t").alias("key"), href.alias("href"), F.lit(None).cast("string").alias("type"), F.array(F.lit("thumbnail")).alias("roles"))
    probes = documents.select(href.alias("url"), F.lit(4).cast("bigint").alias("size"), F.when(key % 3 == 1, F.lit(b"\x89PNG")).otherwise(F.lit(b"<htm")).alias("head"))
    found = audit.thumbnail_checks(documents, assets, probes, within(documents))
    return found.groupBy("detail").agg(F.count("*").alias("n"))


@query("q08_download_paths", "SELECT count(*) AS odd FROM lineitem WHERE l_linenumber IN (1, 2)")
def q08_download_paths(spark, folder):
    line = F.col("l_linenumber")
    url = F.concat(F.lit(f"{HOST}/"), F.when(line == 1, "*.tif").when(line == 2, "").otherwise("x.tif"))
    files = table(spark, folder, "lineitem").select(F.lit("d").alias("doc"), url.alias("url"), F.when(line == 2, "index").otherwise("x.tif").alias("path"))
    place = spark.range(1).select(F.lit("cat").alias("catalog"), F.lit("d").alias("url"))
    return audit.download_checks(files, place).agg(F.count("*").alias("odd"))


@query("q06_style_checks", """SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Not a map style (version 8)' WHEN c_custkey % 2 = 0 THEN '3 sources, 1 outside the collection links' ELSE '3 sources, 1 outside the collection links' END AS detail, count(*) AS n FROM customer GROUP BY 1""")
def q06_style_checks(spark, folder):
    from workload.catalogs import style_rows

    files = style_rows(spark, folder)
    documents = files.select(F.replace("style", F.lit("style.json"), F.lit("c.json")).alias("url"), F.lit("collection").alias("kind"), F.lit(None).cast("string").alias("error"))
    base = F.replace("url", F.lit("c.json"), F.lit(""))
    none = F.lit(None).cast("string")

    def asset(pos: int, name: str, role: str, form) -> DataFrame:
        return documents.select("url", F.lit(pos).alias("pos"), F.lit(name).alias("key"), F.concat(base, F.lit(name)).alias("href"), none.alias("title"), none.alias("type"), F.array(F.lit(role)).alias("roles"), form.alias("format"))

    assets = asset(0, "style.json", "style", none).unionByName(asset(1, "own.pmtiles", "data", F.lit("pmtiles")))
    # With one archive the silent source reads it, so only the far archive is outside.
    found = audit.style_checks(documents, assets, empty_links(spark), files.drop("fallback"), within(documents))
    return found.groupBy("detail").agg(F.count("*").alias("n"))


@query("q03_target_checks", """SELECT "check", detail, count(*) AS n FROM (
  SELECT 'view cog' AS "check", CASE WHEN o_orderkey % 3 = 0 THEN 'The length of the file is not known' ELSE '7 bytes' END AS detail FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'load parquet', CASE WHEN o_orderkey % 3 = 0 THEN 'The footer could not be read' ELSE 'geometry=geom estimate=9' END FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'load csv', CASE WHEN o_orderkey % 3 = 0 THEN 'The length of the file is not known' ELSE '7 bytes' END FROM orders WHERE o_orderstatus = 'P') GROUP BY 1, 2""")
def q03_target_checks(spark, folder):
    from geoquarry.operators import catalog

    assets = order_assets(spark, folder).withColumn("href", F.concat(F.lit(f"{HOST}/"), F.col("url"), F.regexp_extract("href", r"(\.[a-z]+)$", 1)))
    files = catalog.loadable(assets.withColumn("read_url", F.col("href")), empty_links(spark))
    known = assets.where("cast(substring(url, 2, 20) as bigint) % 3 <> 0")
    probes = known.select(F.col("href").alias("url"), F.lit(7).cast("bigint").alias("size"), F.lit(b"II").alias("head"))
    footers = known.select(F.col("href").alias("url"), F.lit("geom").alias("geometry"), F.lit(9).cast("bigint").alias("rows"))
    edges = spark.createDataFrame([], "parent string")
    found = audit.target_checks(catalog.pick_targets(files), catalog.reads_items(files, edges), probes, footers, within(assets))
    return found.groupBy("check", "detail").agg(F.count("*").alias("n"))


@query("q03_item_read_globs", """SELECT "check", detail, CAST(ok AS BIGINT) AS ok, count(*) AS n FROM (
  SELECT 'load parquet' AS "check", o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS ok,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'HTTPS cannot list ' || '{HOST}/g' || o_orderkey % 5 || '/*.parquet' WHEN o_orderkey % 4 = 0 THEN 'The footer could not be read' ELSE 'geometry=geom estimate=9' END AS detail
  FROM orders) GROUP BY 1, 2, 3""".replace("{HOST}", HOST))
def q03_item_read_globs(spark, folder):
    from geoquarry.operators import catalog

    key = F.col("o_orderkey")
    glob = F.concat(F.lit(f"{HOST}/g"), key % 5, F.lit("/*.parquet"))
    none = F.lit(None).cast("string")
    orders = order_assets(spark, folder).join(table(spark, folder, "orders").select(F.concat(F.lit("o"), key).alias("url"), "o_orderkey"), "url")
    globs = orders.withColumns({"href": glob, "glob": glob, "read_url": none, "format": F.lit("parquet")})
    files = catalog.loadable(globs.drop("o_orderkey"), empty_links(spark))
    # Every third document has items; the file of every fourth of their first items has no footer.
    items = orders.where(key % 3 == 0).select(F.col("url").alias("document"), F.concat(F.lit("first of "), "url").alias("item_file"), "o_orderkey")
    footers = items.where(key % 4 != 0).select(F.col("item_file").alias("url"), F.lit("geom").alias("geometry"), F.lit(9).cast("bigint").alias("rows"))
    probes = spark.createDataFrame([], "url string, size bigint, head binary")
    blocked = catalog.reads_items(files, items.select(F.col("document").alias("parent")))
    found = audit.target_checks(catalog.pick_targets(files), blocked, probes, footers, within(orders), items)
    return found.groupBy("check", "detail", flag(F.col("ok")).alias("ok")).agg(F.count("*").alias("n"))


@query("q01_sweep", f"""WITH {GRAPH_SQL}, first AS (SELECT e.parent, min(e.pos) AS pos FROM edge e JOIN l3 ON l3.href = e.parent WHERE e.kind = 'item' AND e.parent NOT IN (SELECT href FROM bad) GROUP BY 1),
seen AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM first JOIN orders ON o_orderkey = pos WHERE o_orderkey % 19 <> 0)
SELECT "check", CAST(ok AS BIGINT) AS ok, count(*) AS n FROM (
  SELECT 'read' AS "check", false AS ok FROM walked WHERE failed AND depth < 4 UNION ALL SELECT 'read', false FROM first WHERE pos % 19 = 0
  UNION ALL SELECT 'no data', false FROM walked w WHERE depth = 3 AND NOT failed AND href NOT IN (SELECT parent FROM edge)
  UNION ALL SELECT 'thumbnail', false FROM walked WHERE depth = 3 AND NOT failed
  UNION ALL SELECT CASE s WHEN 'F' THEN 'view cog' WHEN 'O' THEN 'load parquet' ELSE 'load csv' END, k % 3 <> 0 FROM seen) GROUP BY 1, 2""")
def q01_sweep(spark, folder):
    documents, edges = graph(spark, folder)
    assets = order_assets(spark, folder).withColumn("href", F.concat(F.lit(f"{HOST}/"), F.col("url"), F.regexp_extract("href", r"(\.[a-z]+)$", 1))).withColumn("read_url", F.col("href"))
    known = assets.where("cast(substring(url, 2, 20) as bigint) % 3 <> 0")
    probes = known.select(F.col("href").alias("url"), F.lit(7).cast("bigint").alias("size"), F.lit(b"II").alias("head"))
    footers = known.select(F.col("href").alias("url"), F.lit("geom").alias("geometry"), F.lit(9).cast("bigint").alias("rows"))
    styles = spark.createDataFrame([], "style string, body string")
    roots = spark.range(1).select(F.lit("cat").alias("catalog"), F.lit("root").alias("root"))
    found = sweep(documents.withColumn("body", F.lit("{}")), edges, assets, empty_links(spark), roots, styles, probes, footers)
    return found.groupBy("check", flag(F.col("ok")).alias("ok")).agg(F.count("*").alias("n"))
