"""Feature files: scans, clips, filters, columns, types, sinks and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.functions import wkb
from geoquarry.functions.conditions import Compare, InList, IsNull, Like
from geoquarry.functions.projections import transform_box
from geoquarry.functions.shapes import polygons_of_text
from geoquarry.model import Area, Clip, CopySpec, MapView
from geoquarry.operators.audit import write_report
from geoquarry.operators.ranking import side_by_side
from geoquarry.plans.custom_select import check_select
from geoquarry.plans.dataset import GeoDataset, rerun
from geoquarry.plans.download import write_all_clipped
from geoquarry.session import scratch_path
from geoquarry.sources.object_store import bucket_settings
from geoquarry.sources.parquet import list_files, read_footers
from geoquarry.sources.text_features import read_csv, read_geojson
from workload.base import (
    AREA, AREA_BOX, BOX, BOX_SQL, EDGES_SQL, IN_AREA_SQL, PLACES_SQL, SHAPE_BOX_SQL, SHAPE_COVER_SQL, SHAPES_SQL,
    flag, place_columns, place_rows, places, query, shape_rows, shapes, stored, stored_shapes, table,
)

CLIP = Clip(BOX)
AREA_CLIP = Clip(AREA_BOX, AREA)


def stored_places(spark, folder) -> str:
    """Return the path of the point features below status folders."""
    return stored(spark, folder, "places", lambda path: place_rows(spark, folder).write.partitionBy("o_orderstatus").parquet(path))


@query("slice_box_filter_columns", f"""WITH {PLACES_SQL}
SELECT o_orderkey, o_totalprice, day FROM places
WHERE {BOX_SQL} AND o_orderstatus = 'O' AND o_totalprice > 150000.0""")
def slice_box_filter_columns(spark, folder):
    data = GeoDataset.read(spark, stored_places(spark, folder)).within(CLIP)
    kept = data.where(Compare("o_orderstatus", "=", "O") & Compare("o_totalprice", ">", 150000.0))
    return kept.select("o_totalprice", "o_orderkey", "day").rows().drop("geometry")


@query("s01_scan_glob_with_keys", f"""WITH {PLACES_SQL}
SELECT o_orderstatus, count(*) AS features, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM places GROUP BY 1""")
def s01_scan_glob_with_keys(spark, folder):
    data = GeoDataset.read(spark, stored_places(spark, folder) + "/o_orderstatus=*")
    return data.frame.groupBy("o_orderstatus").agg(F.count("*").alias("features"), F.sum("o_orderkey").alias("keys"))


@query("s02_list_files", "SELECT DISTINCT c_mktsegment AS segment, CAST(1 AS BIGINT) AS files FROM customer")
def s02_list_files(spark, folder):
    path = scratch_path(spark, "customers")
    table(spark, folder, "customer").repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    listed = list_files(spark, path + "/c_mktsegment=*/*.parquet")
    segment = F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1)
    return listed.groupBy(segment.alias("segment")).agg(F.count("*").alias("files"))


@query("l02_listing_order", "SELECT o_orderstatus AS status, row_number() OVER (ORDER BY o_orderstatus) AS place, CAST(1 AS BIGINT) AS together FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def l02_listing_order(spark, folder):
    listed = list_files(spark, stored_places(spark, folder) + "/o_orderstatus=*/*.parquet")
    status = F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1).alias("status")
    # Ids grow in the order of the listing; three groups of files are left for the window.
    rows = listed.select(status, F.monotonically_increasing_id().alias("n")).groupBy("status").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    order = Window.orderBy("low")
    apart = F.coalesce(F.col("high") < F.lead("low").over(order), F.lit(True))
    return rows.select("status", F.row_number().over(order).cast("bigint").alias("place"), flag(apart).alias("together"))


BUCKET_SQL = """bucket AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'eu-west-' || (n_nationkey % 3 + 1) || '.' ELSE 'data.' END || lower(replace(n_name, ' ', '-')) AS name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'eu-west-' || (n_nationkey % 3 + 1) ELSE 'us-east-1' END AS region FROM nation)"""


@query("s13_bucket_settings", f"""WITH {BUCKET_SQL} SELECT 'fs.s3a.bucket.' || name || '.path.style.access' AS setting, 'true' AS value FROM bucket
UNION ALL SELECT 'fs.s3a.bucket.' || name || '.endpoint.region', region FROM bucket""")
def s13_bucket_settings(spark, folder):
    key = F.col("n_nationkey")
    start = F.when(key % 2 == 0, F.concat(F.lit("eu-west-"), key % 3 + 1, F.lit("."))).otherwise("data.")
    named = F.concat(F.lit("s3://"), start, F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("/x.parquet"))
    # Settings belong to the session: one URL a bucket comes to the driver, and plain buckets need none.
    urls = [row[0] for row in table(spark, folder, "nation").select(named).distinct().collect()]
    found = bucket_settings([*urls, "s3://plain/x.parquet", "https://a.b/x.parquet"])
    return spark.createDataFrame(sorted(found.items()), "setting string, value string")


@query("s03_read_footers", f"WITH {PLACES_SQL} SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS features FROM places GROUP BY 1")
def s03_read_footers(spark, folder):
    footers = read_footers(list_files(spark, stored_places(spark, folder) + "/*/*.parquet"))
    status = F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1)
    return footers.groupBy(status.alias("o_orderstatus")).agg(F.sum("rows").alias("features"))


@query("s04_describe_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{kind}' AS kind, count({name}) AS filled FROM orders"
    for name, kind in (("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"))))
def s04_describe_columns(spark, folder):
    data = GeoDataset.read(spark, f"{folder}/orders.parquet")
    counts = data.frame.agg(*(F.count(name).alias(name) for name in data.plan.names))
    kinds = [F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.col(c.name).alias("filled")) for c in data.plan.columns]
    return counts.select(F.explode(F.array(*kinds)).alias("c")).select("c.*")


@query("s05_infer_plan", """SELECT 'geometry' AS geometry, 'bbox' AS covering, 'OGC:CRS84' AS crs, 'Unknown' AS geometry_type,
  'o_orderkey,o_custkey,o_totalprice,o_orderpriority,day,o_orderstatus' AS attributes, count(*) AS features FROM orders""")
def s05_infer_plan(spark, folder):
    data = GeoDataset.read(spark, stored_places(spark, folder))
    plan = data.plan
    return data.frame.agg(F.count("*").alias("features")).select(
        F.lit(plan.geometry).alias("geometry"), F.lit(plan.covering.west[0]).alias("covering"), F.lit(plan.crs).alias("crs"),
        F.lit(plan.geometry_type).alias("geometry_type"), F.lit(",".join(plan.names)).alias("attributes"), "features")


@query("s08_scan_csv_points", f"""WITH {PLACES_SQL}
SELECT o_orderstatus, count(*) AS points, min(x) AS west, max(y) AS north FROM places GROUP BY 1""")
def s08_scan_csv_points(spark, folder):
    path = scratch_path(spark, "csv")
    rows = place_columns(spark, folder).select("o_orderkey", "o_orderstatus", F.col("x").alias("Longitude"), F.col("y").alias("LAT"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    read = read_csv(spark, path).withColumn("b", wkb.envelope("geometry"))
    return read.groupBy("o_orderstatus").agg(F.count("geometry").alias("points"), F.min("b.xmin").alias("west"), F.max("b.ymax").alias("north"))


@query("s09_scan_geojson", f"""WITH {PLACES_SQL}
SELECT o_orderstatus, count(*) AS points, min(x) AS west, max(y) AS north FROM places GROUP BY 1""")
def s09_scan_geojson(spark, folder):
    # Files of at most 500 features each.
    path = scratch_path(spark, "geojson")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("o_orderkey", "o_orderstatus").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"),
    )
    rows = place_columns(spark, folder).withColumn("block", F.floor(F.col("o_orderkey") / 2000))
    files = rows.groupBy("block").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    files.write.partitionBy("block").text(path)
    read = read_geojson(spark, path + "/*/*.txt").select(F.try_variant_get("properties", "$.o_orderstatus", "string").alias("o_orderstatus"), wkb.envelope("geometry").alias("b"))
    return read.groupBy("o_orderstatus").agg(F.count("b").alias("points"), F.min("b.xmin").alias("west"), F.max("b.ymax").alias("north"))


@query("s11_items_as_one_table", f"WITH {PLACES_SQL} SELECT o_orderpriority, count(*) AS features FROM places WHERE {BOX_SQL} GROUP BY 1")
def s11_items_as_one_table(spark, folder):
    files = list_files(spark, stored_places(spark, folder) + "/*/*.parquet")
    data = GeoDataset.read(spark, [row.path for row in files.toLocalIterator()], confirmed=True)
    return data.within(CLIP).kept().groupBy("o_orderpriority").agg(F.count("*").alias("features"))


# ---- filters


def keyed(rows: DataFrame) -> DataFrame:
    """Return the order keys of kept rows."""
    return rows.select("o_orderkey")


@query("f01_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000.0 AND o_orderpriority <> '1-URGENT' AND o_orderkey < 40000 AND o_custkey > 10 AND o_custkey <= 1200")
def f01_compare(spark, folder):
    tests = [Compare("o_totalprice", ">=", 100000.0), Compare("o_orderpriority", "<>", "1-URGENT"), Compare("o_orderkey", "<", 40000), Compare("o_custkey", ">", 10), Compare("o_custkey", "<=", 1200)]
    return keyed(places(spark, folder).where(reduce(lambda a, b: a & b, tests)).kept())


@query("f02_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F', 'P')")
def f02_in_list(spark, folder):
    return keyed(places(spark, folder).where(InList("o_orderpriority", ("1-URGENT", "5-LOW")) & InList("o_orderstatus", ("F", "P"), negated=True)).kept())


@query("f03_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%0_1' AND c_mktsegment NOT LIKE 'B%' AND c_mktsegment ILIKE '%e%' AND c_name NOT ILIKE '%99%'")
def f03_like(spark, folder):
    data = GeoDataset.read(spark, f"{folder}/customer.parquet")
    test = Like("c_name", "%0_1") & Like("c_mktsegment", "B%", negated=True) & Like("c_mktsegment", "%e%", ignore_case=True) & Like("c_name", "%99%", negated=True, ignore_case=True)
    return data.where(test).kept().select("c_custkey")


@query("f04_is_null", "SELECT l.doc_id, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL OR d.lang IS NULL GROUP BY 1")
def f04_is_null(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels").withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"), "left")
    from geoquarry.sources.parquet import plan_read

    data = GeoDataset.over(joined, plan_read(joined.schema, None))
    return data.where(IsNull("quality", negated=True) | IsNull("lang")).kept().groupBy(F.col("label_id").alias("doc_id")).agg(F.count("*").alias("n"))


@query("f05_condition_tree", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR NOT (o_totalprice < 200000.0)) AND NOT (o_orderpriority LIKE '4%' AND o_orderstatus = 'O')")
def f05_condition_tree(spark, folder):
    left = Compare("o_orderstatus", "=", "O") | ~Compare("o_totalprice", "<", 200000.0)
    return keyed(places(spark, folder).where(left & ~(Like("o_orderpriority", "4%") & Compare("o_orderstatus", "=", "O"))).kept())


@query("f06_values_are_bound", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> 'x'' OR ''1''=''1' AND o_orderkey % 2 = 0")
def f06_values_are_bound(spark, folder):
    return keyed(places(spark, folder).where(Compare("o_orderpriority", "<>", "x' OR '1'='1")).kept().where("o_orderkey % 2 = 0"))


@query("f07_stored_filter_forms", "SELECT o_orderkey FROM orders WHERE o_totalprice > -5.5 AND NOT (o_orderstatus IN ('F'))")
def f07_stored_filter_forms(spark, folder):
    from geoquarry.functions.conditions import condition_of

    stored = (Compare("o_totalprice", ">", -5.5) & ~InList("o_orderstatus", ("F",))).to_dict()
    return keyed(places(spark, folder).where(condition_of(stored)).kept())


@query("f08_geometry_present", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def f08_geometry_present(spark, folder):
    rows = place_rows(spark, folder).withColumn("geometry", F.when(F.col("o_orderkey") % 7 != 0, F.col("geometry")))
    return keyed(GeoDataset.over(rows, places(spark, folder).plan).kept())


@query("f09_covering_prefilter", f"WITH {SHAPES_SQL} SELECT o_orderkey FROM shapes WHERE {SHAPE_COVER_SQL}")
def f09_covering_prefilter(spark, folder):
    return keyed(shapes(spark, folder).within(CLIP).kept(exact=False))


@query("f10_touches_box", f"WITH {SHAPES_SQL} SELECT o_orderkey, kind FROM shapes WHERE {SHAPE_BOX_SQL}")
def f10_touches_box(spark, folder):
    return shapes(spark, folder).within(CLIP).kept().select("o_orderkey", "kind")


@query("f10_touches_box_without_covering", f"WITH {SHAPES_SQL} SELECT o_orderkey, kind FROM shapes WHERE {SHAPE_BOX_SQL}")
def f10_touches_box_without_covering(spark, folder):
    from geoquarry.sources.parquet import plan_read

    rows = shape_rows(spark, folder).drop("bbox")
    return GeoDataset.over(rows, plan_read(rows.schema, None)).within(CLIP).kept().select("o_orderkey", "kind")


@query("f11_touches_area", f"WITH {PLACES_SQL}, {EDGES_SQL} SELECT o_orderkey FROM places WHERE {IN_AREA_SQL}")
def f11_touches_area(spark, folder):
    return keyed(places(spark, folder).within(AREA_CLIP).kept())


@query("f11_touches_area_exact_kernel", f"WITH {PLACES_SQL}, {EDGES_SQL} SELECT o_orderkey FROM places WHERE {IN_AREA_SQL}")
def f11_touches_area_exact_kernel(spark, folder):
    touches = wkb.intersects_test(polygons_of_text(AREA))
    return place_rows(spark, folder).where(touches("geometry")).select("o_orderkey")


@query("f12_clip_rules", f"""WITH {PLACES_SQL}, {EDGES_SQL}
SELECT 'whole' AS clip, count(*) AS features FROM places UNION ALL
SELECT 'table', count(*) FROM part UNION ALL
SELECT 'area', count(*) FROM places WHERE {IN_AREA_SQL} AND o_orderstatus = 'F'""")
def f12_clip_rules(spark, folder):
    data = places(spark, folder)
    parts = GeoDataset.read(spark, f"{folder}/part.parquet").within(CLIP)
    chosen = [("whole", data), ("table", parts), ("area", data.within(AREA_CLIP).where(Compare("o_orderstatus", "=", "F")))]
    return reduce(DataFrame.unionByName, [d.kept().agg(F.count("*").alias("features")).select(F.lit(n).alias("clip"), "features") for n, d in chosen])


@query("f20_check_select", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def f20_check_select(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("checked_orders")
    return spark.sql(check_select(spark, "SELECT o_orderstatus AS status, count(*) AS n FROM checked_orders GROUP BY 1; -- one ; statement"))


# ---- projections


@query("p01_chosen_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def p01_chosen_columns(spark, folder):
    return places(spark, folder).select("o_totalprice", "o_orderkey").rows().drop("geometry")


@query("p02_field_kinds", """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, CAST(o_orderkey % 2 = 0 AS BIGINT) AS even,
  '{"status":"' || o_orderstatus || '"}' AS nested FROM orders""")
def p02_field_kinds(spark, folder):
    from geoquarry.sources.parquet import plan_read

    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), (F.col("o_orderkey") % 2 == 0).alias("even"), F.struct(F.col("o_orderstatus").alias("status")).alias("nested"))
    return GeoDataset.over(rows, plan_read(rows.schema, None)).rows().withColumn("even", flag(F.col("even")))


@query("p03_reserved_name", "SELECT o_orderkey AS ogc_fid, o_custkey FROM orders")
def p03_reserved_name(spark, folder):
    from geoquarry.sources.parquet import plan_read

    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("OGC_FID"), "o_custkey")
    return GeoDataset.over(rows, plan_read(rows.schema, None)).rows()


@query("p04_free_names", "SELECT 'fid_1' AS fid_name, 'geom_2' AS geometry_name, count(*) AS features FROM orders")
def p04_free_names(spark, folder):
    from geoquarry.sources.parquet import plan_read

    rows = place_rows(spark, folder).select("geometry", F.col("o_orderkey").alias("FID"), F.col("day").alias("geom"), F.col("o_custkey").alias("Geom_1"))
    data = GeoDataset.over(rows, plan_read(rows.schema, None))
    return data.kept().agg(F.count("*").alias("features")).select(F.lit(data.fid_name).alias("fid_name"), F.lit(data.geometry_name).alias("geometry_name"), "features")


@query("p05_attributes_only", f"WITH {PLACES_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, day FROM places")
def p05_attributes_only(spark, folder):
    data = places(spark, folder)
    return data.frame.select(*data.attributes())


@query("p06_nested_path", f"WITH {PLACES_SQL} SELECT o_orderkey, x, y FROM places")
def p06_nested_path(spark, folder):
    from geoquarry.plans.dataset import path_column

    data = places(spark, folder)
    sides = data.plan.covering
    return data.frame.select("o_orderkey", path_column(sides.west).alias("x"), path_column(sides.north).alias("y"))


KINDS_SQL = "CASE kind WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' ELSE 'MultiPoint' END"


@query("p07_normalised_types", f"""WITH {SHAPES_SQL}
SELECT o_orderkey, CASE WHEN kind IN (0, 3) THEN 'MultiPoint' END AS shown FROM shapes""")
def p07_normalised_types(spark, folder):
    rows = shapes(spark, folder).rows("MultiPoint")
    return rows.select("o_orderkey", wkb.geometry_type(F.col("geometry")).alias("shown"))


@query("p08_preview_shows_types", f"WITH {SHAPES_SQL} SELECT o_orderkey, upper({KINDS_SQL}) AS geometry FROM shapes WHERE {SHAPE_BOX_SQL}")
def p08_preview_shows_types(spark, folder):
    data = shapes(spark, folder).within(CLIP).select("o_orderkey")
    return data.preview(limit=2**31 - 1).select("o_orderkey", "geometry")


@query("p09_custom_select", f"WITH {PLACES_SQL} SELECT o_orderpriority AS priority, o_orderkey * 2 AS twice FROM places WHERE o_totalprice < 50000.0")
def p09_custom_select(spark, folder):
    own = places(spark, folder).within(CLIP).sql("SELECT geometry, o_orderpriority AS priority, o_orderkey * 2 AS twice FROM features_p09 WHERE o_totalprice < 50000.0;", view="features_p09")
    return own.rows().drop("geometry")


@query("p10_custom_result_plan", "SELECT 'geometry' AS geometry, 'Unknown' AS geometry_type, 'o_orderkey' AS attributes, count(*) AS features FROM orders WHERE o_orderkey % 3 = 0")
def p10_custom_result_plan(spark, folder):
    own = places(spark, folder).sql("SELECT o_orderkey, geometry FROM features_p10 WHERE o_orderkey % 3 = 0", view="features_p10")
    return own.kept().agg(F.count("*").alias("features")).select(F.lit(own.plan.geometry).alias("geometry"), F.lit(own.plan.geometry_type).alias("geometry_type"), F.lit(",".join(own.plan.names)).alias("attributes"), "features")


# ---- counts and types


@query("a01_estimate", f"""WITH {SHAPES_SQL}
SELECT 'whole' AS part, count(*) AS features FROM shapes UNION ALL
SELECT 'boxed', count(*) FROM shapes WHERE {SHAPE_COVER_SQL} AND o_orderstatus = 'O'""")
def a01_estimate(spark, folder):
    data = shapes(spark, folder)
    boxed = data.within(CLIP).where(Compare("o_orderstatus", "=", "O"))
    return reduce(DataFrame.unionByName, [d.estimate_frame().select(F.lit(n).alias("part"), "features") for n, d in (("whole", data), ("boxed", boxed))])


@query("a02_exact_count_of_select", "SELECT count(*) AS features FROM orders WHERE o_totalprice > 100000.0")
def a02_exact_count_of_select(spark, folder):
    return places(spark, folder).within(CLIP).sql("SELECT * FROM features_a02 WHERE o_totalprice > 100000.0", view="features_a02").estimate_frame()


@query("a03_refused_features", f"WITH {SHAPES_SQL} SELECT count(*) AS features, count(*) FILTER (WHERE kind <> 2) AS refused FROM shapes WHERE {SHAPE_BOX_SQL}")
def a03_refused_features(spark, folder):
    rows = shapes(spark, folder).within(CLIP).rows("MultiPolygon")
    return rows.agg(F.count("*").alias("features"), F.count_if(F.col("geometry").isNull()).alias("refused"))


@query("a04_first_type", f"WITH {SHAPES_SQL} SELECT {KINDS_SQL} AS family, CAST(0 AS BIGINT) AS z FROM shapes WHERE {SHAPE_BOX_SQL} ORDER BY o_orderkey LIMIT 1")
def a04_first_type(spark, folder):
    path = scratch_path(spark, "sorted-shapes")
    # One file per status range keeps path order equal to key order.
    shape_rows(spark, folder).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return GeoDataset.read(spark, path).within(CLIP).first_type_frame().select("family", flag(F.col("z")).alias("z"))


@query("a05_declared_types", f"""WITH {SHAPES_SQL}
SELECT o_orderstatus, CASE WHEN count(DISTINCT kind) = 1 THEN max({KINDS_SQL}) WHEN count(DISTINCT kind) = 2 AND min(kind) = 0 AND max(kind) = 3 THEN 'MultiPoint' ELSE 'Unknown' END AS layer_type
FROM shapes WHERE kind IN (0, 3) OR (kind = 1 AND o_orderstatus = 'P') GROUP BY 1""")
def a05_declared_types(spark, folder):
    kind = wkb.geometry_type(F.col("geometry"))
    rows = shape_rows(spark, folder).where("kind in (0, 3) or (kind = 1 and o_orderstatus = 'P')")
    # At most seven type names per group.
    types = rows.groupBy("o_orderstatus").agg(F.array_sort(F.collect_set(kind)).alias("types"))
    return types.select("o_orderstatus", wkb.layer_type_of(F.col("types")).alias("layer_type"))


@query("a09_layer_envelope", f"WITH {SHAPES_SQL} SELECT min(x) AS west, min(y) AS south, max(x + w) AS east, max(y + h) AS north, count(*) AS polygons, count(*) AS geometries FROM shapes WHERE kind = 2")
def a09_layer_envelope(spark, folder):
    from geoquarry.operators.spatial import layer_envelope

    return layer_envelope(shape_rows(spark, folder).where("kind = 2"))


@query("l01_preview", "SELECT CAST(least(100, count(*)) AS BIGINT) AS shown FROM orders WHERE o_orderstatus = 'P'")
def l01_preview(spark, folder):
    return places(spark, folder).where(Compare("o_orderstatus", "=", "P")).preview().agg(F.count("*").alias("shown"))


@query("l07_thresholds", f"WITH {PLACES_SQL} SELECT count(*) AS features, CAST(count(*) > 1000000 AS BIGINT) AS asks_first FROM places WHERE {BOX_SQL}")
def l07_thresholds(spark, folder):
    from geoquarry.plans.dataset import CONFIRM_FEATURES

    counted = places(spark, folder).within(CLIP).estimate_frame()
    return counted.select("features", flag(F.col("features") > CONFIRM_FEATURES).alias("asks_first"))


# ---- geometry functions


@query("g02_geometry_type", f"WITH {SHAPES_SQL} SELECT {KINDS_SQL} AS kind, count(*) AS n FROM shapes GROUP BY 1")
def g02_geometry_type(spark, folder):
    return shape_rows(spark, folder).groupBy(wkb.geometry_type(F.col("geometry")).alias("kind")).agg(F.count("*").alias("n"))


@query("g03_has_z", f"WITH {SHAPES_SQL} SELECT o_orderkey, CAST(kind = 1 AS BIGINT) AS z FROM shapes")
def g03_has_z(spark, folder):
    raised = F.concat(F.unhex(F.lit("01EA030000")), F.substring("geometry", 6, 2**31 - 1))
    rows = shape_rows(spark, folder).withColumn("geometry", F.when(F.col("kind") == 1, raised).otherwise(F.col("geometry")))
    return rows.select("o_orderkey", flag(wkb.has_z(F.col("geometry"))).alias("z"))


@query("g04_multi", f"WITH {SHAPES_SQL} SELECT o_orderkey, CASE kind WHEN 0 THEN 'MultiPoint' WHEN 1 THEN 'MultiLineString' WHEN 2 THEN 'MultiPolygon' ELSE 'MultiPoint' END AS shown, x FROM shapes")
def g04_multi(spark, folder):
    wrapped = shape_rows(spark, folder).withColumn("geometry", wkb.as_multi(F.col("geometry")))
    return wrapped.select("o_orderkey", wkb.geometry_type(F.col("geometry")).alias("shown"), wkb.envelope("geometry")["xmin"].alias("x"))


@query("g05_points_from_columns", f"WITH {PLACES_SQL} SELECT o_orderkey, x, y FROM places")
def g05_points_from_columns(spark, folder):
    box = wkb.envelope(wkb.point_wkb("x", "y")).alias("b")
    return place_columns(spark, folder).select("o_orderkey", box).select("o_orderkey", F.col("b.xmin").alias("x"), F.col("b.ymax").alias("y"))


@query("g06_area_from_text", f"WITH {PLACES_SQL} SELECT o_orderkey FROM places WHERE x >= -20.0 AND y >= -10.0 AND x + y <= 40.0")
def g06_area_from_text(spark, folder):
    touches = wkb.intersects_test(polygons_of_text("MULTIPOLYGON(((-20 -10, 50 -10, -20 60, -20 -10)))"))
    return place_rows(spark, folder).where(touches("geometry")).select("o_orderkey")


@query("g07_intersects_triangles", f"""WITH {SHAPES_SQL} SELECT o_orderkey FROM shapes WHERE kind = 2 AND x <= 60.5 AND y <= 40.25
  AND greatest(0.0, -40 - x) <= w AND greatest(0.0, -20 - y) <= h AND greatest(0.0, -40 - x) * h + greatest(0.0, -20 - y) * w <= w * h""")
def g07_intersects_triangles(spark, folder):
    from geoquarry.functions.shapes import box_polygon

    touches = wkb.intersects_test(box_polygon(*BOX))
    return shape_rows(spark, folder).where("kind = 2").where(touches("geometry")).select("o_orderkey")


@query("g07_intersects_shapes", f"WITH {SHAPES_SQL} SELECT o_orderkey FROM shapes WHERE {SHAPE_BOX_SQL}")
def g07_intersects_shapes(spark, folder):
    from geoquarry.functions.shapes import box_polygon

    return shape_rows(spark, folder).where(wkb.intersects_test(box_polygon(*BOX))("geometry")).select("o_orderkey")


@query("g08_envelope", f"WITH {SHAPES_SQL} SELECT o_orderkey, x AS xmin, y AS ymin, CASE WHEN kind = 0 THEN x ELSE x + w END AS xmax, CASE WHEN kind = 0 THEN y ELSE y + h END AS ymax FROM shapes")
def g08_envelope(spark, folder):
    return shape_rows(spark, folder).select("o_orderkey", wkb.envelope("geometry").alias("b")).select("o_orderkey", "b.*")


_W, _S, _E, _N = transform_box((-40.0, -20.0, 60.5, 40.25), "EPSG:4326", "EPSG:3857")


@query("g09_box_in_file_crs", f"WITH {PLACES_SQL} SELECT o_orderkey FROM places WHERE x * 111000.0 BETWEEN {_W!r} AND {_E!r} AND y * 111000.0 BETWEEN {_S!r} AND {_N!r}")
def g09_box_in_file_crs(spark, folder):
    from geoquarry.sources.parquet import plan_read

    rows = place_columns(spark, folder).select("o_orderkey", wkb.point_wkb(F.col("x") * 111000.0, F.col("y") * 111000.0).alias("geometry"))
    geo = '{"primary_column": "geometry", "columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": 3857}}}}}'
    return GeoDataset.over(rows, plan_read(rows.schema, geo)).within(MapView(BOX)).kept().select("o_orderkey")


# ---- sinks


@query("k01_write_features", f"""WITH {SHAPES_SQL} SELECT count(*) AS features, count(*) FILTER (WHERE kind NOT IN (0, 3)) AS refused, min(CASE WHEN kind IN (0, 3) THEN x END) AS west,
  count(*) AS told, 'MultiPoint' AS types, 'WKB' AS encoding, 'bbox.xmin' AS west_column, '1.1.0' AS version, min(CASE WHEN kind IN (0, 3) THEN x END) AS extent_west FROM shapes WHERE {SHAPE_BOX_SQL}""")
def k01_write_features(spark, folder):
    from dataclasses import replace

    path = scratch_path(spark, "copy")
    data = GeoDataset.read(spark, stored_shapes(spark, folder)).within(CLIP)
    typed = replace(data, plan=replace(data.plan, shape=data.plan.shape._replace(kind="MultiPoint")))
    written = typed.write(path, confirmed=True)
    about = "$.columns.geom"
    footers = read_footers(list_files(spark, path)).select(
        "rows", *(F.get_json_object("geo", at).alias(name) for name, at in (
            ("version", "$.version"), ("types", f"{about}.geometry_types[0]"), ("encoding", f"{about}.encoding"), ("extent_west", f"{about}.bbox[0]"),
            ("top", f"{about}.covering.bbox.xmin[0]"), ("side", f"{about}.covering.bbox.xmin[1]"))))
    told = footers.agg(F.sum("rows").alias("told"), F.max("types").alias("types"), F.min("encoding").alias("encoding"), F.max("version").alias("version"),
                       F.max(F.concat_ws(".", "top", "side")).alias("west_column"), F.min(F.col("extent_west").cast("double")).alias("extent_west"))
    west = spark.read.parquet(path).agg(F.min("bbox.xmin").alias("west"), F.lit(written.features).cast("bigint").alias("features"), F.lit(written.refused).cast("bigint").alias("refused"))
    return side_by_side(west, told)


@query("k02_write_table", "SELECT p_brand, count(*) AS parts, min(p_retailprice) AS cheapest FROM part WHERE p_size > 10 GROUP BY 1")
def k02_write_table(spark, folder):
    path = scratch_path(spark, "table")
    GeoDataset.read(spark, f"{folder}/part.parquet").within(CLIP).where(Compare("p_size", ">", 10)).write(path, confirmed=True)
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("parts"), F.min("p_retailprice").alias("cheapest"))


@query("k03_clipped_copies", f"""WITH {PLACES_SQL}, counted AS (SELECT o_orderstatus AS asset, count(*) AS features FROM places
WHERE {BOX_SQL} AND (o_orderstatus <> 'O' OR o_totalprice > 100000.0) GROUP BY 1)
SELECT asset, features, features AS written, 'MultiPoint' AS layer_type FROM counted""")
def k03_clipped_copies(spark, folder):
    source, target = stored_places(spark, folder), scratch_path(spark, "clipped")
    copies = []
    for status in ("F", "O", "P"):
        data = GeoDataset.read(spark, f"{source}/o_orderstatus={status}")
        copies.append((data.where(Compare("o_totalprice", ">", 100000.0)) if status == "O" else data, f"{target}/asset={status}"))
    written = write_all_clipped(copies, MapView(BOX))
    told = spark.createDataFrame([(path[-1], one.features, one.geometry_type) for (_, path), one in zip(copies, written, strict=True)], "asset string, written bigint, layer_type string")
    return spark.read.parquet(target).groupBy("asset").agg(F.count("*").alias("features")).join(told, "asset").select("asset", "features", "written", "layer_type")


CHECKS_SQL = """checks AS (SELECT 'catalog-' || l_suppkey AS catalog, l_orderkey || '/' || l_linenumber AS document,
  l_returnflag AS "check", l_linestatus = 'O' AS ok FROM lineitem)"""


def check_rows(spark, folder) -> DataFrame:
    """Return line items as audit checks."""
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("catalog-"), F.col("l_suppkey")).alias("catalog"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("document"),
        F.col("l_returnflag").alias("check"), (F.col("l_linestatus") == "O").alias("ok"), F.lit("").alias("detail"))


@query("k04_write_report", f"""WITH {CHECKS_SQL}
SELECT CAST((SELECT count(*) FROM checks WHERE NOT ok) + (SELECT count(DISTINCT "check") FROM checks WHERE NOT ok) + 7 AS BIGINT) AS lines,
  CAST(count(*) FILTER (WHERE NOT ok) > 0 AS BIGINT) AS status, count(*) AS checks FROM checks""")
def k04_write_report(spark, folder):
    path = scratch_path(spark, "report")
    status = write_report(check_rows(spark, folder), path)
    lines = spark.read.text(f"{path}/summary").agg(F.count("*").alias("lines"))
    stored = spark.read.json(f"{path}/checks").agg(F.count("*").alias("checks"))
    return side_by_side(lines, stored).select("lines", F.lit(status).cast("bigint").alias("status"), "checks")


@query("k05_run_copy_again", f"WITH {PLACES_SQL}, {EDGES_SQL} SELECT o_orderkey, day FROM places WHERE {IN_AREA_SQL} AND o_orderpriority = '2-HIGH'")
def k05_run_copy_again(spark, folder):
    data = GeoDataset.read(spark, stored_places(spark, folder)).within(Area(AREA, AREA_BOX)).where(Compare("o_orderpriority", "=", "2-HIGH")).select("day", "o_orderkey")
    stored = spark.createDataFrame([(data.spec().to_json(),)], "spec string")
    path = scratch_path(spark, "specs")
    stored.coalesce(1).write.text(path)
    return rerun(spark, CopySpec.from_json(spark.read.text(path).first().value)).rows().drop("geometry")
