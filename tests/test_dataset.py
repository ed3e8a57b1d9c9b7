"""Feature files end to end: clip, filter, choose, normalise, write."""

import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from geoquarry.functions import wkb
from geoquarry.functions.conditions import Compare, InList, IsNull, Like, condition_of
from geoquarry.functions.projections import area_of, clip_for, to_degrees, to_web_map, transform_box
from geoquarry.model import Clip, ConfirmationNeeded, CopySpec, Everything, FeatureFileError, MapView, QueryError
from geoquarry.plans.custom_select import check_select
from geoquarry.plans.dataset import GeoDataset, rerun, write_together
from geoquarry.sources.geoparquet_sink import Target, write_targets
from geoquarry.sources.object_store import bucket_settings
from geoquarry.sources.parquet import first_geo_text, list_files, plan_read, read_footers, scan
from tests.test_shapes import line, multi, point, polygon, square

BOX = (11.1, 44.0, 11.3, 44.15)
ELL = "POLYGON((11 44, 11.205 44, 11.205 44.2, 11.1 44.2, 11.1 44.02, 11 44.02, 11 44))"


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pts") / "points")
    frame = spark.range(200).select(
        "id", F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") / 4).cast("decimal(10,2)").alias("val"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        (11 + F.col("id") * 0.01).alias("x"), (44 + F.col("id") * 0.005).alias("y"),
    )
    frame = frame.select(
        "id", "name", "val", "day", wkb.point_wkb("x", "y").alias("geometry"),
        F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")).alias("bbox"),
    )
    frame.repartition(3).write.parquet(path)
    return path


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


def test_box_and_area(spark, points):
    data = GeoDataset.read(spark, points)
    assert data.plan.covering and data.plan.names == ("id", "name", "val", "day")
    boxed = data.within(Clip(BOX))
    assert ids(boxed.rows()) == list(range(10, 31)) and boxed.estimate() == 21
    area = data.within(Clip((11.0, 44.0, 11.205, 44.2), ELL))
    bare = GeoDataset.over(data.frame.drop("bbox"), plan_read(data.frame.drop("bbox").schema, None))
    assert ids(area.rows()) == ids(bare.within(area.clip).rows())
    assert bare.within(area.clip).estimate() is None and bare.estimate() == 200
    plan = area.kept()._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "bbox.xmin" in plan
    assert data.within(Everything()).estimate() == 200
    assert ids(data.within(MapView(BOX)).rows()) == list(range(10, 31))


def test_filters_and_columns(spark, points):
    data = GeoDataset.read(spark, points)
    kept = data.where((Compare("id", ">=", 5) & ~Like("name", "n1%")) | IsNull("day"))
    assert ids(kept.rows())[:5] == [5, 6, 7, 8, 9]
    assert ids(data.where(InList("name", ("n3", "n4"))).rows()) == [3, 4]
    assert data.where(Like("name", "N1_", ignore_case=True)).estimate() == 10
    assert data.where(Like("name", "n\\b")).estimate() == 0
    assert data.select("day", "id").rows().columns == ["geometry", "id", "day"]
    assert dict(data.rows().dtypes)["val"] == "double"
    for bad in (lambda: data.select("ID"), lambda: data.where(Compare("nope", "=", 1)), lambda: Compare("id", "~", 1),
                lambda: Compare("id", "=", None), lambda: InList("id", (None,)), lambda: Compare("id", "=", F.col("val"))):
        with pytest.raises(QueryError):
            bad()
    stored = json.loads(json.dumps((Compare("id", ">", 1) & InList("name", ("a",), True)).to_dict()))
    assert condition_of(stored) == Compare("id", ">", 1) & InList("name", ("a",), True)


def test_write_and_rerun(spark, points, tmp_path):
    data = GeoDataset.read(spark, points).within(Clip(BOX)).where(Compare("id", "<", 20)).select("id")
    written = data.write(str(tmp_path / "copy"), clustered=True)
    assert (written.features, written.geometry_type, written.refused) == (10, "MultiPoint", 0)
    copy = GeoDataset.read(spark, str(tmp_path / "copy"))
    assert copy.plan.geometry == "geom" and copy.plan.covering is not None
    assert copy.preview().first().geom == "MULTIPOINT"
    spec = CopySpec.from_json(data.spec().to_json())
    assert ids(rerun(spark, spec).rows()) == list(range(10, 20))
    footers = read_footers(list_files(spark, str(tmp_path / "copy"))).collect()
    assert sum(row.rows for row in footers) == 10 and not [name for name in os.listdir(tmp_path / "copy") if not name.startswith("part-")]
    about = [json.loads(row.geo) for row in footers if row.rows]
    assert {one["primary_column"] for one in about} == {"geom"} and {one["version"] for one in about} == {"1.1.0"}
    columns = [one["columns"]["geom"] for one in about]
    assert all(one["geometry_types"] == ["MultiPoint"] and one["covering"]["bbox"]["ymax"] == ["bbox", "ymax"] and "crs" not in one for one in columns)
    extent = spark.read.parquet(str(tmp_path / "copy")).agg(F.min("bbox.xmin"), F.max("bbox.ymax")).first()
    assert (min(one["bbox"][0] for one in columns), max(one["bbox"][3] for one in columns)) == tuple(extent)
    with pytest.raises(FileExistsError):
        data.write(str(tmp_path / "copy"))


def test_empty_copies_and_systems(spark, points, tmp_path):
    nothing = GeoDataset.read(spark, points).within(Clip(BOX)).where(Compare("id", ">", 10_000))
    assert nothing.write(str(tmp_path / "none")).features == 0
    again = GeoDataset.read(spark, str(tmp_path / "none"))
    assert again.rows().count() == 0 and again.plan.geometry == "geom"
    whole = json.dumps({"type": "ProjectedCRS", "name": "mine"})
    for system, back in (("EPSG:4326", "EPSG:4326"), ("EPSG:3857", "EPSG:3857"), ("", ""), (whole, whole)):
        data = GeoDataset.read(spark, points)
        data = replace(data, plan=replace(data.plan, shape=data.plan.shape._replace(crs=system)))
        path = str(tmp_path / f"crs{len(system)}{system[-4:].strip('}')}".replace('"', ""))
        data.write(path)
        assert GeoDataset.read(spark, path).plan.crs == back


def test_copies_of_one_job(spark, points, tmp_path):
    table = str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id string, note string").write.parquet(table)
    data = GeoDataset.read(spark, points)
    copies = [(data.within(Clip(BOX)).where(Compare("id", "<", 20)), str(tmp_path / "one")), (GeoDataset.read(spark, table), str(tmp_path / "two")),
              (data.where(Compare("id", ">", 10_000)), str(tmp_path / "three")), (data.select("id"), str(tmp_path / "four"))]
    tracker, group = spark.sparkContext.statusTracker(), "copies-of-one-job"
    spark.sparkContext.setJobGroup(group, group)
    written = write_together(copies)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [one.features for one in written] == [10, 3, 0, data.rows().count()]
    assert [one.geometry_type for one in written] == ["MultiPoint", "None", "Point", "MultiPoint"]
    # Types that no footer tells, the write, and its counts, with the stages of adaptive plans as jobs; none per copy.
    assert len(tracker.getJobIdsForGroup(group)) <= 6
    assert ids(GeoDataset.read(spark, str(tmp_path / "one")).rows()) == list(range(10, 20))
    assert spark.read.parquet(str(tmp_path / "two")).columns == ["id", "note"] and GeoDataset.read(spark, str(tmp_path / "two")).plan.geometry is None
    assert dict(spark.read.parquet(str(tmp_path / "three")).dtypes) == dict(spark.read.parquet(str(tmp_path / "one")).dtypes)
    assert spark.read.parquet(str(tmp_path / "four")).columns == ["geom", "id", "bbox"]
    assert write_together([]) == []


def test_failed_copies_leave_nothing(spark, tmp_path):
    boom = F.udf(lambda value: 1 // (value - 7), "int")
    rows = spark.range(20).select(boom("id").alias("id"))
    with pytest.raises(Exception, match="division|ZeroDivision"):
        write_targets(rows, [Target(str(tmp_path / "out"), (("id", "id"),))])
    assert not (tmp_path / "out").exists()
    # A task that is killed while the job ends may leave a part below the hidden folder.
    assert all("/.writing-" in folder for folder, _, names in os.walk(tmp_path) if names)


def shapes_frame(spark, values, extra=""):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, geometry binary")


def test_types_refused_and_names(spark, tmp_path):
    mixed = shapes_frame(spark, [point(1, 1), multi(4, point(2, 2)), line([(0, 0), (1, 1)]), None]).withColumn("fid", F.lit(1)).withColumn("geom", F.lit("x")).withColumn("OGC_FID", F.lit(7))
    path = str(tmp_path / "mixed")
    mixed.coalesce(1).write.parquet(path)
    data = GeoDataset.read(spark, path)
    assert (data.fid_name, data.geometry_name) == ("fid_1", "geom_1")
    written = data.write(str(tmp_path / "out"))
    assert (written.features, written.geometry_type, written.refused) == (3, "MultiPoint", 1)
    assert "ogc_fid" in spark.read.parquet(str(tmp_path / "out")).columns
    typed = data.within(Clip((0.4, 0.4, 0.6, 0.6)))
    assert typed.layer_type() == "MultiLineString"
    assert data.within(Clip((50.0, 50.0, 51.0, 51.0))).layer_type() == "Point"
    geo = json.dumps({"primary_column": "geometry", "columns": {"geometry": {"geometry_types": ["Polygon"], "crs": {"id": {"authority": "EPSG", "code": 3857}}}}})
    frame = shapes_frame(spark, [polygon(square(0, 0, 1)), multi(6, polygon(square(0, 0, 1)))])
    declared = GeoDataset.over(frame, plan_read(frame.schema, geo))
    assert declared.plan.crs == "EPSG:3857" and declared.layer_type() == "Polygon"
    assert [r.geometry is None for r in declared.rows("Polygon").orderBy("id").collect()] == [False, True]


def test_first_type_over_many_files(spark, tmp_path):
    for name, value in (("a", point(90, 80)), ("b b", line([(0, 0), (1, 1)])), ("c", point(0, 0))):
        shapes_frame(spark, [value]).coalesce(1).write.parquet(str(tmp_path / f"part={name}"))
    data = GeoDataset.read(spark, str(tmp_path / "part=*"))
    assert data.plan.names == ("id", "part")
    assert data.layer_type() == "MultiPoint"
    assert data.within(Clip((-1.0, -1.0, 2.0, 2.0))).layer_type() == "MultiLineString"
    assert data.where(Compare("part", ">", "b b")).layer_type() == "MultiPoint"
    assert data.where(Compare("part", "=", "b b")).layer_type() == "MultiLineString"


def test_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, "a", "g")], "id int, name string, geom string").write.parquet(path)
    data = GeoDataset.read(spark, path).within(Clip((0.0, 0.0, 1.0, 1.0)))
    assert not data.plan.has_geometry and data.estimate() == 1
    written = data.write(str(tmp_path / "copy"))
    assert (written.features, written.geometry_type) == (1, "None")
    with pytest.raises(FeatureFileError):
        plan_read(spark.read.parquet(path).schema, '{"primary_column": "shape"}')
    with pytest.raises(ConfirmationNeeded):
        GeoDataset.read(spark, ["x"] * 501)


def test_custom_select(spark, points, tmp_path):
    data = GeoDataset.read(spark, points).within(Clip(BOX))
    own = data.sql("SELECT geometry, id * 2 AS twice FROM features WHERE id < 5; -- done; really")
    assert own.estimate() == 5 and own.plan.names == ("twice",) and own.plan.covering is None
    assert own.write(str(tmp_path / "sql")).geometry_type == "MultiPoint"
    with pytest.raises(QueryError):
        data.sql("SELECT id FROM features")
    assert check_select(spark, "SELECT ';' AS a ;") == "SELECT ';' AS a"
    assert check_select(spark, "SELECT 1 AS a -- tail") == "SELECT 1 AS a -- tail"
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE x", "", " ; ", "CREATE TABLE t AS SELECT 1", "INSERT INTO t SELECT 1", "SELECT FROM WHERE", "SELECT nope FROM features"):
        with pytest.raises(QueryError):
            check_select(spark, bad)
    assert spark.catalog.listTables() == [] or all(not t.name.startswith("checked_") for t in spark.catalog.listTables())


def test_files_and_footers(spark, points):
    files = list_files(spark, points + "/*.parquet")
    assert [r.path for r in files.collect()] == sorted(r.path for r in files.collect())
    assert read_footers(files).agg(F.sum("rows")).first()[0] == 200
    assert first_geo_text(spark, points) is None
    assert scan(spark, [r.path for r in files.collect()]).count() == 200


def test_projections_and_areas():
    x, y = to_web_map(12.0, 42.0)
    assert to_degrees(x, y) == pytest.approx((12.0, 42.0))
    assert transform_box((1.0, 2.0, 3.0, 4.0), "EPSG:4326", "OGC:CRS84") == (1.0, 2.0, 3.0, 4.0)
    moved = clip_for(area_of("POLYGON((0 0, 10 0, 10 10, 0 0))"), "EPSG:3857")
    assert moved.bbox[2] == pytest.approx(to_web_map(10, 0)[0])
    with pytest.raises(ValueError):
        clip_for(MapView((0, 0, 1, 1)), "EPSG:32633")
    across = area_of("POLYGON((177 -19, 182 -19, 182 -16, 177 -16, 177 -19))")
    assert across.bbox == (177.0, -19.0, -178.0, -16.0)
    assert across.wkt.startswith("MULTIPOLYGON") and "-178.0" in across.wkt
    with pytest.raises(ValueError):
        Clip(None, "POLYGON((0 0,1 0,1 1,0 0))")
    assert Clip.restored(Clip(BOX, ELL).stored()) == Clip(BOX, ELL)


def test_bucket_settings():
    found = bucket_settings(["s3://us-west-2.open.data/x", "s3://plain/x", "s3a://a.b/y"])
    assert found["fs.s3a.bucket.us-west-2.open.data.endpoint.region"] == "us-west-2"
    assert found["fs.s3a.bucket.a.b.endpoint.region"] == "us-east-1" and len(found) == 4


def test_a_copy_is_read_as_it_was_written(spark, tmp_path):
    rows = [(1, bytearray(point(1_000_000.0, 5_000_000.0)), b"a\x00\xff", 2**53 + 1), (2, bytearray(point(-2_000_000.0, 0.0)), None, None)]
    frame = spark.createDataFrame(rows, "id int, geometry binary, raw binary, big bigint").withColumn("big", F.col("big").cast("decimal(20,0)"))
    frame = frame.withColumn("bbox", F.lit("taken"))
    geo = '{"primary_column": "geometry", "columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": 3857}}, "geometry_types": ["Point"]}}}'
    data = GeoDataset.over(frame, plan_read(frame.schema, geo))
    view = MapView((0.0, 30.0, 20.0, 60.0))
    assert data.within(view).kept().count() == 1
    data.write(str(tmp_path / "copy"))
    copy = GeoDataset.read(spark, str(tmp_path / "copy"))
    assert (copy.plan.crs, copy.plan.geometry_type, copy.plan.covering.west) == ("EPSG:3857", "Point", ("bbox_1", "xmin"))
    assert copy.within(view).kept().count() == 1
    assert [(row.raw, row.big) for row in copy.frame.orderBy("id").collect()] == [("a\\x00\\xFF", 2**53 + 1), (None, None)]


def test_boxes_of_single_precision_do_not_settle_edges(spark):
    rows = [(9.99999999, 5.0), (10.0, 5.0), (10.00001, 5.0), (15.0, 5.0), (19.99999999, 5.0), (20.00000001, 5.0)]
    frame = spark.createDataFrame([(n, x, y, bytearray(point(x, y))) for n, (x, y) in enumerate(rows)], "id int, x double, y double, geometry binary")
    sides = (("xmin", "x"), ("ymin", "y"), ("xmax", "x"), ("ymax", "y"))
    for kind in ("float", "double"):
        boxed = frame.withColumn("bbox", F.struct(*(F.col(name).cast(kind).alias(side) for side, name in sides)))
        kept = GeoDataset.over(boxed, plan_read(boxed.schema, None)).within(Clip((10.0, 0.0, 20.0, 9.0))).kept()
        assert sorted(row.id for row in kept.collect()) == [1, 2, 3, 4]
