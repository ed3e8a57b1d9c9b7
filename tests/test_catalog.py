"""Picks, registry rows and the walk on small hand-made catalogs."""

import json

import pytest
from pyspark.sql import functions as F

from geoquarry.functions import extents
from geoquarry.operators import catalog
from geoquarry.operators.ranking import first_by, numbered
from geoquarry.operators.walk import failures, truncated, walk
from geoquarry.sources import documents as docs
from geoquarry.sources import registry as reg

H = "https://h.test/"


def collection(spark):
    body = {
        "type": "Collection", "id": "c", "links": [
            {"rel": "icon", "href": "i.tif", "type": "image/tiff"}, {"rel": "icon", "href": "i.png"},
            {"rel": "pmtiles", "href": "tiles.pmtiles"}, {"rel": "license", "href": "L", "title": "one"},
            {"rel": "license", "href": "L", "title": "two"}, {"rel": "item", "href": "a.json"},
        ],
        "assets": {
            "doc": {"href": "readme.md", "roles": ["metadata"]},
            "map": {"href": "tiles.pmtiles", "roles": ["visual"], "file:size": 7},
            "csv": {"href": "t.csv", "file:size": 3},
            "pq": {"href": "t.parquet", "title": "Table"},
            "src": {"href": "s.tif", "roles": ["source"]},
            "cog": {"href": "r.tif"},
            "s1": {"href": "s1.json", "roles": ["style"]},
            "s2": {"href": "s2.json", "roles": ["default", "style"]},
            "over": {"href": "o.png", "roles": ["overview"]},
            "thumb": {"href": "t.png", "roles": ["thumbnail"]},
        },
    }
    read = docs.read_documents(spark.createDataFrame([(H + "collection.json", None, json.dumps(body))], "url string, base string, body string"))
    links = docs.links_of(read)
    return read, links, docs.assets_of(read)


def test_picks(spark):
    read, links, assets = collection(spark)
    tiles = docs.tile_links(links)
    files = catalog.loadable(assets, tiles).cache()
    assert [r.title for r in files.orderBy("is_asset", "pos").collect()] == ["Vector tiles", "csv", "Table", "cog"]
    assert catalog.tile_duplicates(assets, tiles).first().href == H + "tiles.pmtiles"
    assert catalog.preferred_file(files).first().href == H + "tiles.pmtiles"
    target = catalog.pick_targets(files).first()
    assert (target.view_format, target.load_format) == ("pmtiles", "parquet")
    assert catalog.pick_targets(files, parquet=False).first().load_format == "csv"
    assert catalog.item_hrefs(assets).first().href == H + "s.tif"
    styles = catalog.styles_of(assets).orderBy("number").collect()
    assert [(r.key, r.is_default) for r in styles] == [("s2", True), ("s1", False)]
    assert catalog.icons(links).first().href == H + "i.png"
    assert catalog.thumbnails(assets).first().key == "thumb"
    assert catalog.document_sizes(assets).first()["size"] == 10
    assert [r.title for r in catalog.links_once(links, "license").collect()] == ["one"]
    assert catalog.archive_urls(assets, tiles).collect()[0].is_asset is False
    assert catalog.child_summary(docs.children_of(links)).first().only_items
    assert catalog.has_parquet(files).first().has_parquet
    assert catalog.item_files(files, read.withColumn("kind", F.lit("item"))).first().format == "cog"


def test_numbering_splits_large_groups(spark):
    frame = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") * 7).alias("p")).union(spark.createDataFrame([(None, 5)], "k string, p bigint"))
    got = numbered(frame, ["k"], "p", bits=48)
    assert got.where("k is not null and number <> p / 7 + 1").count() == 0 and got.count() == 200_001
    assert first_by(frame, ["k"], [F.col("p").desc_nulls_last() if False else -F.col("p")], ["p"]).where("k = 'k'").first().p == 199_999 * 7


def entry(href, **facts):
    title = facts.pop("title", None)
    bbox = facts.pop("bbox", None)
    link = {"rel": "child", "href": href, "bbox": bbox, **{f"x_registry:{k}": v for k, v in facts.items()}}
    if title is not None:
        link["title"] = title
    return link


def test_registry(spark):
    body = {"type": "Catalog", "links": [
        {"rel": "self", "href": "x"},
        entry("https://b.test/c.json", title="beta", id="b", status="ok", bbox=[0, 0, 1, 1], licenses={"Z": {}, "A": 1}, feature_count=4, total_size_bytes=True, logo={"href": "l"}),
        entry("https://a.test/c.json", title="Alpha", id="", status=""),
        entry("s3://nope/c.json", title="no"),
    ]}
    rows = reg.read_registry(spark.createDataFrame([(H + "r.json", json.dumps(body))], "url string, body string"), "x_registry:")
    got = reg.by_title(rows).collect()
    assert [r.title for r in got] == ["Alpha", "beta"]
    assert (got[0].id, got[0].status, got[0].bbox) == ("https://a.test/c.json", "unknown", None)
    assert got[1].licenses == ["A", "Z"] and got[1].feature_count == 4 and got[1].total_size_bytes is None and got[1].logo_url == "l"
    assert reg.filter_entries(rows, " BETA ").count() == 1 and reg.filter_entries(rows, "", "ok").count() == 1
    assert reg.filter_entries(rows, bbox=(5, 5, 6, 6)).first().title == "Alpha"
    assert reg.registered(rows).count() == 1 and reg.page(rows, 1, 1).first().title == "beta"
    assert [r.status for r in reg.statuses(rows).collect()] == ["ok", "unknown"]
    with pytest.raises(reg.CatalogError):
        reg.require_registry(spark.createDataFrame([("u", '{"type": "Catalog"}')], "url string, body string"))


def graph(spark, edges, bad=()):
    nodes = {n for p, cs in edges.items() for n in [p, *(c for c, _ in cs)]}
    documents = spark.createDataFrame([(n, "catalog", "broken" if n in bad else None) for n in nodes if n != "gone"], "url string, kind string, error string")
    rows = [(p, i, c, k) for p, cs in edges.items() for i, (c, k) in enumerate(cs)]
    return documents, spark.createDataFrame(rows, "parent string, pos int, child string, kind string")


def order(visited):
    return [r.href for r in visited.orderBy("depth", "place").collect()]


def test_walk_order_cycles_failures_and_budget(spark):
    edges = {"r": [("b", "catalog"), ("a", "catalog"), ("b", "catalog")], "a": [("x", "item"), ("r", "catalog"), ("z", "catalog")],
             "b": [("z", "catalog"), ("y", "item"), ("w", "item"), ("gone", "item"), ("bad", "catalog")], "bad": [("never", "item")]}
    documents, table = graph(spark, edges, bad={"bad"})
    seen = walk(documents, table, "r")
    assert order(seen) == ["r", "b", "a", "z", "y", "w", "gone", "bad", "x"]
    assert {r.href for r in failures(seen).collect()} == {"gone", "bad"}
    for budget in (1, 2, 5):
        part = walk(documents, table, "r", budget)
        assert order(part) == ["r", "b", "a", "z", "y"][:budget] and truncated(part, budget).first().truncated
    assert order(walk(documents, table, "r", first_item_only=True)) == ["r", "b", "a", "z", "bad", "y", "x"]
    both = walk(documents, table, spark.createDataFrame([("a",), ("b",)], "root string"))
    assert order(both.where("root = 'b'")) == ["b", "z", "y", "w", "gone", "bad"]


def test_boxes_meet_as_sets_of_longitudes(spark):
    """Compare with the whole degrees that a box covers, once whole turns are taken off."""
    def covered(west, east):
        if east - west >= 360:
            return set(range(-180, 181))
        west, east = (side if -180 <= side <= 180 else (side + 180) % 360 - 180 for side in (west, east))
        return {degree for degree in range(-180, 181) if (west <= degree <= east if west <= east else degree >= west or degree <= east)}

    sides = [(-10, 10), (10, 20), (170, -170), (-180, 180), (180, -180), (175, 190), (-190, -175), (350, 370), (0, 720), (20, 10), (-180, -180), (180, 180), (540, 541)]
    rows = [(*map(float, one), *map(float, two)) for one in sides for two in sides]
    frame = spark.createDataFrame(rows, "w double, e double, v double, f double")
    one = extents.box(F.col("w"), F.lit(0.0), F.col("e"), F.lit(1.0))
    two = extents.box(F.col("v"), F.lit(1.0), F.col("f"), F.lit(2.0))
    for row in frame.select("*", extents.boxes_meet(one, two).alias("meet")).collect():
        assert row.meet == bool(covered(row.w, row.e) & covered(row.v, row.f)), row
    far = extents.box(F.col("v"), F.lit(1.5), F.col("f"), F.lit(2.0))
    assert not any(row[0] for row in frame.select(extents.boxes_meet(one, far)).collect())
    assert all(row[0] for row in frame.select(extents.boxes_meet(one, F.lit(None).cast(extents.BOX_TYPE))).collect())
