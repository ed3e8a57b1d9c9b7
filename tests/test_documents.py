"""Documents, links, edges and assets from JSON, with wrong types on purpose."""

import json

from pyspark.sql import functions as F

from geoquarry.sources import documents as docs

ROOT = "https://host.test/data/catalog.json"
PLACE = "https://host.test/data/land/collection.json"
ITEM = "https://host.test/data/land/i1/i1.json"

CATALOG = {
    "type": "Catalog",
    "id": "",
    "title": 5,
    "license": None,
    "properties": {"title": "From properties", "license": "MIT", "description": "d"},
    "links": [
        {"rel": "child", "href": "./land/collection.json", "title": "Land"},
        {"rel": "child", "href": "./sea/catalog.json"},
        {"rel": "item", "href": "i9.json"},
        {"rel": 3, "href": "x"},
        {"rel": "child", "href": ""},
        {"rel": "child", "href": "s3://b/c.json"},
        "junk",
        {"rel": "pmtiles", "href": "/t/a.pmtiles", "pmtiles:layers": ["a", 1, "b"]},
    ],
    "bbox": [0, 1, 2, 3, 4, 5],
}
COLLECTION = {
    "type": "Collection",
    "id": "land",
    "license": "CC0-1.0",
    "extent": {"spatial": {"bbox": [[1, 2, 3.5, 4]]}},
    "partition:glob": "s3://bkt/land/*.parquet",
    "table:columns": [{"name": "id", "type": "int64"}],
    "assets": {
        "z-map": {"href": "./land.pmtiles", "type": "application/vnd.pmtiles", "roles": ["data", 4]},
        "a-style": {"href": "./style.json", "roles": ["style", "default"], "file:size": True},
        "bad": {"href": 4},
        "worse": "text",
        "pic": {"href": "./p.png", "roles": ["thumbnail"], "file:size": 12, "file:checksum": "1220aa"},
    },
    "links": [],
}
FEATURE = {
    "type": "Feature",
    "id": "i1",
    "bbox": [1, 2, True, 4],
    "properties": {"table:columns": [{"name": "GEOM", "type": "binary"}], "table:storage_options": {"account_name": "acc"}},
    "assets": {
        "t": {"href": "d.parquet"},
        "u": {"href": "e.parquet", "table:columns": [{"name": "v", "type": "int"}], "file:size": 5.0},
        "g": {"href": "https://host.test/p/*.parquet", "partition:glob": "https://bkt.s3.amazonaws.com/p/*.parquet"},
        "h": {"href": "https://host.test/q/*.parquet"},
        "az": {"href": "az://cont/x.csv"},
    },
}


def frame(spark):
    rows = [
        (ROOT, None, json.dumps(CATALOG)),
        (PLACE, None, json.dumps(COLLECTION)),
        (ITEM, "https://moved.test/m/i1.json", json.dumps(FEATURE)),
        ("https://host.test/no", None, "{oops"),
        ("https://host.test/list", None, "[1]"),
        ("https://host.test/other", None, '{"type": "Thing"}'),
        ("https://host.test/gone", None, None),
    ]
    return docs.read_documents(spark.createDataFrame(rows, "url string, base string, body string"))


def test_documents(spark):
    rows = {r.url: r for r in frame(spark).collect()}
    catalog, place, item = rows[ROOT], rows[PLACE], rows[ITEM]
    assert (catalog.kind, catalog.id, catalog.title) == ("catalog", "data", "From properties")
    assert catalog.license is None and catalog.description == "d"
    assert tuple(catalog.bbox) == (0.0, 1.0, 3.0, 4.0)
    assert (place.kind, place.title, place.license) == ("collection", "land", "CC0-1.0")
    assert tuple(place.bbox) == (1.0, 2.0, 3.5, 4.0)
    assert item.bbox is None and item.base == "https://moved.test/m/i1.json"
    assert sorted(u.rsplit("/", 1)[1] for u, r in rows.items() if r.error) == ["gone", "list", "no", "other"]


def test_links_and_edges(spark):
    links = docs.links_of(frame(spark))
    assert [(r.pos, r.href) for r in links.where(F.col("url") == ROOT).orderBy("pos").collect()] == [
        (0, PLACE), (1, "https://host.test/data/sea/catalog.json"), (2, "https://host.test/data/i9.json"),
        (5, "s3://b/c.json"), (7, "https://host.test/t/a.pmtiles"),
    ]
    edges = docs.children_of(links).orderBy("pos").collect()
    assert [(r.kind, r.title) for r in edges] == [("collection", "Land"), ("catalog", "sea"), ("item", "data")]
    assert docs.tile_links(links).first().layers == ["a", "b"]


def test_assets(spark):
    assets = docs.assets_of(frame(spark))
    place = assets.where(F.col("url") == PLACE).orderBy("pos").collect()
    assert [r.key for r in place] == ["z-map", "a-style", "pic", "partition:glob"]
    assert place[0].roles == ["data"] and place[0].format == "pmtiles"
    assert place[1].size is None and place[2].size == 12 and place[2].checksum == "1220aa"
    assert place[3].tabular and place[3].read_url == "s3://bkt/land/*.parquet"
    item = {r.key: r for r in assets.where(F.col("url") == ITEM).collect()}
    assert item["t"].href == "https://moved.test/m/d.parquet" and not item["t"].tabular
    assert item["u"].tabular and item["u"].size is None
    assert item["g"].read_url == "s3://bkt/p/*.parquet"
    assert item["h"].glob == "https://host.test/q/*.parquet" and item["h"].read_url is None
    assert item["az"].href == "https://acc.blob.core.windows.net/cont/x.csv" and item["az"].format == "csv"


def test_load_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(CATALOG))
    assert docs.read_documents(docs.load_documents(spark, str(tmp_path))).first().kind == "catalog"
