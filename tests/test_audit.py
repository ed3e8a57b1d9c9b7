"""The audit of a small catalog with one of each fault."""

import json

from pyspark.sql import functions as F

from geoquarry.operators import audit
from geoquarry.plans.sweep import sweep
from geoquarry.sources import documents as docs

R = "https://h.test/"


def bodies():
    item = {"type": "Feature", "id": "i", "assets": {"d": {"href": "d.tif"}, "junk": {"href": 5}}}
    tiles = {"type": "Collection", "id": "t", "links": [{"rel": "item", "href": "i1.json"}, {"rel": "item", "href": "i2.json"}],
             "assets": {"p": {"href": "a.pmtiles"}, "s1": {"href": "s1.json", "roles": ["style"]}, "s2": {"href": "s2.json", "roles": ["style"]},
                        "th": {"href": "t.png", "roles": ["thumbnail"]}, "m": {"href": "items.parquet", "roles": ["collection-mirror"]}}}
    table = {"type": "Collection", "id": "q", "assets": {"g": {"href": "https://h.test/q/*.parquet"}, "n": {"href": "https://h.test/q/dir/"}}}
    return {
        R + "catalog.json": {"type": "Catalog", "id": "root", "links": [{"rel": "child", "href": f"{n}/collection.json"} for n in ("t", "q", "e", "gone")]},
        R + "t/collection.json": tiles, R + "q/collection.json": table, R + "e/collection.json": {"type": "Collection", "id": "e"},
        R + "t/i1.json": item, R + "t/i2.json": item,
    }


def test_sweep(spark, tmp_path):
    rows = [(u, R + "moved.json" if u.endswith("e/collection.json") else None, json.dumps(b)) for u, b in bodies().items()]
    read = docs.read_documents(spark.createDataFrame(rows, "url string, base string, body string")).cache()
    links = docs.links_of(read).cache()
    assets = docs.assets_of(read).cache()
    style = {"version": 8, "sources": {"a": {"type": "vector", "url": "pmtiles://a.pmtiles"}, "b": {"type": "vector", "url": "pmtiles://https://o.test/b.pmtiles"}}}
    files = spark.createDataFrame([(R + "t/s1.json", json.dumps(style))], "style string, body string")
    probes = spark.createDataFrame([(R + "t/a.pmtiles", 10, b"PMTiles\x03"), (R + "t/t.png", 4, b"<htm"), (R + "t/d.tif", 5, b"II")], "url string, size bigint, head binary")
    footers = spark.createDataFrame([(R + "t/items.parquet", "geometry", 2)], "url string, geometry string, rows bigint")
    roots = spark.createDataFrame([("root", R + "catalog.json")], "catalog string, root string")
    result = sweep(read, docs.children_of(links), assets, docs.tile_links(links), roots, files, probes, footers).checkpoint()
    got = {(r.document.removeprefix(R), r.check, r.ok, r.detail) for r in result.collect()}
    assert got == {
        ("gone/collection.json", "read", False, "The document could not be read"),
        ("e/collection.json", "redirect", False, f"fetched from {R}moved.json; hrefs resolve against {R}e/collection.json"),
        ("t/i1.json", "asset dropped", False, "junk: "),
        ("e/collection.json", "no data", False, "nothing to load and no items"),
        ("t/collection.json", "view pmtiles", True, "10 bytes"),
        ("t/i1.json", "view cog", True, "5 bytes"),
        ("q/collection.json", "load parquet", False, f"HTTPS cannot list {R}q/*.parquet"),
        ("t/collection.json", "style", False, "2 styles and none has role default"),
        ("t/collection.json", "style", True, "2 sources, 1 outside the collection links"),
        ("t/collection.json", "thumbnail", False, "not an image"),
        ("q/collection.json", "thumbnail", False, "no thumbnail asset"),
        ("e/collection.json", "thumbnail", False, "no thumbnail asset"),
        ("t/collection.json", "mirror", True, "geometry=geometry estimate=2"),
    }
    assert audit.write_report(result, str(tmp_path / "report")) == 1
    lines = [r.value for r in spark.read.text(str(tmp_path / "report" / "summary")).collect()]
    assert "# Catalog audit: 9 failures in 13 checks" in lines
    assert [r.check for r in audit.failures_per_check(result).collect()][0] == "thumbnail"
    assert audit.ordered_failures(result).first().check == "asset dropped"


def test_probes_and_geometry_names(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 200)
    paths = spark.createDataFrame([("u", str(tmp_path / "a.bin")), ("v", str(tmp_path / "none"))], "url string, path string")
    got = {r.url: (r.size, r.head and len(r.head)) for r in audit.probe_files(paths).collect()}
    assert got == {"u": (200, 127), "v": (None, None)}
    frame = spark.createDataFrame([('{"primary_column": "shape"}', ["id", "shape"]), (None, ["id", "GEOM"]), ("{", ["id"])], "geo string, names array<string>")
    assert [r[0] for r in frame.select(audit.footer_geometry(F.col("geo"), F.col("names"))).collect()] == ["shape", "GEOM", None]
