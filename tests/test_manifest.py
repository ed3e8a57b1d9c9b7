"""Checksums, manifests, the item index and scoped plans."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from geoquarry.functions import multihash
from geoquarry.model import Area, Clip, Everything, MapView
from geoquarry.operators import catalog, manifest
from geoquarry.plans import download, item_files
from geoquarry.sources import documents as docs
from tests.test_shapes import point, polygon, square

ROOT = "https://harbour.test/maps/atlas.json"


def test_multihash(spark, tmp_path):
    data = b"quarry" * 1500
    good = {
        "sha1": "1114" + hashlib.sha1(data).hexdigest(), "sha256": "1220" + hashlib.sha256(data).hexdigest().upper(),
        "sha512": "1340" + hashlib.sha512(data).hexdigest(), "sha3_256": " 1620" + hashlib.sha3_256(data).hexdigest(),
        "blake2b": "a0e40220" + hashlib.blake2b(data, digest_size=32).hexdigest(),
    }
    bad = ["zz", "1220ab", "ff" * 12, "2004abcdef01", "12", "122"]
    rows = [(k, v, data) for k, v in good.items()] + [("wrong", "1220" + "0" * 64, data)] + [(None, v, data) for v in bad]
    frame = spark.createDataFrame(rows, "name string, checksum string, content binary")
    got = manifest.with_matches(frame.withColumn("d", multihash.decode(F.col("checksum")))).collect()
    assert all(r.d.algorithm == r.name and r.matches for r in got if r.name in good)
    assert [r.matches for r in got if r.name == "wrong"] == [False]
    errors = {r.checksum: r.d.error for r in got if r.name is None}
    assert errors["zz"] == errors["122"] == "Not a hex string" and errors["2004abcdef01"].startswith("Unsupported")
    assert errors["1220ab"].startswith("The digest") and errors["12"].startswith("Trunc") and errors["ff" * 12].startswith("Trunc")
    path = tmp_path / "f.bin"
    path.write_bytes(data)
    paths = spark.createDataFrame([(str(path), v) for v in good.values()] + [(str(path), "1220" + "0" * 64), (str(path), "zz")], "path string, checksum string")
    assert sorted(str(r.matches) for r in multihash.verify_paths(paths).collect()) == ["False", "None"] + ["True"] * 5


SHEETS = (("quay", [20.0, -3.0, 21.5, -2.0]), ("reef", [-70.0, 12.0, -69.0, 13.0]), ("loose", None), ("pier", [20.5, -2.5, 20.75, -2.25]))


def items(spark, extra_assets=None, extra_links=()):
    """A collection of four sheets, one of them without a place."""
    def sheet(name, bbox):
        return {"type": "Feature", "id": name, "bbox": bbox, "assets": {"scan": {"href": f"scans/{name}.tif", "roles": ["data"]}}}

    folder = ROOT.rsplit("/", 1)[0]
    links = [{"rel": "item", "href": f"sheets/{name}.json"} for name, _ in SHEETS]
    documents = [(ROOT, {"type": "Collection", "id": "harbour", "assets": extra_assets or {}, "links": [*links, *extra_links]})]
    documents += [(f"{folder}/sheets/{name}.json", sheet(name, bbox)) for name, bbox in SHEETS]
    fetched = spark.createDataFrame([(url, None, json.dumps(body)) for url, body in documents], "url string, base string, body string")
    read = docs.read_documents(fetched).cache()
    found = docs.links_of(read).cache()
    return read, docs.children_of(found), docs.assets_of(read).cache(), docs.tile_links(found)


def sheet_files(*names):
    return [path for name in names for path in (f"sheets/{name}.json", f"sheets/scans/{name}.tif")]


def paths(plan):
    return [r.path for r in plan.files.orderBy("depth", "place", "part", "pos").collect()]


def test_scoped_plans(spark):
    tables = items(spark)
    every = download.plan_download(*tables, ROOT)
    assert paths(every) == ["atlas.json", *sheet_files("quay", "reef", "loose", "pier")]
    near = download.plan_download(*tables, ROOT, scope=MapView((20, -2.6, 22, 0)))
    assert paths(near) == ["atlas.json", *sheet_files("quay", "loose", "pier")]
    row = near.summary().first()
    assert (row.files, row.outside, row.truncated, row.unknown_sizes) == (7, 1, False, 7)
    assert download.plan_download(*tables, ROOT, budget=1).summary().first().truncated


def test_partitions_collisions_and_decisions(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"part-{name}.parquet").write_bytes(b"x" * 3)
    glob = f"file://{tmp_path}/part-*.parquet"
    assets = spark.createDataFrame([("d1", 0, glob, glob), ("d2", 0, "https://h/*.p", None), ("d3", 0, "https://h/*.p", None), ("d4", 0, "file:///nope/*.p", "file:///nope/*.p")], "url string, pos int, glob string, read_url string")
    edges = spark.createDataFrame([("d3",)], "parent string")
    files, unlisted = manifest.partition_files(assets, edges, "file:///root/x.json")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["part-a.parquet", "part-b.parquet"]
    assert sorted(r.doc for r in unlisted.collect()) == ["d2", "d4"]
    rows = [("u1", "A/x.tif", 1, None), ("u2", "a/X.tif", 2, None), ("u3", "b", 5, "1220"), ("u4", "../up", 1, None), ("u5", "e", 9, "x"), ("u6", "f", 9, "x"), ("u7", "g", None, None)]
    frame = spark.createDataFrame(rows, "url string, path string, size bigint, checksum string")
    kept, clashes = manifest.split_collisions(frame, ["url"])
    assert kept.count() == 6 and clashes.first().url == "u2"
    stored = spark.createDataFrame([("A/x.tif", 1, None), ("b", 5, None), ("e", 9, False), ("f", 9, True), ("g", 4, None)], "path string, size bigint, matches boolean")
    got = {r.path: (r.outcome, r.verified) for r in manifest.decide(kept, stored, "/t").collect()}
    assert got == {"A/x.tif": ("skipped", False), "b": ("skipped", False), "../up": ("failed", False), "e": ("fetch", False), "f": ("skipped", True), "g": ("fetch", False)}
    settled = manifest.settle(spark.createDataFrame([("p", "x", True), ("q", "x", False), ("r", None, None), ("s", "bad", None)], "path string, checksum string, matches boolean"))
    assert manifest.fetch_report(settled).first().asDict() == {"downloaded": 3, "fetch": 0, "skipped": 0, "failed": 1, "verified": 1}
    share = spark.createDataFrame([(10, 4, False), (10, 0, True)], "size bigint, received bigint, settled boolean")
    assert manifest.progress(share).first().fraction == 0.7
    assert manifest.progress(share.withColumn("size", F.when(F.col("settled"), F.col("size")))).first().fraction == 0.5
    assert manifest.without_clipped(frame, spark.createDataFrame([("u3",)], "href string")).count() == 6


def stored_index(spark, path, as_list=False):
    """An item index of two fields; one says where its own document is."""
    fields = [("upper", -30.5, "upper.tif", "https://fields.test/own/upper.json"), ("lower", -28.25, "lower.tif", None)]
    rows = [(name, bytearray(polygon(square(x, 10.0, 0.5))), x, href, own) for name, x, href, own in fields]
    frame = spark.createDataFrame(rows, "id string, geometry binary, x double, href string, own string")
    sides = {"xmin": F.col("x"), "ymin": F.lit(10.0), "xmax": F.col("x") + 0.5, "ymax": F.lit(10.5)}
    named = F.struct(*(value.alias(side) for side, value in sides.items()))
    listed = F.array(sides["xmin"], sides["ymin"], F.lit(-4.0), sides["xmax"], sides["ymax"], F.lit(6.0))
    picture = F.struct(F.lit("small.jpg").alias("href"), F.array(F.lit("thumbnail")).alias("roles"))
    scan = F.struct("href", F.lit("image/tiff; application=geotiff").alias("type"))
    link = F.struct(F.lit("self").alias("rel"), F.col("own").alias("href"))
    made = frame.select(
        "id", "geometry", (listed if as_list else named).alias("bbox"), F.struct(picture.alias("small"), scan.alias("scan")).alias("assets"),
        F.when(F.col("own").isNotNull(), F.array(link)).alias("links"),
    )
    made.coalesce(1).write.parquet(path)
    return path


def test_item_index(spark, tmp_path):
    folder = ROOT.rsplit("/", 1)[0]
    edges = spark.createDataFrame([(ROOT, 0, f"{folder}/lower/lower.json", "item")], "parent string, pos int, child string, kind string")
    upper, lower = "https://fields.test/own/upper.tif", f"{folder}/lower/lower.tif"
    corner = Area("POLYGON((-28.0 10.1, -27.0 10.1, -27.0 10.2, -28.0 10.1))", (-28.0, 10.1, -27.0, 10.2))
    passing = Area("POLYGON((-30.1 10.4, -27.0 13.0, -30.1 13.0, -30.1 10.4))", (-30.1, 10.4, -27.0, 13.0))
    cases = [(MapView((-31.0, 9.0, -30.25, 11.0)), {upper}), (Everything(), {upper, lower}), (corner, {lower}), (passing, {upper}), (MapView((175, -5, -175, 5)), set())]
    for as_list in (False, True):
        frame = spark.read.parquet(stored_index(spark, str(tmp_path / f"index{as_list}"), as_list))
        for scope, expected in cases[: 1 if as_list else None]:
            assert {r.href for r in item_files.indexed_files(frame, ROOT, scope, edges).collect()} == expected


def test_files_in_scope_falls_back_to_the_walk(spark, tmp_path):
    index = stored_index(spark, str(tmp_path / "index"))

    def tables(path):
        return items(spark, {"index": {"href": f"file://{path}", "roles": ["collection-mirror"]}})

    # The file of the lower field resolves against the index, which no http address serves here.
    found = item_files.files_in_scope(spark, *tables(index)[:3], ROOT, Everything())
    assert [r.href for r in found.collect()] == ["https://fields.test/own/upper.tif"]
    walked = item_files.files_in_scope(spark, *tables("/nowhere/at/all.parquet")[:3], ROOT, MapView((20, -3, 21, -2)))
    assert {r.href.rsplit("/", 1)[1] for r in walked.collect()} == {"quay.tif", "loose.tif", "pier.tif"}
    # Footers that open, pages that do not read.
    broken = stored_index(spark, str(tmp_path / "broken"))
    for part in (name for name in os.listdir(broken) if name.endswith(".parquet")):
        with open(f"{broken}/{part}", "rb+") as file:
            body = file.read()
            footer = int.from_bytes(body[-8:-4], "little") + 8
            file.seek(4)
            file.write(bytes(len(body) - footer - 4))
    for sums in (name for name in os.listdir(broken) if name.endswith(".crc")):
        os.remove(f"{broken}/{sums}")
    again = item_files.files_in_scope(spark, *tables(broken)[:3], ROOT, MapView((20, -3, 21, -2)))
    assert {r.href.rsplit("/", 1)[1] for r in again.collect()} == {"quay.tif", "loose.tif", "pier.tif"}
    stopped = item_files.walked_files(*tables(index)[:3], ROOT, Everything(), 3).collect()
    assert len(stopped) == 2 and all(row.truncated for row in stopped)


def test_items_as_one_and_clipped_targets(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(n, bytearray(point(n, n)))], "id int, geometry binary").coalesce(1).write.parquet(str(tmp_path / f"{n}.parquet"))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.parquet",) for n in range(2)], "href string")
    assert item_files.split_files(files.union(spark.createDataFrame([("https://h/x.parquet",)], "href string")))[1].count() == 1
    from geoquarry.plans.dataset import GeoDataset
    data = GeoDataset.read(spark, [r.href for r in files.collect()])
    assert data.within(Clip((0.5, 0.5, 2.0, 2.0))).rows().count() == 1
    written = download.write_clipped(data, MapView((0.5, 0.5, 2.0, 2.0)), str(tmp_path / "out"))
    assert written.features == 1
    listing = spark.createDataFrame([
        ("d", True, 0, "https://harbour.test/maps/a.parquet", "parquet", False, None, "https://harbour.test/maps/a.parquet"),
        ("d", True, 1, "https://harbour.test/maps/t.parquet", "parquet", True, None, "https://harbour.test/maps/t.parquet"),
        ("d", True, 2, "https://harbour.test/maps/g/*.parquet", "parquet", False, "https://harbour.test/maps/g/*.parquet", None),
    ], "url string, is_asset boolean, pos int, href string, format string, tabular boolean, glob string, read_url string")
    assert download.assets_to_clip(listing, Everything()).count() == 0
    assert download.assets_to_clip(listing, Everything(), "https://harbour.test/maps/t.parquet").count() == 1
    assert download.clipped_targets(download.assets_to_clip(listing, MapView((0, 0, 1, 1))), ROOT).first().path == "a.clipped.parquet"
    assert catalog.reads_items(listing, spark.createDataFrame([("d",)], "parent string")).first().through_items
