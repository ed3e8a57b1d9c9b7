"""URL columns against Python's own URL library and small case tables."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from geoquarry.functions import urls

BASES = [
    "https://host.test/data/catalog.json",
    "https://host.test/a/b/c/collection.json?x=1",
    "http://host.test",
    "https://host.test/a/b/",
    "https://host.test/a//b/c.json",
]
HREFS = [
    "./x.json", "x.json", "../x.json", "../../../x", "/root.json", "/a/../b/./c", "//other.test/p",
    "https://other.test/q?z=1#f", "http://host.test/w/../v", "s3://bucket/key.parquet", "?q=2", "#frag",
    "", ".", "..", "./", "../", "a/./b/../c", "a//b.json", "x y.json", "a?b=../c", "data/*.parquet",
    "./items/i%20j.json", "g;x=1/../y",
]


def one(spark, rows, names, column):
    return [row[0] for row in spark.createDataFrame(rows, names).select(column).collect()]


def test_join_equals_the_library(spark):
    pairs = [(h, b) for b in BASES for h in HREFS]
    got = one(spark, pairs, "h string, b string", urls.join_url(F.col("h"), F.col("b")))
    assert got == [urljoin(b, h) for h, b in pairs]


def check(spark, make, cases):
    got = one(spark, [(a,) for a, _ in cases], "v string", make(F.col("v")))
    assert dict(zip([a for a, _ in cases], got)) == dict(cases)


def test_website_endpoint(spark):
    check(spark, urls.catalog_href, [
        ("http://bkt.s3-website-us-west-2.amazonaws.com/c.json?a=1", "https://bkt.s3.us-west-2.amazonaws.com/c.json?a=1"),
        ("http://my.bkt.s3-website.eu-west-1.amazonaws.com/c.json", "https://s3.eu-west-1.amazonaws.com/my.bkt/c.json"),
        ("https://plain.test/x", "https://plain.test/x"),
    ])


def test_asset_href(spark):
    base = "https://host.test/cat/c.json"
    check(spark, lambda v: urls.asset_href(v, base, "acc"), [
        ("./d.parquet", "https://host.test/cat/d.parquet"),
        ("s3://bkt/a/b.tif", "https://bkt.s3.amazonaws.com/a/b.tif"),
        ("s3://us-west-2.open.bkt/a.tif", "https://s3.us-west-2.amazonaws.com/us-west-2.open.bkt/a.tif"),
        ("s3://open.bkt/a.tif", "https://s3.amazonaws.com/open.bkt/a.tif"),
        ("gs://bkt/a.tif", "https://storage.googleapis.com/bkt/a.tif"),
        ("abfs://cont/a.tif", "https://acc.blob.core.windows.net/cont/a.tif"),
        ("abfss://cont@own.dfs.core.windows.net/a.tif", "https://own.blob.core.windows.net/cont/a.tif"),
    ])
    check(spark, lambda v: urls.asset_href(v, base), [("az://cont/a.tif", "az://cont/a.tif")])


def test_bucket_url(spark):
    check(spark, urls.bucket_url, [
        ("s3://b/x", "s3://b/x"),
        ("https://storage.googleapis.com/b/x/*.parquet", "gs://b/x/*.parquet"),
        ("https://storage.googleapis.com/b", None),
        ("https://s3.eu-west-1.amazonaws.com/my.b/x", "s3://my.b/x"),
        ("https://b.s3.amazonaws.com/x", "s3://b/x"),
        ("https://b.s3-us-west-2.amazonaws.com/x", "s3://b/x"),
        ("http://b.s3.amazonaws.com/x", None),
        ("https://other.test/x", None),
    ])


def test_globs_names_and_extensions(spark):
    check(spark, urls.is_glob, [("https://h/a/*.p", True), ("https://h/a?b=*", False), ("s3://b/x[0-9]", True)])
    check(spark, urls.glob_root, [
        ("https://h.test/a/b/*.parquet", "https://h.test/a/b"),
        ("s3://b/year=*/part-[0-9].parquet?x=1", "s3://b"),
        ("https://h.test/a/b.parquet", "https://h.test/a/b.parquet"),
    ])
    check(spark, urls.url_extension, [("https://h/a/B.Parquet?x=.y", "parquet"), ("https://h/a.b/c", ""), ("https://h/x.", "")])
    check(spark, urls.folder_name, [
        ("https://h/a/land%20use/collection.json", "land use"),
        ("https://h/catalog.json", "catalog"),
        ("https://h/a/b+c/", "b+c"),
        ("https://h", "https://h"),
    ])
    check(spark, lambda v: urls.is_image(v, F.lit(None).cast("string")), [("https://h/a.PNG?x", True), ("https://h/a.tif", False), ("s3://b/a.png", False)])
    check(spark, lambda v: urls.is_image(v, F.lit("image/tiff; profile=x")), [("https://h/a.png", False)])


@pytest.mark.parametrize(("allowed", "blocked"), [(None, False), (".tif, .parquet", True), ("JSON", False)])
def test_extension_blocked(spark, allowed, blocked):
    check(spark, lambda v: urls.extension_blocked(v, allowed), [("https://h/a/b.geojson", blocked)])


def test_local_paths(spark):
    harbour = "https://harbour.test/maps/region/catalog.json"
    # Below the root's folder: the path from there; anything else: the host and its whole path.
    check(spark, lambda v: urls.local_path(v, harbour), [
        ("https://harbour.test/maps/region/quay/berth.json", "quay/berth.json"), ("https://harbour.test/maps/region/", "index"),
        ("https://harbour.test/maps/other/./x//y.csv", "_external/harbour.test/maps/other/x/y.csv"),
        ("ftp://harbour.test/maps/region/a.json", "_external/harbour.test/maps/region/a.json"),
        ("https://harbour.test:8443/maps/region/a.json", "_external/harbour.test_8443/maps/region/a.json"),
        ("https://tide.test/a/b.json?key=1#top", "_external/tide.test/a/b.json"),
    ])
    # Escapes are decoded once; signs that file systems mind become underscores, steps upwards vanish.
    check(spark, lambda v: urls.local_path(v, harbour), [
        ("https://harbour.test/maps/region/caf%C3%A9%20noir.json", "caf__noir.json"),
        ("https://harbour.test/maps/region/%252E%252E%252Fkeys", "_2E_2E_2Fkeys"),
        ("https://harbour.test/maps/region/a%5C..%5C..%5Cb.tif", "a_.._.._b.tif"),
        ("https://tide.test/%2e%2e/%2e%2e/log.txt", "_external/tide.test/log.txt"),
        ("https://tide.test/a;b=c,d.json", "_external/tide.test/a_b=c_d.json"),
    ])
    root = "https://host.test/data/catalog.json"
    check(spark, lambda v: urls.clipped_path(v, root, ".out"), [
        ("https://host.test/data/a/b.parquet", "a/b.out"),
        ("https://host.test/data/b.GeoParquet", "b.out"),
        ("https://host.test/data/roads/*.parquet", "roads/roads.out"),
        ("https://host.test/data/b.bin", "b.bin.out"),
    ])
    check(spark, lambda v: urls.target_path("/t", v), [
        ("a/b", "/t/a/b"), ("a/../b", "/t/b"), ("../b", None), ("a/../../b", None), ("/etc/x", None),
    ])


def test_browser_url(spark):
    check(spark, lambda v: urls.browser_url(v, "https://viewer.test/"), [
        ("https://h.test/a/c.json?k=1", "https://viewer.test/#/external/h.test/a/c.json?k=1"),
        ("http://h.test/c.json", "https://viewer.test/#/external/http:/h.test/c.json"),
        ("s3://b/x", None),
    ])


def test_plain_bases_schemes_and_escapes(spark):
    rows = [
        ("x.json", "/d/c.json", "/d/x.json"), ("../x.json?a=1", "/d/e/c.json", "/d/x.json?a=1"), ("//h/x", "/d/c.json", "//h/x"),
        ("HTTPS://H/x", "https://a/b", "https://H/x"), ("S3://b/k", "https://a/b", "s3://b/k"), ("y", "file:///d/c.json", "file:///d/y"),
    ]
    frame = spark.createDataFrame(rows, "href string, base string, want string")
    got = frame.select(urls.join_url(F.col("href"), F.col("base")).alias("got"), "want").collect()
    assert [row.got for row in got] == [row.want for row in got]
    texts = spark.createDataFrame([("a%20b%zz", "a b%zz"), ("%", "%"), ("1+2%2B", "1+2+"), (None, None)], "t string, want string")
    assert all(row[0] == row[1] for row in texts.select(urls.percent_decode(F.col("t")), "want").collect())
