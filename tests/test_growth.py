"""What tasks, broadcasts and files hold as tables grow."""

import re

from pyspark.sql import functions as F

from geoquarry.functions import assets as rules
from geoquarry.functions import urls
from geoquarry.llm import fingerprints
from geoquarry.operators import catalog, spatial, styles, usage
from geoquarry.sources import documents as docs
from workload import tiles, walks


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def stored(spark, path, rows):
    rows.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_use_marks_move_hashes_only(spark):
    files = spark.createDataFrame([("https://h/a b.tif", "s3://b/1"), ("https://h/c.tif", "s3://b/2"), ("https://h/d.tif", None), (None, "s3://b/4"), (None, None)], "href string, read_url string")
    urls = spark.createDataFrame([("s3://b/2",), (None,)], "url string")
    sources = spark.createDataFrame([("/vsicurl?empty_dir=yes&url=https%3A%2F%2Fh%2Fa%20b.tif",), (None,), ("CSV:/vsicurl/https://h/d.tif|x",)], "source string")
    marked = usage.mark_used(files, urls, sources)
    assert {(r.href, r.read_url, r.used) for r in marked.collect()} == {
        ("https://h/a b.tif", "s3://b/1", True), ("https://h/c.tif", "s3://b/2", True), ("https://h/d.tif", None, True), (None, "s3://b/4", False), (None, None, False)}
    plan = plan_of(marked)
    assert "hashpartitioning(href" not in plan and "hashpartitioning(read_url" not in plan


def test_archives_are_matched_without_broadcasts(spark, tmp_path):
    rows = stored(spark, tmp_path / "names", spark.range(50).select(F.concat(F.lit("u"), F.col("id")).alias("url"), F.concat(F.lit("https://h/"), F.col("id"), F.lit(".pmtiles")).alias("archive")))
    other = rows.where("url <> 'u7'").select("url", F.col("archive").alias("href"))
    matched = styles.match_archives(rows, other)
    assert "BroadcastHashJoin" not in plan_of(matched)
    assert {r.url for r in matched.where("href IS NULL").collect()} == {"u7"}


def test_stray_archives_are_found_without_broadcasts(spark, tmp_path):
    none = spark.createDataFrame([("u7", "x"), ("u7", "x"), (None, "y"), (None, None), ("z", None)], "url string, archive string")
    rows = stored(spark, tmp_path / "stray", none)
    stray = styles.stray_archives(rows, rows.where("archive IS NULL").select("url", F.col("archive").alias("href")))
    assert "BroadcastHashJoin" not in plan_of(stray)
    assert sorted(stray.collect(), key=str) == sorted([("u7", "x"), (None, "y")], key=str)


def test_cells_never_broadcast_what_grows_with_the_features(spark, tmp_path):
    box = F.struct(*(F.col("id").cast("double").alias(side) for side in ("xmin", "ymin", "xmax", "ymax")))
    from geoquarry.functions.wkb import point_wkb

    rows = stored(spark, tmp_path / "points", spark.range(40).select("id", box.alias("bbox"), point_wkb(F.col("id").cast("double"), F.col("id").cast("double")).alias("geometry")))
    areas = tiles.triangles(spark.createDataFrame([(3.0, 3.0, 4.0, 4.0)], "ax double, ay double, aw double, ah double"))
    found = spatial.touching(rows, areas, "id", carried_bytes=0)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert sorted(row["id"] for row in found.collect()) == [3, 4, 5]


def test_files_of_a_status_are_written_by_several_tasks(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(walks, "WRITE_ROWS", 300)
    monkeypatch.setattr(walks, "scratch_path", lambda _spark, name: str(tmp_path / name))
    walks.q05_parquet_checks(spark, sf_dir).collect()
    assert len(list((tmp_path / "footers").glob("o_orderstatus=F/*.parquet"))) > 1


def test_one_archive_at_a_time_is_turned_into_objects(spark, sf_dir, monkeypatch):
    from geoquarry.sources import tile_archives

    monkeypatch.setattr(tile_archives, "HEADER_ROWS", 1)
    written = tiles.write_archives(spark, sf_dir)
    heads = tile_archives.read_headers(written.coalesce(1)).collect()
    assert len(heads) == written.count() > 1 and all(row["error"] is None for row in heads)


def test_assets_read_only_what_is_asked(spark):
    body = '{"type":"Catalog","id":"c","assets":{"a":{"href":"a.json","roles":["style"]},"b":{"href":7},"c":{"href":"s3://k/c.tif"}},"partition:glob":"s3://k/p/*.parquet"}'
    read = docs.read_documents(spark.createDataFrame([("https://h/c/catalog.json", None, body)], "url string, base string, body string"))
    assets = docs.assets_of(read)
    assert [(r.key, r.pos, r.href, r.format, r.read_url) for r in assets.orderBy("pos").collect()] == [
        ("a", 0, "https://h/c/a.json", None, "https://h/c/a.json"), ("c", 2, "https://k.s3.amazonaws.com/c.tif", "cog", "https://k.s3.amazonaws.com/c.tif"),
        ("partition:glob", 2**31 - 1, "https://k.s3.amazonaws.com/p/*.parquet", "parquet", "s3://k/p/*.parquet")]
    lean = assets.where(rules.is_style(F.col("roles"), F.col("type"))).select("url", "pos")
    assert "file:checksum" in plan_of(assets) and "file:checksum" not in plan_of(lean)


def test_styles_are_numbered_from_one_reading_of_documents(spark):
    body = '{"type":"Catalog","id":"c","assets":{"a":{"href":"a.json","roles":["style"]},"b":{"href":"b.json","roles":["style","default"]}}}'
    read = docs.read_documents(spark.createDataFrame([("https://h/catalog.json", None, body), (None, None, body)], "url string, base string, body string"))
    ranked = catalog.styles_of(docs.assets_of(read))
    plan = plan_of(ranked)
    assert "from_json" not in plan and "BroadcastHashJoin" not in plan
    assert [(r.url, r.key, r.number, r.is_default) for r in ranked.orderBy("number").collect()] == [("https://h/catalog.json", "b", 1, True), ("https://h/catalog.json", "a", 2, False)]


def test_plain_addresses_resolve_like_all_others(spark):
    bases = ["https://h/a/b/c.json", "http://h:8/x.json", "https://h/a/", "https://h", "HTTPS://h/a/c.json", "https://h/a/../c.json", "https://h//a/c.json", "https://h/a?q=/z/y", "s3://b/a/c.json", "file:///a/c.json"]
    hrefs = ["p.png", "./p.png", "./", "././p", ".", "..", "../p", "a/b", "a/", "a//b", "a/./b", "a/..", "/r/p", "/", "//o/p", "/a/../b", "p?q", "p#f", "a:b", "S3://b/k", "az://c/k", "gs:x", ".p", "..p", "...", "a b", "p.png\n", "a\nb/c\n"]
    pairs = spark.createDataFrame([(href, base) for href in hrefs for base in bases], "h string, b string")
    href, base = F.col("h"), F.col("b")
    whole = urls.with_parts(href, lambda own: urls.with_parts(base, lambda root: urls._resolve(href, own, root)))
    assert [r for r in pairs.select("h", "b", urls.join_url(href, base).alias("got"), whole.alias("want")).collect() if r.got != r.want] == []


def test_neighbours_are_compared_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
    texts = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("one of many texts "), F.col("id")).alias("text"))
    assert re.search(r"hashpartitioning\(_range#\d+, (2\d|30)\), REPARTITION_BY_NUM", plan_of(fingerprints.with_next(texts)))
