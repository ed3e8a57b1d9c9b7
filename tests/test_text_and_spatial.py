"""Labels, CSV and GeoJSON sources, and the spatial semi join on both of its ways."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoquarry.functions import labels, pieces, shapes, wkb
from geoquarry.operators import spatial
from geoquarry.sources import text_features as tf
from tests.test_shapes import line, polygon, square


@pytest.mark.parametrize(("body", "points"), [
    ("\ufefflon;lat\n1;2\n", [(1, 2)]), ("x,y\n10,20\n", [(10, 20)]), ("x,y\n10,20\n500000,20\n", None), ("x,y\n", None),
    ("x,y\nfoo,bar\n1,2\n", [(1, 2), None]), ("a,b\n1,2\n", None), ("", None), ("x,lng,lat\n9000,1,2\n", [(1, 2)]),
    ("lon\tlatitude\n3\t4\n", [(3, 4)]), ("n,lat,lon\n\"say \"\"hi\"\", you\",2,1\n\"two\nlines\",4,3\n", [(1, 2), (3, 4)]),
])
def test_points_of_a_csv_file(spark, tmp_path, body, points):
    (tmp_path / "f.csv").write_text(body)
    read = tf.read_csv(spark, str(tmp_path / "f.csv"))
    if points is None:
        assert "geometry" not in read.columns
        return
    boxes = [row.b for row in read.select(wkb.envelope("geometry").alias("b")).collect()]
    assert sorted(str(box and (box.xmin, box.ymin)) for box in boxes) == sorted(str(at and (float(at[0]), float(at[1]))) for at in points)


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lon,lat\n1,10,50\n")
    (tmp_path / "b.csv").write_text('lat;lon;note;id\n51;11;"a ""b""; c\nd";x2\n')
    rows = tf.read_csv(spark, str(tmp_path)).select("id", "note", wkb.envelope("geometry").alias("b")).orderBy("id").collect()
    assert [(r.id, r.note, r.b.xmin, r.b.ymin) for r in rows] == [("1", None, 10, 50), ("x2", 'a "b"; c\nd', 11, 51)]


def test_csv_and_geojson(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id;Name;Longitude;LAT\n1;a;11.5;44\n2;b;;45\n")
    points = tf.read_csv(spark, str(tmp_path / "p.csv"))
    rows = points.select("id", wkb.envelope("geometry").alias("b")).orderBy("id").collect()
    assert tuple(rows[0].b) == (11.5, 44, 11.5, 44) and rows[1].b is None
    (tmp_path / "t.csv").write_text("id,score\n1,2.5\n")
    assert tf.read_csv(spark, str(tmp_path / "t.csv")).dtypes == [("id", "int"), ("score", "double")]
    shapes = [{"type": "Point", "coordinates": [1, 2, 3]}, {"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(5, 5, 1)]]}, None,
              {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0], [4, 4]]}]}]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": i, "properties": {"n": i}, "geometry": s} for i, s in enumerate(shapes)] + [{"type": "Nope"}]}
    (tmp_path / "f.geojson").write_text(json.dumps(body))
    got = tf.read_geojson(spark, str(tmp_path / "f.geojson")).select("pos", F.try_variant_get("properties", "$.n", "int").alias("n"), wkb.geometry_type(F.col("geometry")).alias("t"), wkb.has_z(F.col("geometry")).alias("z"), wkb.envelope("geometry").alias("b")).orderBy("pos").collect()
    assert [(r.n, r.t, r.z) for r in got] == [(0, "Point", True), (1, "MultiPolygon", False), (2, None, None), (3, "GeometryCollection", False)]
    assert tuple(got[1].b) == (0, 0, 6, 6)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_labels(spark):
    sizes = spark.createDataFrame([(0,), (999,), (1500,), (1059267903,), (-1,), (None,), (10**19 // 2,)], "n bigint")
    assert [r[0] for r in sizes.select(labels.human_size(F.col("n"))).collect()] == ["0 B", "999 B", "1.5 kB", "1.1 GB", "", "", "5,000.0 PB"]
    assert one(spark, labels.excerpt(F.col("t"), 10), t=" a  b\nc defghijk ") == "a b c def…"
    assert one(spark, labels.license_name(F.col("t")), t=" Other ") == "Custom terms"
    cases = [("https://h/x/README.md", "License", "README.md"), ("https://www.h.test/x", None, "h.test"), ("https://h/a.md#s", "", "h"), ("https://h/x", " Mine ", "Mine")]
    frame = spark.createDataFrame(cases, "href string, title string, want string")
    assert all(r[0] == r[1] for r in frame.select(labels.link_label(F.col("href"), F.col("title")), "want").collect())
    forms = [("parquet", None, "h", True, "Parquet"), ("cog", None, "h", False, "COG"), (None, "image/svg+xml", "h", False, "SVG"), (None, "application/pdf; v=1", "h", False, "PDF"), (None, None, "https://h/a.las?x", False, "LAS"), (None, None, "https://h/a", False, "File"), ("csv", "text/csv", "h", False, "CSV")]
    frame = spark.createDataFrame(forms, "f string, m string, h string, t boolean, want string")
    assert all(r[0] == r.want for r in frame.select(labels.format_label(F.col("f"), F.col("m"), F.col("h"), F.col("t")), "want").collect())
    summary = labels.catalog_summary(F.lit(1), F.lit(None).cast("bigint"), F.array(F.lit("A"), F.lit("B")))
    assert one(spark, summary, a=1) == "1 collection, A and B"
    assert "named b." in one(spark, labels.read_error(F.lit("s3://b/x"), F.lit("NoSuchBucket: gone")), a=1)
    assert one(spark, labels.read_error(F.lit("https://b/x"), F.lit("NoSuchBucket")), a=1) == "NoSuchBucket"


def test_spatial_semi_join(spark, monkeypatch):
    rng = random.Random(5)
    areas = [polygon([(x, y), (x + w, y + 0.3), (x + w / 2, y + w), (x, y)]) for x, y, w in ((0, 0, 3.5), (2.2, 1.1, 0.4), (-7.3, 3, 5), (6, 6, 0.2))]
    values = [line([(x, y), (x + rng.random() * 2, y + rng.random() * 2)]) for x, y in ((rng.uniform(-9, 9), rng.uniform(-2, 9)) for _ in range(300))]
    values += [polygon(square(-8, -1, 12)), polygon(square(0.5, 0.2, 0.05)), None]
    features = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, geometry binary").withColumn("bbox", wkb.envelope("geometry"))
    layer = spark.createDataFrame([(a,) for a in areas] + [(line([(0, 0), (9, 9)]),)], "geometry binary")
    near = sorted(r.id for r in spatial.touching(features, layer, "id").collect())
    cells = sorted(r.id for r in spatial.touching(features, layer, "id", carried_bytes=0).collect())
    # Blocks of cells with many features and pieces, and boxes of rounded floats.
    monkeypatch.setattr(spatial, "CARRIED_BYTES", 0)
    monkeypatch.setattr(spatial, "BLOCK_ROWS", 2)
    floats = features.withColumn("bbox", F.col("bbox").cast("struct<xmin: float, ymin: float, xmax: float, ymax: float>"))
    for rows in (features, floats):
        blocks = sorted(r.id for r in spatial.touching(rows, layer.unionAll(layer), "id", carried_bytes=0).collect())
        assert near == blocks
    assert near == cells and 300 in near and 302 not in near and len(near) > 20
    row = spatial.layer_envelope(layer).first()
    assert (row.polygons, row.geometries, row.west) == (4, 5, -7.3)
    with pytest.raises(ValueError):
        spatial.touching(features, layer.limit(0), "id")


@pytest.mark.parametrize("carried", [spatial.CARRIED_BYTES, 0])
def test_a_semi_join_writes_ids_and_no_pairs(spark, monkeypatch, tmp_path, carried):
    rng = random.Random(7)
    spots = [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(150)]
    layer = spark.createDataFrame([(polygon([(x, y), (x + 3, y + 0.1), (x + 1, y + 3), (x, y)]),) for x, y in spots], "geometry binary")
    values = [line([(x, y), (x + 0.3, y - 0.2), (x + 0.5, y + 0.5)]) for x, y in ((rng.uniform(-1, 9), rng.uniform(-1, 9)) for _ in range(200))]
    features = spark.createDataFrame(list(enumerate(values)), "id int, geometry binary").withColumn("bbox", wkb.envelope("geometry"))
    near = sorted(row.id for row in spatial.touching(features, layer, "id").collect())
    paths = []
    monkeypatch.setattr(spatial, "CARRIED_BYTES", carried)
    monkeypatch.setattr(spatial, "scratch_path", lambda _spark, name: paths.append(str(tmp_path / f"{name}-{len(paths)}")) or paths[-1])
    assert sorted(row.id for row in spatial.touching(features, layer, "id", carried_bytes=0).collect()) == near and 50 < len(near) < 200
    # Most features meet dozens of pieces; each is written a few times at most, and without a piece.
    written = [spark.read.parquet(path) for path in paths if "pieces" not in path]
    assert sum(rows.count() for rows in written) < 4 * len(values)
    assert all("body" not in rows.columns for rows in written)


def test_crowded_tiles_are_split(spark, monkeypatch, tmp_path):
    rng = random.Random(11)
    spots = [(rng.uniform(0, 8), rng.uniform(0, 8), rng.uniform(0.1, 0.6)) for _ in range(150)] + [(500, -300, 1.0)]
    layer = spark.createDataFrame([(polygon([(x, y), (x + w, y), (x, y + w), (x, y)]),) for x, y, w in spots], "geometry binary")
    # Small ones in the crowd, some that are larger than it, one around all, and one apart.
    values = [line([(x, y), (x + rng.random() / 9, y + rng.random() / 9)]) for x, y in ((rng.uniform(-1, 9), rng.uniform(-1, 9)) for _ in range(400))]
    values += [line([(-20, y), (30, y + 0.01), (31, 30)]) for y in (3.3, 8.9, 20)] + [polygon(square(-600, -600, 1300)), line([(499, -300), (501, -299.5)])]
    features = spark.createDataFrame(list(enumerate(values)), "id int, geometry binary").withColumn("bbox", wkb.envelope("geometry"))
    near = sorted(row.id for row in spatial.touching(features, layer, "id").collect())
    tiles = []

    def path(_spark, name):
        at = str(tmp_path / f"{name}-{len(tiles)}")
        tiles.extend([at] if name == "tiles" else [])
        return at

    for name, value in (("CARRIED_BYTES", 0), ("BLOCK_ROWS", 60), ("scratch_path", path)):
        monkeypatch.setattr(spatial, name, value)
    assert sorted(row.id for row in spatial.touching(features, layer, "id", carried_bytes=0).collect()) == near
    assert {400, 403, 404} <= set(near) and 402 not in near and 30 < len(near) < 400
    first, last = (spark.read.parquet(at).agg(F.max("_features")).first()[0] for at in (tiles[0], tiles[-1]))
    assert len(tiles) > 1 and first > 200 and last < first / 2


def star(rng, x, y, size, corners, grid):
    """Return a ring of alternating radii; on a grid many corners and edges fall together."""
    ring = []
    for corner in range(corners):
        reach = size * (1 if corner % 2 else 0.4 + 0.3 * rng.random())
        at = (x + reach * math.cos(2 * math.pi * corner / corners), y + reach * math.sin(2 * math.pi * corner / corners))
        ring.append(tuple(round(value / grid) * grid for value in at) if grid else at)
    return [*ring, ring[0]]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
@pytest.mark.parametrize("grid", [0.0, 0.125])
def test_pieces_tell_what_whole_polygons_tell(scale, grid):
    rng = random.Random(3)
    where = lambda reach: rng.uniform(-reach, reach) * scale
    areas = [polygon(star(rng, where(5), where(5), rng.uniform(0.5, 4) * scale, corners, grid * scale)) for corners in (3, 40, 1500)]
    hole = [star(rng, 3 * scale, 3 * scale, size * scale, corners, grid * scale) for size, corners in ((2, 200), (0.3, 8))]
    areas.append(polygon(*hole))
    cut = pa.Table.from_batches(pieces.cut(pa.array(areas, pa.binary()))).combine_chunks()
    e, ix, iy, inside = (cut.column(name).to_numpy() for name in ("e", "ix", "iy", "inside"))
    xs, ys = (np.array([rng.choice([where(9), round(where(9) * 8 / scale) * scale / 8]) for _ in range(800)]) for _ in range(2))
    whole = [shapes.polygons_of_wkb(area) for area in areas]
    wanted = np.any([shapes.points_in(xs, ys, area) for area in whole], axis=0)
    found = np.zeros(len(xs), bool)
    for level in set(e.tolist()):
        cell = np.floor(xs / 2.0**level) * 2**32 + np.floor(ys / 2.0**level)
        point, piece = np.nonzero(cell[:, None] == np.where(e == level, ix * 2**32 + iy, np.inf)[None, :])
        found[point[inside[piece]]] = True
        point, piece = point[~inside[piece]], piece[~inside[piece]]
        bodies = pieces.Bodies(cut.column("body").combine_chunks().take(pa.array(piece)))
        found[point[pieces.points_in_pieces(xs[point], ys[point], bodies.of_row, bodies)]] = True
    assert (found == wanted).all()
    values = [line([(where(9), where(9)) for _ in range(rng.choice([2, 5]))]) for _ in range(20)]
    values += [polygon(star(rng, where(9), where(9), size * scale, 9, 0)) for size in (0.2, 3, 20) * 4]
    flat = shapes.decode(pa.array(values, pa.binary()))
    wanted = np.any([shapes.intersects(flat, area) for area in whole], axis=0)
    body = cut.column("body").combine_chunks()
    found = [pieces.shapes_meet_pieces(pa.array([value] * len(e), pa.binary()), e, ix, iy, body).any() for value in values]
    assert (wanted == found).all()


def test_overlaid_edges_end_the_cut():
    ring = [(0.0, 0.0), (1.0, 1.0)] * 500 + [(0.0, 0.0)]
    batches = list(pieces.cut(pa.array([polygon(ring), polygon([(0, 0), (0, 0), (0, 0)])], pa.binary())))
    assert 0 < sum(batch.num_rows for batch in batches) < 5_000
