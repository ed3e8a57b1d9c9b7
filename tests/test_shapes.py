"""WKB headers and the exact intersection kernel, against small brute-force checks."""

import random
import struct
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoquarry.functions import shapes, wkb


def pack(kind, body, little=True, z=False):
    mark = "<" if little else ">"
    return struct.pack(mark + "BI", 1 if little else 0, kind + (1000 if z else 0)) + body


def point(x, y, little=True, z=None):
    mark = "<" if little else ">"
    return pack(1, struct.pack(mark + "2d", x, y) + (struct.pack(mark + "d", z) if z is not None else b""), little, z is not None)


def line(points):
    return pack(2, struct.pack("<I", len(points)) + b"".join(struct.pack("<2d", *p) for p in points))


def polygon(*rings):
    body = struct.pack("<I", len(rings))
    for ring in rings:
        body += struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    return pack(3, body)


def multi(kind, *parts):
    return pack(kind, struct.pack("<I", len(parts)) + b"".join(parts))


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


DONUT = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
CASES = [
    (point(1, 1), True), (point(5, 5), False), (point(0, 3), True), (point(4, 5), True), (point(10, 10), True),
    (point(11, 5), False), (point(2, 2, little=False), True), (point(2, 2, z=9), True),
    (line([(-1, 5), (11, 5)]), True), (line([(4.5, 5), (5.5, 5)]), False), (line([(-1, -1), (-1, 11)]), False),
    (line([(10, -5), (10, 15)]), True), (polygon(square(-5, -5, 30)), True), (polygon(square(4.5, 4.5, 1)), False),
    (polygon(square(3, 3, 4)), True), (polygon(square(20, 20, 2)), False),
    (polygon(square(-5, -5, 30), square(-1, -1, 12)), False), (polygon(square(10, 10, 2)), True),
    (multi(4, point(50, 50), point(5, 1)), True), (multi(6, polygon(square(40, 40, 1)), polygon(square(1, 1, 1))), True),
    (multi(7, point(50, 50), line([(60, 60), (61, 61)])), False), (multi(7, point(50, 50), multi(7, point(1, 2))), True),
    (multi(7), False), (None, False), (point(float("nan"), float("nan")), False),
]


def test_intersects_a_polygon_with_a_hole():
    flat = shapes.decode(pa.array([v for v, _ in CASES], pa.binary()))
    got = shapes.intersects(flat, shapes.polygons_of_text(DONUT))
    assert [bool(g) for g in got] == [e for _, e in CASES]


def test_multipolygon_and_overlapping_parts():
    area = shapes.polygons_of_text("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0)),((3 3,8 3,8 8,3 8,3 3)))")
    values = pa.array([point(3.5, 3.5), point(1, 1), point(7, 7), point(7, 1), polygon(square(-9, -9, 99))], pa.binary())
    assert shapes.intersects(shapes.decode(values), area).tolist() == [True, True, True, False, True]


def test_envelopes_and_sliced_arrays():
    values = pa.array([point(9, 9), polygon(square(1, 2, 3)), None, multi(7)], pa.binary()).slice(1)
    boxes, filled = shapes.envelopes(shapes.decode(values))
    assert filled.tolist() == [True, False, False] and boxes[0].tolist() == [1, 2, 4, 5]


def test_random_points_against_winding():
    rng = random.Random(3)
    ring = [(0, 0), (7, 1), (9, 6), (5, 3), (4, 9), (1, 7), (0, 0)]
    area = shapes.polygons_of([[ring]])
    pts = [(rng.randint(-2, 40) / 4, rng.randint(-2, 40) / 4) for _ in range(3000)]

    def brute(px, py):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            turn = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            if turn == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return True
            if (ay <= py < by and turn > 0) or (by <= py < ay and turn < 0):
                odd = not odd
        return odd

    got = shapes.points_in(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), area)
    assert got.tolist() == [brute(*p) for p in pts]


def test_orientation_is_exact_near_the_line():
    a = np.array([0.5]), np.array([0.5]), np.array([12.0]), np.array([12.0])
    step = 2.0**-53
    assert shapes.orientation(*a, np.array([24.0]), np.array([24.0])).tolist() == [0]
    assert shapes.orientation(*a, np.array([0.5 + step]), np.array([0.5 + step * 2])).tolist()[0] in (0, 1)


def test_turns_on_a_grid_are_exact_without_fractions(monkeypatch):
    rng = np.random.default_rng(5)
    grid = rng.integers(-9, 9, (4000, 6)) / 8
    start, way = rng.random((2000, 2)), rng.random((2000, 2))
    near = np.hstack([start, start + way, start + way * rng.random((2000, 1))])
    mixed = rng.integers(-3, 3, (2000, 6)) * rng.choice([1e-300, 1e-160, 1.0, 1 / 3, 2.0**52], (2000, 6))
    for places in (grid, grid + 2.0**30, near, mixed):
        a, b, c, d, p, q = ([Fraction(value) for value in column] for column in places.T.tolist())
        turns = [(c[i] - a[i]) * (q[i] - b[i]) - (d[i] - b[i]) * (p[i] - a[i]) for i in range(len(a))]
        assert shapes.orientation(*places.T).tolist() == [(turn > 0) - (turn < 0) for turn in turns]
    monkeypatch.setattr(shapes, "Fraction", None)
    assert (shapes.orientation(*grid.T) == 0).any()


@pytest.mark.parametrize("text", ["POINT(1 2)", "POLYGON EMPTY", "nonsense"])
def test_other_texts_are_refused(text):
    with pytest.raises(ValueError):
        shapes.polygons_of_text(text)


def test_unreadable_value_is_an_error():
    with pytest.raises(ValueError):
        shapes.decode(pa.array([b"\x01\x01\x00"], pa.binary()))


def test_headers_and_promotion(spark):
    values = [point(1, 2), point(1, 2, little=False), point(1, 2, z=3), line([(0, 0), (1, 1)]), multi(4, point(1, 2)), None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, g binary").orderBy("i")
    g = F.col("g")
    rows = frame.select(wkb.geometry_type(g), wkb.has_z(g), wkb.geometry_type(wkb.as_multi(g)), wkb.as_multi(g)).collect()
    assert [r[0] for r in rows] == ["Point", "Point", "Point", "LineString", "MultiPoint", None]
    assert [r[1] for r in rows] == [False, False, True, False, False, None]
    assert [r[2] for r in rows] == ["MultiPoint", "MultiPoint", "MultiPoint", "MultiLineString", "MultiPoint", None]
    assert bytes(rows[0][3]) == multi(4, point(1, 2))
    boxes = frame.select(wkb.envelope(g).alias("b")).collect()
    assert tuple(boxes[1].b) == (1, 2, 1, 2) and boxes[5].b is None
    fitted = frame.select(wkb.normalised(g, "MultiPoint").alias("n")).collect()
    assert [r.n is None for r in fitted] == [False, False, False, True, False, True]


def test_points_and_column_test(spark):
    frame = spark.createDataFrame([(i, i / 4, (i * 7 % 40) / 4) for i in range(41)] + [(99, None, 1.0)], "i int, x double, y double")
    area = shapes.polygons_of_text(DONUT)
    test = wkb.intersects_test(area)
    rows = frame.withColumn("g", wkb.point_wkb("x", "y")).select("i", test("g").alias("exact"), wkb.point_inside(F.col("x"), F.col("y"), area).alias("quick")).collect()
    assert all(r.quick is None or r.quick == r.exact for r in rows if r.i != 99)
    assert sum(r.quick is not None for r in rows) > 20
    assert [r.exact for r in rows if r.i == 99] == [None]
