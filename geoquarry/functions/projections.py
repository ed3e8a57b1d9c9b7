"""The two coordinate systems with a closed form: degrees and the square web map."""

from __future__ import annotations

import math

from geoquarry.functions.shapes import (
    Polygons,
    box_polygon,
    polygons_of,
    polygons_of_text,
    rings_of_text,
)
from geoquarry.model import Area, Box, Clip, Everything, MapView, Scope

# Names of the two systems, and the sphere of the web map.
DEGREES = ("", "OGC:CRS84", "EPSG:4326", "OGC:CRS84h", "EPSG:4979")
WEB_MAP = ("EPSG:3857", "EPSG:900913", "EPSG:102100")
RADIUS = 6378137.0


def to_web_map(longitude: float, latitude: float) -> tuple[float, float]:
    """Return web map metres of a point in degrees."""
    angle = math.pi / 4 + math.radians(latitude) / 2
    return RADIUS * math.radians(longitude), RADIUS * math.log(math.tan(angle))


def to_degrees(x: float, y: float) -> tuple[float, float]:
    """Return degrees of a point in web map metres."""
    latitude = 2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2
    return math.degrees(x / RADIUS), math.degrees(latitude)


def _step(source: str, target: str):
    one, other = source in DEGREES, target in DEGREES
    if (one and other) or source == target:
        return lambda x, y: (x, y)
    if one and target in WEB_MAP:
        return to_web_map
    if source in WEB_MAP and other:
        return to_degrees
    raise ValueError(f"Cannot transform the area from {source} into {target}")


def transform_box(box: Box, source: str, target: str) -> Box:
    """Return a box in another system; both systems keep the axes parallel."""
    step = _step(source, target)
    west, south = step(box[0], box[1])
    east, north = step(box[2], box[3])
    return (west, south, east, north)


def transform_area(wkt: str, source: str, target: str) -> str:
    """Return a polygon text with its vertices in another system."""
    step = _step(source, target)
    groups = []
    for polygon in rings_of_text(wkt):
        rings = ["(" + ", ".join("{!r} {!r}".format(*step(*corner)) for corner in ring) + ")" for ring in polygon]
        groups.append("(" + ", ".join(rings) + ")")
    return "MULTIPOLYGON (" + ", ".join(groups) + ")"


def clip_for(scope: Scope, crs: str) -> Clip:
    """Return the clip of a scope in a file's system; an area brings its own envelope."""
    if isinstance(scope, Everything):
        return Clip()
    known = crs if crs in DEGREES or crs in WEB_MAP else None
    if known is None and crs:
        raise ValueError(f"Cannot transform the area into {crs}")
    if isinstance(scope, MapView):
        return Clip(transform_box(scope.bbox, "EPSG:4326", crs))
    moved = transform_area(scope.wkt, "EPSG:4326", crs)
    return Clip(polygons_of(rings_of_text(moved)).box, moved)


def area_of(wkt: str) -> Area:
    """Return a scope for a polygon text in degrees, cut at 180 degrees when it passes it.

    Longitudes beyond 180 mark a polygon that passes the line. Its parts come
    back on both sides, and its box has west > east.
    """
    rings = rings_of_text(wkt)
    xs = [x for polygon in rings for ring in polygon for x, _y in ring]
    if all(-180 <= x <= 180 for x in xs):
        return Area(wkt, polygons_of(rings).box)
    moved = [[[(x + 360 if x < 0 else x, y) for x, y in ring] for ring in polygon] for polygon in rings]
    west, south, east, north = polygons_of(moved).box
    if east <= 180:
        return Area(wkt, polygons_of(rings).box)
    sides = _cut(moved, 180.0, keep_low=True, shift=0.0) + _cut(moved, 180.0, keep_low=False, shift=-360.0)
    parts = ["(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in polygon) + ")" for polygon in sides]
    return Area("MULTIPOLYGON (" + ", ".join(parts) + ")", (max(west, -180.0), south, east - 360.0, north))


def _cut(polygons: list, at: float, *, keep_low: bool, shift: float) -> list:
    """Keep one side of a vertical line of each polygon, moved by ``shift``."""
    kept = []
    for polygon in polygons:
        rings = []
        for ring in polygon:
            loop = ring if ring[0] == ring[-1] else [*ring, ring[0]]
            out: list[tuple[float, float]] = []
            for (ax, ay), (bx, by) in zip(loop, loop[1:], strict=False):
                a_in, b_in = (ax <= at, bx <= at) if keep_low else (ax >= at, bx >= at)
                if a_in:
                    out.append((ax + shift, ay))
                if a_in != b_in:
                    out.append((at + shift, ay + (by - ay) * (at - ax) / (bx - ax)))
            if len(out) >= 3:
                rings.append([*out, out[0]])
        if rings:
            kept.append(rings)
    return kept


def as_polygons(clip: Clip) -> Polygons | None:
    """Return what a clip tests against: its area, else its box."""
    if clip.area is not None:
        return polygons_of_text(clip.area)
    return None if clip.bbox is None else box_polygon(*clip.bbox)
