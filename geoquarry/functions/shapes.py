"""Batch geometry on numpy arrays: decode WKB, envelopes, exact intersection tests.

Runs inside Arrow UDFs. A whole Arrow batch is decoded at once: the loops below
go over steps of the format, never over rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa

POINT, LINE, RING = 0, 1, 2
# Pairs of points and edges that one numpy step may hold.
_PAIRS = 2_000_000
# Rounding bound of the orientation determinant (Shewchuk, 1997).
_ORIENT_BOUND = (3.0 + 16.0 * np.finfo(float).eps / 2) * np.finfo(float).eps / 2


@dataclass(frozen=True)
class Flat:
    """Geometries of a batch as flat arrays.

    A part is a point, a line or one ring of a polygon. Vertices are grouped
    by part and parts by row.
    """

    rows: int
    x: np.ndarray
    y: np.ndarray
    part_row: np.ndarray
    part_kind: np.ndarray
    part_polygon: np.ndarray
    part_start: np.ndarray

    @property
    def part_of(self) -> np.ndarray:
        """Return the part of each vertex."""
        return np.repeat(np.arange(len(self.part_row)), np.diff(self.part_start))

    def rows_only(self, keep: np.ndarray) -> Flat:
        """Return the parts of the rows that the mask keeps; row numbers stay."""
        chosen = keep[self.part_row]
        sizes = np.diff(self.part_start)
        vertices = np.repeat(chosen, sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[chosen])])
        return Flat(
            self.rows, self.x[vertices], self.y[vertices], self.part_row[chosen],
            self.part_kind[chosen], self.part_polygon[chosen], starts,
        )


def _gather(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if len(at) and (at.min() < 0 or at.max() + width > len(data)):
        raise ValueError("A geometry value is not readable WKB")
    return data[at[:, None] + np.arange(width)]


def _unsigned(data: np.ndarray, at: np.ndarray, little: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(_gather(data, at, 4))
    return np.where(little, raw.view("<u4")[:, 0], raw.view(">u4")[:, 0]).astype(np.int64)


def decode(values: pa.Array) -> Flat:
    """Decode an Arrow array of WKB (ISO or extended, either byte order, any dimension)."""
    values = values.cast(pa.large_binary())
    rows = len(values)
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, rows + 1, values.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    present = np.array(values.is_valid()) & (np.diff(offsets) > 0) if rows else np.zeros(0, bool)

    cursor = offsets[:-1].astype(np.int64)
    pending = present.astype(np.int64)
    rings = np.zeros(rows, np.int64)
    little = np.ones(rows, bool)
    width = np.full(rows, 2, np.int64)
    polygon = np.zeros(rows, np.int64)
    polygons = 0
    found: list[tuple[np.ndarray, ...]] = []

    while True:
        ringed = np.flatnonzero(rings > 0)
        headed = np.flatnonzero((rings == 0) & (pending > 0))
        if not len(ringed) and not len(headed):
            break
        if len(ringed):
            count = _unsigned(data, cursor[ringed], little[ringed])
            start = cursor[ringed] + 4
            found.append((ringed, start, count, np.full(len(ringed), RING), polygon[ringed],
                          width[ringed], little[ringed]))
            cursor[ringed] = start + count * width[ringed] * 8
            rings[ringed] -= 1
            pending[ringed] -= rings[ringed] == 0
        if len(headed):
            order = _gather(data, cursor[headed], 1)[:, 0]
            little[headed] = order == 1
            code = _unsigned(data, cursor[headed] + 1, little[headed])
            extra = np.where(code & 0x20000000, 4, 0)
            base = code & 0x0FFFFFFF
            band, kind = base // 1000, base % 1000
            flags = ((code & 0x80000000) != 0).astype(np.int64) + ((code & 0x40000000) != 0)
            width[headed] = 2 + np.where(flags > 0, flags, np.select([band == 3, band > 0], [2, 1], 0))
            if ((kind < 1) | (kind > 7) | (order > 1)).any():
                raise ValueError("A geometry value is not readable WKB")
            cursor[headed] += 5 + extra
            points = headed[kind == 1]
            if len(points):
                ones = np.ones(len(points), np.int64)
                found.append((points, cursor[points].copy(), ones, ones * POINT, ones * -1,
                              width[points], little[points]))
                cursor[points] += width[points] * 8
                pending[points] -= 1
            counted = headed[kind != 1]
            if len(counted):
                kinds = kind[kind != 1]
                count = _unsigned(data, cursor[counted], little[counted])
                cursor[counted] += 4
                lines = counted[kinds == 2]
                if len(lines):
                    size = count[kinds == 2]
                    found.append((lines, cursor[lines].copy(), size, np.full(len(lines), LINE),
                                  np.full(len(lines), -1), width[lines], little[lines]))
                    cursor[lines] += size * width[lines] * 8
                    pending[lines] -= 1
                areas = counted[kinds == 3]
                if len(areas):
                    rings[areas] = count[kinds == 3]
                    polygon[areas] = polygons + np.arange(len(areas))
                    polygons += len(areas)
                    pending[areas] -= rings[areas] == 0
                groups = counted[kinds > 3]
                if len(groups):
                    pending[groups] += count[kinds > 3] - 1
    return _assemble(rows, data, found)


def _assemble(rows: int, data: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> Flat:
    if not found:
        none = np.zeros(0, np.int64)
        return Flat(rows, np.zeros(0), np.zeros(0), none, none, none, np.zeros(1, np.int64))
    row, start, count, kind, polygon, width, little = (
        np.concatenate([step[index] for step in found]) for index in range(7)
    )
    order = np.argsort(row, kind="stable")
    row, start, count, kind, polygon, width, little = (
        part[order] for part in (row, start, count, kind, polygon, width, little)
    )
    starts = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(starts[-1]) - np.repeat(starts[:-1], count)
    at = np.repeat(start, count) + within * np.repeat(width, count) * 8
    raw = np.ascontiguousarray(_gather(data, at, 16))
    native, swapped = raw.view("<f8"), raw.view(">f8")
    ordered = np.repeat(little, count)[:, None]
    xy = np.where(ordered, native, swapped)
    real = ~np.isnan(xy).any(axis=1)
    if not real.all():
        count = np.bincount(np.repeat(np.arange(len(row)), count)[real], minlength=len(row))
        starts = np.concatenate([[0], np.cumsum(count)])
        xy = xy[real]
    return Flat(rows, xy[:, 0].copy(), xy[:, 1].copy(), row, kind, polygon, starts)


def envelopes(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Return the boxes of the rows as an array of 4 columns, and which rows have one."""
    boxes = np.empty((flat.rows, 4))
    boxes[:, :2], boxes[:, 2:] = np.inf, -np.inf
    row = np.repeat(flat.part_row, np.diff(flat.part_start))
    for column, (values, reduce) in enumerate(
        [(flat.x, np.minimum), (flat.y, np.minimum), (flat.x, np.maximum), (flat.y, np.maximum)]
    ):
        reduce.at(boxes[:, column], row, values)
    return boxes, boxes[:, 0] <= boxes[:, 2]


@dataclass(frozen=True)
class Polygons:
    """A polygon or multipolygon to test against: its edges, grouped by polygon."""

    edges: np.ndarray
    polygon: np.ndarray
    corner: np.ndarray
    box: tuple[float, float, float, float]

    @property
    def count(self) -> int:
        """Return the number of polygons."""
        return len(self.corner)


def polygons_of(rings: Iterable[Iterable[list[tuple[float, float]]]]) -> Polygons:
    """Prepare polygons, each given as rings of vertices, the outer ring first."""
    edges, owner, corner = [], [], []
    for index, polygon in enumerate(rings):
        for ring in polygon:
            loop = np.asarray(ring, float)
            if (loop[0] != loop[-1]).any():
                loop = np.vstack([loop, loop[:1]])
            edges.append(np.hstack([loop[:-1], loop[1:]]))
            owner.append(np.full(len(loop) - 1, index))
            if len(corner) == index:
                corner.append(loop[0])
    if not edges:
        raise ValueError("The area is empty")
    stacked = np.vstack(edges)
    xs, ys = stacked[:, [0, 2]], stacked[:, [1, 3]]
    box = (float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max()))
    return Polygons(stacked, np.concatenate(owner), np.array(corner), box)


def box_polygon(west: float, south: float, east: float, north: float) -> Polygons:
    """Return a box as a polygon."""
    ring = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return polygons_of([[ring]])


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_RING_TEXT = re.compile(r"\(([^()]*)\)")


def rings_of_text(wkt: str) -> list[list[list[tuple[float, float]]]]:
    """Read the rings of a POLYGON or MULTIPOLYGON text.

    Raises:
        ValueError: The text is something else, or is empty.
    """
    shaped = re.fullmatch(r"\s*(MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*\((.*)\)\s*", wkt, re.IGNORECASE | re.DOTALL)
    if shaped is None:
        raise ValueError(f"Not a Polygon or MultiPolygon: {wkt[:80]}")
    groups = re.split(r"\)\s*\)\s*,\s*\(\s*\(", shaped[2]) if shaped[1] else [shaped[2]]
    polygons = []
    for group in groups:
        rings = []
        for ring in _RING_TEXT.findall("(" + group.strip().lstrip("(").rstrip(")") + ")"):
            corners = [re.findall(_NUMBER, corner) for corner in ring.split(",")]
            rings.append([(float(corner[0]), float(corner[1])) for corner in corners])
        if not rings or any(len(ring) < 3 for ring in rings):
            raise ValueError(f"Not a Polygon or MultiPolygon: {wkt[:80]}")
        polygons.append(rings)
    return polygons


def polygons_of_text(wkt: str) -> Polygons:
    """Prepare the polygons of a WKT text."""
    return polygons_of(rings_of_text(wkt))


def polygons_of_wkb(value: bytes) -> Polygons:
    """Prepare the polygons of one WKB value; points and lines in it do not count."""
    flat = decode(pa.array([value], pa.binary()))
    polygons: dict[int, list] = {}
    for part in np.flatnonzero(flat.part_kind == RING):
        span = slice(flat.part_start[part], flat.part_start[part + 1])
        ring = list(zip(flat.x[span], flat.y[span], strict=True))
        polygons.setdefault(int(flat.part_polygon[part]), []).append(ring)
    return polygons_of(polygons.values())


def _exact_product(a, b, c, d) -> np.ndarray:
    """Return where (a - b) * (c - d) is computed without any rounding."""
    one, two = a - b, c - d
    exact = np.ones(one.shape, bool)
    for high, low, value in ((a, b, one), (c, d, two)):
        back = high - value
        exact &= ((high - (value + back)) + (back - low)) == 0
    # The rest of the product (Dekker, 1971); out of the range of halves it is not known.
    halves = []
    for value in (one, two):
        wide = value * (2.0**27 + 1)
        upper = wide - (wide - value)
        halves.append((upper, value - upper))
    (p, q), (r, t) = halves
    product = one * two
    exact &= q * t - (((product - p * r) - q * r) - p * t) == 0
    return exact & ((np.abs(product) > 1e-250) | (one == 0) | (two == 0))


def orientation(ax, ay, bx, by, px, py) -> np.ndarray:
    """Return the exact sign of the turn a -> b -> p: 1 left, -1 right, 0 on the line."""
    left = (bx - ax) * (py - ay)
    right = (by - ay) * (px - ax)
    value = left - right
    sign = np.sign(value)
    unsure = np.abs(value) <= _ORIENT_BOUND * (np.abs(left) + np.abs(right))
    if unsure.any():
        shaped = np.broadcast_arrays(ax, ay, bx, by, px, py)
        a, b, c, d, p, q = (part[unsure] for part in shaped)
        with np.errstate(over="ignore", invalid="ignore"):
            unsure[unsure] = ~(_exact_product(c, a, q, b) & _exact_product(d, b, p, a))
        for at in np.argwhere(unsure):
            a, b, c, d, p, q = (Fraction(float(part[tuple(at)])) for part in shaped)
            exact = (c - a) * (q - b) - (d - b) * (p - a)
            sign[tuple(at)] = (exact > 0) - (exact < 0)
    return sign


def _chunks(total: int, other: int) -> Iterator[slice]:
    step = max(1, _PAIRS // max(1, other))
    for start in range(0, total, step):
        yield slice(start, min(total, start + step))


def _hits(px: np.ndarray, py: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return per point and edge: the ray from the point crosses it; the point lies on it."""
    ax, ay, bx, by = (edges[:, column][None, :] for column in range(4))
    x, y = px[:, None], py[:, None]
    level = (np.minimum(ay, by) <= y) & (np.maximum(ay, by) >= y)
    reach = level & (np.maximum(ax, bx) >= x)
    crossing, on_edge = np.zeros(level.shape, bool), np.zeros(level.shape, bool)
    p, e = np.nonzero(reach)
    if len(p):
        a, b, c, d = (edges[e, column] for column in range(4))
        turn = orientation(a, b, c, d, px[p], py[p])
        upward = (b <= py[p]) & (py[p] < d)
        downward = (d <= py[p]) & (py[p] < b)
        crossing[p, e] = (upward & (turn > 0)) | (downward & (turn < 0))
        on_edge[p, e] = (turn == 0) & (np.minimum(a, c) <= px[p])
    return crossing, on_edge


def points_in(px: np.ndarray, py: np.ndarray, area: Polygons) -> np.ndarray:
    """Return which points lie in the area or on its boundary."""
    inside = np.zeros(len(px), bool)
    for part in _chunks(len(px), len(area.edges)):
        crossing, on_edge = _hits(px[part], py[part], area.edges)
        hit = on_edge.any(axis=1)
        if area.count == 1:
            hit |= crossing.sum(axis=1) % 2 == 1
        else:
            starts = np.flatnonzero(np.diff(area.polygon, prepend=-1))
            per_polygon = np.add.reduceat(crossing.astype(np.int64), starts, axis=1)
            hit |= (per_polygon % 2 == 1).any(axis=1)
        inside[part] = hit
    return inside


def _segments_meet(segments: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Return which segments touch any edge."""
    meets = np.zeros(len(segments), bool)
    low = np.minimum(edges[:, :2], edges[:, 2:])
    high = np.maximum(edges[:, :2], edges[:, 2:])
    for part in _chunks(len(segments), len(edges)):
        own = segments[part]
        own_low, own_high = np.minimum(own[:, :2], own[:, 2:]), np.maximum(own[:, :2], own[:, 2:])
        near = (
            (own_low[:, None, 0] <= high[None, :, 0]) & (own_high[:, None, 0] >= low[None, :, 0])
            & (own_low[:, None, 1] <= high[None, :, 1]) & (own_high[:, None, 1] >= low[None, :, 1])
        )
        s, e = np.nonzero(near)
        if not len(s):
            continue
        p, q, r, t = (own[s, column] for column in range(4))
        a, b, c, d = (edges[e, column] for column in range(4))
        across = (
            (orientation(a, b, c, d, p, q) * orientation(a, b, c, d, r, t) <= 0)
            & (orientation(p, q, r, t, a, b) * orientation(p, q, r, t, c, d) <= 0)
        )
        hit = np.zeros(len(own), bool)
        hit[s[across]] = True
        meets[part] = hit
    return meets


def segments_of(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Return the segments of lines and rings, with the part of each, and their polygon."""
    part = flat.part_of
    joined = (part[1:] == part[:-1]) & (flat.part_kind[part[1:]] != POINT)
    first = np.flatnonzero(joined)
    segments = np.column_stack([flat.x[first], flat.y[first], flat.x[first + 1], flat.y[first + 1]])
    return segments, part[first], flat.part_polygon[part[first]]


def intersects(flat: Flat, area: Polygons) -> np.ndarray:
    """Return which rows touch the area, its boundary included."""
    result = np.zeros(flat.rows, bool)
    boxes, filled = envelopes(flat)
    west, south, east, north = area.box
    near = filled & (boxes[:, 0] <= east) & (boxes[:, 2] >= west)
    near &= (boxes[:, 1] <= north) & (boxes[:, 3] >= south)
    if not near.any():
        return result
    flat = flat.rows_only(near)
    row = np.repeat(flat.part_row, np.diff(flat.part_start))
    close = (flat.x >= west) & (flat.x <= east) & (flat.y >= south) & (flat.y <= north)
    inside = points_in(flat.x[close], flat.y[close], area)
    result[row[close][inside]] = True

    undecided = near & ~result
    undecided &= np.isin(np.arange(flat.rows), flat.part_row[flat.part_kind != POINT])
    if not undecided.any():
        return result
    flat = flat.rows_only(undecided)
    segments, part, polygon = segments_of(flat)
    low, high = np.minimum(segments[:, :2], segments[:, 2:]), np.maximum(segments[:, :2], segments[:, 2:])
    close = (low[:, 0] <= east) & (high[:, 0] >= west) & (low[:, 1] <= north) & (high[:, 1] >= south)
    met = _segments_meet(segments[close], area.edges)
    result[flat.part_row[part[close][met]]] = True

    ringed = polygon >= 0
    open_rows = ringed & ~result[flat.part_row[part]]
    if open_rows.any():
        result[_rows_around(segments[open_rows], polygon[open_rows], flat.part_row[part[open_rows]], area)] = True
    return result


def _rows_around(
    edges: np.ndarray, polygon: np.ndarray, row: np.ndarray, area: Polygons
) -> np.ndarray:
    """Return the rows of which one polygon holds a corner of the area."""
    names, dense = np.unique(polygon, return_inverse=True)
    owner = np.zeros(len(names), np.int64)
    owner[dense] = row
    holds = np.zeros(len(names), bool)
    for x, y in area.corner:
        for part in _chunks(len(edges), 1):
            crossing, _on_edge = _hits(np.array([x]), np.array([y]), edges[part])
            count = np.bincount(dense[part], weights=crossing[0], minlength=len(names))
            if part.start == 0:
                total = count
            else:
                total = total + count
        holds |= total % 2 == 1
    return owner[holds]


def point_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Return little-endian WKB points as rows of 21 bytes."""
    out = np.zeros((len(x), 21), np.uint8)
    out[:, 0], out[:, 1] = 1, 1
    out[:, 5:13] = np.ascontiguousarray(x, "<f8").view(np.uint8).reshape(-1, 8)
    out[:, 13:21] = np.ascontiguousarray(y, "<f8").view(np.uint8).reshape(-1, 8)
    return out
