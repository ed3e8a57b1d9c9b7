"""Polygons cut into cells of a quadtree, and exact tests of points and shapes against single pieces.

A cell is ``(e, ix, iy)``: the square of side ``2 ** e`` at ``ix * 2 ** e``,
``iy * 2 ** e``. Sides are powers of two and the grid begins at zero, so cell
numbers and borders are exact in any unit. A polygon begins with the cells of
about its own size; a cell with more than a few edges is split. Each piece is
enough to tell what is inside of its cell: ``body`` holds the edges that come
near the cell, and what edges further left do to the count of crossings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from geoquarry.functions import shapes

# Edges of a piece that is not split further, exponents between a cell and its children, and splits below the first cells.
FEW_EDGES = 12
STEP = 2
SPLITS = 9
# A polygon whose cells hold each edge so many times gains nothing by more splits: its edges are long or lie on each other.
COPIES = 8
# Pairs of segments and edges that one numpy step may hold.
PAIRS = 2_000_000
# Pieces that a shape is tried with at first, before those that touched one are left out.
FIRST_TRIES = 8
# Pairs of shapes and pieces that exist at once, and bytes of geometry that are decoded at once for them.
TRIES = 250_000
SHAPE_BYTES = 4 * 1024 * 1024

PIECE_FIELDS = "e int, ix bigint, iy bigint, inside boolean, px0 double, py0 double, px1 double, py1 double, body binary"


def level_of(extent: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Return the exponent, a multiple of ``STEP``, of cells at least as wide as an extent.

    ``reach`` is the largest coordinate: cells are never so small that their
    numbers leave 53 bits.
    """
    with np.errstate(divide="ignore"):
        wanted = np.maximum(np.ceil(np.log2(extent)), np.ceil(np.log2(np.maximum(reach, 1e-300))) - 48)
    return (np.ceil(np.maximum(wanted, -1000) / STEP) * STEP).astype(np.int64)


def _ranks(owner: np.ndarray) -> np.ndarray:
    """Return the place of each item among those of its owner; owners are in order."""
    if not len(owner):
        return owner
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))


class _Cells:
    """Some cells with the edges near them, and the heights at which edges on the left flip the count."""

    def __init__(self, polygon, e, ix, iy, base, pair_cell, pair_edge, flip_cell, flip_y) -> None:
        self.polygon, self.e, self.ix, self.iy, self.base = polygon, e, ix, iy, base
        self.pair_cell, self.pair_edge = pair_cell, pair_edge
        self.flip_cell, self.flip_y = flip_cell, flip_y

    def sorted_out(self, edges: np.ndarray) -> _Cells:
        """Keep the edges near each cell, and turn those that lie left of it into flips."""
        side = np.ldexp(1.0, self.e)
        left, bottom = self.ix * side, self.iy * side
        right, top = left + side, bottom + side
        cell, edge = self.pair_cell, edges[self.pair_edge]
        low, high = np.minimum(edge[:, 1], edge[:, 3]), np.maximum(edge[:, 1], edge[:, 3])
        band = (high >= bottom[cell]) & (low <= top[cell])
        past = np.maximum(edge[:, 0], edge[:, 2]) < left[cell]
        near = band & ~past & (np.minimum(edge[:, 0], edge[:, 2]) <= right[cell])
        gone = band & past & (low < high)
        turns = [self.flip_cell, cell[gone], cell[gone]]
        heights = [self.flip_y, low[gone], high[gone]]
        flip_cell, flip_y = np.concatenate(turns), np.concatenate(heights)
        below = np.bincount(flip_cell[flip_y <= bottom[flip_cell]], minlength=len(self.e)) % 2 == 1
        inner = (flip_y > bottom[flip_cell]) & (flip_y <= top[flip_cell])
        flip_cell, flip_y = flip_cell[inner], flip_y[inner]
        order = np.lexsort((flip_y, flip_cell))
        flip_cell, flip_y = flip_cell[order], flip_y[order]
        # Two flips at one height are none.
        fresh = np.ones(len(flip_y), bool)
        fresh[1:] = (flip_cell[1:] != flip_cell[:-1]) | (flip_y[1:] != flip_y[:-1])
        begins = np.flatnonzero(fresh)
        odd = begins[np.diff(np.append(begins, len(flip_y))) % 2 == 1]
        pair_cell, pair_edge = cell[near], self.pair_edge[near]
        order = np.argsort(pair_cell, kind="stable")
        return _Cells(
            self.polygon, self.e, self.ix, self.iy, self.base ^ below,
            pair_cell[order], pair_edge[order], flip_cell[odd], flip_y[odd],
        )

    def only(self, chosen: np.ndarray) -> _Cells:
        """Return the cells that a mask keeps."""
        number = np.cumsum(chosen) - 1
        pairs, flips = chosen[self.pair_cell], chosen[self.flip_cell]
        return _Cells(
            self.polygon[chosen], self.e[chosen], self.ix[chosen], self.iy[chosen], self.base[chosen],
            number[self.pair_cell[pairs]], self.pair_edge[pairs], number[self.flip_cell[flips]], self.flip_y[flips],
        )

    def children(self) -> _Cells:
        """Return the cells one step below, each with all that its parent has."""
        fan = 1 << STEP
        count = fan * fan
        cells = np.repeat(np.arange(len(self.e)), count)
        place = np.tile(np.arange(count), len(self.e))

        def spread(owner: np.ndarray) -> np.ndarray:
            return (owner[:, None] * count + np.arange(count)).ravel()

        return _Cells(
            self.polygon[cells], self.e[cells] - STEP, self.ix[cells] * fan + place % fan, self.iy[cells] * fan + place // fan,
            self.base[cells], spread(self.pair_cell), np.repeat(self.pair_edge, count), spread(self.flip_cell), np.repeat(self.flip_y, count),
        )


def _first_cells(edges: np.ndarray, owner: np.ndarray) -> tuple[_Cells, np.ndarray]:
    """Return the cells of about the size of each polygon, and the boxes of the polygons."""
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    boxes = np.column_stack([
        np.minimum.reduceat(xs.min(axis=1), begins), np.minimum.reduceat(ys.min(axis=1), begins),
        np.maximum.reduceat(xs.max(axis=1), begins), np.maximum.reduceat(ys.max(axis=1), begins),
    ])
    e = level_of(np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]), np.abs(boxes).max(axis=1))
    side = np.ldexp(1.0, e)
    low, high = np.floor(boxes[:, :2] / side[:, None]).astype(np.int64), np.floor(boxes[:, 2:] / side[:, None]).astype(np.int64)
    wide = high - low + 1
    counts = wide[:, 0] * wide[:, 1]
    polygon = np.repeat(np.arange(len(e)), counts)
    place = _ranks(polygon)
    ix, iy = low[polygon, 0] + place % wide[polygon, 0], low[polygon, 1] + place // wide[polygon, 0]
    # All edges of a polygon go with each of its cells.
    sizes = np.diff(np.append(begins, len(edges)))
    pair_cell = np.repeat(np.arange(len(polygon)), sizes[polygon])
    pair_edge = begins[polygon[pair_cell]] + _ranks(pair_cell)
    none = np.zeros(0, np.int64)
    return _Cells(polygon, e[polygon], ix, iy, np.zeros(len(polygon), bool), pair_cell, pair_edge, none, np.zeros(0)), boxes


def _bodies(cells: _Cells, edges: np.ndarray) -> pa.Array:
    """Return each cell's start count, flips and edges as doubles in one value."""
    count = len(cells.e)
    flips, near = np.bincount(cells.flip_cell, minlength=count), np.bincount(cells.pair_cell, minlength=count)
    sizes = 2 + flips + 4 * near
    begins = np.concatenate([[0], np.cumsum(sizes)])
    values = np.empty(begins[-1])
    values[begins[:-1]], values[begins[:-1] + 1] = cells.base, flips
    values[begins[cells.flip_cell] + 2 + _ranks(cells.flip_cell)] = cells.flip_y
    at = begins[cells.pair_cell] + 2 + flips[cells.pair_cell] + 4 * _ranks(cells.pair_cell)
    values[at[:, None] + np.arange(4)] = edges[cells.pair_edge]
    buffers = [None, pa.py_buffer((begins * 8).astype(np.int64)), pa.py_buffer(values)]
    return pa.Array.from_buffers(pa.large_binary(), count, buffers).cast(pa.binary())


def cut(areas: pa.Array) -> Iterator[pa.RecordBatch]:
    """Cut WKB polygons into pieces; the columns are those of ``PIECE_FIELDS``.

    ``inside`` marks a cell that lies in a polygon as a whole; it has no
    body. The box of a piece is the part of its cell that its polygon can
    reach.
    """
    flat = shapes.decode(areas)
    ringed = flat.rows_only(np.ones(flat.rows, bool))
    part = ringed.part_of
    linked = (part[1:] == part[:-1]) & (ringed.part_kind[part[1:]] == shapes.RING)
    first = np.flatnonzero(linked)
    edges = np.column_stack([ringed.x[first], ringed.y[first], ringed.x[first + 1], ringed.y[first + 1]])
    owner = ringed.part_polygon[part[first]]
    # Rings that do not end where they begin are closed.
    starts, ends = ringed.part_start[:-1], ringed.part_start[1:] - 1
    open_ = (ringed.part_kind == shapes.RING) & (ends > starts)
    a, b = starts[open_], ends[open_]
    gap = (ringed.x[a] != ringed.x[b]) | (ringed.y[a] != ringed.y[b])
    closing = np.column_stack([ringed.x[b], ringed.y[b], ringed.x[a], ringed.y[a]])[gap]
    edges, owner = np.vstack([edges, closing]), np.concatenate([owner, ringed.part_polygon[open_][gap]])
    if not len(edges):
        return
    order = np.argsort(owner, kind="stable")
    edges, owner = edges[order], owner[order]
    cells, boxes = _first_cells(edges, owner)
    held = np.diff(np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner)))
    for turn in range(SPLITS + 1):
        cells = cells.sorted_out(edges)
        near = np.bincount(cells.pair_cell, minlength=len(cells.e))
        whole = (near == 0) & cells.base
        full = np.bincount(cells.polygon, near, minlength=len(held)) > COPIES * held
        settled = (near > 0) & ((near <= FEW_EDGES) | full[cells.polygon] | (turn == SPLITS))
        for chosen in (whole, settled):
            if chosen.any():
                yield _batch(cells.only(chosen), boxes, edges, chosen is whole)
        cells = cells.only((near > 0) & ~settled)
        if not len(cells.e):
            return
        cells = cells.children()


def _batch(cells: _Cells, boxes: np.ndarray, edges: np.ndarray, inside: bool) -> pa.RecordBatch:
    side = np.ldexp(1.0, cells.e)
    own = boxes[cells.polygon]
    box = [
        np.maximum(cells.ix * side, own[:, 0]), np.maximum(cells.iy * side, own[:, 1]),
        np.minimum((cells.ix + 1) * side, own[:, 2]), np.minimum((cells.iy + 1) * side, own[:, 3]),
    ]
    count = len(side)
    body = pa.nulls(count, pa.binary()) if inside else _bodies(cells, edges)
    columns = [
        pa.array(cells.e.astype(np.int32)), pa.array(cells.ix), pa.array(cells.iy), pa.array(np.full(count, inside)),
        *(pa.array(values) for values in box), body,
    ]
    return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in PIECE_FIELDS.split(", ")])


class Bodies:
    """The bodies of a batch, read once per distinct value: edges and flips as flat arrays."""

    def __init__(self, column: pa.Array) -> None:
        codes = column.dictionary_encode()
        self.of_row = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = [np.frombuffer(value, float) for value in codes.dictionary.to_pylist()]
        flips = np.array([int(value[1]) for value in values], np.int64)
        self.base = np.array([value[0] for value in values]) > 0
        self.flip_start = np.concatenate([[0], np.cumsum(flips)]).astype(np.int64)
        self.edge_start = np.concatenate([[0], np.cumsum([(len(v) - 2 - n) // 4 for v, n in zip(values, flips, strict=True)])]).astype(np.int64)
        empty = np.zeros(0)
        self.flips = np.concatenate([empty, *(value[2 : 2 + n] for value, n in zip(values, flips, strict=True))])
        self.edges = np.concatenate([empty, *(value[2 + n :] for value, n in zip(values, flips, strict=True))]).reshape(-1, 4)


def _pairs(of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return items by the items of their list: ``(place in of, place in the lists)``."""
    counts = starts[of + 1] - starts[of]
    item = np.repeat(np.arange(len(of)), counts)
    return item, starts[of[item]] + _ranks(item)


def points_in_pieces(x: np.ndarray, y: np.ndarray, body: np.ndarray, bodies: Bodies) -> np.ndarray:
    """Return which points, each in the cell of its body, lie in the polygon or on its boundary."""
    hit = np.zeros(len(x), bool)
    sizes = bodies.edge_start[body + 1] - bodies.edge_start[body] + bodies.flip_start[body + 1] - bodies.flip_start[body] + 1
    step = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + PAIRS, PAIRS))
    for begin, end in zip(step[:-1], np.maximum(step[1:], step[:-1] + 1), strict=True):
        own = slice(int(begin), min(int(end), len(x)))
        px, py, of = x[own], y[own], body[own]
        point, at = _pairs(of, bodies.flip_start)
        odd = bodies.base[of] ^ (np.bincount(point[bodies.flips[at] <= py[point]], minlength=len(px)) % 2 == 1)
        point, at = _pairs(of, bodies.edge_start)
        a, b, c, d = bodies.edges[at].T
        p, q = px[point], py[point]
        level = (np.minimum(b, d) <= q) & (q <= np.maximum(b, d)) & (np.minimum(a, c) <= p)
        point, a, b, c, d, p, q = (values[level] for values in (point, a, b, c, d, p, q))
        turn = shapes.orientation(a, b, c, d, p, q)
        # Edges left of the point: it lies right of rising and left of falling ones.
        crossed = ((b <= q) & (q < d) & (turn < 0)) | ((d <= q) & (q < b) & (turn > 0))
        odd ^= np.bincount(point[crossed], minlength=len(px)) % 2 == 1
        odd[point[(turn == 0) & (np.maximum(a, c) >= p)]] = True
        hit[own] = odd
    return hit


def shapes_meet_pieces(
    wkb: pa.Array, e: np.ndarray, ix: np.ndarray, iy: np.ndarray, column: pa.Array
) -> np.ndarray:
    """Return which shapes touch the part of a polygon in the cell of their row; a null body is a cell inside."""
    bodies = Bodies(column)
    return _shapes_meet(wkb, e, ix, iy, bodies.of_row, bodies)


def _shapes_meet(
    wkb: pa.Array, e: np.ndarray, ix: np.ndarray, iy: np.ndarray, of_row: np.ndarray, bodies: Bodies
) -> np.ndarray:
    flat = shapes.decode(wkb)
    hit = np.zeros(flat.rows, bool)
    side = np.ldexp(1.0, e)
    left, bottom = ix * side, iy * side
    row = np.repeat(flat.part_row, np.diff(flat.part_start))
    within = (flat.x >= left[row]) & (flat.x <= (left + side)[row]) & (flat.y >= bottom[row]) & (flat.y <= (bottom + side)[row])
    whole = of_row < 0
    hit[row[within & whole[row]]] = True
    tried = within & ~whole[row]
    found = points_in_pieces(flat.x[tried], flat.y[tried], of_row[row[tried]], bodies)
    hit[row[tried][found]] = True

    undecided = ~hit & ~whole
    undecided &= np.isin(np.arange(flat.rows), flat.part_row[flat.part_kind != shapes.POINT])
    if not undecided.any():
        return hit
    flat = flat.rows_only(undecided)
    segments, part, polygon = shapes.segments_of(flat)
    row = flat.part_row[part]
    hit |= _crossing(segments, row, of_row[row], bodies, flat.rows)
    # A shape around the piece has any point of its edges inside.
    around = (polygon >= 0) & ~hit[row]
    if around.any():
        segments, row, polygon = segments[around], row[around], polygon[around]
        corner = bodies.edges[bodies.edge_start[of_row[row]], :2]
        b, d = segments[:, 1], segments[:, 3]
        q = corner[:, 1]
        turn = shapes.orientation(*segments.T, corner[:, 0], q)
        crossed = ((b <= q) & (q < d) & (turn < 0)) | ((d <= q) & (q < b) & (turn > 0))
        names, dense = np.unique(polygon, return_inverse=True)
        owner = np.zeros(len(names), np.int64)
        owner[dense] = row
        hit[owner[np.bincount(dense[crossed], minlength=len(names)) % 2 == 1]] = True
    return hit


def _crossing(segments: np.ndarray, row: np.ndarray, of: np.ndarray, bodies: Bodies, rows: int) -> np.ndarray:
    """Return the rows of which a segment meets an edge of their piece."""
    hit = np.zeros(rows, bool)
    sizes = bodies.edge_start[of + 1] - bodies.edge_start[of]
    step = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + PAIRS, PAIRS))
    for begin, end in zip(step[:-1], np.maximum(step[1:], step[:-1] + 1), strict=True):
        own = segments[int(begin) : int(end)]
        segment, at = _pairs(of[int(begin) : int(end)], bodies.edge_start)
        one, two = own[segment], bodies.edges[at]
        near = np.ones(len(one), bool)
        for low, high in ((0, 2), (1, 3)):
            near &= np.minimum(one[:, low], one[:, high]) <= np.maximum(two[:, low], two[:, high])
            near &= np.maximum(one[:, low], one[:, high]) >= np.minimum(two[:, low], two[:, high])
        segment, one, two = segment[near], one[near], two[near]
        p, q, r, t = one.T
        a, b, c, d = two.T
        across = (shapes.orientation(a, b, c, d, p, q) * shapes.orientation(a, b, c, d, r, t) <= 0) & (
            shapes.orientation(p, q, r, t, a, b) * shapes.orientation(p, q, r, t, c, d) <= 0
        )
        hit[row[int(begin) : int(end)][segment[across]]] = True
    return hit


class _Grid:
    """Places of pieces by cells of one size."""

    def __init__(self, ix: np.ndarray, iy: np.ndarray, piece: np.ndarray) -> None:
        self.columns, column = np.unique(ix, return_inverse=True)
        self.lines, line = np.unique(iy, return_inverse=True)
        code = column * len(self.lines) + line
        order = np.argsort(code, kind="stable")
        self.piece = piece[order]
        self.cells, first = np.unique(code[order], return_index=True)
        self.start = np.append(first, len(order))

    def spans(self, ix: np.ndarray, iy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return where the pieces of each cell begin and end in ``piece``."""
        column = np.minimum(np.searchsorted(self.columns, ix), len(self.columns) - 1)
        line = np.minimum(np.searchsorted(self.lines, iy), len(self.lines) - 1)
        code = column * len(self.lines) + line
        at = np.minimum(np.searchsorted(self.cells, code), len(self.cells) - 1)
        known = (self.columns[column] == ix) & (self.lines[line] == iy) & (self.cells[at] == code)
        return np.where(known, self.start[at], 0), np.where(known, self.start[at + 1], 0)


class Layer:
    """Pieces of a layer, or of a part of it, in memory: tells which shapes touch any of them.

    Only some pairs of shapes and pieces exist at a time, and a shape that
    touched a piece is tried with no other one.
    """

    def __init__(self, table: pa.Table) -> None:
        body = table.column("body").cast(pa.large_binary()).combine_chunks()
        self.e, self.ix, self.iy, self.inside = (table.column(name).to_numpy() for name in ("e", "ix", "iy", "inside"))
        self.box = [table.column(name).to_numpy() for name in ("px0", "py0", "px1", "py1")]
        self.bodies = Bodies(body)
        self.levels = np.unique(self.e)
        self.reach = [edge(side) for edge, side in zip((np.min, np.min, np.max, np.max), self.box, strict=True)]
        self.grids: dict[tuple[int, bool], _Grid] = {}

    def _grid(self, level: int, below: bool) -> _Grid:
        """Return the pieces of a level by cell, or the smaller ones by the cells of that level that they lie in."""
        if (level, below) not in self.grids:
            piece = np.flatnonzero(self.e < level if below else self.e == level)
            shift = np.minimum(level - self.e[piece], 63).astype(np.int64)
            self.grids[level, below] = _Grid(self.ix[piece] >> shift, self.iy[piece] >> shift, piece)
        return self.grids[level, below]

    def touched(self, boxes: list[np.ndarray], wkb: pa.Array) -> np.ndarray:
        """Return which shapes touch a piece, given the sides of all boxes and the WKB of those that are not points."""
        hit = np.zeros(len(wkb), bool)
        cut = [np.fmax(boxes[0], self.reach[0]), np.fmax(boxes[1], self.reach[1]), np.fmin(boxes[2], self.reach[2]), np.fmin(boxes[3], self.reach[3])]
        rows = np.flatnonzero((cut[0] <= cut[2]) & (cut[1] <= cut[3]))
        if not len(rows):
            return hit
        wkb = wkb.cast(pa.large_binary())
        extent = np.maximum(cut[2] - cut[0], cut[3] - cut[1])[rows]
        own = np.maximum(level_of(extent, np.zeros(len(rows))), self.levels[0])
        looks = [(int(level), False, rows[own <= level]) for level in self.levels]
        looks += [(int(level), True, rows[own == level]) for level in np.unique(own) if level > self.levels[0]]
        for level, below, asked in looks:
            if not len(asked):
                continue
            grid = self._grid(level, below)
            left, bottom, right, top = (
                np.clip(np.floor(side[asked] / 2.0**level), -(2.0**62), 2.0**62).astype(np.int64) for side in cut
            )
            for across in range(int((right - left).max()) + 1):
                for up in range(int((top - bottom).max()) + 1):
                    ix, iy = left + across, bottom + up
                    own_cell = (ix <= right) & (iy <= top) & ~hit[asked]
                    begin, end = grid.spans(ix[own_cell], iy[own_cell])
                    self._try(grid, asked[own_cell], begin, end, boxes, cut, wkb, hit)
        return hit

    def _try(self, grid, rows, begin, end, boxes, cut, wkb, hit) -> None:
        """Mark the rows that touch a piece of their span; some pieces of each come first."""
        tries = FIRST_TRIES
        while True:
            left = (begin < end) & ~hit[rows]
            rows, begin, end = rows[left], begin[left], end[left]
            if not len(rows):
                return
            take = np.minimum(end - begin, tries)
            step = max(1, TRIES // tries)
            for first in range(0, len(rows), step):
                own = slice(first, first + step)
                row = np.repeat(rows[own], take[own])
                begins = np.concatenate([[0], np.cumsum(take[own])[:-1]])
                piece = grid.piece[np.arange(len(row)) + np.repeat(begin[own] - begins, take[own])]
                self._test(row, piece, boxes, cut, wkb, hit)
            begin = begin + take
            tries = min(tries * 4, TRIES)

    def _test(self, row, piece, boxes, cut, wkb, hit) -> None:
        """Mark the rows that touch their piece: by boxes, as points, and at last by their geometry."""
        for low, high in ((0, 2), (1, 3)):
            near = (cut[low][row] <= self.box[high][piece]) & (cut[high][row] >= self.box[low][piece])
            row, piece = row[near], piece[near]
        inside = self.inside[piece]
        one, of = row[inside], piece[inside]
        held = (boxes[0][one] >= self.box[0][of]) & (boxes[1][one] >= self.box[1][of]) & (boxes[2][one] <= self.box[2][of]) & (boxes[3][one] <= self.box[3][of])
        hit[one[held]] = True
        point = (boxes[0][row] == boxes[2][row]) & (boxes[1][row] == boxes[3][row])
        tried = point & ~inside & ~hit[row]
        if tried.any():
            one = row[tried]
            found = points_in_pieces(boxes[0][one], boxes[1][one], self.bodies.of_row[piece[tried]], self.bodies)
            hit[one[found]] = True
        tried = ~point & ~hit[row]
        row, piece = row[tried], piece[tried]
        if not len(row):
            return
        sizes = np.cumsum(np.diff(np.frombuffer(wkb.buffers()[1], np.int64, len(wkb) + 1, wkb.offset * 8))[row])
        bounds = np.unique(np.concatenate([np.searchsorted(sizes, np.arange(SHAPE_BYTES, sizes[-1], SHAPE_BYTES)) + 1, [0, len(row)]]))
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            own, of = row[first:last], piece[first:last]
            # A shape that touched a piece of an earlier part is settled.
            own, of = own[~hit[own]], of[~hit[own]]
            if len(own):
                met = _shapes_meet(wkb.take(pa.array(own)), self.e[of], self.ix[of], self.iy[of], self.bodies.of_row[of], self.bodies)
                hit[own[met]] = True
