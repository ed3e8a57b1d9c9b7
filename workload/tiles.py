"""Tile archives, tile lookups, and the spatial semi join."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.functions import wkb
from geoquarry.functions.tile_ids import tile_id
from geoquarry.operators import spatial, tiles
from geoquarry.session import scratch_path
from geoquarry.sources import tile_archives
from workload.base import PLACES_SQL, covering, flag, place_columns, place_rows, query, shape_rows, table

# ---- directory entries: one per order, 0..3 unused ids after each run

ENTRY_SQL = """entry AS (SELECT o_orderkey % 7 AS archive, CAST((o_orderkey // 7) * 40 AS BIGINT) AS tile_id, CASE WHEN o_orderkey % 5 = 0 THEN 36 ELSE 1 + o_orderkey % 3 END AS run_length, o_orderkey * 100 AS offset, 10 + o_orderkey % 50 AS length FROM orders)"""


def entry_rows(spark, folder) -> DataFrame:
    """Return orders as the runs of seven archives."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        (key % 7).alias("archive"), (F.floor(key / 7) * 40).cast("bigint").alias("tile_id"),
        F.when(key % 5 == 0, 36).otherwise(1 + key % 3).cast("bigint").alias("run_length"), (key * 100).alias("offset"), (10 + key % 50).cast("bigint").alias("length"))


@query("j10_interval_lookup", f"""WITH {ENTRY_SQL}, asked AS (SELECT DISTINCT l_orderkey % 9 AS archive, CAST((l_orderkey // 7) * 40 + l_partkey % 40 AS BIGINT) AS id FROM lineitem)
SELECT a.archive, a.id, e.tile_id, e.offset, e.length FROM asked a LEFT JOIN entry e ON e.archive = a.archive AND e.tile_id = a.id - a.id % 40 AND a.id < e.tile_id + e.run_length""")
def j10_interval_lookup(spark, folder):
    asked = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 9).alias("archive"), (F.floor(F.col("l_orderkey") / 7) * 40 + F.col("l_partkey") % 40).cast("bigint").alias("id"))
    return tiles.locate_ids(asked, entry_rows(spark, folder)).select("archive", "id", "tile_id", "offset", "length")


@query("j10_tile_requests", f"""WITH {ENTRY_SQL}, asked AS (SELECT l_orderkey % 7 AS archive, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS z, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 2 ELSE 0 END AS x, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 2 ELSE 0 END AS y FROM lineitem),
keyed AS (SELECT *, CASE WHEN z = 0 THEN 0 WHEN archive = 6 THEN NULL WHEN x = 0 AND y = 0 THEN 1 WHEN x = 0 THEN 2 WHEN y = 1 THEN 3 ELSE 4 END AS id, count(*) AS requests FROM asked GROUP BY ALL)
SELECT k.archive, CAST(z AS BIGINT) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, requests, e.tile_id FROM keyed k LEFT JOIN entry e ON e.archive = k.archive AND k.id >= e.tile_id AND k.id < e.tile_id + e.run_length""")
def j10_tile_requests(spark, folder):
    part, deep = F.col("l_partkey"), F.col("l_partkey") % 3 == 0
    asked = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 7).alias("archive"), F.when(deep, 1).otherwise(0).alias("z"), F.when(deep, part % 2).otherwise(0).alias("x"), F.when(deep, F.col("l_suppkey") % 2).otherwise(0).alias("y"))
    headers = table(spark, folder, "orders").select((F.col("o_orderkey") % 7).alias("archive")).distinct().select("archive", F.lit(0).alias("min_zoom"), F.when(F.col("archive") == 6, 0).otherwise(5).alias("max_zoom"))
    found = tiles.locate_tiles(asked, entry_rows(spark, folder), headers)
    return found.select("archive", F.col("z").cast("bigint").alias("z"), "x", "y", "requests", "tile_id")


def _hilbert_sql() -> str:
    """Return the id of (z, x, y) as nested selects, one level of the curve per step, zooms 0 to 5."""
    step = "SELECT k, z, 0 AS id, x, y FROM cell"
    for level in range(4, -1, -1):
        size = 1 << level
        step = f"""SELECT k, z, CASE WHEN z > {level} THEN id + ((3 * rx) # ry) * {size * size} ELSE id END AS id,
          CASE WHEN z > {level} AND ry = 0 THEN CASE WHEN rx = 1 THEN {size - 1} - y ELSE y END ELSE x END AS x,
          CASE WHEN z > {level} AND ry = 0 THEN CASE WHEN rx = 1 THEN {size - 1} - x ELSE x END ELSE y END AS y
          FROM (SELECT *, CASE WHEN x & {size} <> 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {size} <> 0 THEN 1 ELSE 0 END AS ry FROM ({step}))"""
    return step.replace(" # ", " ^ ")


@query("h20_tile_ids", f"""WITH cell AS (SELECT o_orderkey AS k, CAST(o_orderkey % 6 AS BIGINT) AS z, o_orderkey * 7 % CAST(pow(2, o_orderkey % 6) AS BIGINT) AS x, o_orderkey * 11 // 6 % CAST(pow(2, o_orderkey % 6) AS BIGINT) AS y FROM orders)
SELECT k, CAST((CAST(pow(4, z) AS BIGINT) - 1) // 3 + id AS BIGINT) AS id FROM ({_hilbert_sql().replace("((3 * rx) ^ ry)", "xor(3 * rx, ry)")})""")
def h20_tile_ids(spark, folder):
    key = F.col("o_orderkey")
    z = (key % 6).cast("int")
    side = F.call_function("shiftleft", F.lit(1).cast("bigint"), z)
    return table(spark, folder, "orders").select(key.alias("k"), tile_id(z, key * 7 % side, F.floor(key * 11 / 6) % side).alias("id"))


# ---- archives written from the entries, then read back


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    previous = [(0, 0, 0, 0), *entries[:-1]]
    ids = [entry[0] - before[0] for entry, before in zip(entries, previous, strict=True)]
    marks = [0 if at and entry[2] == before[2] + before[3] else entry[2] + 1 for at, (entry, before) in enumerate(zip(entries, previous, strict=True))]
    columns = [ids, [entry[1] for entry in entries], [entry[3] for entry in entries], marks]
    return b"".join(map(_number, [len(entries), *(value for column in columns for value in column)]))


def _archive(entries: list[tuple[int, int, int, int]]) -> bytes:
    leaves, pointers = b"", []
    for start in range(0, len(entries), 64):
        leaf = _directory(entries[start : start + 64])
        pointers.append((entries[start][0], 0, len(leaves), len(leaf)))
        leaves += leaf
    root, meta = _directory(pointers), json.dumps({"vector_layers": [{"id": "orders"}]}).encode()
    at = 127 + len(root)
    offsets = (127, len(root), at, len(meta), at + len(meta), len(leaves), at + len(meta) + len(leaves), 0, 0, 0, 0)
    head = b"PMTiles\x03" + struct.pack("<11Q", *offsets) + bytes([1, 1, 2, 1, 0, 5]) + struct.pack("<4i", -1800000000, -850000000, 1800000000, 850000000)
    return head + bytes(127 - len(head)) + root + meta + leaves


def write_archives(spark, folder) -> DataFrame:
    """Write blocks of at most 1000 entries as archives in the shared folder and return their paths."""
    target = scratch_path(spark, "archives")
    blocks = entry_rows(spark, folder).select(
        F.concat_ws("-", "archive", F.floor(F.col("tile_id") / 40000)).alias("name"), F.struct("tile_id", "run_length", "offset", "length").alias("entry"))
    grouped = blocks.groupBy("name").agg(F.array_sort(F.collect_list("entry")).alias("entries"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            # One archive's entries are Python objects at a time, not those of a whole batch.
            for at in range(batch.num_rows):
                name, entries = (column[at].as_py() for column in batch.columns)
                with store.open_output_stream(f"{root}/{name}.pmtiles") as out:
                    out.write(_archive([tuple(entry.values()) for entry in entries]))
                paths.append(f"{target}/{name}.pmtiles")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["archive"])

    # A written table of paths, so that reading never writes again.
    listed = scratch_path(spark, "archive-paths")
    grouped.mapInArrow(write, "archive string").write.parquet(listed)
    return spark.read.parquet(listed)


@query("s12_archive_entries", f'''WITH {ENTRY_SQL} SELECT archive, tile_id, CAST(run_length AS BIGINT) AS run_length, entry."offset", length FROM entry''')
def s12_archive_entries(spark, folder):
    entries = tile_archives.read_entries(write_archives(spark, folder))
    number = F.regexp_extract("archive", "/([0-9]+)-[0-9]+\\.pmtiles$", 1).cast("bigint")
    return entries.select(number.alias("archive"), "tile_id", "run_length", "offset", "length")


@query("s12_archive_headers", "SELECT count(DISTINCT o_orderkey % 7 || '-' || (o_orderkey // 7) // 1000) AS archives, 'orders' AS layers, CAST(5 AS BIGINT) AS max_zoom, -180.0::DOUBLE AS west FROM orders")
def s12_archive_headers(spark, folder):
    heads = tile_archives.read_headers(write_archives(spark, folder))
    return heads.agg(F.count("*").alias("archives"), F.max(F.array_join("vector_layers", ",")).alias("layers"), F.max("max_zoom").cast("bigint").alias("max_zoom"), F.min("west").alias("west"))


DELTA_SQL = """d AS (SELECT o_orderkey % 7 AS a, o_orderkey // 7000 AS d, (o_orderkey // 7) % 1000 AS pos, o_custkey AS delta, 1 + o_orderkey % 90 AS length, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE 0 END AS mark FROM orders)"""


@query("w09_directory_deltas", f"""WITH {DELTA_SQL}, g AS (SELECT *, sum(delta) OVER w AS tile_id, sum(length) OVER w - length AS before, sum(CASE WHEN mark > 0 OR pos = 0 THEN 1 ELSE 0 END) OVER w AS stretch
  FROM d WINDOW w AS (PARTITION BY a, d ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT a, d, pos, CAST(tile_id AS BIGINT) AS tile_id, CAST(first_value(mark - 1 - before) OVER (PARTITION BY a, d, stretch ORDER BY pos) + before AS BIGINT) AS start FROM g""")
def w09_directory_deltas(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        (key % 7).alias("archive"), F.floor(key / 7000).alias("directory"), (F.floor(key / 7) % 1000).alias("pos"), F.col("o_custkey").alias("id_delta"),
        F.lit(1).alias("run_length"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(0).alias("mark"), (1 + key % 90).alias("length"))
    return tile_archives.running_offsets(rows).select(F.col("archive").alias("a"), F.col("directory").alias("d"), "pos", "tile_id", F.col("offset").alias("start"))


# ---- features that touch any polygon of a layer: triangles with a right angle

NATION_AREAS = """area AS (SELECT CAST(n_nationkey * 14 - 175 AS DOUBLE) AS ax, CAST((n_nationkey * 29) % 120 - 70 AS DOUBLE) AS ay, 12.0 AS aw, 18.0 AS ah FROM nation)"""
SUPPLIER_AREAS = """area AS (SELECT CAST((s_suppkey * 37) % 350 - 178 AS DOUBLE) AS ax, CAST((s_suppkey * 53) % 160 - 82 AS DOUBLE) AS ay, 1.0 + s_suppkey % 3 AS aw, 1.5 + s_suppkey % 4 AS ah FROM supplier)"""
IN_TRIANGLE = "x >= ax AND y >= ay AND (x - ax) * ah + (y - ay) * aw <= aw * ah"


def triangles(rows: DataFrame) -> DataFrame:
    """Return triangles of ``ax, ay, aw, ah`` as WKB polygons."""
    x, y, w, h = (F.col(name).cast("double") for name in ("ax", "ay", "aw", "ah"))
    xy = [F.substring(wkb.point_wkb(a, b), 6, 16) for a, b in ((x, y), (x + w, y), (x, y + h), (x, y))]
    head = F.unhex(F.lit("01030000000100000004000000"))
    return rows.select(F.concat(head, *xy).alias("geometry"))


def nation_areas(spark, folder) -> DataFrame:
    """Return one triangle per nation."""
    key = F.col("n_nationkey")
    return triangles(table(spark, folder, "nation").select((key * 14 - 175).alias("ax"), (key * 29 % 120 - 70).alias("ay"), F.lit(12.0).alias("aw"), F.lit(18.0).alias("ah")))


def supplier_areas(spark, folder) -> DataFrame:
    """Return one triangle per supplier; their number grows with the data."""
    key = F.col("s_suppkey")
    return triangles(table(spark, folder, "supplier").select((key * 37 % 350 - 178).alias("ax"), (key * 53 % 160 - 82).alias("ay"), (1.0 + key % 3).alias("aw"), (1.5 + key % 4).alias("ah")))


@query("j09_touching_a_layer", f"WITH {PLACES_SQL}, {NATION_AREAS} SELECT o_orderkey FROM places WHERE EXISTS (SELECT 1 FROM area WHERE {IN_TRIANGLE})")
def j09_touching_a_layer(spark, folder):
    return spatial.touching(place_rows(spark, folder), nation_areas(spark, folder), "o_orderkey").select("o_orderkey")


@query("j09_touching_by_grid_cells", f"WITH {PLACES_SQL}, {SUPPLIER_AREAS} SELECT o_orderkey FROM places WHERE EXISTS (SELECT 1 FROM area WHERE {IN_TRIANGLE})")
def j09_touching_by_grid_cells(spark, folder):
    return spatial.touching(place_rows(spark, folder), supplier_areas(spark, folder), "o_orderkey", carried_bytes=0).select("o_orderkey")


METRES = 111_000.0
METRE_AREAS = """area AS (SELECT ((s_suppkey * 37) % 350 - 178) * 111000.0::DOUBLE AS ax, ((s_suppkey * 53) % 160 - 82) * 111000.0::DOUBLE AS ay,
  (1 + s_suppkey % 3) * 111000.0::DOUBLE AS aw, (1.5 + s_suppkey % 4)::DOUBLE * 111000.0::DOUBLE AS ah FROM supplier)"""


def points(rows: DataFrame) -> DataFrame:
    """Return ``o_orderkey, x, y`` as point features with a covering."""
    return rows.select("o_orderkey", covering("x", "y", "x", "y").alias("bbox"), wkb.point_wkb("x", "y").alias("geometry"))


@query("j09_touching_in_metres", f"""WITH {PLACES_SQL}, {METRE_AREAS} SELECT o_orderkey FROM (SELECT o_orderkey, x * 111000.0::DOUBLE AS x, y * 111000.0::DOUBLE AS y FROM places)
WHERE EXISTS (SELECT 1 FROM area WHERE {IN_TRIANGLE})""")
def j09_touching_in_metres(spark, folder):
    key = F.col("s_suppkey")
    areas = triangles(table(spark, folder, "supplier").select(*((value * METRES).alias(name) for name, value in (
        ("ax", key * 37 % 350 - 178), ("ay", key * 53 % 160 - 82), ("aw", 1.0 + key % 3), ("ah", 1.5 + key % 4)))))
    features = points(place_columns(spark, folder).select("o_orderkey", (F.col("x") * METRES).alias("x"), (F.col("y") * METRES).alias("y")))
    return spatial.touching(features, areas, "o_orderkey", carried_bytes=0).select("o_orderkey")


# All customers are triangles in one degree, all orders points in it.
CROWD_SQL = """area AS (SELECT ((c_custkey * 37) % 997)::DOUBLE / 1024.0 AS ax, ((c_custkey * 53) % 991)::DOUBLE / 1024.0 AS ay,
  (1 + c_custkey % 5)::DOUBLE / 2048.0 AS aw, (1 + c_custkey % 7)::DOUBLE / 2048.0 AS ah FROM customer),
crowd AS (SELECT o_orderkey, ((o_orderkey * 29) % 4093)::DOUBLE / 4096.0 AS x, ((o_orderkey * 31) % 4091)::DOUBLE / 4096.0 AS y FROM orders)"""


@query("j09_crowded_degree", f"WITH {CROWD_SQL} SELECT o_orderkey FROM crowd WHERE EXISTS (SELECT 1 FROM area WHERE {IN_TRIANGLE})")
def j09_crowded_degree(spark, folder):
    one, two = F.col("c_custkey"), F.col("o_orderkey")
    areas = triangles(table(spark, folder, "customer").select(
        (one * 37 % 997 / 1024.0).alias("ax"), (one * 53 % 991 / 1024.0).alias("ay"), ((1 + one % 5) / 2048.0).alias("aw"), ((1 + one % 7) / 2048.0).alias("ah")))
    features = points(table(spark, folder, "orders").select("o_orderkey", (two * 29 % 4093 / 4096.0).alias("x"), (two * 31 % 4091 / 4096.0).alias("y")))
    return spatial.touching(features, areas, "o_orderkey").select("o_orderkey")


@query("j09_shapes_by_both_ways", "SELECT CAST(1 AS BIGINT) AS same, count(*) AS features FROM orders")
def j09_shapes_by_both_ways(spark, folder):
    features, areas = shape_rows(spark, folder), supplier_areas(spark, folder)
    near = spatial.touching(features, areas, "o_orderkey").select("o_orderkey", F.lit(1).alias("near"))
    cells = spatial.touching(features, areas, "o_orderkey", carried_bytes=0).select("o_orderkey", F.lit(1).alias("cells"))
    both = features.select("o_orderkey").join(near.hint("merge"), "o_orderkey", "left").join(cells.hint("merge"), "o_orderkey", "left")
    same = F.bool_and(F.col("near").eqNullSafe(F.col("cells")))
    return both.agg(flag(same).alias("same"), F.count("*").alias("features"))
