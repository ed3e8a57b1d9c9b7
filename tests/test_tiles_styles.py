"""Tile ids, archives, lookups, styles and usage marks."""

import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from geoquarry.functions.tile_ids import tile_id
from geoquarry.operators import styles, tiles, usage
from geoquarry.session import ensure_checkpoints
from geoquarry.sources import tile_archives as arc


def hilbert(z, x, y):
    """The textbook curve: quadrant by quadrant, from the largest down."""
    total = sum(4**k for k in range(z))
    side = 2**z // 2
    while side:
        rx, ry = int(bool(x & side)), int(bool(y & side))
        total += side * side * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = 2**z - 1 - x, 2**z - 1 - y
            x, y = y, x
        side //= 2
    return total


def test_tile_ids(spark):
    cells = [(z, x, y) for z in range(5) for x in range(2**z) for y in range(2**z)] + [(14, 8529, 5975), (31, 2**31 - 1, 0), (20, 7, 1048575)]
    rows = spark.createDataFrame(cells + [(2, 4, 0), (32, 0, 0), (3, -1, 0)], "z int, x bigint, y bigint")
    got = [r[0] for r in rows.select(tile_id(F.col("z"), F.col("x"), F.col("y"))).collect()]
    assert got[: len(cells)] == [hilbert(*c) for c in cells]
    assert got[len(cells):] == [None] * 3
    assert sorted(got[: 341]) == list(range(341))


def varint(value):
    out = b""
    while True:
        byte, value = value & 0x7F, value >> 7
        out += bytes([byte | (0x80 if value else 0)])
        if not value:
            return out


def pack_directory(entries):
    ids = [e[0] - (entries[i - 1][0] if i else 0) for i, e in enumerate(entries)]
    marks = [0 if i and e[2] == entries[i - 1][2] + entries[i - 1][3] else e[2] + 1 for i, e in enumerate(entries)]
    values = [len(entries), *ids, *(e[1] for e in entries), *(e[3] for e in entries), *marks]
    return b"".join(map(varint, values))


def write_archive(path, entries, per_leaf=3, packed=True):
    squeeze = gzip.compress if packed else (lambda data: data)
    leaves, pointers, at = b"", [], 0
    for start in range(0, len(entries), per_leaf):
        leaf = squeeze(pack_directory(entries[start : start + per_leaf]))
        pointers.append((entries[start][0], 0, at, len(leaf)))
        leaves += leaf
        at += len(leaf)
    root = squeeze(pack_directory(pointers))
    meta = squeeze(json.dumps({"vector_layers": [{"id": "roads"}, {"id": "rivers"}]}).encode())
    base = 127
    offsets = [base, len(root), base + len(root), len(meta), base + len(root) + len(meta), len(leaves), base + len(root) + len(meta) + len(leaves), 0, 0, 0, 0]
    head = b"PMTiles\x03" + struct.pack("<11Q", *offsets) + bytes([1, 2 if packed else 1, 2, 1, 0, 3])
    head += struct.pack("<4i", -1800000000, -850000000, 1800000000, 850000000) + bytes(9)
    path.write_bytes(head + root + meta + leaves)


ENTRIES = [(0, 1, 0, 5), (1, 3, 5, 9), (6, 1, 14, 2), (9, 40, 100, 7), (50, 1, 107, 1), (60, 20, 3, 3), (84, 1, 6, 6)]


def test_archives_and_lookup(spark, tmp_path):
    write_archive(tmp_path / "a.pmtiles", ENTRIES)
    write_archive(tmp_path / "b.pmtiles", ENTRIES[:2], packed=False)
    (tmp_path / "c.pmtiles").write_bytes(b"nope")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.pmtiles", "b.pmtiles", "c.pmtiles")], "archive string")
    heads = {r.archive[-9]: r for r in arc.read_headers(paths).collect()}
    assert heads["a"].vector_layers == ["roads", "rivers"] and heads["a"].west == -180.0 and heads["a"].max_zoom == 3
    assert heads["c"].error == "Not a tile archive"
    entries = arc.read_entries(paths.where("archive not like '%c.pmtiles'")).cache()
    got = sorted((r.tile_id, r.run_length, r.offset, r.length) for r in entries.where("archive like '%a.pmtiles'").collect())
    assert got == ENTRIES
    asked = spark.range(90).select(F.lit(str(tmp_path / "a.pmtiles")).alias("archive"), F.col("id"))
    found = {r.id: r.tile_id for r in tiles.locate_ids(asked, entries).collect()}
    assert found == {i: next((e[0] for e in ENTRIES if e[0] <= i < e[0] + e[1]), None) for i in range(90)}
    cells = spark.createDataFrame([(str(tmp_path / "a.pmtiles"), 0, 0, 0)] * 3 + [(str(tmp_path / "a.pmtiles"), 4, 0, 0)], "archive string, z int, x bigint, y bigint")
    rows = {r.z: (r.requests, r.tile_id) for r in tiles.locate_tiles(cells, entries, arc.read_headers(paths)).collect()}
    assert rows == {0: (3, 0), 4: (1, None)}


def test_directories_of_any_depth(spark, tmp_path):
    # Seven levels; the last points to tiles and, wrongly, back to itself.
    levels, at = [], 0
    for depth in range(7):
        rows = [(10 * depth, 1, depth, 1)] + ([(70, 0, at, 9)] if depth == 0 else [(70 - depth, 0, *levels[-1])])
        body = pack_directory(sorted(rows))
        levels.append((at, len(body)))
        at += len(body)
        levels_body = body if depth == 0 else levels_body + body
    root = pack_directory([(0, 0, *levels[-1])])
    base = 127
    offsets = [base, len(root), base + len(root), 0, base + len(root), len(levels_body), base + len(root) + at, 0, 0, 0, 0]
    head = b"PMTiles\x03" + struct.pack("<11Q", *offsets) + bytes([1, 1, 1, 1, 0, 3]) + struct.pack("<4i", 0, 0, 0, 0) + bytes(9)
    (tmp_path / "deep.pmtiles").write_bytes(head + root + levels_body)
    found = arc.read_entries(spark.createDataFrame([(str(tmp_path / "deep.pmtiles"),)], "archive string")).collect()
    assert sorted(row.tile_id for row in found) == [0, 10, 20, 30, 40, 50, 60]


def test_running_offsets(spark):
    rows = spark.createDataFrame([("a", 0, i, d, 1, m, n) for i, (d, m, n) in enumerate([(3, 1, 5), (1, 0, 9), (4, 101, 2), (1, 0, 4)])], "archive string, directory int, pos int, id_delta bigint, run_length bigint, mark bigint, length bigint")
    got = [(r.tile_id, r.offset) for r in arc.running_offsets(rows).orderBy("pos").collect()]
    assert got == [(3, 0), (4, 5), (8, 100), (9, 102)]


STYLE = {
    "version": 8,
    "sources": {
        "own": {"type": "vector", "url": "pmtiles://./a.pmtiles"}, "other": {"type": "raster", "url": "x.pmtiles"},
        "tiled": {"type": "vector", "tiles": ["pmtiles://https://t.test/b.pmtiles/{z}/{x}/{y}.mvt"]},
        "silent": {"type": "vector"}, "http": {"type": "vector", "url": "https://t.test/tiles.json"},
    },
    "layers": [{"id": "bg", "type": "background"}, {"id": "l1", "type": "fill", "source": "own"}, {"id": "l2", "source": "tiled"}, {"id": "l3", "source": "http"}, {"id": "l4"}, "junk"],
}


def test_styles(spark):
    style = "https://h.test/c/style.json"
    files = spark.createDataFrame([(style, json.dumps(STYLE), "https://h.test/c/only.pmtiles"), ("bad", '{"version": 7}', None)], "style string, body string, fallback string")
    parsed = styles.parse_styles(files)
    assert parsed.where("error is not null").count() == 1
    styled = styles.with_sources(parsed)
    sources = [(r.source, r.archive) for r in styles.sources_of(styled).orderBy("pos").collect()]
    assert sources == [("own", "https://h.test/c/a.pmtiles"), ("tiled", "https://t.test/b.pmtiles"), ("silent", "https://h.test/c/only.pmtiles")]
    layers = [(r.layer, r.archive and r.archive[-9]) for r in styles.split_layers(styled).orderBy("pos").collect()]
    assert layers == [("bg", "a"), ("l1", "a"), ("l2", "b"), ("l3", None), ("l4", None)]
    archives = spark.createDataFrame([("d", "https://h.test/c/a.pmtiles"), ("d", "https://m.test/b.pmtiles"), ("d", "https://m.test/1/z.pmtiles"), ("d", "https://m.test/2/z.pmtiles")], "url string, href string")
    named = spark.createDataFrame([("d", a) for _, a in sources[:2]] + [("d", "https://q.test/z.pmtiles")], "url string, archive string")
    got = {r.archive: r.href for r in styles.match_archives(named, archives).collect()}
    assert got == {"https://h.test/c/a.pmtiles": "https://h.test/c/a.pmtiles", "https://t.test/b.pmtiles": "https://m.test/b.pmtiles", "https://q.test/z.pmtiles": None}
    assert {r.archive for r in styles.stray_archives(named, archives).collect()} == {"https://t.test/b.pmtiles", "https://q.test/z.pmtiles"}


def test_unique_names(spark):
    ensure_checkpoints(spark)
    names = ["a", "a (2)", "a", "Default", "b", "a", "b"]
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate(names)], "doc string, pos int, name string")
    got = [r.unique_name for r in styles.unique_names(rows, ["doc"], "name", "pos", "Default").orderBy("pos").collect()]
    assert got == ["a", "a (2)", "a (3)", "Default (2)", "b", "a (4)", "b (2)"]


def one_by_one(names, reserved):
    """Name rows in order: the own name if free, else the smallest free number."""
    taken = {reserved} - {None}
    found = []
    for name in names:
        shown, number = name, 1
        while shown in taken:
            number += 1
            shown = f"{name} ({number})"
        taken.add(shown)
        found.append(shown)
    return found


@pytest.mark.parametrize("reserved", [None, "a", "b (2)"])
def test_unique_names_as_one_by_one(spark, reserved):
    ensure_checkpoints(spark)
    rng = random.Random(6)
    pool = ["a", "a (2)", "a (3)", "a (5)", "a (2) (2)", "a (3) (2)", "a (2) (2) (2)", "b", "b (2)", "b (02)", "b (1)", "b (4)", "", " (2)", "a\n(2)", "a (12)"]
    groups = {f"g{number}": [rng.choice(pool[: rng.choice([2, 5, 16])]) for _ in range(rng.choice([3, 12, 40]))] for number in range(25)}
    groups["hot"] = ["a (2)"] + ["a"] * 12
    groups["late"] = ["a"] * 12 + ["a (5)", "a (14)", "a", "a", "a", "a (14)"]
    rows = [(group, 3 * at, name) for group, names in groups.items() for at, name in enumerate(names)]
    frame = spark.createDataFrame(rows, "doc string, pos int, name string")
    got = {(row.doc, row.pos): row.unique_name for row in styles.unique_names(frame, ["doc"], "name", "pos", reserved).collect()}
    want = {(group, 3 * at): name for group, names in groups.items() for at, name in enumerate(one_by_one(names, reserved))}
    assert got == want


def test_jobs_of_unique_names_do_not_depend_on_clashes(spark):
    ensure_checkpoints(spark)
    tracker, counts = spark.sparkContext.statusTracker(), []
    for repeats in (3, 60):
        names = ["a (2)", "a (7)"] + ["a"] * repeats
        frame = spark.createDataFrame([("d", at, name) for at, name in enumerate(names)], "doc string, pos int, name string")
        spark.sparkContext.setJobGroup(f"names-{repeats}", "names")
        assert len({row.unique_name for row in styles.unique_names(frame, ["doc"], "name", "pos").collect()}) == len(names)
        counts.append(len(tracker.getJobIdsForGroup(f"names-{repeats}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(counts[0] - counts[1]) <= 2


def test_usage(spark):
    href = "https://h.test/a b/x.parquet?k=1"
    files = spark.createDataFrame([(href, None), ("https://h.test/y", None), ("https://h.test/z", "s3://b/z"), ("https://h.test/n", None)], "href string, read_url string")
    urls = spark.createDataFrame([("s3://b/z",)], "url string")
    quoted = "https%3A%2F%2Fh.test%2Fa%20b%2Fx.parquet%3Fk%3D1"
    sources = spark.createDataFrame([(f"/vsicurl?empty_dir=yes&url={quoted}|layer=1",), ("CSV:/vsicurl/https://h.test/y?more",), ("plain",)], "source string")
    used = {r.href for r in usage.mark_used(files, urls, sources).where("used").collect()}
    assert used == {href, "https://h.test/y", "https://h.test/z"}
