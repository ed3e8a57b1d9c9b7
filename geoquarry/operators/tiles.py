"""Find the directory entry of each requested tile: an interval join without long spans.

Entries are runs of ids. A run of length n is filed at the level whose buckets
are at least n ids wide, so it lies in at most two buckets there. A request
looks once per level in use. Both sides meet in an equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.functions.tile_ids import tile_id

# Each level has buckets 16 times as wide as the level below.
LEVEL_BITS = 4


def _filed(entries: DataFrame) -> DataFrame:
    """File each run at its level, in the one or two buckets it touches."""
    # Length in bits of run_length - 1: the exponent that covers the run.
    bits = F.length(F.regexp_replace(F.bin(F.col("run_length") - 1), "^0+", ""))
    level = F.ceil(bits / LEVEL_BITS).cast("int")
    leveled = entries.where("run_length > 0").withColumn("level", level)
    first = F.call_function("shiftright", F.col("tile_id"), F.col("level") * LEVEL_BITS)
    last = F.call_function("shiftright", F.col("tile_id") + F.col("run_length") - 1, F.col("level") * LEVEL_BITS)
    return leveled.withColumn("bucket", F.explode(F.array_distinct(F.array(first, last))))


def locate_ids(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Return the entry of each distinct ``(archive, id)``, NULL where the archive has none.

    Adds ``tile_id, run_length, offset, length``.
    """
    filed = _filed(entries)
    wanted = requests.select("archive", "id").where("id is not null").distinct()
    # At most 17 values, whatever the size of the archives.
    levels = sorted(row.level for row in filed.select("level").distinct().collect())
    if not levels:
        levels = [0]
    looked = wanted.withColumn("level", F.explode(F.array(*(F.lit(level) for level in levels)))).withColumn(
        "bucket", F.call_function("shiftright", F.col("id"), F.col("level") * LEVEL_BITS)
    )
    met = looked.join(filed, ["archive", "level", "bucket"]).where(
        (F.col("id") >= F.col("tile_id")) & (F.col("id") < F.col("tile_id") + F.col("run_length"))
    )
    best = met.groupBy("archive", "id").agg(F.max(F.struct("tile_id", "run_length", "offset", "length")).alias("_entry"))
    return wanted.join(best, ["archive", "id"], "left").select("archive", "id", "_entry.*")


def locate_tiles(requests: DataFrame, entries: DataFrame, headers: DataFrame) -> DataFrame:
    """Return the entry of each distinct tile ``(archive, z, x, y)``, with how often it was asked for.

    A zoom outside the archive's range, or a tile outside the pyramid, has no
    entry. Repeats are combined before the join, so a tile that everyone asks
    for is looked up once.
    """
    wanted = requests.groupBy("archive", "z", "x", "y").agg(F.count("*").alias("requests"))
    zooms = headers.select("archive", "min_zoom", "max_zoom")
    ranged = wanted.join(zooms, "archive", "left")
    inside = F.col("z").between(F.col("min_zoom"), F.col("max_zoom"))
    keyed = ranged.withColumn("id", F.when(inside, tile_id(F.col("z"), F.col("x"), F.col("y")))).drop("min_zoom", "max_zoom")
    found = locate_ids(keyed, entries)
    return keyed.join(found, ["archive", "id"], "left").select(
        "archive", "z", "x", "y", "requests", "id", "tile_id", "run_length", "offset", "length"
    )
