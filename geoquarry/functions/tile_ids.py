"""Tile addresses as Hilbert ids, computed on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoquarry.functions.bindings import record

MAX_ZOOM = 31


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Return the id of a tile in the pyramid, NULL outside it.

    The ids of a zoom follow the Hilbert curve, after all ids of lower zooms.
    """
    zoom = z.cast("int")
    one = F.lit(1).cast("bigint")

    def power(bits: Column) -> Column:
        return F.call_function("shiftleft", one, bits)

    def step(state: Column, level: Column) -> Column:
        size = power(level)
        right = F.when(state["x"].bitwiseAND(size) != 0, 1).otherwise(0)
        low = F.when(state["y"].bitwiseAND(size) != 0, 1).otherwise(0)
        quarter = (right * 3).bitwiseXOR(low).cast("bigint")
        flip = (low == 0) & (right == 1)
        turned_x = F.when(flip, size - 1 - state["y"]).otherwise(state["y"])
        turned_y = F.when(flip, size - 1 - state["x"]).otherwise(state["x"])
        return record(
            x=F.when(low == 0, turned_x).otherwise(state["x"]),
            y=F.when(low == 0, turned_y).otherwise(state["y"]),
            id=state["id"] + F.call_function("shiftleft", quarter, level * 2),
        )

    start = record(
        x=x.cast("bigint"),
        y=y.cast("bigint"),
        id=F.aggregate(
            F.when(zoom > 0, F.sequence(F.lit(0), zoom - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(0).cast("bigint"),
            lambda total, level: total + power(level * 2),
        ),
    )
    levels = F.when(zoom > 0, F.reverse(F.sequence(F.lit(0), zoom - 1))).otherwise(
        F.array().cast("array<int>")
    )
    inside = zoom.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < power(zoom)) & (y < power(zoom))
    return F.when(inside, F.aggregate(levels, start, step)["id"])
