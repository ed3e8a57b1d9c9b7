"""First-of-group and numbering that stay safe when one group holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one window task may hold for one group.
CHUNK_BITS = 16


def first_by(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]
) -> DataFrame:
    """Return the columns ``keep`` of the first row of each group.

    A ``min_by`` aggregate combines on the map side, so a hot key costs one
    partial row per task. A window would move and sort every row of the key.
    """
    rank = F.struct(*(F.col(item) if isinstance(item, str) else item for item in order))
    picked = F.min_by(F.struct(*(F.col(name) for name in keep)), rank)
    grouped = rows.groupBy(*keys).agg(picked.alias("_first"))
    return grouped.select(*keys, *(F.col("_first")[name].alias(name) for name in keep))


def running_sums(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, Column],
    *,
    bits: int = 32,
) -> DataFrame:
    """Add running sums of values in each group, in the order of an integer position.

    ``position`` is not negative, below ``2 ** bits`` and unique in its group.
    The group is cut into chunks of ``2 ** CHUNK_BITS`` positions: sums run
    inside a chunk and are shifted by the totals of the chunks before it. No
    task ever holds more than one chunk of one group.
    """
    names = list(values)
    chunked = rows.select(
        "*",
        F.shiftright(F.col(position).cast("bigint"), CHUNK_BITS).alias("_chunk"),
        *(value.cast("bigint").alias(f"_value_{name}") for name, value in values.items()),
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = chunked.select("*", *(F.sum(f"_value_{name}").over(inside).alias(f"_local_{name}") for name in names))
    totals = chunked.groupBy(*keys, "_chunk").agg(*(F.sum(f"_value_{name}").alias(name) for name in names))
    shifts = _shifts(totals, list(keys), names, bits - CHUNK_BITS)
    places = [*keys, "_chunk"]
    shifts = shifts.select(*(F.col(place).alias(f"_r{index}") for index, place in enumerate(places)), *names)
    same = F.lit(True)
    for index, place in enumerate(places):
        same = same & local[place].eqNullSafe(shifts[f"_r{index}"])
    # There are as many shifts as groups: they are never broadcast by the size of the files behind them.
    joined = local.join(shifts.hint("merge"), same, "left")
    return joined.select(
        *(local[name] for name in rows.columns),
        *((local[f"_local_{name}"] + shifts[name]).alias(name) for name in names),
    )


def _shifts(totals: DataFrame, keys: list[str], names: list[str], bits: int) -> DataFrame:
    """Turn the total of each chunk into the sum of the chunks before it in its group."""

    def before(sums: DataFrame, groups: list[str], prefix: str) -> list[Column]:
        window = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(name).over(window), F.lit(0)).alias(prefix + name) for name in names]

    if bits <= CHUNK_BITS:
        return totals.select(*keys, "_chunk", *before(totals, keys, ""))
    upper = totals.withColumn("_upper", F.shiftright("_chunk", CHUNK_BITS))
    inner = upper.select(*keys, "_upper", "_chunk", *before(upper, [*keys, "_upper"], "_in_"))
    coarse = upper.groupBy(*keys, F.col("_upper").alias("_chunk")).agg(*(F.sum(name).alias(name) for name in names))
    outer = _shifts(coarse, keys, names, bits - CHUNK_BITS).withColumnRenamed("_chunk", "_upper")
    return inner.join(outer.hint("merge"), [*keys, "_upper"], "left").select(
        *keys, "_chunk", *((F.col("_in_" + name) + F.col(name)).alias(name) for name in names)
    )


def numbered(
    rows: DataFrame, keys: Sequence[str], position: str, *, alias: str = "number", bits: int = 32
) -> DataFrame:
    """Number the rows of each group from 1 in the order of an integer position."""
    return running_sums(rows, keys, position, {alias: F.lit(1)}, bits=bits)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Put one-row results with different columns into one row, by a union and not a join."""
    stacked = rows[0]
    for other in rows[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*(F.max(name).alias(name) for name in stacked.columns))
