"""Mixing sources to target weights by hash thresholds found on histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoquarry.llm.common import prepared, word_count

# A document's place is 48 bits of a digest; each level of the histogram reads 12 of them.
PLACE_BITS = 48
LEVEL_BITS = 12


def place(id_: Column, text: Column) -> Column:
    """Return the place of a document between 0 and 2**48, the same in every run."""
    named = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, PLACE_BITS // 4), 16, 10).cast("bigint")


def ordered_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Give the sources the weights in turn, in the order of their names, null last.

    The sort is distributed: rows are numbered inside their partition and
    shifted by the sizes of the partitions before it.
    """
    mask = (1 << 33) - 1
    placed = (
        sources.orderBy(F.col("source").asc_nulls_last())
        .withColumn("_seat", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_seat", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_seat").bitwiseAND(F.lit(mask)) + F.col("_before")
    choices = F.array(*(F.lit(float(weight)) for weight in weights))
    return (
        placed.join(F.broadcast(shifts), part == F.col("_part"))  # one row per sort partition
        .withColumn("weight", F.element_at(choices, (number % len(weights) + 1).cast("int")))
        .select(*sources.columns, "weight")
    )


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Return the target of each source: its weight's part of the shared words, at most ``most`` times its size.

    Every round reshares what full sources leave; the driver only sees one
    row of totals per round.
    """
    rows = ordered_weights(sources, weights).withColumn("cap", F.col("source_size") * F.lit(float(most))).checkpoint()
    level = 0.0
    full = -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        left = rows.agg(
            F.sum("source_size").alias("size"),
            F.count(F.when(above, 1)).alias("full"),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        rest = float(share) * float(left["size"] or 0) - left["given"]
        if left["full"] == full or left["weight"] == 0:
            break
        full, level = left["full"], rest / left["weight"]
    below = F.lit(rest) * F.col("weight") / F.lit(left["weight"] or 1.0)
    return rows.select("source", "source_size", F.when(above, F.col("cap")).otherwise(below).alias("target"))


def thresholds(narrow: DataFrame, aims: DataFrame) -> DataFrame:
    """Find per source how often every document is taken, and the place up to which once more.

    A level sums the words of each bucket of places; only the bucket in which
    the budget ends is split further on the next level.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = aims.select(
        "source",
        "source_size",
        "target",
        whole.alias("copies"),
        (F.col("target") - whole * F.col("source_size")).alias("budget"),
        F.lit(0).cast("bigint").alias("bucket"),
        F.lit(0).cast("bigint").alias("before"),
        F.lit(0).cast("bigint").alias("inside"),
    )
    for shift in range(PLACE_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        held = state.filter("budget > 0").select(F.col("source").alias("_source"), "bucket", "budget", "before")
        same = F.col("source").eqNullSafe(F.col("_source")) & (
            F.shiftright("place", shift + LEVEL_BITS) == F.col("bucket")
        )
        sums = (
            narrow.join(held, same)
            .groupBy("source", F.shiftright("place", shift).alias("part"), "budget", "before")
            .agg(F.sum("size").alias("words"))
        )
        upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("words").over(upto) + F.col("before"))
        edge = (
            run.filter("upto >= budget")
            .groupBy("source")
            .agg(F.min(F.struct("part", "upto", "words")).alias("edge"))
            .select(F.col("source").alias("_source"), "edge")
        )
        state = (
            state.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left")
            .withColumn("bucket", F.coalesce("edge.part", F.lit(-1)))
            .withColumn("before", F.coalesce(F.col("edge.upto") - F.col("edge.words"), F.col("before")))
            .withColumn("inside", F.coalesce("edge.words", F.lit(0)))
            .drop("_source", "edge")
            .checkpoint()
        )
    nearer = F.col("before") + F.col("inside") - F.col("budget") <= F.col("budget") - F.col("before")
    last = F.when(F.col("budget") <= 0, F.lit(-1)).when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1)
    return state.select("source", "source_size", "target", "copies", last.cast("bigint").alias("last"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Add to each document how many words of it a mix of the sources takes.

    Added columns (they replace input columns of the same names): ``size``
    words of the text, ``source_size``, ``target`` of the source, and
    ``taken``, which is 0, 1 or 2 times the size. Null and empty texts have
    size 0 and are taken with 0 words; a null source is a source of its own,
    last in the order. Documents of equal place, which are rows that repeat
    both id and text, are taken alike. The last group of a source is taken
    when that comes nearer to the target. An empty table gives an empty one.
    """
    prepared(docs)
    added = ("size", "source_size", "target", "taken")
    rows = docs.drop(*added)
    text = rows["text"].cast("string")
    sized = rows.withColumns({"size": word_count(text), "_place": place(rows["doc_id"], text)})
    narrow = sized.select("source", "size", F.col("_place").alias("place")).checkpoint()
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    chosen = thresholds(narrow, targets(sources, weights, share, most))
    chosen = chosen.select(
        F.col("source").alias("_source"), F.col("source_size"), "target", F.col("copies").alias("_copies"),
        F.col("last").alias("_last"),
    )
    once_more = F.when(F.col("_place") <= F.col("_last"), 1).otherwise(0)
    return (
        sized.join(chosen, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("taken", F.col("size") * (F.col("_copies") + once_more))
        .select(*rows.columns, *added)
    )


def mixed_rows(docs: DataFrame, **settings: object) -> DataFrame:
    """Return the documents as the mix takes them: left out, once or repeated, with the input's columns.

    A document without words has nothing to take and stays out.
    """
    kept = docs.select(F.struct(*(docs[name] for name in docs.columns)).alias("_row"), "doc_id", "text", "source")
    mixed = mix(kept, **settings).filter("taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("_row.*")
