"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# So few rows of numbers are one task's work: dealt to all, every step would write many small files.
TASK_ROWS = 50_000


def settled(rows: DataFrame, at_most: int | None = None) -> tuple[DataFrame, int]:
    """Checkpoint rows of numbers and return them with their number, or with a bound of it that is known to be small.

    Few of them are one partition from then on: steps on single partitions
    alone move nothing and write no small files.
    """
    kept = rows.checkpoint()
    count = at_most if at_most is not None and at_most <= TASK_ROWS else kept.count()
    return (kept.coalesce(1) if count <= TASK_ROWS else kept), count


def sent(rows: DataFrame, count: int) -> DataFrame:
    """Send a side of a join to all tasks if it has few rows: after many joins Spark believes that it is large."""
    return F.broadcast(rows) if count <= TASK_ROWS else rows


def components(links: DataFrame) -> DataFrame:
    """Return ``v, component`` for every end of the links ``a, b``; the component is its smallest end.

    Each round is two aggregates and two joins on the remaining edges, and
    ends with a checkpoint; the number of rounds grows with the logarithm of
    the longest path. No component is ever gathered in one task.
    """
    edges = (
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
        .distinct()
        .checkpoint()
    )
    seen = None
    while True:
        print_ = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "w") % (1 << 40)).alias("h")).first()
        if seen == (print_["n"], print_["h"]):
            break
        seen = (print_["n"], print_["h"])
        many = print_["n"]

        def dealt(rows: DataFrame, few: bool = many <= TASK_ROWS) -> DataFrame:
            return rows.coalesce(1) if few else rows

        both = dealt(edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w"))))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(sent(least, many), "u").filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        below = large.groupBy("u").agg(F.min("w").alias("m"))
        joined = large.join(sent(below, many), "u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w")
        next_ = joined.unionByName(below.select("u", F.col("m").alias("w")))
        edges = dealt(dealt(next_).distinct().checkpoint())
    leaves = edges.select(F.col("u").alias("v"), F.col("w").alias("component"))
    return dealt(leaves.unionByName(edges.select(F.col("w").alias("v"), F.col("w").alias("component")).distinct()))
