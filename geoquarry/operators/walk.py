"""The breadth-first walk of a catalog graph, one distributed step per level.

The catalog is an edge table and a table of readable documents. Each level is
a join of the frontier with the edges, an aggregate that keeps the first
mention of each child, and an anti join with what is already placed. Levels
are cut with a checkpoint in the shared folder, so a lost executor costs the
current level only. What the walk needs of documents and edges is written
there once, at the begin: no level parses a document again. A frontier of few
rows goes to the tables, which then are read in place; a large one is joined
by a shuffle, where a hot parent is split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.operators.ranking import first_by, numbered
from geoquarry.session import ensure_checkpoints

# Rows of a frontier that go along with the tasks.
CARRIED_ROWS = 50_000
VISITED = "href string, depth int, place bigint, kind string, error string"


def walk(
    documents: DataFrame,
    edges: DataFrame,
    starts: DataFrame | str,
    budget: int | None = None,
    *,
    first_item_only: bool = False,
) -> DataFrame:
    """Return each document below the starts once: ``(root, href, depth, place, kind, error)``.

    ``documents`` has ``(url, kind, error)``, one row per URL that was tried; a
    URL without a row counts as unreadable. ``edges`` has ``(parent, pos,
    child, kind)``. ``starts`` is one URL, or a table of them in column
    ``root``: every root walks on its own. ``(depth, place)`` sorts a root's
    rows in the order of a queue: parents in order, children in link order.
    ``budget`` stops the walk of each root after so many reads, and
    ``truncated`` then tells which roots it stopped; by default all is read.
    ``first_item_only`` follows only the first item of a document, after its
    other children.
    """
    spark = documents.sparkSession
    ensure_checkpoints(spark)
    read = documents.select(F.col("url").alias("href"), "kind", "error", F.lit(True).alias("_there"))
    followed = _first_items(edges) if first_item_only else edges.select("parent", "pos", "child", F.lit(0).alias("late"))
    followed = followed.withColumnRenamed("parent", "href")
    if isinstance(starts, str):
        starts = spark.createDataFrame([(starts,)], "root string")
    read, followed = read.checkpoint(), followed.checkpoint()
    frontier = starts.select("root", F.col("root").alias("href"), F.lit(0).cast("bigint").alias("place")).distinct()
    levels: list[DataFrame] = []
    depth = 0
    while True:
        if budget is not None:
            frontier = _within_budget(frontier, levels, budget)
        # The files of a checkpoint hold the rows: counting them is a metadata-sized job.
        frontier = frontier.checkpoint(eager=True)
        found = frontier.count()
        if found == 0:
            break
        few = found <= CARRIED_ROWS
        own = read.join(F.broadcast(frontier.select("href").distinct()), "href", "left_semi") if few else read
        level = (
            frontier.join(own, "href", "left")
            .select(
                "root",
                "href",
                F.lit(depth).alias("depth"),
                "place",
                "kind",
                F.when(F.col("_there").isNull(), "The document could not be read").otherwise(F.col("error")).alias("error"),
            )
            .checkpoint(eager=True)
        )
        levels.append(level)
        placed = reduce(DataFrame.unionByName, levels).select("root", "href")
        parents = level.where("error is null").select("root", "href", F.col("place").alias("parent_place"))
        mentions = (F.broadcast(parents) if few else parents).join(followed, "href")
        first = first_by(
            mentions, ["root", "child"], ["parent_place", "late", "pos"], ["parent_place", "late", "pos"]
        ).withColumnRenamed("child", "href")
        fresh = first.join(placed, ["root", "href"], "left_anti")
        # After the sort the ids grow along the queue order; they need not be dense.
        frontier = fresh.orderBy("parent_place", "late", "pos").select(
            "root", "href", F.monotonically_increasing_id().alias("place")
        )
        depth += 1
    if not levels:
        return spark.createDataFrame([], "root string, " + VISITED)
    return reduce(DataFrame.unionByName, levels)


def _within_budget(frontier: DataFrame, levels: list[DataFrame], budget: int) -> DataFrame:
    """Keep what each root may still read, in queue order.

    Roots are numbered only when one of them has more children than reads
    left, which happens once per root.
    """
    if not levels:
        return frontier
    frontier = frontier.checkpoint(eager=True)
    used = reduce(DataFrame.unionByName, levels).groupBy("root").agg(F.count("*").alias("used"))
    waiting = frontier.groupBy("root").agg(F.count("*").alias("waiting"))
    left = waiting.join(used, "root", "left").select(
        "root", (budget - F.coalesce("used", F.lit(0))).alias("left"), "waiting"
    )
    short = left.where(F.col("waiting") > F.col("left")).select("root", "left")
    if not short.limit(1).count():
        return frontier
    ranked = numbered(frontier.join(short, "root"), ["root"], "place", alias="turn", bits=64)
    cut = ranked.where(F.col("turn") <= F.col("left")).select("root", "href", "place")
    return frontier.join(short, "root", "left_anti").unionByName(cut)


def _first_items(edges: DataFrame) -> DataFrame:
    """Return the edges to catalogs and collections, and the first item edge of each parent, last."""
    others = edges.where(F.col("kind") != "item").select("parent", "pos", "child", F.lit(0).alias("late"))
    items = first_by(edges.where(F.col("kind") == "item"), ["parent"], ["pos"], ["pos", "child"])
    return others.unionByName(items.select("parent", "pos", "child", F.lit(1).alias("late")))


def truncated(visited: DataFrame, budget: int | None) -> DataFrame:
    """Return per root whether its walk used up the budget; without one no walk does."""
    used_up = F.lit(False) if budget is None else F.count("*") >= budget
    return visited.groupBy("root").agg(used_up.alias("truncated"))


def failures(visited: DataFrame) -> DataFrame:
    """Return the documents of a walk that could not be read, with the reason."""
    return visited.where("error is not null").select("root", "href", "error")


def redirected(documents: DataFrame) -> DataFrame:
    """Return the documents that came from another URL than the one asked for."""
    return documents.where("error is null and base <> url").select("url", "base")
