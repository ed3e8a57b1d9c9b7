"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.session import ensure_checkpoints, ship_package

# Words are runs of anything but the space and the five control characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Open one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepared(rows: DataFrame) -> SparkSession:
    """Return the session of a frame, ready for tasks that import this package and for checkpoints."""
    spark = rows.sparkSession
    ship_package(spark)
    ensure_checkpoints(spark)
    return spark


def word_count(text: Column) -> Column:
    """Return the number of words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """Lower the letters A to Z and leave all others as they are."""
    return F.translate(text, UPPER, UPPER.lower())
