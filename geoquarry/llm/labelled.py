"""Bounded, repeatable samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, name: str = "doc_id") -> F.Column:
    """Return crc32 of the id as text modulo a number; null ids give null."""
    return F.crc32(F.col(name).cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Return ``text, label, part`` of at most ``bound`` labelled ids, picked by a hash of the id.

    ``labels`` has ``doc_id`` and the 0/1 column; null ids and labels are
    left out, and the larger of several labels counts. An id that several
    documents have gives one row, with the text of the smallest hash.
    ``part`` deals the ids into ten parts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = one.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(bound)
    picked = picked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # ``bound`` rows of 20 bytes go to every task.
    joined = rows.join(F.broadcast(picked), "doc_id")
    single = joined.groupBy("doc_id", "label", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return single.select("text", "label", "part")
