"""A training-data pipeline over documents: filter, deduplicate, cut repeats, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquarry.llm.byte_bpe import bpe_digests
from geoquarry.llm.common import table
from geoquarry.llm.labelled import remainder
from geoquarry.llm.mixing import mixed_rows
from geoquarry.llm.ngram_join import one_of_each
from geoquarry.llm.substring_dedup import without_repeats
from geoquarry.llm.toxicity import fit_toxicity, toxicity
from geoquarry.session import scratch_path

ORACLE_SQL = None  # the classifier and the tokenizer are not expressible in SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity is below one half; labels of a fifth of the ids are never learned."""
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    model = fit_toxicity(docs, labels)
    rows = docs.select(F.struct(*(docs[name] for name in docs.columns)).alias("_row"), "text")
    return toxicity(rows, model).filter("toxicity < 0.5").select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, by sets of five words at 80 percent."""
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that an earlier document has; a document stays, even with no words left."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out, keep or repeat documents so that sources meet their targets."""
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the mix; one row per document and repeat."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_each),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = scratch_path(spark, f"pipeline-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
