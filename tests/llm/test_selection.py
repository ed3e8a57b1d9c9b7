"""Mixing and URL rules on small tables, the registered SQL, and the pipeline."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoquarry.llm.mixing import mix, mixed_rows
from geoquarry.llm.queries import ORACLES, QUERIES
from geoquarry.llm.url_filter import judge


def same_rows(spark, name, folder, tables):
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted((tuple(row) for row in got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("name", "tables"), [
    ("op1_ngram_jaccard", ["documents"]), ("op4_url_filter", ["pages", "labels"]), ("op8_mixing", ["documents"]),
])
def test_registered_sql(spark, sf_dir, name, tables):
    same_rows(spark, name, sf_dir, tables)


def odd_documents(spark, folder):
    """Write documents with nulls, empty texts, repeated rows and one source of most words."""
    rows = [(number, "w " * (number % 13), f"s{number % 5}" if number % 11 else None) for number in range(400)]
    rows += [(1000 + number, "hot word " * 9, "hot") for number in range(600)]
    rows += [(5, "again", "s1")] * 4 + [(None, "no id", "s2"), (None, None, None), (7000, "x " * 30_000, "long"), (7001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.coalesce(1).write.parquet(f"{folder}/parts")
    part = next(name for name in os.listdir(f"{folder}/parts") if name.endswith(".parquet"))
    os.link(f"{folder}/parts/{part}", f"{folder}/documents.parquet")


def test_mix_of_odd_documents(spark, tmp_path):
    odd_documents(spark, str(tmp_path))
    same_rows(spark, "op8_mixing", str(tmp_path), ["documents"])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = mix(docs.withColumn("taken", F.lit("clash"))).cache()
    assert mixed.filter("taken > 2 * size OR taken < 0").count() == 0
    for row in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("aim"), F.max("size").alias("most")).collect():
        assert abs(row["t"] - row["aim"]) <= max(row["most"], 5)
    rows = mixed_rows(docs.withColumn("size", F.lit("clash")))
    assert rows.columns == [*docs.columns, "size"]
    whole = mixed.filter("size > 0").agg(F.sum((F.col("taken") / F.col("size")).cast("int"))).first()[0]
    assert rows.count() == whole
    assert mix(docs.limit(0)).collect() == []


def test_urls_and_rules(spark):
    rows = [
        (1, "https://Example.COM/en/a?b#c"), (2, "http://www.example.com/en/x"), (3, "http://a.b.net/es/"), (4, "http://net/fr/1"),
        (5, None), (6, "no scheme"), (7, "http://spam.example.org/p"), (8, "http://good.example.org"), (9, "://?q"), (10, "http://x.com"),
        (7, "http://spam.example.org/p"), (None, "http://notexample.com/en/"),
    ]
    rows += [(100 + number, f"http://spam.example.org/{number}") for number in range(40)]
    rows += [(200 + number, f"http://good.example.org/{number}") for number in range(40)]
    marks = [(100 + number, True) for number in range(40)] + [(200 + number, False) for number in range(40)] + [(None, True), (8, None), (100, False)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = judge(pages, spark.createDataFrame(marks, "page_id bigint, bad boolean")).collect()
    assert len(got) == len(rows)
    seen = {row["page_id"]: (row["host"], row["path"], row["rule"], row["verdict"]) for row in got}
    assert seen[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert seen[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert seen[3][2:] == ("net/es/", "block") and seen[4][2:] == ("net/fr/", "block")
    assert seen[5][:3] == seen[6][:3] == seen[9][:3] == ("", "", None)
    assert seen[7][2:] == (None, "block") and seen[8] == ("good.example.org", "", None, "allow")
    assert seen[10] == ("x.com", "", None, "allow") and seen[None][2] == "com/"
    bounds = {row["host"]: row["bad_bound"] for row in got}
    assert bounds["spam.example.org"] > 0.7 > bounds["good.example.org"]
    assert judge(pages.limit(0), spark.createDataFrame([], "page_id bigint, bad boolean")).collect() == []


def test_pipeline_stages_keep_the_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        counts.append(docs.count())
        assert docs.columns == (columns if number < 4 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert 150 < counts[0] < 200 and counts[1] < counts[0] and counts[2] == counts[1] and counts[3] == counts[4]
    again = sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert again == sorted(map(str, docs.collect()))


def test_pipeline_of_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        if number < 4:
            assert out.columns == docs.columns
