"""The registered queries: well formed, and equal to their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

QUICK = [
    "slice_box_filter_columns", "f02_in_list", "f09_covering_prefilter", "f10_touches_box_without_covering", "f11_touches_area_exact_kernel",
    "g08_envelope", "w01_numbered_in_hot_groups", "w02_path_collisions", "h09_paths_stay_inside", "h20_tile_ids", "j10_interval_lookup",
    "w09_directory_deltas", "m04_decide_per_file", "a07_failures_per_check", "q02_collections_without_data",
]


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150


def plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    frame = contract.queries()[name](spark, sf_dir)
    names = sorted(frame.columns)
    mine = sorted((tuple(map(plain, row)) for row in frame.select(*names).collect()), key=str)
    result = tables.execute(contract.oracle_sql()[name])
    order = [[column[0] for column in result.description].index(each) for each in names]
    theirs = sorted((tuple(plain(row[at]) for at in order) for row in result.fetchall()), key=str)
    assert mine == theirs and mine


def test_entry(spark):
    assert contract.entry(spark).count() > 0
