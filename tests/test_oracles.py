"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, database, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    wanted = database.execute(ORACLES[name]).fetchdf()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert len(found) == len(wanted)
    found = found[columns].sort_values(columns).reset_index(drop=True)
    wanted = wanted[columns].sort_values(columns).reset_index(drop=True)
    for column in columns:
        same = (found[column] == wanted[column]) | (found[column].isna() & wanted[column].isna())
        assert same.all(), f"{column}: {found[column][~same].head(3).tolist()} {wanted[column][~same].head(3).tolist()}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    words = entry_points.entry(spark).collect()
    assert len(words) == 20
    assert {w["topic"] for w in words} == {0, 1, 2, 3}
