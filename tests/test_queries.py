"""Every registered query against its SQL, and its plan for joins without keys."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tools.check import TABLES, canonical

FOLDER = os.environ.get("GISTWORKS_TABLES", "/root/testdata/sf0.001")
WITHOUT_SQL = {"encode_subword"}
#: The training-data queries have tests of their own.
OWN = [n for n in driver.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_names_agree():
    assert set(OWN) - set(driver.oracle_sql()) == WITHOUT_SQL
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, plan_of, name):
    built = driver.queries()[name](spark, FOLDER)
    plan = plan_of(built)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ours = built.toPandas()
    if name in WITHOUT_SQL:
        assert len(ours)
        return
    theirs = con.sql(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours)
    assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert {r["split"] for r in driver.entry(spark).collect()} == {"train", "validation", "test"}

