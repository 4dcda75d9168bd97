"""Every registered query that has SQL agrees with it."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# At this scale there are fewer labelled documents than it takes to learn.
TOO_FEW = {"learned_model"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) - TOO_FEW))
def test_query(spark, con, name):
    found = driver.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    rows = sorted(repr([r[c] for c in columns]) for r in found.collect())
    assert rows == sorted(repr([r[names.index(c)] for c in columns]) for r in expected.fetchall())
    assert rows or name in {"stack_suggestions", "accepted_suggestions"}


def test_entry(spark):
    assert driver.entry(spark).count() > 0
