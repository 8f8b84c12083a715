"""Every catalogue query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from colloquy.plans import catalogue


@pytest.fixture(scope="session")
def views(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, views, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    wanted = views.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = wanted.columns
    left = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    right = sorted((tuple(map(plain, r)) for r in wanted.fetchall()), key=str)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_both(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
