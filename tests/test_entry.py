"""The driver's contract, and every catalogue query against DuckDB at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodeseek.plans.catalog import CATALOG
from lodeseek.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 6) if isinstance(x, float) else str(x)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, tables, name):
    found = CATALOG[name](spark, SF)
    want = tables.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found.collect(), found.columns) == plain(want.fetchall(), want.columns)


def test_every_query_is_registered(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and set(CATALOG) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_works_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(CATALOG) and set(again.oracle_sql()) == set(ORACLE)
    monkeypatch.undo()
    importlib.reload(entry)
