"""Every query against its SQL, over whole tables."""

import importlib.util
import os

import duckdb
import pytest

from rolecall.plans import catalogue, oracle

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(
        tuple(repr(round(row[i], 9)) if isinstance(row[i], float) else str(row[i]) for i in order) for row in rows)


def test_every_sql_has_its_query():
    assert set(oracle.all_sql()) == set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.category for r in rows][0] == "Fullstack" and len(rows) == 5


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    expected = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert canonical(df.columns, df.collect()) == expected
    assert expected[1]

