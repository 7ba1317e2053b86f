"""Every query with SQL gives the rows that DuckDB gives for it; those without give rows of a stable schema."""

import math

import duckdb
import pytest

import __spark_entry__
from inquest import catalog
from tests.conftest import SMALL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    """Numbers as Spark and DuckDB both show them."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_is_stable(spark, name):
    first, second = (catalog.queries()[name](spark, SMALL) for _ in range(2))
    assert first.schema == second.schema
    assert rows(first.columns, first.collect()) == rows(second.columns, second.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["entity_id", "peak_start", "peak_count", "baseline_mean", "score", "severity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
