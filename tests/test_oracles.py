"""Every registered graph query against its SQL on the smallest tables, and the driver's entry points."""

from __future__ import annotations

import math

import duckdb
import pytest

from graphwright.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def _rows(rows):
    return sorted(tuple(_text(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rel = db.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    place = [list(rel.columns).index(c) for c in columns]
    assert _rows([tuple(r[c] for c in columns) for r in df.collect()]) == _rows([tuple(r[i] for i in place) for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    registry.queries()[name](spark, DIR).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["relation_type", "source_entity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
