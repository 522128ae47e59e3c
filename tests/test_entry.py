"""Every registered dashboard query beside its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillboard.plans import dashboard

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    return pd.Timestamp(value).isoformat() if hasattr(value, "isoformat") else value


def matches(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    relation = duck.execute(sql)
    columns = [c[0] for c in relation.description]
    assert sorted(columns) == names
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in relation.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(dashboard.QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    matches(spark, duck, sf_dir, dashboard.QUERIES[name], dashboard.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(dashboard.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
