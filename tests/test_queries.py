"""Every query with SQL gives what DuckDB gives on the smallest tables; the entry works."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(x):
    return f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(plain(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert a == b


def test_slugs_of_whole_texts(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").where("length(text) > 200").count()
    assert catalog.queries()["text_slugs"](spark, FOLDER).where("length(slug) > 60").count() >= texts // 2 > 0


@pytest.mark.parametrize("name", ["text_slugs", "title_slugs"])
def test_slugs_are_made_once(spark, name):
    assert catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert 0 < entry.entry(spark).first()["roc_auc"] < 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_guidelines_are_made_once(spark):
    df = catalog.queries()["guideline_updates"](spark, FOLDER)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Abstract: ") == 1
