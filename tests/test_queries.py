"""Every registered query against its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry
from tonguemap.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["domain", "status", "language_count", "languages", "review_recommended"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    expected = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    want = Counter(tuple(r) for r in expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got == want


def test_language_report_explodes_once_and_shuffles_little(spark, monkeypatch):
    """Over the plans of all tables that it stages, and its own."""
    plans = []
    written = DataFrameWriter.parquet

    def noted(self, path, *args, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return written(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    plans.append(QUERIES["language_report"](spark, SF)._jdf.queryExecution().executedPlan().toString())
    rounds = sum("sitemaps-seen" in p or "sitemap-documents" in p for p in plans[:-1])
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 25 + 5 * rounds
    assert plans[-1].count("Exchange hashpartitioning") <= 9 and plans[-1].count("FileScan parquet") <= 8


def test_flat_report_agrees_with_the_report(spark):
    """Reports read all pages, so both say the same."""
    report = {r.domain: (r.language_count, r.languages) for r in QUERIES["language_report"](spark, SF).collect()}
    flat = {r.domain: (r.language_count, r.languages.replace(";", "; ")) for r in QUERIES["language_report_csv"](spark, SF).collect()}
    assert report == flat
