"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pandas as pd
import pytest

from formloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df.values.tolist()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_crop_actions_follow_what_was_asked(spark):
    """Its constant had the name of another one, further down."""
    got = {r["job_id"]: r["actions"] for r in catalogue.QUERIES["crop_actions"](spark, SF).where("job_id in (4, 6, 9)").collect()}
    assert got == {4: "upscale+clahe", 6: "upscale+checkbox_focus+adaptive_binarize", 9: "checkbox_focus+upscale"}
