"""Registered queries: contract checks, and values against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from pulsepanel.plans import catalog

CHECKED = [
    "zone_distribution", "signal_two_stage", "macro_ffill", "peaks_sensitive", "model_frame", "baseline_ols", "ridge_effect",
    "excess_effect", "event_car", "event_media_impact", "event_summary_rollup", "robustness_grid", "advanced_event_metrics",
    "granger_controls", "adf", "kpss", "johansen_trace", "strategy_performance", "gkg_scan", "news_events_scan", "convergence"]


def canon(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v != v else v for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
    assert set(catalog.QUERIES) <= set(sql)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["preset", "zone", "days", "pct"] and df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, (int, float)) for v in x) else x == y or all(
            p == q or (isinstance(p, float) and p == pytest.approx(q, rel=1e-6, abs=2e-4)) for p, q in zip(x, y))
