import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsepanel.functions.clean import finite
from pulsepanel.operators import joins as jn
from pulsepanel.operators import windows as wn
from pulsepanel.operators.aggregates import daily_signal_two_stage, grouped_summary, winsorise
from pulsepanel.operators.quantiles import exact_quantiles

START = dt.date(2020, 1, 1)


def panel(spark, n=120, series=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame([
        {"series_id": s, "date": START + dt.timedelta(days=int(i)), "x": float(v) if rng.random() > 0.05 else None}
        for s in series for i, v in enumerate(rng.normal(size=n))])
    df = spark.createDataFrame(pdf, "series_id string, date date, x double")
    return df.withColumn("x", finite(F.col("x"))).repartition(5), pdf


@pytest.mark.parametrize("name", ["z", "std", "ma", "rank"])
def test_rolling_matches_pandas(spark, name):
    df, pdf = panel(spark)
    w = wn.ordered()
    col = {
        "z": wn.rolling_zscore(F.col("x"), w, 10), "std": wn.rolling_std(F.col("x"), w, 10),
        "ma": wn.rolling_mean_sum("x", w, (7,))["x_ma7"], "rank": wn.average_rank("x")}[name]
    got = df.filter("x IS NOT NULL") if name == "rank" else df
    base = pdf.dropna() if name == "rank" else pdf
    got = got.select("series_id", "date", col.alias("v")).orderBy("series_id", "date").toPandas()["v"].to_numpy(float)

    def want(g):
        s = g["x"].astype(float)
        return {
            "z": (s - s.rolling(10).mean()) / s.rolling(10).std(ddof=0), "std": s.rolling(10).std(),
            "ma": s.rolling(7, min_periods=1).mean(), "rank": s.rank()}[name]

    exp = pd.concat([want(g) for _, g in base.groupby("series_id")]).to_numpy(float)
    np.testing.assert_allclose(got, exp, atol=1e-9)


def test_min_gap_is_greedy_on_the_last_kept_day(spark):
    rng = random.Random(5)
    rows = [(s, START + dt.timedelta(days=d)) for s in "abc" for d in sorted(rng.sample(range(200), 40))]
    df = spark.createDataFrame(rows, "series_id string, date date").repartition(3)
    got = sorted(tuple(r) for r in wn.min_gap_dates(df, 9).collect())
    want = []
    for s in "abc":
        last = None
        for _, d in sorted(r for r in rows if r[0] == s):
            if last is None or (d - last).days >= 9:
                want.append((s, d))
                last = d
    assert got == sorted(want)


def test_forward_fill_and_local_max(spark):
    rows = [("a", START + dt.timedelta(days=i), v) for i, v in enumerate([None, 1.0, None, 3.0, 2.0, None])]
    df = spark.createDataFrame(rows, "series_id string, date date, x double")
    assert [r.x for r in wn.forward_fill(df, ["x"]).orderBy("date").collect()] == [None, 1.0, 1.0, 3.0, 2.0, 2.0]
    flags = df.select("date", wn.local_max(F.col("x"), wn.ordered(), 2).alias("t")).orderBy("date").collect()
    assert [r.t for r in flags] == [False, False, False, True, False, False]


def test_exact_quantiles_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(0)
    hot = np.concatenate([np.full(4000, 1.5), rng.integers(0, 50, 3000) / 7.0, rng.normal(size=2000)])
    cold = rng.normal(size=7)
    pdf = pd.DataFrame({"k": ["hot"] * len(hot) + ["cold"] * len(cold), "v": np.concatenate([hot, cold])})
    df = spark.createDataFrame(pdf).repartition(8)
    probs = {"p0": 0.0, "p1": 0.013, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, buckets=16).collect()}
    for k, v in (("hot", hot), ("cold", cold)):
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), abs=1e-12), (k, name)


def test_grouped_summary_total_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", None)], "g string, v double")
    rows = {r.g: (r.n, r.m, r.med) for r in grouped_summary(df, "g", {"n": F.count(F.lit(1)), "m": F.avg("v")}, {"med": "v"}, total=True).collect()}
    assert rows == {"a": (2, 1.5, 1.5), "b": (2, 10.0, 10.0), None: (4, pytest.approx(13 / 3), 2.0)}


def test_salted_join_equals_join(spark):
    days = [START + dt.timedelta(days=i) for i in range(5)]
    big = spark.createDataFrame([(i, days[0] if i % 3 else days[i % 5]) for i in range(300)], "id int, date date")
    small = spark.createDataFrame([(d, f"w{j}") for j in range(3) for d in days[: 2 + j]], "date date, w string")
    key = lambda df: sorted((r.id, r.date, r.w) for r in df.collect())
    assert key(jn.salted_join(big, small, ["date"], 7)) == key(big.join(small, "date"))


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k string, o int, v string").repartition(3)
    assert {tuple(r) for r in jn.keep_one(df, ["k"], [F.col("o")]).collect()} == {("a", 1, "x"), ("b", 5, None)}
    assert {tuple(r) for r in jn.keep_last(df, ["k"], [F.col("o")]).collect()} == {("a", 2, "y"), ("b", 5, None)}


def test_event_windows_by_day_and_by_row(spark):
    days = [START + dt.timedelta(days=i) for i in range(20) if i % 4 != 1]
    daily = spark.createDataFrame([("a", d, float(i)) for i, d in enumerate(days)], "series_id string, date date, v double")
    ev = spark.createDataFrame([("a", "e1", days[6]), ("a", "gone", START + dt.timedelta(days=1))], "series_id string, event_id string, peak_date date")
    by_day = jn.events_x_daily(ev, daily, 3, 2).filter("event_id = 'e1'").collect()
    assert sorted(r.date for r in by_day) == [d for d in days if -3 <= (d - days[6]).days <= 2]
    by_row = jn.events_x_rows(ev, jn.number_rows(daily), 3, 2).collect()
    assert {r.event_id for r in by_row} == {"e1"} and sorted(r.date for r in by_row) == days[3:9]


def test_merge_and_missing(spark):
    a = spark.createDataFrame([("s", START, 1)], "series_id string, date date, x int")
    b = spark.createDataFrame([("s", START, 2, 3)], "series_id string, date date, x int, y int")
    assert jn.merge_panel(a, b, "_b").columns == ["series_id", "date", "x", "x_b", "y"]
    cal = jn.calendar_range(spark, "2020-01-01", "2020-01-04")
    assert jn.missing_days(cal, a).count() == 3


def test_two_stage_tone_weights_files_by_matches(spark):
    rows = [(START, "f1", True, 1.0), (START, "f1", True, None), (START, "f2", True, 4.0), (START, "f2", False, 99.0),
            (START + dt.timedelta(days=1), "f1", False, 5.0)]
    df = spark.createDataFrame(rows, "day date, file_no string, matched boolean, tone double")
    got = {r.date: (r.mentions, r.tone) for r in daily_signal_two_stage(df).collect()}
    # f1: mean 1.0 with weight 2 (both matches), f2: mean 4.0 with weight 1.
    assert got == {START: (3, 2.0), START + dt.timedelta(days=1): (0, None)}


def test_winsorise_leaves_short_groups(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(10)] + [("l", i, float(i)) for i in range(101)], "series_id string, d int, x double")
    out = winsorise(df, ["x"])
    assert out.filter("series_id = 's'").agg(F.max("x")).first()[0] == 9.0
    assert out.filter("series_id = 'l'").agg(F.min("x"), F.max("x")).first() == (1.0, 99.0)


def test_partition_count_does_not_change_results(spark):
    df, _ = panel(spark)
    w = wn.ordered()
    outs = []
    for n in (1, 3, 11):
        z = df.repartition(n).select("series_id", "date", wn.rolling_zscore(F.col("x"), w, 10).alias("z"))
        outs.append(z.orderBy("series_id", "date").collect())
    assert outs[0] == outs[1] == outs[2]
