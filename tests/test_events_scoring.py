import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsepanel.operators import backtest as bt
from pulsepanel.operators import events as ev
from pulsepanel.operators import scoring as sc
from pulsepanel.operators import validation as vd
from pulsepanel.operators.aggregates import article_stats, correlation_grid, domain_weights, linear_fit, null_share, zone_distribution
from pulsepanel.functions.topics import classify_domain

START = dt.date(2021, 1, 1)


def days(n):
    return [START + dt.timedelta(days=i) for i in range(n)]


def peaks_brute(price, p):
    r = np.concatenate([[np.nan], np.diff(np.log(price))])
    s = pd.Series(r)
    z = (s - s.rolling(p.window).mean()) / s.rolling(p.window).std(ddof=0)
    keep, last = [], None
    for i in range(len(z)):
        near = z.iloc[max(0, i - p.half): i + p.half + 1]
        if z[i] >= p.threshold and z[i] == near.max() and (last is None or i - last >= p.gap):
            keep.append(i)
            last = i
    return keep


def test_peaks_brute_force(spark):
    rng = np.random.default_rng(4)
    presets = {"p": ev.PeakParams(20, 1.3, 2, 6), "q": ev.PeakParams(30, 1.8, 3, 12)}
    rows, want = [], set()
    for s in ("a", "b", "c"):
        price = np.exp(np.cumsum(rng.standard_t(3, 250) * 0.02)) * 100
        rows += [(s, d, float(v), float(v) * 10) for d, v in zip(days(250), price)]
        for name, prm in presets.items():
            want |= {(s, name, days(250)[i]) for i in peaks_brute(price, prm)}
    df = spark.createDataFrame(rows, "series_id string, date date, price double, mcap double").repartition(4)
    got = ev.detect_peaks(df, presets).collect()
    assert {(r.series_id, r.preset, r.peak_date) for r in got} == want and len(got) == len(want) > 10
    first = [r for r in got if r.series_id == "a" and r.preset == "p"]
    assert sorted(r.event_id for r in first) == [f"P_EVT_{i + 1:04d}" for i in range(len(first))]
    assert all((r.peak_date - r.window_start).days == 7 and r.param_gap == presets[r.preset].gap for r in got)


def test_returns_are_clipped_at_series_ends_and_reversal(spark):
    ar = [0.1, -0.2, 0.3, -0.1, 0.05]
    daily = spark.createDataFrame(
        [("a", d, 1.0, 2.0, x, 100 * (np.exp(x) - 1).item(), None, 1000 * x) for d, x in zip(days(5), ar)],
        "series_id string, date date, price double, mcap double, abnormal_logret double, abnormal_return_pct double, abnormal_z60 double, abnormal_usd double")
    e = spark.createDataFrame([("a", "p", "e", days(5)[2], days(5)[2] - dt.timedelta(7), days(5)[2] + dt.timedelta(7))],
                              "series_id string, preset string, event_id string, peak_date date, window_start date, window_end date")
    r = ev.event_abnormal_returns(daily, e).first()
    assert (r.pre_days, r.post_days, r.w3_days, r.w7_days, r.event_days) == (2, 2, 3, 3, 5)
    assert r.pre_car_log == pytest.approx(-0.1) and r.post_car_log == pytest.approx(-0.05)
    assert r.w3_abs_usd == pytest.approx(450) and r.reversal_ratio == pytest.approx(0.05 / 0.3) and r.is_reversal == 1


def test_media_impact_counts_calendar_days(spark):
    daily = spark.createDataFrame([("a", d, 1.0, -2.0 if i % 2 else None) for i, d in enumerate(days(80))],
                                  "series_id string, date date, media_effect double, media_effect_oof double")
    peak = days(80)[40]
    cols = {f"w{w}_abs_usd": 10.0 for w in (3, 7, 14, 30)} | {"event_abs_usd": 0.0, "peak_usd": -4.0}
    e = spark.createDataFrame([("a", "p", "e", peak, None, None)], "series_id string, preset string, event_id string, peak_date date, window_start date, window_end date")
    r = ev.event_media_impact(daily, e.withColumns({k: F.lit(v) for k, v in cols.items()})).first()
    assert (r.event_days_effect, r.d7_days_effect, r.d30_days_effect) == (61, 15, 61)
    assert r.sum_effect_oof == -60.0 and r.abs_effect_oof == 60.0 and r.d7_abs_effect_oof == 16.0
    assert r.share_event_oof == 0.0 and r.share_car7_oof == 160.0 and r.share_peak_oof == 50.0


def test_grid_counts_overlapping_days_once(spark):
    daily = spark.createDataFrame([("a", d, 1.0, 0.5, 2.0, 0.6) for d in days(60)],
                                  "series_id string, date date, media_effect_oof double, excess_effect double, abnormal_usd double, score double")
    e = spark.createDataFrame([("a", "p", f"e{i}", days(60)[20 + 3 * i]) for i in range(2)], "series_id string, preset string, event_id string, peak_date date")
    r = {x.window: x for x in ev.robustness_grid(daily, e, {"w7": (7, 7), "one": (0, 1)}).collect()}
    assert (r["w7"].n_unique_days, r["w7"].n_peaks, r["w7"].sum_abs_media) == (18, 2, 18.0)
    assert r["one"].n_unique_days == 4 and r["one"].excess_of_media_pct == 50.0 and r["one"].avg_score == pytest.approx(0.6)


def test_shock_reversal_and_fallback(spark):
    rows = [("a", d, x, 10.0) for d, x in zip(days(8), [0.2, -0.05, 0.05, -0.1, 0.0, 0.0, 0.0, 0.0])]
    rows += [("b", d, None, v) for d, v in zip(days(8), [1.0, -3.0, 2.0, 4.0, 4.0, 4.0, 4.0, 4.0])]
    daily = spark.createDataFrame(rows, "series_id string, date date, r double, f double")
    e = spark.createDataFrame([(s, "p", "e", START) for s in "ab"], "series_id string, preset string, event_id string, peak_date date")
    got = {x.series_id: x for x in ev.shock_reversal(e, daily, "r", "f").collect()}
    assert got["a"].shock_reversal == pytest.approx(0.5) and got["a"].permanent_share == pytest.approx(0.5)
    assert got["b"].shock_reversal == pytest.approx(2.0) and got["b"].temporary_share == 1.0


def test_composite_is_neutral_without_spread(spark):
    e = spark.createDataFrame([("p", 5.0, None, 0.2, 1.0, None)] * 3, "preset string, total_mentions double, mean_tone double, source_hhi double, peak_usd double, shock_reversal double")
    r = ev.event_composite(e).first()
    assert r.composite == 0.5 and r.composite_label == "LOW-MODERATE"


def test_article_weights_and_concentration(spark):
    rows = [("e", "ccn.com", 3, 9, 1.0), ("e", "m.ccn.com", 0, 2, None), ("e", "ft.com", None, None, -2.0), ("e", "x.org", 0, 0, None)]
    df = spark.createDataFrame(rows, "event_id string, domain string, num_articles int, num_mentions int, avg_tone double")
    r = article_stats(domain_weights(df, ["event_id"]), classify_domain(F.col("domain")), ["event_id"]).first()
    assert (r.total_mentions, r.low_cred_mentions, r.trusted_mentions, r.unknown_mentions) == (7.0, 5.0, 1.0, 1.0)
    assert r.mean_tone == -0.5 and r.source_hhi == pytest.approx((9 + 4 + 1 + 1) / 49)


def test_score_days_neutral_when_missing(spark):
    rows = [("a", START, 10.0, None), ("a", days(2)[1], 20.0, None), ("b", START, None, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, date date, mentions double, tone double")
    got = {(r.series_id, r.date): r for r in sc.score_days(df).collect()}
    assert got[("a", START)].z_volume == -1.0 and got[("a", START)].z_tone == 0.0
    assert got[("b", START)].score == 0.5 and got[("b", START)].zone == "NORMAL"


def test_constant_columns_give_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, float(i), 2.0 * i) for i in range(30)], "k string, c double, x double, y double")
    r = {(g.predictor, g.target): g.r for g in correlation_grid(df, ["k"], ["c", "x"], ["y"]).collect()}
    assert r == {("c", "y"): None, ("x", "y"): pytest.approx(1.0)}
    fit = linear_fit(df, "x", "y", ["k"]).first()
    assert (fit.slope, fit.rmse) == (pytest.approx(2.0), pytest.approx(0.0, abs=1e-9))
    assert {(n.column_name, n.null_pct) for n in null_share(df, ["c", "x"]).collect()} == {("c", 0.0), ("x", 0.0)}


def test_zone_distribution_sums_to_100(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "z string")
    assert {(r.z, r.days, round(r.pct, 3)) for r in zone_distribution(df, "z").collect()} == {("x", 2, 66.667), ("y", 1, 33.333)}


def scored(spark, n=520):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({
        "series_id": "a", "date": days(n), "raw_abs_effect": rng.gamma(2, size=n), "tone_used": rng.normal(size=n),
        "media_share_pct": rng.gamma(1.5, size=n), "excess_effect": rng.normal(size=n), "logret": rng.normal(size=n) * 0.02})
    return spark.createDataFrame(pdf).repartition(3), pdf


def blend(p, mu, sd):
    z = np.clip((p - mu) / np.where(sd > 1e-9, sd, 1.0), -3, 3)
    return 1 / (1 + np.exp(-(z @ np.array([0.25, 0.2, 0.2]))))


def proxies(pdf):
    return np.column_stack([pdf.raw_abs_effect, pdf.tone_used.abs(), pdf.media_share_pct])


def test_walk_forward_brute_force(spark):
    df, pdf = scored(spark)
    p, n = proxies(pdf), len(pdf)
    want = []
    for b, s in enumerate(range(0, n - 365 - 30, 30)):
        tr, te = p[s:s + 365], slice(s + 365, s + 395)
        want.append((b, pdf.date[s + 365], np.corrcoef(blend(p[te], tr.mean(0), tr.std(0)), pdf.excess_effect[te])[0, 1]))
    got = vd.walk_forward(df, "2022-03-01").orderBy("block").collect()
    assert [(r.block, r.test_start) for r in got] == [(b, d) for b, d, _ in want] and all(r.n_test == 30 for r in got)
    np.testing.assert_allclose([r.r for r in got], [r for *_, r in want], atol=1e-9)
    assert {r.period for r in got} == {"TRAIN_PERIOD", "TEST"}


def test_oos_index_uses_training_rows_only(spark):
    df, pdf = scored(spark)
    cut = dt.date(2022, 1, 1)
    train = (pdf.date < cut).to_numpy()
    p = proxies(pdf)
    want = blend(p, p[train].mean(0), p[train].std(0))
    out = vd.oos_index(df, "2022-01-01").orderBy("date").toPandas()
    np.testing.assert_allclose(out.oos_score, want, atol=1e-12)
    assert out.threshold[0] == pytest.approx(np.quantile(want[train], 0.7))


def test_distribution_shift_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 20, 80) / 10.0, rng.integers(3, 25, 50) / 10.0
    df = spark.createDataFrame([("s", "TRAIN", float(v)) for v in a] + [("s", "TEST", float(v)) for v in b], "series_id string, split string, v double")
    r = vd.distribution_shift(df, "v", ["series_id"]).first()
    grid = np.unique(np.concatenate([a, b]))
    ks = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.ks_stat == pytest.approx(ks) and r.u_stat == pytest.approx(u) and r.verdict == "unstable"


def test_strategy_uses_yesterdays_position(spark):
    s = [0.1, 0.9, 0.2, 0.8]
    ret = [0.01, 0.02, -0.03, 0.04]
    df = spark.createDataFrame([("a", d, x, y) for d, x, y in zip(days(4), s, ret)], "series_id string, date date, score double, logret double")
    out = bt.strategy_returns(bt.prepare_returns(df), threshold=0.5)
    got = {k: [r.strategy_ret for r in sorted((r for r in out.collect() if r.rule == k), key=lambda r: r.date)] for k in ("hold", "long_short", "long_only")}
    assert got == {"hold": ret, "long_short": pytest.approx([0.02, 0.03, 0.04]), "long_only": pytest.approx([0.02, 0.0, 0.04])}
    perf = {r.rule: r for r in bt.performance(out, ["series_id", "rule"]).collect()}
    assert perf["long_only"].active_days == 2 and perf["hold"].max_drawdown == pytest.approx(-0.03)
    assert perf["hold"].sharpe == pytest.approx(np.mean(ret) / np.std(ret) * np.sqrt(365))
    better = {r.rule: (r.better_sharpe, r.lower_drawdown) for r in bt.compare_to_hold(bt.performance(out, ["series_id", "rule"])).collect()}
    assert better["long_short"] == (True, True)


def test_articles_join_every_open_window_once(spark):
    w = spark.createDataFrame([("a", "p", "e1", START, days(3)[2]), ("a", "p", "e2", days(3)[1], days(5)[4])],
                              "series_id string, preset string, event_id string, window_start date, window_end date")
    rec = spark.createDataFrame([("r1", days(3)[1], "u1"), ("r1", days(3)[1], "u1"), ("r2", days(9)[8], "u2")], "record_id string, date date, source_url string")
    got = sorted((r.record_id, r.event_id, r.window_key) for r in ev.event_articles(rec, w).collect())
    assert got == [("r1", "e1", "p:e1:2021-01-01_2021-01-03"), ("r1", "e2", "p:e2:2021-01-02_2021-01-05")]


def test_training_threshold_does_not_see_later_days(spark):
    rows = [("a", d, float(i), 0.01) for i, d in enumerate(days(20))]
    df = spark.createDataFrame(rows, "series_id string, date date, score double, logret double")
    full = bt.strategy_returns(df.withColumnRenamed("logret", "ret"), 0.5).first().threshold
    early = bt.strategy_returns(df.withColumnRenamed("logret", "ret"), 0.5, train_until=str(days(20)[10])).first().threshold
    assert (full, early) == (9.5, 4.5)


def test_component_index_scales_test_rows_by_training_moments(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 3))
    pdf = pd.DataFrame({"series_id": "a", "date": days(40), "z_volume": z[:, 0], "z_tone": z[:, 1], "z_resid": z[:, 2]})
    out = vd.oos_index_components(spark.createDataFrame(pdf).repartition(3), str(days(40)[25])).orderBy("date").toPandas()
    tr = z[:25]
    own = np.clip((z - tr.mean(0)) / tr.std(0), -3, 3)
    other = np.clip((z - tr.mean(0)) / tr.std(0, ddof=1), -3, 3)
    raw = np.where(np.arange(40)[:, None] < 25, own, other) @ np.array([0.25, 0.2, 0.2])
    np.testing.assert_allclose(out.oos_score, 1 / (1 + np.exp(-raw)), atol=1e-12)
