"""Closed forms and brute force in numpy against the Spark operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsepanel.functions import pvalues as pv
from pulsepanel.operators import models as md
from pulsepanel.operators import timeseries as ts
from pulsepanel.operators.gram import VECTOR, gram, triangle, vector

START = dt.date(2019, 1, 1)


def frame(spark, n=300, seed=1, series=("a", "b")):
    parts = []
    for k, s in enumerate(series):
        rng = np.random.default_rng(seed + k)
        x = rng.normal(size=(n, 3))
        walk = np.cumsum(rng.normal(size=n))
        y = 0.5 * x[:, 0] - 0.2 * x[:, 1] + 0.3 * np.roll(x[:, 2], 1) + rng.normal(size=n)
        parts.append(pd.DataFrame({
            "series_id": s, "date": [START + dt.timedelta(days=i) for i in range(n)], "x1": x[:, 0], "x2": x[:, 1] * 50 + 300,
            "x3": x[:, 2], "y": y, "walk": walk, "walk2": 0.7 * walk + rng.normal(size=n)}))
    pdf = pd.concat(parts)
    return spark.createDataFrame(pdf).repartition(6), pdf


@pytest.mark.parametrize("width", [3, 20])
def test_gram_equals_numpy(spark, width):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, width))
    keys = np.where(np.arange(500) % 3, "hot", "cold")
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": x.tolist()})).repartition(7).withColumnRenamed("v", VECTOR)
    for r in gram(df, ["k"], width).collect():
        m = x[keys == r.k]
        np.testing.assert_allclose(triangle(r.g, width), m.T @ m, rtol=1e-10, atol=1e-9)


def test_ols_matches_lstsq(spark):
    df, pdf = frame(spark)
    xs = ["x1", "x2", "x3"]
    for r in md.fit_ols(df, "y", xs, ["series_id"]).collect():
        g = pdf[pdf.series_id == r.series_id]
        X = np.column_stack([np.ones(len(g)), g[xs]])
        beta, ssr = np.linalg.lstsq(X, g.y, rcond=None)[:2]
        n, k = X.shape
        np.testing.assert_allclose(r.beta, beta, atol=1e-8)
        ll = -n / 2 * (math.log(2 * math.pi) + math.log(ssr[0] / n) + 1)
        assert r.aic == pytest.approx(-2 * ll + 2 * k) and r.bic == pytest.approx(-2 * ll + k * math.log(n))
        assert r.r2 == pytest.approx(1 - ssr[0] / ((g.y - g.y.mean()) ** 2).sum())


def ridge(X, y, alpha):
    mu, sd = X.mean(0), X.std(0)
    sd = np.where(sd == 0, 1.0, sd)
    Z = (X - mu) / sd
    c = np.linalg.solve(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - y.mean()))
    return c, mu, sd, y.mean()


def test_ridge_folds_match_refits(spark):
    df, pdf = frame(spark, n=203)
    xs = ["x1", "x2", "x3"]
    seg = md.fold_segments(df, ["series_id"], 5)
    rows = seg.withColumn(VECTOR, vector([F.lit(1.0), *[F.col(x) for x in xs], F.col("y")]))
    fits = md.fit_ridge_cv(rows, ["series_id"], 5)
    scored = md.score_ridge(
        md.feature_vector(seg.withColumn("mcap", F.lit(2.0)).withColumn("abnormal_usd", F.lit(1.0)), xs), fits, ["series_id"], "__f"
    ).toPandas().sort_values(["series_id", "date"])
    for s, g in pdf.groupby("series_id"):
        X, y, n = g[xs].to_numpy(), g.y.to_numpy(), len(g)
        size = n // 6
        oof = np.full(n, np.nan)
        for k in range(5):
            a = n - (5 - k) * size
            c, mu, sd, b = ridge(X[:a], y[:a], 10.0)
            oof[a:a + size] = (X[a:a + size] - mu) / sd @ c + b
        c, mu, sd, b = ridge(X, y, 10.0)
        got = scored[scored.series_id == s]
        np.testing.assert_allclose(got.media_logret_oof.to_numpy(float), oof, atol=1e-8)
        np.testing.assert_allclose(got.media_logret.to_numpy(float), (X - mu) / sd @ c + b, atol=1e-8)
        np.testing.assert_allclose(got.media_effect.to_numpy(float), 2 * got.media_logret.to_numpy(float))


def test_constant_feature_is_harmless():
    rng = np.random.default_rng(2)
    X = np.column_stack([rng.normal(size=50), np.full(50, 3.7)])
    y = rng.normal(size=50)
    V = np.column_stack([np.ones(50), X, y])
    coef, mean, scale, beta = md.ridge_from_gram(V.T @ V, [1, 2], 3, 10.0)
    want = ridge(X, y, 10.0)[0]
    assert scale[1] == 1.0 and coef[0] == pytest.approx(want[0], abs=1e-9) and abs(coef[1]) < 1e-9


def test_prune_keeps_the_stronger_of_a_pair():
    corr = np.array([[1, .99, .1], [.99, 1, .98], [.1, .98, 1.0]])
    assert md.prune_collinear(corr, np.array([.3, .5, .2]), .97) == [1]
    assert md.prune_collinear(corr, np.array([.5, .3, .2]), .97) == [0, 2]
    assert md.prune_collinear(corr, np.array([.5, .5, .2]), .97) == [0, 2]


def test_screen_and_top_k(spark):
    df, pdf = frame(spark)
    vec = md.feature_vector(df.withColumn("gap", F.when(F.dayofmonth("date") > 20, F.col("x1"))).withColumn("flat", F.lit(1.0)), ["x1", "x2", "x3", "gap", "flat"])
    screen = md.screen_features(vec, "y", ["series_id"])
    usable = md.filter_features(screen)
    assert {r.pos for r in usable.collect()} == {0, 1, 2}
    top = md.top_k_features(usable, ["series_id"], 2).collect()
    for s, g in pdf.groupby("series_id"):
        r = [abs(np.corrcoef(g[c], g.y)[0, 1]) for c in ("x1", "x2", "x3")]
        assert [t.pos for t in sorted((t for t in top if t.series_id == s), key=lambda t: t.place)] == list(np.argsort(r)[::-1][:2])


def test_one_hot_columns_and_regime_option():
    assert md.baseline_features(include_regime=True, months=True).count("regime") == 1
    assert len(md.baseline_features(months=True)) == 7 + 6 + 11


# Time-series tests ----------------------------------------------------------------------

def lagmat(v, k):
    return np.column_stack([v[k - j: len(v) - j] for j in range(k + 1)])


def ssr(y, X):
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ b
    return float(e @ e), b


def test_granger_brute_force(spark):
    df, pdf = frame(spark)
    res = ts.granger(df, ["series_id"], [("x3", "y")], (1, 2, 5)).collect()
    assert len(res) == 6
    for r in res:
        g = pdf[pdf.series_id == r.series_id]
        L = r.lag
        ly, lx = lagmat(g.y.to_numpy(), L), lagmat(g.x3.to_numpy(), L)
        one = np.ones((len(ly), 1))
        r0 = ssr(ly[:, 0], np.hstack([one, ly[:, 1:]]))[0]
        r1 = ssr(ly[:, 0], np.hstack([one, ly[:, 1:], lx[:, 1:]]))[0]
        n = len(ly)
        assert r.f_stat == pytest.approx((r0 - r1) / L / (r1 / (n - 2 * L - 1)), rel=1e-8)
        assert r.chi2 == pytest.approx(n * (r0 - r1) / r1, rel=1e-8) and r.lr == pytest.approx(n * math.log(r0 / r1), rel=1e-8)
        assert r.significant == (r.f_p < 0.05)


def adf_brute(x, const=True):
    n = len(x)
    limit = min(n // 2 - (2 if const else 1), math.ceil(12 * (n / 100) ** 0.25))
    dx = np.diff(x)

    def design(k, lags):
        t = np.arange(k, len(dx))
        cols = ([np.ones(len(t))] if const else []) + [x[t]] + [dx[t - j] for j in range(1, lags + 1)]
        return dx[t], np.column_stack(cols)

    best = None
    for k in range(limit + 1):
        y, X = design(limit, k)
        s = ssr(y, X)[0]
        aic = len(y) * (math.log(2 * math.pi) + math.log(s / len(y)) + 1) + 2 * X.shape[1]
        if best is None or aic < best[0]:
            best = (aic, k)
    y, X = design(best[1], best[1])
    s, b = ssr(y, X)
    i = 1 if const else 0
    return b[i] / math.sqrt(s / (len(y) - X.shape[1]) * np.linalg.inv(X.T @ X)[i, i]), best[1], len(y)


def test_adf_brute_force(spark):
    df, pdf = frame(spark)
    out = ts.adf(ts.melt(df, ["series_id"], ["y", "walk"]), ["series_id", "variable"]).collect()
    assert len(out) == 4
    for r in out:
        tau, used, m = adf_brute(pdf[pdf.series_id == r.series_id][r.variable].to_numpy())
        assert r.stat == pytest.approx(tau, rel=1e-7) and (r.used_lag, r.n_obs) == (used, m)
        assert (r.stat < r.cv5) == (r.p_value < 0.05)
    assert {r.variable: r.p_value < 0.05 for r in out}["y"] is True


def kpss_brute(x):
    n = len(x)
    e = x - x.mean()
    q = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, q + 1):
        p = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + p, s1 + i * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    v = e @ e + 2 * sum((e[i:] @ e[: n - i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / (v / n), lags


def test_kpss_and_stationarity(spark):
    df, pdf = frame(spark)
    long = ts.melt(df, ["series_id"], ["y", "walk"])
    for r in ts.kpss(long, ["series_id", "variable"]).collect():
        stat, lags = kpss_brute(pdf[pdf.series_id == r.series_id][r.variable].to_numpy())
        assert r.stat == pytest.approx(stat, rel=1e-8) and r.n_lags == lags
    table = ts.stationarity_table(df, ["series_id"], ["y", "walk"])
    rows = {(r.series_id, r.variable): r for r in table.collect()}
    assert not rows[("a", "y")].needs_diff
    diffed = ts.make_stationary(long, table, ["series_id"])
    nulls = {(r.series_id, r.variable): r.n for r in diffed.groupBy("series_id", "variable").agg(F.count_if(F.col("value").isNull()).alias("n")).collect()}
    assert all(nulls[k] == int(rows[k].needs_diff) for k in rows)


def test_engle_granger(spark):
    df, pdf = frame(spark)
    out = ts.engle_granger(df, ["series_id"], [("walk", "walk2")]).collect()
    for r in out:
        g = pdf[pdf.series_id == r.series_id]
        b, a = np.polyfit(g.walk2, g.walk, 1)
        tau, used, _ = adf_brute((g.walk - a - b * g.walk2).to_numpy(), const=False)
        assert r.stat == pytest.approx(tau, rel=1e-6) and r.used_lag == used and r.cointegrated


def test_var_order_and_fit(spark):
    df, pdf = frame(spark, n=250)
    cols = ["y", "x3"]
    for r in ts.var_fit(df, ["series_id"], cols, max_order=4).collect():
        z = pdf[pdf.series_id == r.series_id][cols].to_numpy()

        def fit(p, start):
            t = np.arange(start, len(z))
            X = np.column_stack([np.ones(len(t))] + [z[t - j] for j in range(1, p + 1)])
            B = np.linalg.lstsq(X, z[t], rcond=None)[0]
            e = z[t] - X @ B
            ld = np.linalg.slogdet(e.T @ e / len(t))[1]
            free = 2 * (2 * p + 1)
            return ld + 2 / len(t) * free, ld + math.log(len(t)) / len(t) * free

        scores = [fit(p, 4) for p in range(5)]
        assert r.order_aic == int(np.argmin([s[0] for s in scores])) and r.order_bic == int(np.argmin([s[1] for s in scores]))
        used = max(1, min(r.order_aic, 7))
        assert (r.aic, r.bic) == pytest.approx(fit(used, used), rel=1e-8)


def test_johansen_brute_force(spark):
    df, pdf = frame(spark)
    cols, k = ["walk", "walk2", "y"], 2
    for r in ts.johansen(df, ["series_id"], cols).collect():
        z = pdf[pdf.series_id == r.series_id][cols].to_numpy()
        dz = np.diff(z, axis=0)
        t = np.arange(k, len(dz))
        X = np.column_stack([np.ones(len(t))] + [dz[t - j] for j in range(1, k + 1)])

        def res(v):
            return v - X @ np.linalg.lstsq(X, v, rcond=None)[0]

        r0, r1 = res(dz[t]), res(z[t + 1 - k])
        s00, s01, s11 = r0.T @ r0, r0.T @ r1, r1.T @ r1
        eig = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))).real)[::-1]
        trace = [-len(t) * np.log(1 - eig[i:]).sum() for i in range(3)]
        assert r.trace == pytest.approx(trace, rel=1e-6)
        rank = sum(a > b for a, b in zip(trace, (29.7961, 15.4943, 3.8415)))
        assert r.rank == rank and r.applicable == (rank < 3)


def test_lead_lag_points_forward(spark):
    df, pdf = frame(spark)
    out = ts.lead_lag(df, ["series_id"], [("x3", "y")], range(4)).collect()
    for r in out:
        g = pdf[pdf.series_id == r.series_id]
        n = len(g) - r.lag
        assert r.n == n and r.r == pytest.approx(np.corrcoef(g.x3[:n], g.y[r.lag:])[0, 1])
    best = {r.series_id: r.lag for r in ts.best_lag(spark.createDataFrame(out), ["series_id"]).collect()}
    assert best == {"a": 1, "b": 1}


# Tail probabilities ------------------------------------------------------------------------

def test_tail_probabilities_at_tabulated_points(spark):
    row = spark.range(1).select(
        pv.f_pvalue(F.lit(4.9646), F.lit(1), F.lit(10)), pv.chi2_pvalue(F.lit(7.8147), F.lit(3)), pv.normal_pvalue(F.lit(1.959964)),
        pv.corr_pvalue(F.lit(0.6319), F.lit(10)), pv.ks_pvalue(F.lit(1.3581 / math.sqrt(500)), F.lit(1000), F.lit(1000)),
        pv.f_pvalue(F.lit(None).cast("double"), F.lit(1), F.lit(10))).first()
    assert list(row)[:5] == pytest.approx([0.05] * 5, abs=2e-4) and row[5] is None


def test_unit_root_probabilities_agree_with_critical_values():
    assert pv.unit_root_pvalue(-2.86154, 1) == pytest.approx(0.05, abs=2e-3)
    assert pv.unit_root_pvalue(-3.33613, 2) == pytest.approx(0.05, abs=2e-3)
    assert pv.unit_root_pvalue(5.0) == 1.0 and pv.unit_root_pvalue(-30.0) == 0.0


def test_model_frame_options(spark):
    rng = np.random.default_rng(6)
    n = 60
    pdf = pd.DataFrame({
        "series_id": "a", "date": [START + dt.timedelta(days=i) for i in range(n)], "price": np.exp(np.cumsum(rng.normal(size=n) * 0.1)),
        "mcap": 1.0, **{c: np.exp(rng.normal(size=n)) for c in md.CONTROLS}})
    df = spark.createDataFrame(pdf).withColumn("ctl_n", F.when(F.dayofmonth("date") % 2 == 0, F.col("ctl_n")))
    plain = md.prepare_model_frame(df)
    more = md.prepare_model_frame(df, include_regime=True, months=True)
    assert "regime" not in plain.columns and {"regime", "m_2", "m_12"} <= set(more.columns)
    # 30 returns fill the volatility, its lag needs one row more, and row 0 has no return.
    assert plain.count() == more.count() == n - 31
    assert md.prepare_model_frame(df, ffill=False).count() == 0
    assert all(r.regime == (1 if r.logret > 0 else -1) for r in more.collect())


def test_moments_of_parts_add_up():
    rng = np.random.default_rng(1)
    x, y = rng.normal(20, 0.1, (300, 5)), rng.normal(size=300)
    x[:, 1], x[::3, 2], x[:, 3], y[5] = 0.1, np.nan, np.nan, np.nan
    cuts = [0, 1, 40, 300]
    total = None
    for a, b in zip(cuts, cuts[1:]):
        m = md._moments(x[a:b], y[a:b])
        total = m if total is None else md._add_moments(total, m)
    whole = md._moments(x, y)
    assert np.allclose(total, whole, rtol=1e-9, atol=1e-12) and total[7, 1] == 0.0 and total[3, 1] == 0.0
    both = ~np.isnan(x[:, 2]) & ~np.isnan(y)
    r = total[9, 2] / np.sqrt(total[7, 2] * total[8, 2])
    assert r == pytest.approx(np.corrcoef(x[both, 2], y[both])[0, 1]) and total[4, 3] == 0
