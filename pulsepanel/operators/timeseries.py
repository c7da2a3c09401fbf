"""Causality, stationarity and cointegration tests, one result row per series.

The regressions behind every test use lags of the same few columns.  Rows are
turned into vectors of lags once; their cross-products are summed per group and
per number of available lags, so each test and each lag order is a sub-block
of a sum of those matrices and the data is read once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.functions.pvalues import (
    JOHANSEN_TRACE95, chi2_pvalue, corr_pvalue, f_pvalue, kpss_pvalue, unit_root_cv5, unit_root_pvalue,
)
from pulsepanel.operators.aggregates import pearson_over
from pulsepanel.operators.gram import VECTOR, ols, segment_grams, segment_sums, solve_rows, vector
from pulsepanel.operators.joins import argmax_abs
from pulsepanel.operators.windows import ordered, running

GRANGER_LAGS = (1, 2, 3, 5, 7, 14)


def melt(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, date, variable, value) rows with a value."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*keys, "date", F.explode(cells).alias("c")).select(*keys, "date", "c.*")
        .filter(F.col("value").isNotNull())
    )


def pair_rows(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(keys, x_name, y_name, date, x, y) rows where both sides are present."""
    cells = F.array(*[
        F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
                 F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for x, y in pairs
    ])
    return (
        df.select(*keys, "date", F.explode(cells).alias("c")).select(*keys, "date", "c.*")
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def lagged_grams(df: DataFrame, keys: list[str], cols: list[str], depth: int) -> tuple[DataFrame, int]:
    """Cross-products of (1, each column at lags 0..depth), by available lags.

    Columns are centred on their group mean first; every regression here
    either has a constant or is on a residual, so results do not change.  The
    first rows of a group lack some lags and stay rows; all others are summed.
    """
    every = Window.partitionBy(*keys)
    w = every.orderBy("date")
    centred = df.withColumns({f"__c_{c}": F.col(c) - F.avg(c).over(every) for c in cols})
    numbered = centred.withColumn("__seg", F.least(F.row_number().over(w) - 1, F.lit(depth)).cast("int"))
    parts = [F.lit(1.0)] + [F.lag(f"__c_{c}", k).over(w) for c in cols for k in range(depth + 1)]
    width = len(parts)
    rows = numbered.select(*keys, "__seg", vector(parts).alias(VECTOR))
    return segment_grams(rows, keys, "__seg", width, head=depth), width


def _at_least(segs: np.ndarray, mats: np.ndarray, lag: int) -> np.ndarray:
    """Sum over the rows that have ``lag`` earlier rows."""
    return mats[segs >= lag].sum(axis=0)


# Granger ---------------------------------------------------------------------

def granger(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], lags=GRANGER_LAGS, least: int = 50, guard: bool = True) -> DataFrame:
    """Does x help to predict y?  One row per (keys, pair, lag).

    With ``guard`` a lag must stay below a quarter of the rows.
    """
    depth = max(lags)
    by = [*keys, "x_name", "y_name"]
    grams, width = lagged_grams(pair_rows(df, keys, pairs), by, ["y", "x"], depth)

    def solve(row: dict) -> list[dict]:
        segs, mats = segment_sums(row, width)
        n_all = int(round(mats[:, 0, 0].sum()))
        out = []
        for lag in lags:
            n = n_all - lag
            if n_all < least or (guard and lag >= n_all // 4) or n - 2 * lag - 1 <= 0:
                continue
            g = _at_least(segs, mats, lag)
            own = [0] + list(range(2, 2 + lag))
            other = list(range(depth + 3, depth + 3 + lag))
            ssr_r, ssr_u = ols(g, own, 1)[1], ols(g, own + other, 1)[1]
            if ssr_u <= 0.0:
                continue
            free = n - 2 * lag - 1
            out.append({
                "lag": lag, "n": n_all, "df_den": free,
                "f_stat": (ssr_r - ssr_u) / lag / (ssr_u / free),
                "chi2": n * (ssr_r - ssr_u) / ssr_u, "lr": n * math.log(ssr_r / ssr_u),
            })
        return out

    schema = "lag int, n bigint, df_den bigint, f_stat double, chi2 double, lr double"
    res = solve_rows(grams, by, schema, solve)
    return res.withColumns({
        "f_p": f_pvalue(F.col("f_stat"), F.col("lag"), F.col("df_den")),
        "chi2_p": chi2_pvalue(F.col("chi2"), F.col("lag")),
        "lr_p": chi2_pvalue(F.col("lr"), F.col("lag")),
        # The parameter F test of a linear restriction equals the SSR one.
        "params_f": F.col("f_stat"),
    }).withColumn("significant", F.col("f_p") < 0.05)


def granger_best(results: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest p and the significant lags per pair."""
    return results.groupBy(*keys, "x_name", "y_name").agg(
        F.min("f_p").alias("best_p"),
        F.array_sort(F.collect_set(F.when(F.col("significant"), F.col("lag")))).alias("sig_lags"),
    )


# Unit roots ------------------------------------------------------------------

def default_max_lag(n: int, trend: int = 1) -> int:
    return max(0, min(n // 2 - trend - 1, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    """Plan-time bound for lag depth: the row count of the longest series."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(top or 0)


def adf_from_grams(segs: np.ndarray, mats: np.ndarray, n: int, const: bool, n_vars: int) -> dict | None:
    """t value of the level with the lag order chosen by AIC on common rows."""
    limit = default_max_lag(n, 1 if const else 0)
    depth = mats.shape[1] - 2
    limit = min(limit, depth - 1)
    # Columns: 0 constant, 1..depth+1 the level at lags 0..depth.
    to = np.zeros((depth + 2, depth + 2))
    to[0, 0] = 1.0
    to[2, 1] = 1.0                       # 1: level lagged once
    for k in range(depth):               # 2 + k: difference at lag k
        to[1 + k, 2 + k], to[2 + k, 2 + k] = 1.0, -1.0
    head = [0, 1] if const else [1]

    def fit(lag: int, rows_lag: int):
        g = to.T @ _at_least(segs, mats, rows_lag + 1) @ to
        xs = head + list(range(3, 3 + lag))
        beta, ssr = ols(g, xs, 2)
        return g, xs, beta, ssr, int(round(g[0, 0]))

    best, used = None, 0
    for lag in range(limit + 1):
        _, xs, _, ssr, m = fit(lag, limit)
        if m <= len(xs) or ssr <= 0.0:
            continue
        aic = m * (math.log(2 * math.pi) + math.log(ssr / m) + 1.0) + 2 * len(xs)
        if best is None or aic < best:
            best, used = aic, lag
    g, xs, beta, ssr, m = fit(used, used)
    if m <= len(xs) or ssr <= 0.0:
        return None
    where = xs.index(1)
    a = g[np.ix_(xs, xs)]
    d = np.sqrt(np.diag(a))
    inv = np.linalg.pinv(a / np.outer(d, d), hermitian=True) / np.outer(d, d)
    tau = beta[where] / math.sqrt(ssr / (m - len(xs)) * inv[where, where])
    cv5 = unit_root_cv5(m if n_vars == 1 else n - 1, n_vars)
    return {"stat": float(tau), "used_lag": used, "n_obs": m, "p_value": unit_root_pvalue(float(tau), n_vars), "cv5": cv5}


ADF_SCHEMA = "stat double, used_lag int, n_obs bigint, p_value double, cv5 double"


def adf(long: DataFrame, keys: list[str], least: int = 30, const: bool = True, n_vars: int = 1) -> DataFrame:
    """Augmented unit-root test of ``value`` ordered by ``date`` within each key."""
    depth = default_max_lag(_largest_group(long, keys), 1 if const else 0) + 1
    grams, width = lagged_grams(long, keys, ["value"], depth)

    def solve(row: dict) -> list[dict]:
        segs, mats = segment_sums(row, width)
        n = int(round(mats[:, 0, 0].sum()))
        res = adf_from_grams(segs, mats, n, const, n_vars) if n >= least else None
        return [res] if res else []

    return solve_rows(grams, keys, ADF_SCHEMA, solve)


def kpss_lags(long: DataFrame, keys: list[str]) -> DataFrame:
    """Automatic truncation lag per key from the first n^(2/9) autocovariances."""
    w = Window.partitionBy(*keys).orderBy("date")
    n_max = _largest_group(long, keys)
    depth = max(1, int(n_max ** (2.0 / 9.0)))
    e, n = _deviation(long, keys)
    rows = e.withColumns({f"__l{i}": F.lag("e", i).over(w) for i in range(1, depth + 1)})
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"),
        *[F.sum(F.col("e") * F.col(f"__l{i}")).alias(f"g{i}") for i in range(1, depth + 1)],
    )
    cov = F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9.0)))
    s0, s1 = F.col("g0") / F.col("n"), F.lit(0.0)
    for i in range(1, depth + 1):
        term = F.when(F.lit(i) <= cov, F.coalesce(f"g{i}", F.lit(0.0)) / (F.col("n") / 2.0)).otherwise(0.0)
        s0, s1 = s0 + term, s1 + i * term
    gamma = 1.1447 * F.pow(F.pow(s1 / F.nullif(s0, F.lit(0.0)), 2.0), F.lit(1.0 / 3.0))
    auto = F.floor(gamma * F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0)))
    return sums.select(*keys, "n", F.least(auto, F.col("n") - 1).cast("int").alias("n_lags"))


def _deviation(long: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    every = Window.partitionBy(*keys)
    return long.withColumn("e", F.col("value") - F.avg("value").over(every)), F.count(F.lit(1)).over(every)


def kpss(long: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Level-stationarity statistic with automatic lags.

    The number of autocovariance columns is the largest lag any series asks
    for; it is read once while the plan is built.
    """
    lags = kpss_lags(long, keys)
    depth = int(lags.agg(F.max("n_lags")).first()[0] or 0)
    w = Window.partitionBy(*keys).orderBy("date")
    e, _ = _deviation(long, keys)
    rows = e.withColumns({
        "s": F.sum("e").over(running(w)), **{f"__l{i}": F.lag("e", i).over(w) for i in range(1, depth + 1)}})
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(F.col("s") * F.col("s")).alias("ss"),
        F.sum(F.col("e") * F.col("e")).alias("g0"),
        *[F.sum(F.col("e") * F.col(f"__l{i}")).alias(f"g{i}") for i in range(1, depth + 1)],
    ).join(lags.drop("n"), keys)
    var = F.col("g0")
    for i in range(1, depth + 1):
        weight = F.when(F.lit(i) <= F.col("n_lags"), 1.0 - i / (F.col("n_lags") + 1.0)).otherwise(0.0)
        var = var + 2.0 * weight * F.coalesce(f"g{i}", F.lit(0.0))
    stat = (F.col("ss") / (F.col("n_obs") * F.col("n_obs"))) / F.nullif(var / F.col("n_obs"), F.lit(0.0))
    return (
        sums.filter(F.col("n_obs") >= least).select(*keys, "n_obs", "n_lags", stat.alias("stat"))
        .withColumn("p_value", kpss_pvalue(F.col("stat")))
    )


def stationarity_table(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Both tests per variable, the verdict and whether to difference."""
    long = melt(df, keys, cols)
    by = [*keys, "variable"]
    a = adf(long, by).select(*by, F.col("stat").alias("adf_stat"), F.col("p_value").alias("adf_p"))
    k = kpss(long, by).select(*by, F.col("stat").alias("kpss_stat"), F.col("p_value").alias("kpss_p"))
    adf_ok, kpss_ok = F.col("adf_p") < 0.05, F.col("kpss_p") >= 0.05
    verdict = F.when(adf_ok & kpss_ok, "stationary").when(~F.coalesce(adf_ok, F.lit(False)), "difference").otherwise("ambiguous")
    return a.join(k, by, "full").withColumns({
        "stationary": adf_ok, "needs_diff": F.coalesce(~adf_ok, F.lit(False)), "verdict": verdict})


def make_stationary(long: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """First differences for the (key, variable) pairs the table flags."""
    by = [*keys, "variable"]
    w = Window.partitionBy(*by).orderBy("date")
    flagged = long.join(table.select(*by, "needs_diff"), by, "left")
    step = F.col("value") - F.lag("value").over(w)
    return flagged.withColumn("value", F.when(F.coalesce("needs_diff", F.lit(False)), step).otherwise(F.col("value")))


def stationarised(df: DataFrame, table: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The panel with the columns that ``table`` flags for a key replaced by their first differences."""
    flags = table.groupBy(*keys).agg(*[
        F.bool_or((F.col("variable") == c) & F.col("needs_diff")).alias(f"__d_{c}") for c in cols])
    w = Window.partitionBy(*keys).orderBy("date")
    both = df.join(flags, keys, "left")
    return both.withColumns({
        c: F.when(F.coalesce(f"__d_{c}", F.lit(False)), F.col(c) - F.lag(c).over(w)).otherwise(F.col(c)) for c in cols
    }).drop(*[f"__d_{c}" for c in cols])


def integration_order(df: DataFrame, keys: list[str], cols: list[str], least: int = 50) -> DataFrame:
    """Unit-root test of the level and of the difference."""
    by = [*keys, "variable"]
    level = melt(df, keys, cols)
    w = Window.partitionBy(*by).orderBy("date")
    diff = level.withColumn("value", F.col("value") - F.lag("value").over(w)).filter(F.col("value").isNotNull())
    a = adf(level, by, least).select(*by, F.col("stat").alias("stat_level"), F.col("p_value").alias("p_level"))
    d = adf(diff, by, least - 1).select(*by, F.col("stat").alias("stat_diff"), F.col("p_value").alias("p_diff"))
    order = F.when(F.col("p_level") < 0.05, "I(0)").when(F.col("p_diff") < 0.05, "I(1)").otherwise("I(2)?")
    return a.join(d, by, "left").withColumn("integration", order).withColumn("is_i1", order == "I(1)")


def engle_granger(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], least: int = 50) -> DataFrame:
    """Unit-root test on the residual of x regressed on y."""
    by = [*keys, "x_name", "y_name"]
    rows = pair_rows(df, keys, pairs)
    every = Window.partitionBy(*by)
    slope, icept = F.regr_slope("x", "y").over(every), F.regr_intercept("x", "y").over(every)
    resid = rows.withColumn("value", F.col("x") - (icept + slope * F.col("y")))
    out = adf(resid, by, least, const=False, n_vars=2)
    return out.withColumn("cointegrated", F.col("p_value") < 0.05)


# Systems ----------------------------------------------------------------------

def var_fit(df: DataFrame, keys: list[str], cols: list[str], max_order: int = 10, use_at_most: int = 7) -> DataFrame:
    """Vector autoregression: order by AIC and BIC on common rows, then one fit.

    The fit uses max(1, min(order by AIC, ``use_at_most``)) on all rows it can.
    """
    k = len(cols)
    grams, width = lagged_grams(df.dropna(subset=cols), keys, cols, max_order)

    def at(c: int, lag: int) -> int:
        return 1 + c * (max_order + 1) + lag

    def fit(g: np.ndarray, p: int):
        xs = [0] + [at(c, lag) for lag in range(1, p + 1) for c in range(k)]
        ys = [at(c, 0) for c in range(k)]
        n = g[0, 0]
        beta = np.stack([ols(g, xs, y)[0] for y in ys])
        cross = g[np.ix_(ys, ys)] - beta @ g[np.ix_(xs, ys)]
        sign, logdet = np.linalg.slogdet((cross + cross.T) / 2.0 / n)
        free = k * (k * p + 1)
        return beta, n, logdet + 2.0 / n * free, logdet + math.log(n) / n * free

    def solve(row: dict) -> list[dict]:
        segs, mats = segment_sums(row, width)
        common = _at_least(segs, mats, max_order)
        if common[0, 0] <= k * max_order + 1:
            return []
        scores = [fit(common, p)[2:] for p in range(max_order + 1)]
        aic = int(np.argmin([s[0] for s in scores]))
        bic = int(np.argmin([s[1] for s in scores]))
        used = max(1, min(aic, use_at_most))
        beta, n, a, b = fit(_at_least(segs, mats, used), used)
        return [{
            "order_aic": aic, "order_bic": bic, "order_used": used, "n_obs": int(round(n)),
            "aic": float(a), "bic": float(b), "coefficients": beta.tolist(),
        }]

    schema = (
        "order_aic int, order_bic int, order_used int, n_obs bigint, aic double, bic double, "
        "coefficients array<array<double>>"
    )
    return solve_rows(grams, keys, schema, solve)


def johansen(df: DataFrame, keys: list[str], cols: list[str], k_diff: int = 2, least: int = 100, orders: DataFrame | None = None) -> DataFrame:
    """Trace test with a constant; full rank is reported as not applicable.

    With ``orders``, the table of integration orders, each key tests its own
    I(1) variables only, on the rows where those are known: a variable that
    isn't tested costs no row.  Critical values reach as far as their table;
    systems with more variables are reported as such.
    """
    depth = k_diff + 1
    every = F.array(*map(F.lit, cols))
    if orders is None:
        chosen, rows = None, df.dropna(subset=cols)
    else:
        chosen = orders.groupBy(*keys).agg(F.collect_set(F.when(F.col("is_i1"), F.col("variable"))).alias("chosen"))
        tested = df.join(chosen.withColumnRenamed("chosen", "__chosen"), keys, "left")
        known = F.lit(True)
        for c in cols:
            known = known & (F.col(c).isNotNull() | ~F.array_contains(F.coalesce("__chosen", every), c))
        # Untested variables only fill places of the matrix that nothing reads.
        rows = tested.where(known).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols}).drop("__chosen")
    grams, width = lagged_grams(rows, keys, cols, depth)
    grams = grams.withColumn("chosen", every) if chosen is None else grams.join(chosen, keys, "left")

    def at(c: int, lag: int) -> int:
        return 1 + c * (depth + 1) + lag

    def solve(row: dict) -> list[dict]:
        segs, mats = segment_sums(row, width)
        n_all = int(round(mats[:, 0, 0].sum()))
        names = set(row["chosen"] if row["chosen"] is not None else ())
        picked = [i for i, c in enumerate(cols) if c in names]
        k = len(picked)
        known = {"n_obs": n_all, "variables": [cols[i] for i in picked]}
        if k < 2 or n_all < least or k not in JOHANSEN_TRACE95:
            why = "fewer than two variables" if k < 2 else "too few observations" if n_all < least else "more variables than critical values"
            return [known | {"applicable": False, "reason": why, "rank": None, "trace": [], "cv95": []}]
        # New basis: constant, differences at lags 0..k_diff, level at lag k_diff.
        cols_new = []
        for lag in range(k_diff + 1):
            for c in picked:
                v = np.zeros(width)
                v[at(c, lag)], v[at(c, lag + 1)] = 1.0, -1.0
                cols_new.append(v)
        for c in picked:
            v = np.zeros(width)
            v[at(c, k_diff)] = 1.0
            cols_new.append(v)
        one = np.zeros(width)
        one[0] = 1.0
        to = np.stack([one, *cols_new], axis=1)
        g = to.T @ _at_least(segs, mats, depth) @ to
        t = g[0, 0]
        d0 = list(range(1, 1 + k))
        z = [0] + list(range(1 + k, 1 + k * (k_diff + 1)))
        lv = list(range(1 + k * (k_diff + 1), 1 + k * (k_diff + 2)))

        def partial(a: list[int], b: list[int]) -> np.ndarray:
            zz, za, zb = g[np.ix_(z, z)], g[np.ix_(z, a)], g[np.ix_(z, b)]
            return (g[np.ix_(a, b)] - za.T @ np.linalg.pinv(zz, hermitian=True) @ zb) / t

        s00, s01, s11 = partial(d0, d0), partial(d0, lv), partial(lv, lv)
        eig = np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
        eig = np.clip(np.sort(eig.real)[::-1], 0.0, 1.0 - 1e-15)
        trace = [float(-t * np.log1p(-eig[i:]).sum()) for i in range(k)]
        cv = [JOHANSEN_TRACE95[k - i] for i in range(k)]
        rank = sum(s > c for s, c in zip(trace, cv))
        full = rank >= k
        return [known | {
            "applicable": not full, "reason": "full rank" if full else None,
            "rank": rank, "trace": trace, "cv95": cv,
        }]

    schema = "n_obs bigint, variables array<string>, applicable boolean, reason string, rank int, trace array<double>, cv95 array<double>"
    return solve_rows(grams, keys, schema, solve)


# Lead and lag -------------------------------------------------------------------

def lead_lag(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], lags, least: int = 10) -> DataFrame:
    """r between today's signal and the outcome ``lag`` rows later.

    Leads share one sort; the (pair, lag) cells are exploded into partial
    aggregation, so only accumulators are shuffled.
    """
    w = ordered(*keys)
    ys = sorted({y for _, y in pairs})
    ahead = df.select(
        *keys, *sorted({x for x, _ in pairs} - set(ys)), *ys,
        *[F.lead(y, k).over(w).alias(f"__{y}_{k}") for y in ys for k in lags])
    cells = F.array(*[
        F.struct(F.lit(x).alias("predictor"), F.lit(y).alias("target"), F.lit(k).alias("lag"),
                 F.col(x).cast("double").alias("x"), F.col(f"__{y}_{k}").cast("double").alias("y"))
        for x, y in pairs for k in lags
    ])
    long = ahead.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    agg = pearson_over(F.col("x"), F.col("y"), least)
    return long.groupBy(*keys, "predictor", "target", "lag").agg(*[c.alias(n) for n, c in agg.items()])


def with_corr_p(df: DataFrame, r: str = "r", n: str = "n", name: str = "p") -> DataFrame:
    return df.withColumn(name, corr_pvalue(F.col(r), F.col(n)))


def best_lag(results: DataFrame, keys: list[str]) -> DataFrame:
    return argmax_abs(results, "r", ["lag"], *keys, "predictor", "target")


def primary_preset(signals: DataFrame, order: list[str], least: int = 1) -> DataFrame:
    """Rows of the first preset in ``order`` that holds at least ``least`` values.

    The counts are one row per preset, so choosing is a plan-time step.
    """
    held = {r["preset"]: r["n"] for r in signals.groupBy("preset").agg(F.count("mentions").alias("n")).collect()}
    pick = next((p for p in order if held.get(p, 0) >= least), None)
    if pick is None:
        raise ValueError("no preset holds enough data")
    return signals.filter(F.col("preset") == pick)


