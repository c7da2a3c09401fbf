"""Queries on correlation, causality, stationarity, validation and back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsepanel.functions.clean import log_floor, signed_log
from pulsepanel.functions.index import benchmark_zone
from pulsepanel.functions.pvalues import corr_pvalue
from pulsepanel.operators import aggregates as ag
from pulsepanel.operators import backtest as bt
from pulsepanel.operators import joins as jn
from pulsepanel.operators import timeseries as ts
from pulsepanel.operators import validation as vd
from pulsepanel.operators import windows as wn
from pulsepanel.plans import fixtures as fx
from pulsepanel.plans import panels as pn
from pulsepanel.plans.oracle import PX, bins, cte, sigmoid, zt
from pulsepanel.plans.registry import query

# SQL forms of the tail probabilities: Simpson sums over the smooth densities -------------


def _simpson(top: str, density: str, at_zero: str) -> str:
    """Integral of ``density`` (in s) from 0 to ``top``."""
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    value = density.replace("{s}", f"(({top}) * i / 2000.0)")
    return f"(({top}) / 6000.0 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * CASE WHEN i = 0 THEN {at_zero} ELSE {value} END)))"


def f_tail(f: str, d1: str, d2: str) -> str:
    y = f"({d1} * {f} / ({d2} + {d1} * {f}))"
    c = f"(LN(2) + LGAMMA(({d1} + {d2}) / 2.0) - LGAMMA({d1} / 2.0) - LGAMMA({d2} / 2.0))"
    body = f"EXP(({d1} - 1) * LN({{s}}) + ({d2} / 2.0 - 1) * LN(1 - {{s}} * {{s}}) + {c})"
    return f"(1 - {_simpson(f'SQRT({y})', body, f'CASE WHEN {d1} = 1 THEN EXP({c}) ELSE 0 END')})"


def chi2_tail(x: str, k: str) -> str:
    c = f"(LN(2) - ({k} / 2.0) * LN(2) - LGAMMA({k} / 2.0))"
    body = f"EXP(({k} - 1) * LN({{s}}) - {{s}} * {{s}} / 2 + {c})"
    return f"(1 - {_simpson(f'SQRT(GREATEST({x}, 0))', body, f'CASE WHEN {k} = 1 THEN EXP({c}) ELSE 0 END')})"


def corr_tail(r: str, n: str) -> str:
    return f"CASE WHEN {r} IS NOT NULL THEN {f_tail(f'({r} * {r} * ({n} - 2) / (1 - {r} * {r}))', '1', f'({n} - 2)')} END"


def r_sql(x: str, y: str, least: int) -> str:
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return (
        f"CASE WHEN COUNT(*) {both} >= {least} AND STDDEV_POP({x}) {both} > 1e-12 AND STDDEV_POP({y}) {both} > 1e-12 "
        f"THEN CORR({x}, {y}) {both} END")


# Correlations ---------------------------------------------------------------------------

cte("signal_panel", """
SELECT s.*, m.preset, m.mentions AS m_mentions, m.tone AS m_tone FROM scored s JOIN media_signal m USING (date)""")
TARGETS = ["score", "excess_effect", "media_share_pct", "media_effect_oof", "abnormal_usd"]
BY = ["series_id", "preset"]


def signal_panel(spark, sf):
    """Scored days with each preset's raw signal; presets x days bound the signal."""
    sig = pn.signals(spark, sf).select("date", "preset", F.col("mentions").alias("m_mentions"), F.col("tone").alias("m_tone"))
    return pn.scored_panel(spark, sf).join(sig, "date")


cte("corr_cells", " UNION ALL ".join(
    f"SELECT series_id, preset, '{x}' AS predictor, '{y}' AS target, COUNT(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n, {r_sql(x, y, 10)} AS r FROM signal_panel GROUP BY 1, 2"
    for x in ("m_mentions", "m_tone") for y in TARGETS))


@query("corr_grid", "series_id preset predictor target n r:6 r2:6 p:6 mark", f"""
SELECT *, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark
FROM (SELECT *, r * r AS r2, {corr_tail('r', 'n')} AS p FROM corr_cells)""")
def corr_grid(spark, sf):
    from pulsepanel.functions.clean import stars

    grid = ag.correlation_grid(signal_panel(spark, sf), BY, ["m_mentions", "m_tone"], TARGETS)
    return grid.withColumns({"r2": F.col("r") * F.col("r"), "p": corr_pvalue(F.col("r"), F.col("n"))}).withColumn("mark", stars(F.col("p")))


@query("best_corr", "series_id preset predictor target r:6", """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, preset ORDER BY ABS(r) DESC, predictor, target) AS k FROM corr_cells WHERE r IS NOT NULL) WHERE k = 1""")
def best_corr(spark, sf):
    grid = ag.correlation_grid(signal_panel(spark, sf), BY, ["m_mentions", "m_tone"], TARGETS)
    return jn.argmax_abs(grid, "r", ["predictor", "target"], *BY)


def _rank_sql(x: str) -> str:
    p = "PARTITION BY series_id, preset"
    return f"RANK() OVER ({p} ORDER BY {x}) + (COUNT(*) OVER ({p}, {x}) - 1) / 2.0"


_SPEAR = [(x, y) for x in ("m_mentions", "m_tone") for y in ("excess_effect", "media_effect_oof", "abnormal_usd")]


@query("spearman_grid", "series_id preset predictor target n rho:6", " UNION ALL ".join(
    f"SELECT series_id, preset, '{x}' AS predictor, '{y}' AS target, COUNT(*) AS n, CASE WHEN COUNT(*) >= 10 THEN CORR(rx, ry) END AS rho FROM "
    f"(SELECT series_id, preset, {_rank_sql(x)} AS rx, {_rank_sql(y)} AS ry FROM signal_panel WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY 1, 2"
    for x, y in _SPEAR))
def spearman_grid(spark, sf):
    return ag.spearman_grid(signal_panel(spark, sf), BY, ["m_mentions", "m_tone"], ["excess_effect", "media_effect_oof", "abnormal_usd"])


PAIRS = [("m_mentions", "excess_effect"), ("m_mentions", "media_effect_oof"), ("m_mentions", "logret"), ("m_tone", "excess_effect"), ("m_tone", "logret")]
cte("signal_numbered", "SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, preset ORDER BY date) AS place FROM signal_panel")


def _lead_sql(pairs, lags, least: int, x_wrap: str = "{x}") -> str:
    ks = ", ".join(str(k) for k in lags)
    parts = []
    for x, y in pairs:
        xe = x_wrap.format(x=f"a.{x}")
        parts.append(
            f"SELECT a.series_id, a.preset, '{x}' AS predictor, '{y}' AS target, k.lag, COUNT(*) FILTER (WHERE {xe} IS NOT NULL AND b.{y} IS NOT NULL) AS n, {r_sql(xe, f'b.{y}', least)} AS r "
            f"FROM signal_numbered a CROSS JOIN (SELECT UNNEST([{ks}]) AS lag) k LEFT JOIN signal_numbered b ON b.series_id = a.series_id AND b.preset = a.preset AND b.place = a.place + k.lag GROUP BY 1, 2, 5")
    return " UNION ALL ".join(parts)


@query("lead_lag", "series_id preset predictor target lag:i n r:6 p:6", f"SELECT *, {corr_tail('r', 'n')} AS p FROM ({_lead_sql(PAIRS, range(15), 10)})")
def lead_lag(spark, sf):
    return ts.with_corr_p(ts.lead_lag(signal_panel(spark, sf), BY, PAIRS, range(15)))


@query("best_lag", "series_id preset predictor target lag:i r:6", f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, preset, predictor, target ORDER BY ABS(r) DESC, lag) AS k
FROM ({_lead_sql(PAIRS, range(15), 10)}) WHERE r IS NOT NULL) WHERE k = 1""")
def best_lag(spark, sf):
    return ts.best_lag(ts.lead_lag(signal_panel(spark, sf), BY, PAIRS, range(15)), BY)


SIMPLE = [("m_mentions", "logret"), ("m_mentions", "excess_effect"), ("m_tone", "logret"), ("excess_effect", "logret"), ("logret", "m_mentions")]


@query("lead_lag_simple", "series_id preset predictor target lag:i n r:6", _lead_sql(SIMPLE, ts.GRANGER_LAGS, 20, "COALESCE({x}, 0)"))
def lead_lag_simple(spark, sf):
    df = signal_panel(spark, sf)
    filled = df.withColumns({f"x_{x}": F.coalesce(x, F.lit(0.0)) for x in {x for x, _ in SIMPLE}})
    res = ts.lead_lag(filled, BY, [(f"x_{x}", y) for x, y in SIMPLE], ts.GRANGER_LAGS, 20)
    return res.withColumn("predictor", F.substring("predictor", 3, 99))


cte("clipped", "SELECT series_id, date, " + ", ".join(
    f"CASE WHEN n_{c} > 10 AND {c} IS NOT NULL THEN LEAST(GREATEST({c}, lo_{c}), hi_{c}) ELSE {c} END AS {c}" for c in ("logret", "mentions", "tone", "excess_effect", "score")) +
    " FROM scored JOIN (SELECT series_id, " + ", ".join(f"COUNT({c}) AS n_{c}, QUANTILE_CONT({c}, 0.01) AS lo_{c}, QUANTILE_CONT({c}, 0.99) AS hi_{c}" for c in ("logret", "mentions", "tone", "excess_effect", "score")) +
    " FROM scored GROUP BY 1) USING (series_id)")
WINSOR = ["logret", "mentions", "tone", "excess_effect", "score"]


def clipped(spark, sf):
    df = pn.scored_panel(spark, sf).select("series_id", "date", *[F.col(c).cast("double").alias(c) for c in WINSOR])
    return ag.winsorise(df, WINSOR)


@query("winsorise", "series_id date:d logret:6 mentions:4 tone:6 excess_effect:1 score:6", "SELECT * FROM clipped")
def winsorise(spark, sf):
    return clipped(spark, sf)


@query("describe", "series_id n mean:6 std:6 p25:6 p50:6 p75:6 p90:6", """
SELECT series_id, COUNT(score) AS n, AVG(score) AS mean, STDDEV_SAMP(score) AS std, QUANTILE_CONT(score, 0.25) AS p25, QUANTILE_CONT(score, 0.5) AS p50,
       QUANTILE_CONT(score, 0.75) AS p75, QUANTILE_CONT(score, 0.9) AS p90 FROM scored GROUP BY 1""")
def describe(spark, sf):
    return ag.describe_series(pn.scored_panel(spark, sf), "score", ["series_id"], probs=(0.25, 0.5, 0.75, 0.9))


@query("describe_events", "preset p10:6 p50:6 p90:6", """
SELECT preset, QUANTILE_CONT(zscore, 0.1) AS p10, QUANTILE_CONT(zscore, 0.5) AS p50, QUANTILE_CONT(zscore, 0.9) AS p90 FROM peaks GROUP BY 1""")
def describe_events(spark, sf):
    return ag.exact_quantiles(pn.peaks(spark, sf), ["preset"], "zscore", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


_PRE = list(fx.PRESETS)
_FLAGS = " + ".join(f"CAST(COALESCE(mentions_{p}, 0) > (SELECT MEDIAN(mentions_{p}) FROM wide_signal) AS INTEGER) + CAST(COALESCE(tone_{p}, 0) < -1.0 AS INTEGER)" for p in _PRE)
cte("convergence_days", f"SELECT date, {_FLAGS} AS conv_score FROM wide_signal")


def convergence_days(spark, sf):
    """Score 0..2 x presets per day; medians are over all calendar days, one row each."""
    wide = jn.wide_by_preset(pn.signals(spark, sf), list(_PRE), ["mentions", "tone"]).withColumn("calendar", F.lit("all"))
    flags = []
    for p in _PRE:
        flags += [wn.column_threshold(wide, f"mentions_{p}", "calendar"), F.coalesce(f"tone_{p}", F.lit(0.0)) < -1.0]
    return wide.select("date", wn.sum_flags(flags).alias("conv_score"))


@query("convergence", "series_id conv_score:i n_days mean_excess:1 mean_score:6 mean_share:4", """
SELECT series_id, conv_score, COUNT(*) AS n_days, AVG(excess_effect) AS mean_excess, AVG(score) AS mean_score, AVG(media_share_pct) AS mean_share
FROM scored JOIN convergence_days USING (date) GROUP BY 1, 2""")
def convergence(spark, sf):
    return pn.scored_panel(spark, sf).join(convergence_days(spark, sf), "date").groupBy("series_id", "conv_score").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("excess_effect").alias("mean_excess"), F.avg("score").alias("mean_score"), F.avg("media_share_pct").alias("mean_share"))


cte("preset_rob", f"""
SELECT series_id, preset, COUNT(*) AS n_days, AVG(score) AS mean_score, AVG(media_share_pct) AS anomaly_share,
       {r_sql('COALESCE(m_mentions, 0)', 'COALESCE(excess_effect, 0)', 10)} AS r_mentions FROM signal_panel GROUP BY 1, 2""")


@query("preset_robustness", "series_id preset n_days mean_score:6 anomaly_share:4 r_mentions:6", "SELECT * FROM preset_rob")
def preset_robustness(spark, sf):
    r = ag.pearson_over(F.coalesce("m_mentions", F.lit(0)).cast("double"), F.coalesce("excess_effect", F.lit(0.0)), 10)["r"]
    return signal_panel(spark, sf).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("score").alias("mean_score"), F.avg("media_share_pct").alias("anomaly_share"), r.alias("r_mentions"))


_MET = ("mean_score", "anomaly_share", "r_mentions")


@query("robustness_spread", "series_id metric spread:4 verdict", "SELECT *, CASE WHEN spread < 0.05 THEN 'stable' WHEN spread < 0.15 THEN 'moderate' ELSE 'unstable' END AS verdict FROM (" + " UNION ALL ".join(
    f"SELECT series_id, '{m}' AS metric, MAX({m}) - MIN({m}) AS spread FROM preset_rob GROUP BY 1" for m in _MET) + ")")
def robustness_spread(spark, sf):
    long = preset_robustness(spark, sf).unpivot(["series_id", "preset"], list(_MET), "metric", "value")
    out = long.groupBy("series_id", "metric").agg((F.max("value") - F.min("value")).alias("spread"))
    return out.withColumn("verdict", F.when(F.col("spread") < 0.05, "stable").when(F.col("spread") < 0.15, "moderate").otherwise("unstable"))


# Sweeps: one elimination gives nested residual sums ---------------------------------------------

SWEEP = (
    "list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = step + 1 AND j = step + 1 THEN 1 / v "
    "WHEN i = step + 1 THEN v / m[step + 1][step + 1] WHEN j = step + 1 THEN -v / m[step + 1][step + 1] "
    "ELSE v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1] END))")


def products(xs: list[str]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"SUM({min(a, b)} * {max(a, b)})" for b in xs) + "]" for a in xs) + "]"


def sweep(name: str, source: str, keys: str, last: str) -> None:
    """Rows (keys, step, m) for every number of swept columns up to ``last``."""
    carry = f"{keys}, depth" if last == "depth" else keys
    cte(name, f"SELECT {carry}, 0 AS step, m FROM {source} UNION ALL SELECT {carry}, step + 1, {SWEEP} FROM {name} WHERE step < {last}", keep=False)


# Granger: x1..xL after the constant and y1..yL, target last.
GPAIRS = [("mentions", "logret"), ("mentions", "excess_effect"), ("tone", "logret"), ("tone", "excess_effect"), ("excess_effect", "logret"),
          ("logret", "mentions"), ("logret", "excess_effect"), ("score", "logret")]


def granger_sql(source: str, tag: str, pairs, lags) -> str:
    cte(f"{tag}_pairs", " UNION ALL ".join(
        f"SELECT series_id, '{x}' AS x_name, '{y}' AS y_name, date, CAST({x} AS DOUBLE) AS x0, CAST({y} AS DOUBLE) AS y0 FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in pairs))
    depth = max(lags)
    w = "(PARTITION BY series_id, x_name, y_name ORDER BY date)"
    cte(f"{tag}_lagged", f"""
SELECT *, 1.0::DOUBLE AS one, ROW_NUMBER() OVER {w} AS rn, COUNT(*) OVER (PARTITION BY series_id, x_name, y_name) AS n_all,
  {', '.join(f'LAG(y, {k}) OVER {w} AS y{k}, LAG(x, {k}) OVER {w} AS x{k}' for k in range(1, depth + 1))}
FROM (SELECT *, x0 - AVG(x0) OVER (PARTITION BY series_id, x_name, y_name) AS x, y0 - AVG(y0) OVER (PARTITION BY series_id, x_name, y_name) AS y FROM {tag}_pairs)""")
    parts = []
    for lag in lags:
        xs = ["one", *[f"y{k}" for k in range(1, lag + 1)], *[f"x{k}" for k in range(1, lag + 1)], "y"]
        cte(f"{tag}_m{lag}", f"SELECT series_id, x_name, y_name, MAX(n_all) AS n, {products(xs)} AS m FROM {tag}_lagged WHERE rn > {lag} GROUP BY 1, 2, 3")
        sweep(f"{tag}_s{lag}", f"{tag}_m{lag}", "series_id, x_name, y_name, n", str(2 * lag + 1))
        parts.append(
            f"SELECT a.series_id, a.x_name, a.y_name, {lag} AS lag, a.n, a.n - {lag} - {2 * lag + 1} AS df_den, a.m[{2 * lag + 2}][{2 * lag + 2}] AS ssr_r, b.m[{2 * lag + 2}][{2 * lag + 2}] AS ssr_u "
            f"FROM {tag}_s{lag} a JOIN {tag}_s{lag} b USING (series_id, x_name, y_name) WHERE a.step = {lag + 1} AND b.step = {2 * lag + 1} AND a.n >= 50 AND {lag} < a.n // 4")
    cte(f"{tag}_ssr", " UNION ALL ".join(parts))
    return f"""
SELECT *, f_p < 0.05 AS significant FROM (SELECT *, {f_tail('f_stat', 'lag', 'df_den')} AS f_p, {chi2_tail('chi2', 'lag')} AS chi2_p, {chi2_tail('lr', 'lag')} AS lr_p
FROM (SELECT *, (ssr_r - ssr_u) / lag / (ssr_u / df_den) AS f_stat, (n - lag) * (ssr_r - ssr_u) / ssr_u AS chi2, (n - lag) * LN(ssr_r / ssr_u) AS lr FROM {tag}_ssr))"""


cte("granger", granger_sql("clipped", "gr", GPAIRS, ts.GRANGER_LAGS))


@query("granger_all", "series_id x_name y_name lag:i n df_den f_stat:5 chi2:4 lr:4 f_p:6 chi2_p:6 lr_p:6 significant", "SELECT * FROM granger")
def granger_all(spark, sf):
    return ts.granger(clipped(spark, sf), ["series_id"], GPAIRS)


@query("granger_best", "series_id x_name y_name best_p:6 n_sig", "SELECT series_id, x_name, y_name, MIN(f_p) AS best_p, COUNT(*) FILTER (WHERE significant) AS n_sig FROM granger GROUP BY 1, 2, 3")
def granger_best(spark, sf):
    best = ts.granger_best(granger_all(spark, sf), ["series_id"])
    return best.withColumn("n_sig", F.size("sig_lags").cast("bigint"))


MPAIRS = [("ctl_a_logret", "logret"), ("ctl_n_logret", "logret"), ("ctl_r_logret", "logret")]
cte("granger_macro", granger_sql("model_frame", "gm", MPAIRS, range(1, 15)))


@query("granger_controls", "series_id x_name y_name lag:i n f_stat:5 f_p:6", "SELECT * FROM granger_macro WHERE lag <= 3")
def granger_controls(spark, sf):
    return ts.granger(pn.model_frame(spark, sf), ["series_id"], MPAIRS, (1, 2, 3), least=44, guard=False)


@query("granger_controls_14", "series_id x_name y_name lag:i f_stat:5 f_p:6 params_f:5", "SELECT *, f_stat AS params_f FROM granger_macro")
def granger_controls_14(spark, sf):
    return ts.granger(pn.model_frame(spark, sf), ["series_id"], MPAIRS, range(1, 15), least=44, guard=False)


# Unit roots ------------------------------------------------------------------------------------------

VARS = ["log_mcap", "log_mentions", "log_excess"]
cte("levels", """
SELECT series_id, date, LN(GREATEST(mcap, 1)) AS log_mcap, LN(GREATEST(mentions, 0.1)) AS log_mentions,
       SIGN(COALESCE(excess_effect, 0)) * LN(GREATEST(ABS(COALESCE(excess_effect, 0)), 1.0)) AS log_excess FROM scored WHERE mentions IS NOT NULL""")
cte("level_rows", " UNION ALL ".join(f"SELECT series_id, '{v}' AS variable, date, {v} AS value FROM levels WHERE {v} IS NOT NULL" for v in VARS))
cte("diff_rows", """
SELECT * FROM (SELECT series_id, variable, date, value - LAG(value) OVER (PARTITION BY series_id, variable ORDER BY date) AS value FROM level_rows) WHERE value IS NOT NULL""")
MAXLAG = 28
# MacKinnon (1994) polynomials, constant only, by number of variables.
_TAU = {
    1: ("2.74", "-18.83", "-1.61", ("2.1659", "1.4412", "0.038269"), ("1.7339", "0.93202", "-0.12745", "-0.010368")),
    2: ("0.92", "-18.86", "-2.62", ("2.92", "1.5012", "0.039796"), ("2.1945", "0.64695", "-0.29198", "-0.042377"))}


def _tau_p(t: str, n_vars: int) -> str:
    hi, lo, star, small, large = _TAU[n_vars]

    def poly(cs) -> str:
        return "(" + " + ".join(f"{c} * POW({t}, {i})" for i, c in enumerate(cs)) + ")"

    z = f"CASE WHEN {t} <= {star} THEN {poly(small)} ELSE {poly(large)} END"
    cdf = f"(0.5 + SIGN(z) * 0.5 * (1 - {chi2_tail('(z * z)', '1')}))"
    return f"(SELECT CASE WHEN {t} > {hi} THEN 1 WHEN {t} < {lo} THEN 0 ELSE {cdf} END FROM (SELECT {z} AS z))"


def adf_sql(source: str, tag: str, keys: str, least: int, const: bool = True, n_vars: int = 1) -> str:
    w = f"(PARTITION BY {keys} ORDER BY date)"
    head = 2 if const else 1
    lim = f"LEAST(n_all // 2 - {head}, CAST(CEIL(12.0 * POW(n_all / 100.0, 0.25)) AS BIGINT))"
    cte(f"{tag}_lv", f"""
SELECT *, d0, {', '.join(f'COALESCE(LAG(d0, {k}) OVER {w}, 0) AS d{k}' for k in range(1, MAXLAG + 1))} FROM (
  SELECT *, 1.0::DOUBLE AS one, v - LAG(v) OVER {w} AS d0, LAG(v) OVER {w} AS lv, ROW_NUMBER() OVER {w} AS rn, {lim} AS depth FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY {keys}) AS n_all, value - AVG(value) OVER (PARTITION BY {keys}) AS v FROM {source}))""".replace("SELECT *, d0, ", "SELECT *, "))
    xs = [*(["one"] if const else []), "lv", *[f"d{k}" for k in range(1, MAXLAG + 1)], "d0"]
    last = len(xs)
    cte(f"{tag}_m", f"SELECT {keys}, depth + {head} AS depth, {products(xs)} AS m FROM {tag}_lv WHERE rn >= depth + 2 AND n_all >= {least} GROUP BY {keys}, depth")
    cte(f"{tag}_n", f"SELECT {keys}, COUNT(*) AS n FROM {tag}_lv WHERE rn >= depth + 2 GROUP BY {keys}")
    sweep(f"{tag}_s", f"{tag}_m", keys, "depth")
    cte(f"{tag}_pick", f"""
SELECT {keys}, step - {head} AS used FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY n * (LN(2 * PI()) + LN(m[{last}][{last}] / n) + 1) + 2 * step, step) AS k
FROM {tag}_s JOIN {tag}_n USING ({keys}) WHERE step >= {head}) WHERE k = 1""")
    cte(f"{tag}_fm", f"SELECT {keys}, used + {head} AS depth, COUNT(*) AS n, {products(xs)} AS m FROM {tag}_lv JOIN {tag}_pick USING ({keys}) WHERE rn >= used + 2 GROUP BY {keys}, used")
    sweep(f"{tag}_fs", f"{tag}_fm", f"{keys}, n", "depth")
    at = head
    return f"""
SELECT {keys}, stat, used_lag, n_obs, {_tau_p('stat', n_vars)} AS p_value FROM (
  SELECT {keys}, step - {head} AS used_lag, n AS n_obs, m[{at}][{last}] / SQRT(m[{last}][{last}] / (n - step) * m[{at}][{at}]) AS stat FROM {tag}_fs WHERE step = depth)"""


cte("adf_level", adf_sql("level_rows", "al", "series_id, variable", 30))
cte("adf_diff", adf_sql("diff_rows", "ad", "series_id, variable", 30))


def levels(spark, sf):
    df = pn.scored_panel(spark, sf).filter(F.col("mentions").isNotNull())
    return df.select(
        "series_id", "date", log_floor(F.col("mcap"), 1.0).alias("log_mcap"), log_floor(F.col("mentions").cast("double"), 0.1).alias("log_mentions"),
        signed_log(F.col("excess_effect")).alias("log_excess"))


def level_rows(spark, sf):
    return ts.melt(levels(spark, sf), ["series_id"], VARS)


VKEYS = ["series_id", "variable"]


@query("adf", "series_id variable stat:4 used_lag:i n_obs p_value:5", "SELECT * FROM adf_level")
def adf(spark, sf):
    return ts.adf(level_rows(spark, sf), VKEYS)


cte("kpss_in", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, variable ORDER BY date) AS rn, SUM(e) OVER (PARTITION BY series_id, variable ORDER BY date ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, value - AVG(value) OVER (PARTITION BY series_id, variable) AS e, COUNT(*) OVER (PARTITION BY series_id, variable) AS n FROM level_rows)""")
cte("kpss_cov", """
SELECT a.series_id, a.variable, a.n, k.lag, SUM(a.e * b.e) AS g FROM kpss_in a CROSS JOIN (SELECT UNNEST(RANGE(0, 80)) AS lag) k
JOIN kpss_in b ON b.series_id = a.series_id AND b.variable = a.variable AND b.rn = a.rn + k.lag GROUP BY 1, 2, 3, 4""")
cte("kpss_auto", """
SELECT series_id, variable, n, LEAST(CAST(FLOOR(1.1447 * POW(POW(s1 / s0, 2), 1.0 / 3.0) * POW(n, 1.0 / 3.0)) AS BIGINT), n - 1) AS n_lags FROM (
  SELECT series_id, variable, n, SUM(CASE WHEN lag = 0 THEN g / n ELSE g / (n / 2.0) END) AS s0, SUM(CASE WHEN lag = 0 THEN 0 ELSE lag * g / (n / 2.0) END) AS s1
  FROM kpss_cov WHERE lag <= FLOOR(POW(n, 2.0 / 9.0)) GROUP BY 1, 2, 3)""")
cte("kpss_level", """
SELECT *, CASE WHEN stat <= 0.347 THEN 0.10 WHEN stat <= 0.463 THEN 0.10 + (stat - 0.347) * (0.05 - 0.10) / (0.463 - 0.347) WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
       WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS p_value
FROM (SELECT series_id, variable, n AS n_obs, n_lags, ss / (n * n) / (v / n) AS stat FROM kpss_auto
  JOIN (SELECT series_id, variable, SUM(s * s) AS ss FROM kpss_in GROUP BY 1, 2) USING (series_id, variable)
  JOIN (SELECT c.series_id, c.variable, SUM(CASE WHEN lag = 0 THEN g ELSE 2 * g * (1 - lag / (n_lags + 1.0)) END) AS v
        FROM kpss_cov c JOIN kpss_auto a USING (series_id, variable) WHERE lag <= n_lags GROUP BY 1, 2) USING (series_id, variable))""")


@query("kpss", "series_id variable n_obs n_lags:i stat:5 p_value:5", "SELECT * FROM kpss_level")
def kpss(spark, sf):
    return ts.kpss(level_rows(spark, sf), VKEYS)


cte("stationary_table", """
SELECT *, adf_p < 0.05 AS stationary, NOT adf_p < 0.05 AS needs_diff, CASE WHEN adf_p < 0.05 AND kpss_p >= 0.05 THEN 'stationary' WHEN adf_p < 0.05 THEN 'ambiguous' ELSE 'difference' END AS verdict
FROM (SELECT series_id, variable, stat AS adf_stat, p_value AS adf_p FROM adf_level) JOIN (SELECT series_id, variable, stat AS kpss_stat, p_value AS kpss_p FROM kpss_level) USING (series_id, variable)""")


@query("stationarity", "series_id variable adf_stat:4 adf_p:5 kpss_stat:5 kpss_p:5 stationary needs_diff verdict", "SELECT * FROM stationary_table")
def stationarity(spark, sf):
    return ts.stationarity_table(levels(spark, sf), ["series_id"], VARS)


@query("made_stationary", "series_id variable n total:4", """
SELECT series_id, variable, COUNT(value) AS n, SUM(value) AS total FROM (
  SELECT l.series_id, l.variable, CASE WHEN t.needs_diff THEN value - LAG(value) OVER (PARTITION BY l.series_id, l.variable ORDER BY date) ELSE value END AS value
  FROM level_rows l LEFT JOIN stationary_table t ON t.series_id = l.series_id AND t.variable = l.variable) GROUP BY 1, 2""")
def made_stationary(spark, sf):
    out = ts.make_stationary(level_rows(spark, sf), stationarity(spark, sf), ["series_id"])
    return out.groupBy(*VKEYS).agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("integration_order", "series_id variable stat_level:4 p_level:5 stat_diff:4 p_diff:5 integration is_i1", """
SELECT *, integration = 'I(1)' AS is_i1 FROM (SELECT *, CASE WHEN p_level < 0.05 THEN 'I(0)' WHEN p_diff < 0.05 THEN 'I(1)' ELSE 'I(2)?' END AS integration
FROM (SELECT series_id, variable, stat AS stat_level, p_value AS p_level FROM adf_level) LEFT JOIN (SELECT series_id, variable, stat AS stat_diff, p_value AS p_diff FROM adf_diff) USING (series_id, variable))""")
def integration_order(spark, sf):
    return ts.integration_order(levels(spark, sf), ["series_id"], VARS)


cte("eg_rows", " UNION ALL ".join(
    f"""SELECT series_id, '{x}' AS x_name, '{y}' AS y_name, date, {x} - (REGR_INTERCEPT({x}, {y}) OVER (PARTITION BY series_id) + REGR_SLOPE({x}, {y}) OVER (PARTITION BY series_id) * {y}) AS value
    FROM levels""" for x, y in (("log_mcap", "log_excess"), ("log_mcap", "log_mentions"))))
cte("eg", adf_sql("eg_rows", "eg", "series_id, x_name, y_name", 50, const=False, n_vars=2))


@query("engle_granger", "series_id x_name y_name stat:4 used_lag:i p_value:5 cointegrated", "SELECT *, p_value < 0.05 AS cointegrated FROM eg")
def engle_granger(spark, sf):
    return ts.engle_granger(levels(spark, sf), ["series_id"], [("log_mcap", "log_excess"), ("log_mcap", "log_mentions")])


VCOLS, ORDER = ["logret", "mentions", "excess_effect"], 10
_VX = ["one", *[f"z{c}_{k}" for k in range(1, ORDER + 1) for c in range(3)], "z0", "z1", "z2"]
_a, _b, _c = len(_VX) - 2, len(_VX) - 1, len(_VX)
_DET = (f"(m[{_a}][{_a}] * (m[{_b}][{_b}] * m[{_c}][{_c}] - m[{_b}][{_c}] * m[{_c}][{_b}]) - m[{_a}][{_b}] * (m[{_b}][{_a}] * m[{_c}][{_c}] - m[{_b}][{_c}] * m[{_c}][{_a}]) "
        f"+ m[{_a}][{_c}] * (m[{_b}][{_a}] * m[{_c}][{_b}] - m[{_b}][{_b}] * m[{_c}][{_a}])) / POW(n, 3)")


def var_sql(tag: str, source: str, cols: list[str]) -> str:
    w = "(PARTITION BY series_id ORDER BY date)"
    cte(f"{tag}_lagged", f"""
SELECT *, 1.0::DOUBLE AS one, ROW_NUMBER() OVER {w} AS rn, {', '.join(f'COALESCE(LAG(z{c}, {k}) OVER {w}, 0) AS z{c}_{k}' for k in range(1, ORDER + 1) for c in range(3))}
FROM (SELECT series_id, date, {', '.join(f'{v} - AVG({v}) OVER (PARTITION BY series_id) AS z{i}' for i, v in enumerate(cols))} FROM {source}
      WHERE {' AND '.join(f'{v} IS NOT NULL' for v in cols)})""")
    cte(f"{tag}_m", f"SELECT series_id, COUNT(*) AS n, {products(_VX)} AS m FROM {tag}_lagged WHERE rn > {ORDER} GROUP BY 1")
    sweep(f"{tag}_s", f"{tag}_m", "series_id, n", str(3 * ORDER + 1))
    cte(f"{tag}_ic", f"SELECT series_id, (step - 1) // 3 AS p, LN({_DET}) + 2.0 / n * 3 * step AS aic, LN({_DET}) + LN(n) / n * 3 * step AS bic FROM {tag}_s WHERE step % 3 = 1")
    cte(f"{tag}_pick", f"SELECT series_id, ARG_MIN(p, aic) AS order_aic, ARG_MIN(p, bic) AS order_bic, GREATEST(1, LEAST(ARG_MIN(p, aic), 7)) AS order_used FROM {tag}_ic GROUP BY 1")
    cte(f"{tag}_fm", f"SELECT series_id, COUNT(*) AS n, 3 * order_used + 1 AS depth, {products(_VX)} AS m FROM {tag}_lagged JOIN {tag}_pick USING (series_id) WHERE rn > order_used GROUP BY 1, order_used")
    sweep(f"{tag}_fs", f"{tag}_fm", "series_id, n", "depth")
    return f"""
SELECT series_id, order_aic, order_bic, order_used, n AS n_obs, LN({_DET}) + 2.0 / n * 3 * step AS aic, LN({_DET}) + LN(n) / n * 3 * step AS bic
FROM {tag}_fs JOIN {tag}_pick USING (series_id) WHERE step = depth"""


VAR_SPEC = "series_id order_aic:i order_bic:i order_used:i n_obs aic:5 bic:5"


@query("var_fit", VAR_SPEC, var_sql("var", "clipped", VCOLS))
def var_fit(spark, sf):
    return ts.var_fit(clipped(spark, sf), ["series_id"], VCOLS)


# The same on differenced columns, chosen per series by the stationarity table.
_sw = "(PARTITION BY l.series_id ORDER BY date)"
cte("levels_stat", f"""
SELECT l.series_id, l.date, {', '.join(f'CASE WHEN d_{v} THEN {v} - LAG({v}) OVER {_sw} ELSE {v} END AS {v}' for v in VARS)}
FROM levels l LEFT JOIN (SELECT series_id, {', '.join(f"BOOL_OR(variable = '{v}' AND needs_diff) AS d_{v}" for v in VARS)} FROM stationary_table GROUP BY 1) t ON t.series_id = l.series_id""")
SPAIRS = [("log_mentions", "log_mcap"), ("log_excess", "log_mcap"), ("log_mcap", "log_mentions")]


def levels_stationarised(spark, sf):
    return ts.stationarised(levels(spark, sf), stationarity(spark, sf), ["series_id"], VARS)


@query("granger_stationarised", "series_id x_name y_name lag:i n df_den f_stat:4 f_p:5 significant", granger_sql("levels_stat", "gst", SPAIRS, (1, 2, 3, 5)))
def granger_stationarised(spark, sf):
    return ts.granger(levels_stationarised(spark, sf), ["series_id"], SPAIRS, (1, 2, 3, 5))


@query("var_stationarised", VAR_SPEC.replace(":5", ":4"), var_sql("vst", "levels_stat", VARS))
def var_stationarised(spark, sf):
    return ts.var_fit(levels_stationarised(spark, sf), ["series_id"], VARS)


# Johansen: partialled moment matrices from a sweep; the three roots by the cubic formula.
_jw = "(PARTITION BY series_id ORDER BY date)"
cte("joh_lagged", f"""
SELECT *, {', '.join(f'LAG(d{c}, {k}) OVER {_jw} AS d{c}_{k}' for k in (1, 2) for c in range(3))} FROM (
  SELECT *, 1.0::DOUBLE AS one, ROW_NUMBER() OVER {_jw} AS rn, {', '.join(f'v{c} - LAG(v{c}) OVER {_jw} AS d{c}, LAG(v{c}, 2) OVER {_jw} AS l{c}' for c in range(3))}
  FROM (SELECT series_id, date, {', '.join(f'{v} - AVG({v}) OVER (PARTITION BY series_id) AS v{i}' for i, v in enumerate(VARS))} FROM levels))""")
_JX = ["one", *[f"d{c}_{k}" for k in (1, 2) for c in range(3)], "l0", "l1", "l2", "d0", "d1", "d2"]
cte("joh_m", f"SELECT series_id, COUNT(*) AS n, {products(_JX)} AS m FROM joh_lagged WHERE rn > 3 GROUP BY 1")
sweep("joh_s", "joh_m", "series_id, n", "10")
# After 7 sweeps the lower block is partialled; after 10 the upper-right part holds S11^-1 S10 and the rest S00.1.
_J = {(i, j): f"(b.m[{11 + i}][{11 + j}])" for i in range(3) for j in range(3)}
_K = {(i, j): f"(a.m[{11 + i}][{11 + j}])" for i in range(3) for j in range(3)}


JOHANSEN_SQL = f"""
SELECT series_id, n + 3 AS n_obs, -n * LN(ratio) AS trace0, ratio AS full_det FROM (
SELECT a.series_id, a.n,
  ({_J[0, 0]} * ({_J[1, 1]} * {_J[2, 2]} - {_J[1, 2]} * {_J[2, 1]}) - {_J[0, 1]} * ({_J[1, 0]} * {_J[2, 2]} - {_J[1, 2]} * {_J[2, 0]}) + {_J[0, 2]} * ({_J[1, 0]} * {_J[2, 1]} - {_J[1, 1]} * {_J[2, 0]})) /
  ({_K[0, 0]} * ({_K[1, 1]} * {_K[2, 2]} - {_K[1, 2]} * {_K[2, 1]}) - {_K[0, 1]} * ({_K[1, 0]} * {_K[2, 2]} - {_K[1, 2]} * {_K[2, 0]}) + {_K[0, 2]} * ({_K[1, 0]} * {_K[2, 1]} - {_K[1, 1]} * {_K[2, 0]})) AS ratio
FROM joh_s a JOIN joh_s b USING (series_id) WHERE a.step = 7 AND b.step = 10)"""


# S00^-1 times the partialled block has the roots 1 - lambda; three real roots in closed form.
def _minor(i: int, j: int) -> str:
    r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    return f"({_K[r[0], c[0]]} * {_K[r[1], c[1]]} - {_K[r[0], c[1]]} * {_K[r[1], c[0]]})"


_INV = {(i, j): f"({'-' if (i + j) % 2 else ''}{_minor(j, i)} / det)" for i in range(3) for j in range(3)}
cte("joh_pair", f"""
SELECT a.series_id, a.n, a.m AS am, b.m AS bm, {_K[0, 0]} * {_minor(0, 0)} - {_K[0, 1]} * {_minor(0, 1)} + {_K[0, 2]} * {_minor(0, 2)} AS det
FROM joh_s a JOIN joh_s b USING (series_id) WHERE a.step = 7 AND b.step = 10""")
_entries = ", ".join(
    "(" + " + ".join(f"{_INV[i, k]} * {_J[k, j]}" for k in range(3)) + f") AS q{i}{j}" for i in range(3) for j in range(3)
).replace("a.m[", "am[").replace("b.m[", "bm[")
cte("joh_roots", f"""
SELECT series_id, n, list_sort([e1 / 3 + 2 * SQRT(p) * COS(phi), e1 / 3 + 2 * SQRT(p) * COS(phi + 2 * PI() / 3), e1 / 3 + 2 * SQRT(p) * COS(phi + 4 * PI() / 3)]) AS mu
FROM (SELECT *, ACOS(LEAST(GREATEST(q / POW(p, 1.5), -1), 1)) / 3 AS phi
FROM (SELECT *, (e1 * e1 - 3 * e2) / 9 AS p, (2 * POW(e1, 3) - 9 * e1 * e2 + 27 * e3) / 54 AS q
FROM (SELECT series_id, n, q00 + q11 + q22 AS e1, q00 * q11 - q01 * q10 + q00 * q22 - q02 * q20 + q11 * q22 - q12 * q21 AS e2,
  q00 * (q11 * q22 - q12 * q21) - q01 * (q10 * q22 - q12 * q20) + q02 * (q10 * q21 - q11 * q20) AS e3 FROM (SELECT series_id, n, {_entries} FROM joh_pair))))""")


cte("joh_test", """
SELECT *, rank < 3 AS applicable, CASE WHEN rank >= 3 THEN 'full rank' END AS reason FROM (
SELECT *, CAST(trace0 > 29.7961 AS INTEGER) + CAST(trace1 > 15.4943 AS INTEGER) + CAST(trace2 > 3.8415 AS INTEGER) AS rank FROM (
SELECT series_id, n + 3 AS n_obs, -n * (LN(mu[1]) + LN(mu[2]) + LN(mu[3])) AS trace0, -n * (LN(mu[2]) + LN(mu[3])) AS trace1, -n * LN(mu[3]) AS trace2 FROM joh_roots))""")


@query("johansen", "series_id n_obs applicable rank:0 reason trace0:3 trace1:3 trace2:3", "SELECT * FROM joh_test")
def johansen(spark, sf):
    out = ts.johansen(levels(spark, sf), ["series_id"], VARS)
    return out.withColumns({f"trace{i}": F.get("trace", F.lit(i)) for i in range(3)})


@query("johansen_trace", "series_id n_obs trace0:3 full_det:5", JOHANSEN_SQL)
def johansen_trace(spark, sf):
    """The trace against rank zero equals -T ln of a ratio of determinants."""
    out = ts.johansen(levels(spark, sf), ["series_id"], VARS)
    stat = F.get("trace", F.lit(0))
    return out.select("series_id", "n_obs", stat.alias("trace0"), F.exp(-stat / (F.col("n_obs") - 3)).alias("full_det"))


@query("johansen_i1", "series_id n_i1 n_obs tested reason rank:0 trace0:3 trace1:3 trace2:3", """
SELECT o.series_id, n_i1, r.n_obs, n_i1 >= 2 AND r.n_obs >= 100 AS tested, CASE WHEN n_i1 < 2 THEN 'fewer than two variables' WHEN r.n_obs < 100 THEN 'too few observations' WHEN n_i1 = 3 THEN t.reason END AS reason,
  CASE WHEN n_i1 = 3 THEN t.rank END AS rank, CASE WHEN n_i1 = 3 THEN t.trace0 END AS trace0, CASE WHEN n_i1 = 3 THEN t.trace1 END AS trace1, CASE WHEN n_i1 = 3 THEN t.trace2 END AS trace2
FROM (SELECT series_id, COUNT(*) FILTER (WHERE p_level >= 0.05 AND p_diff < 0.05) AS n_i1
  FROM (SELECT series_id, variable, p_value AS p_level FROM adf_level) LEFT JOIN (SELECT series_id, variable, p_value AS p_diff FROM adf_diff) USING (series_id, variable) GROUP BY 1) o
JOIN (SELECT series_id, COUNT(*) AS n_obs FROM levels GROUP BY 1) r USING (series_id) LEFT JOIN joh_test t USING (series_id)""")
def johansen_i1(spark, sf):
    """The trace test on each series' own I(1) variables.

    The SQL has the statistics of series whose three variables are all I(1);
    those of two variables are left out on both sides here and held against
    plain matrices in the tests.
    """
    out = ts.johansen(levels(spark, sf), ["series_id"], VARS, orders=integration_order(spark, sf))
    n = F.size("variables").cast("bigint")
    whole = {f"trace{i}": F.when(n == 3, F.get("trace", F.lit(i))) for i in range(3)}
    why = F.when((n != 2) | ~F.coalesce(F.col("reason") == "full rank", F.lit(False)), F.col("reason"))
    return out.withColumns(whole).select(
        "series_id", n.alias("n_i1"), "n_obs", F.col("rank").isNotNull().alias("tested"), why.alias("reason"),
        F.when(n == 3, F.col("rank")).alias("rank"), *whole)


# Validation ---------------------------------------------------------------------------------------------

SPLIT = ["series_id", "split"]


def _oos(spark, sf):
    return pn.validated(spark, sf)


@query("oos_index", "series_id date:d split oos_score:6 threshold:6", "SELECT * FROM oos")
def oos_index(spark, sf):
    return _oos(spark, sf)


cte("oos_parts", "SELECT *, abnormal_z60 AS z_resid, CASE WHEN date < DATE '2000-01-01' THEN 'TRAIN' ELSE 'TEST' END AS split FROM scored")


def _part(p: str) -> str:
    tr = "FILTER (WHERE split = 'TRAIN') OVER (PARTITION BY series_id)"
    f = f"COALESCE({p}, 0)"
    own = f"LEAST(GREATEST(({f} - AVG({f}) {tr}) / GREATEST(STDDEV_POP({f}) {tr}, 1e-9), -3.0), 3.0)"
    other = f"LEAST(GREATEST(({f} - AVG({p}) {tr}) / GREATEST(STDDEV_SAMP({p}) {tr}, 1e-9), -3.0), 3.0)"
    return f"CASE WHEN split = 'TRAIN' THEN {own} ELSE {other} END"


@query("oos_index_components", "series_id date:d split oos_score:6", f"""
SELECT *, {sigmoid(' + '.join(f'{w} * {_part(p)}' for p, w in zip(('z_volume', 'z_tone', 'z_resid'), ('0.25', '0.20', '0.20'))))} AS oos_score FROM oos_parts""")
def oos_index_components(spark, sf):
    df = pn.scored_panel(spark, sf).withColumn("z_resid", F.col("abnormal_z60"))
    return vd.oos_index_components(df, fx.BOUNDARY)


@query("train_calibration", "series_id n_train n_test threshold:6", """
SELECT series_id, COUNT(*) FILTER (WHERE split = 'TRAIN') AS n_train, COUNT(*) FILTER (WHERE split = 'TEST') AS n_test, MAX(threshold) AS threshold FROM oos GROUP BY 1""")
def train_calibration(spark, sf):
    return vd.train_calibration(_oos(spark, sf))


cte("shift_counts", """
SELECT series_id, oos_score AS v, COUNT(*) FILTER (WHERE split = 'TRAIN') AS a, COUNT(*) FILTER (WHERE split = 'TEST') AS b FROM (SELECT series_id, split, ROUND(oos_score, 9) AS oos_score FROM oos) GROUP BY 1, 2""")
cte("shift", """
SELECT *, u_stat FROM (SELECT series_id, MAX(na) AS n_train, MAX(nb) AS n_test, MAX(ABS(ca / na - cb / nb)) AS ks_stat,
  SUM(a * (ca + cb - a - b + (a + b + 1) / 2.0)) - MAX(na) * (MAX(na) + 1) / 2.0 AS u_stat, SUM(CAST(POW(a + b, 3) - (a + b) AS DOUBLE)) AS ties,
  SUM(v * a) / MAX(na) AS mean_train, SUM(v * b) / MAX(nb) AS mean_test
FROM (SELECT *, SUM(a) OVER (PARTITION BY series_id) AS na, SUM(b) OVER (PARTITION BY series_id) AS nb, SUM(a) OVER (PARTITION BY series_id ORDER BY v) AS ca, SUM(b) OVER (PARTITION BY series_id ORDER BY v) AS cb FROM shift_counts)
GROUP BY 1)""".replace("SELECT *, u_stat FROM", "SELECT * FROM").replace("ca / na - cb / nb", "CAST(ca AS DOUBLE) / na - CAST(cb AS DOUBLE) / nb"))
_EN = "SQRT(CAST(n_train AS DOUBLE) * n_test / (n_train + n_test)) * ks_stat"


@query("ks_mw", "series_id n_train:i n_test:i ks_stat:6 u_stat:1 mw_z:5 mean_train:6 mean_test:6 mean_diff:6 verdict ks_p:6 ks_p_kind mw_p:6", f"""
SELECT *, 'limiting' AS ks_p_kind, {chi2_tail('(GREATEST(mw_z, 0) * GREATEST(mw_z, 0))', '1')} AS mw_p FROM (
SELECT *, (GREATEST(u_stat, CAST(n_train AS DOUBLE) * n_test - u_stat) - CAST(n_train AS DOUBLE) * n_test / 2 - 0.5) /
  SQRT(CAST(n_train AS DOUBLE) * n_test / 12.0 * (n_train + n_test + 1 - ties / ((n_train + n_test) * (n_train + n_test - 1)))) AS mw_z,
  ABS(mean_test - mean_train) AS mean_diff, CASE WHEN ABS(mean_test - mean_train) < 0.03 THEN 'stable' WHEN ABS(mean_test - mean_train) < 0.07 THEN 'moderate' ELSE 'unstable' END AS verdict,
  CASE WHEN {_EN} < 0.2 THEN 1 ELSE LEAST(GREATEST(2 * list_sum(list_transform(range(1, 101), lambda k: POW(-1.0, k - 1) * EXP(-2 * POW(k * {_EN}, 2)))), 0), 1) END AS ks_p FROM shift)""")
def ks_mw(spark, sf):
    # Nine digits merge values that differ by rounding noise only.
    df = _oos(spark, sf).withColumn("oos_score", F.round("oos_score", 9))
    return vd.with_shift_pvalues(vd.distribution_shift(df, "oos_score", ["series_id"]))


cte("performance_split", f"""
SELECT series_id, split, COUNT(*) AS n, MAX(sl) AS slope, MAX(ic) AS intercept, POW(CORR(oos_score, y), 2) AS r2, {r_sql('oos_score', 'y', 10)} AS r,
       SQRT(AVG(POW(y - (sl * oos_score + ic), 2))) AS rmse, AVG(ABS(y - (sl * oos_score + ic))) AS mae
FROM (SELECT *, REGR_SLOPE(y, oos_score) OVER (PARTITION BY series_id, split) AS sl, REGR_INTERCEPT(y, oos_score) OVER (PARTITION BY series_id, split) AS ic
      FROM (SELECT series_id, split, oos_score, COALESCE(excess_effect, 0) AS y FROM oos)) GROUP BY 1, 2""")


@query("linear_fit", "series_id split n slope:0 intercept:0 r2:6 rmse:1 mae:1", "SELECT * FROM performance_split WHERE n >= 11")
def linear_fit(spark, sf):
    df = _oos(spark, sf).withColumn("excess_effect", F.coalesce("excess_effect", F.lit(0.0)))
    return ag.linear_fit(df, "oos_score", "excess_effect", SPLIT)


@query("predictive_performance", "series_id split n r:6 r2:6 rmse:1 mae:1 r2_loss_pct:3", """
SELECT *, CASE WHEN tr > 0 THEN 100.0 * (tr - te) / tr END AS r2_loss_pct FROM (SELECT *, MAX(r2) FILTER (WHERE split = 'TRAIN') OVER (PARTITION BY series_id) AS tr,
  MAX(r2) FILTER (WHERE split = 'TEST') OVER (PARTITION BY series_id) AS te FROM performance_split)""")
def predictive_performance(spark, sf):
    return vd.predictive_performance(_oos(spark, sf))


cte("walk_rows", f"""
SELECT *, COALESCE(excess_effect, 0) AS y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) - 1 AS place, COUNT(*) OVER (PARTITION BY series_id) AS total FROM proxied)""")
cte("walk_stats", f"""
SELECT series_id, k AS block, {', '.join(f'AVG({p}) AS {p}_mu, STDDEV_POP({p}) AS {p}_sd' for p in PX)}
FROM walk_rows JOIN (SELECT UNNEST(RANGE(0, 2000)) AS k) b ON place BETWEEN 30 * k AND 30 * k + 364 AND 30 * k < total - 395 GROUP BY 1, 2""")
cte("walk", f"""
SELECT *, r * r AS r2, CASE WHEN test_start >= DATE '2000-01-01' THEN 'TEST' ELSE 'TRAIN_PERIOD' END AS period FROM (
SELECT series_id, block, MIN(date) AS test_start, MAX(date) AS test_end, COUNT(*) AS n_test, {r_sql('roll', 'y', 10)} AS r FROM (
  SELECT w.series_id, s.block, w.date, w.y, {sigmoid(' + '.join(f"{w} * {zt(p, f'{p}_mu', f'{p}_sd')}" for p, w in zip(PX, ('0.25', '0.20', '0.20'))))} AS roll
  FROM walk_rows w JOIN walk_stats s ON s.series_id = w.series_id AND s.block = (w.place - 365) // 30 AND w.place >= 365) GROUP BY 1, 2)""")


@query("walk_forward", "series_id block:i test_start:d test_end:d n_test r:6 r2:6 period", "SELECT * FROM walk")
def walk_forward(spark, sf):
    return vd.walk_forward(pn.scored_panel(spark, sf), fx.BOUNDARY)


@query("walk_forward_year", "series_id year:i n_windows mean_r:6 significant_pct:4", f"""
SELECT series_id, YEAR(test_start) AS year, COUNT(*) AS n_windows, AVG(r) AS mean_r, 100.0 * AVG(CAST(COALESCE(p < 0.05, FALSE) AS INTEGER)) AS significant_pct
FROM (SELECT *, {corr_tail('r', 'n_test')} AS p FROM walk) GROUP BY 1, 2""")
def walk_forward_year(spark, sf):
    return vd.yearly_rollup(walk_forward(spark, sf))


@query("regime_stability", "series_id split regime n_days score_mean:6 r:6", f"""
SELECT series_id, split, regime, COUNT(*) AS n_days, AVG(oos_score) AS score_mean, {r_sql('oos_score', 'y', 10)} AS r
FROM (SELECT *, COALESCE(excess_effect, 0) AS y, CASE WHEN logret > 0.01 THEN 'bull' WHEN logret < -0.01 THEN 'bear' ELSE 'flat' END AS regime FROM (SELECT * EXCLUDE (regime) FROM oos) WHERE logret IS NOT NULL)
GROUP BY 1, 2, 3 HAVING COUNT(*) >= 20""")
def regime_stability(spark, sf):
    return vd.regime_stability(_oos(spark, sf))


# Benchmark ----------------------------------------------------------------------------------------------------

cte("bench", """
SELECT *, bench_value / 100.0 AS bench_norm FROM (SELECT CAST(l_shipdate AS DATE) AS date, (SUM(CAST(l_linenumber AS BIGINT)) * 7 + COUNT(*)) % 101 AS bench_value FROM lineitem GROUP BY 1)""")
cte("bench_panel", "SELECT s.*, b.bench_value, CAST(b.bench_norm AS DOUBLE) AS bench_norm FROM scored s LEFT JOIN bench b USING (date)")


def bench_panel(spark, sf):
    return jn.attach_signal(pn.scored_panel(spark, sf), fx.benchmark(spark, sf))


_O, _R = "COALESCE(excess_effect, 0)", "COALESCE(logret, 0)"
_BR = "RANK() OVER (PARTITION BY series_id ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY series_id, {x}) - 1) / 2.0"
cte("inc_r2", f"""
SELECT series_id, n, POW(r2, 2) AS r2_single, (POW(r1, 2) + POW(r2, 2) - 2 * r1 * r2 * r12) / (1 - POW(r12, 2)) AS r2_both,
       CASE WHEN n >= 51 THEN GREATEST((POW(r1, 2) + POW(r2, 2) - 2 * r1 * r2 * r12) / (1 - POW(r12, 2)) - POW(r2, 2), 0) END AS incremental_r2
FROM (SELECT series_id, COUNT(*) AS n, CORR(score, {_O}) AS r1, CORR(bench_norm, {_O}) AS r2, CORR(score, bench_norm) AS r12 FROM bench_panel WHERE bench_norm IS NOT NULL GROUP BY 1)""")


@query("benchmark_compare", "series_id n_overlap r_pair:6 rho_pair:6 r_score_outcome:6 r_bench_outcome:6 r_score_return:6 r_bench_return:6 advantage:6 incremental_r2:6", f"""
SELECT *, r_score_outcome - r_bench_outcome AS advantage FROM (
  SELECT series_id, COUNT(*) AS n_overlap, {r_sql('score', 'bench_norm', 20)} AS r_pair, {r_sql('score', _O, 20)} AS r_score_outcome, {r_sql('bench_norm', _O, 20)} AS r_bench_outcome,
         {r_sql('score', _R, 20)} AS r_score_return, {r_sql('bench_norm', _R, 20)} AS r_bench_return, CORR(ra, rb) AS rho_pair
  FROM (SELECT *, {_BR.format(x='score')} AS ra, {_BR.format(x='bench_norm')} AS rb FROM bench_panel WHERE bench_norm IS NOT NULL) GROUP BY 1) JOIN inc_r2 USING (series_id)""")
def benchmark_compare(spark, sf):
    return vd.benchmark_compare(bench_panel(spark, sf), ["series_id"])


@query("incremental_r2", "series_id n r2_single:6 r2_both:6 incremental_r2:6", "SELECT * FROM inc_r2")
def incremental_r2(spark, sf):
    df = bench_panel(spark, sf).withColumn("y", F.coalesce("excess_effect", F.lit(0.0)))
    return ag.incremental_r2(df, "y", "score", "bench_norm", ["series_id"])


@query("benchmark_zones", "zone days pct:5", f"""
SELECT zone, days, 100.0 * days / SUM(days) OVER () AS pct FROM (SELECT {bins('bench_value', (25, 45, 55, 75), ('Extreme Fear', 'Fear', 'Neutral', 'Greed', 'Extreme Greed'))} AS zone, COUNT(*) AS days FROM bench GROUP BY 1)""")
def benchmark_zones(spark, sf):
    return ag.zone_distribution(fx.benchmark(spark, sf).withColumn("zone", benchmark_zone(F.col("bench_value"))), "zone")


cte("granger_bench", granger_sql("bench_panel", "gb", [("score", "logret"), ("bench_norm", "logret"), ("score", "excess_effect"), ("bench_norm", "excess_effect")], (1, 2, 3, 5)))


@query("granger_benchmark", "series_id x_name y_name lag:i n f_stat:5 f_p:6", "SELECT * FROM granger_bench")
def granger_benchmark(spark, sf):
    pairs = [("score", "logret"), ("bench_norm", "logret"), ("score", "excess_effect"), ("bench_norm", "excess_effect")]
    return ts.granger(bench_panel(spark, sf), ["series_id"], pairs, (1, 2, 3, 5))


# Back-test --------------------------------------------------------------------------------------------------------

cte("strategy", f"""
SELECT series_id, date, rule, position, score, threshold, logret AS ret, position * logret AS strategy_ret FROM (
  SELECT s.series_id, s.date, s.score, s.logret, t.threshold, r.rule,
         CASE WHEN r.rule = 'hold' THEN 1.0 ELSE CASE WHEN LAG(s.score) OVER (PARTITION BY s.series_id, r.rule ORDER BY s.date) < t.threshold THEN r.below
              WHEN LAG(s.score) OVER (PARTITION BY s.series_id, r.rule ORDER BY s.date) IS NOT NULL THEN r.above END END AS position
  FROM scored s JOIN (SELECT series_id, QUANTILE_CONT(score, 0.7) AS threshold FROM scored WHERE logret IS NOT NULL GROUP BY 1) t USING (series_id)
  CROSS JOIN (VALUES ('hold', 1.0, 1.0), ('long_short', 1.0, -1.0), ('long_only', 1.0, 0.0), ('cash_on_high', 1.0, 0.0)) r(rule, below, above) WHERE s.logret IS NOT NULL)
WHERE position IS NOT NULL""")
_sw = "(PARTITION BY series_id, rule ORDER BY date ROWS UNBOUNDED PRECEDING)"
cte("strategy_perf", f"""
SELECT series_id, rule, SUM(strategy_ret) AS total_return, CASE WHEN COUNT(*) >= 2 THEN AVG(strategy_ret) / NULLIF(STDDEV_POP(strategy_ret), 0) * SQRT(365) END AS sharpe,
       MIN(cum - peak) AS max_drawdown, COUNT(*) FILTER (WHERE strategy_ret <> 0) AS active_days
FROM (SELECT *, MAX(cum) OVER {_sw} AS peak FROM (SELECT *, SUM(strategy_ret) OVER {_sw} AS cum FROM strategy)) GROUP BY 1, 2""")


def _strategy(spark, sf):
    return bt.strategy_returns(bt.prepare_returns(pn.scored_panel(spark, sf)))


@query("strategy_returns", "series_id date:d rule position:1 strategy_ret:6 threshold:6", "SELECT * FROM strategy")
def strategy_returns(spark, sf):
    return _strategy(spark, sf)


@query("strategy_performance", "series_id rule total_return:6 sharpe:6 max_drawdown:6 active_days", "SELECT * FROM strategy_perf")
def strategy_performance(spark, sf):
    return bt.performance(_strategy(spark, sf), ["series_id", "rule"])


@query("strategy_vs_hold", "series_id rule better_sharpe lower_drawdown", """
SELECT p.series_id, p.rule, COALESCE(p.sharpe > h.sharpe, FALSE) AS better_sharpe, COALESCE(ABS(p.max_drawdown) < ABS(h.max_drawdown), FALSE) AS lower_drawdown
FROM strategy_perf p JOIN strategy_perf h ON h.series_id = p.series_id AND h.rule = 'hold' WHERE p.rule <> 'hold'""")
def strategy_vs_hold(spark, sf):
    return bt.compare_to_hold(strategy_performance(spark, sf))

