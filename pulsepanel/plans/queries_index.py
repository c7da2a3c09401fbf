"""Queries on the index, zones, scored days and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsepanel.functions import clean as cl
from pulsepanel.functions import index as ix
from pulsepanel.operators import aggregates as ag
from pulsepanel.operators import scoring as sc
from pulsepanel.operators.timeseries import primary_preset
from pulsepanel.plans import fixtures as fx
from pulsepanel.plans import panels as pn
from pulsepanel.plans.oracle import ALARM, BOUNDS, PRESSURE, bins, clip3, cte, sigmoid
from pulsepanel.plans.registry import query


def _score_sql(source: str, mu_m: str, sd_m: str, mu_t: str, sd_t: str) -> str:
    z1, z2 = clip3(f"(mentions - {mu_m}) / {sd_m}"), clip3(f"(tone - {mu_t}) / {sd_t}")
    return f"""SELECT *, {sigmoid('0.25 * z_volume + 0.20 * z_tone')} AS score
        FROM (SELECT *, {z1} AS z_volume, {z2} AS z_tone FROM {source})"""


cte("train_scored", _score_sql("media_signal", "312.4", "274.1", "(-0.8834)", "0.6912"))
cte("calibrated", _score_sql("""(SELECT *, AVG(mentions) OVER (PARTITION BY preset) AS mm, STDDEV_POP(mentions) OVER (PARTITION BY preset) AS ms,
    AVG(tone) OVER (PARTITION BY preset) AS tm, STDDEV_POP(tone) OVER (PARTITION BY preset) AS td FROM media_signal)""", "mm", "ms", "tm", "td"))


def _calibrated(spark, sf):
    """Signals scored on each preset's own days (presets are calendar-bounded)."""
    return sc.score_days(fx.media_signal(spark, sf), "preset", labels=ix.PRESSURE_LABELS)


@query("index_daily", "preset date:d score:6 z_volume:6 z_tone:6", "SELECT * FROM train_scored")
def index_daily(spark, sf):
    r = ix.pressure_result(F.col("mentions").cast("double"), F.col("tone"))
    df = fx.media_signal(spark, sf)
    return df.select("preset", "date", ix.pressure_index_train(F.col("mentions").cast("double"), F.col("tone")).alias("score"), r.alias("r")).select(
        "preset", "date", "score", "r.z_volume", "r.z_tone")


@query("index_zone", "preset date:d score:6 zone short", f"""
SELECT *, {bins('score', BOUNDS, PRESSURE)} AS zone, {bins('score', BOUNDS, ('Minimal', 'Baseline', 'Elevated', 'High', 'Extreme'))} AS short FROM calibrated""")
def index_zone(spark, sf):
    return _calibrated(spark, sf).withColumn("short", ix.zone_short(F.col("score")))


@query("index_zone_details", "preset zone days lower:3 upper:3 description note", """
SELECT preset, v.zone, COUNT(*) AS days, lower, upper, description, note FROM calibrated JOIN (VALUES
  ('MINIMAL', 0.0, 0.47, 'Coverage is lighter than usual and prices move on their own.', 'Lower quarter of the calibration sample.'),
  ('BASELINE', 0.47, 0.53, 'Ordinary coverage without unusual pressure.', 'Between the 25th and 60th percentile of the calibration sample.'),
  ('ELEVATED', 0.53, 0.59, 'Coverage is heavier than usual and prices react more.', 'Between the 60th and 75th percentile of the calibration sample.'),
  ('HIGH', 0.59, 0.65, 'Coverage is much heavier than usual; reversals become likely.', 'Between the 75th and 95th percentile of the calibration sample.'),
  ('EXTREME', 0.65, 1.001, 'Coverage is in its top twentieth; the excess fades within days.', 'Above the 95th percentile of the calibration sample.')
) v(zone, lower, upper, description, note) ON calibrated.score >= v.lower AND calibrated.score < v.upper GROUP BY 1, 2, 4, 5, 6, 7""")
def index_zone_details(spark, sf):
    return sc.zone_details(ag.zone_distribution(_calibrated(spark, sf), "zone", "preset"))


_PCT = "CASE " + " ".join(f"WHEN score <= {e} THEN {p}" for e, p in ix.PERCENTILE_BREAKS) + " ELSE 99 END"


@query("index_percentile", "preset percentile top_pct days", f"""
SELECT preset, percentile, 100 - percentile AS top_pct, COUNT(*) AS days FROM (SELECT preset, {_PCT} AS percentile FROM calibrated) GROUP BY 1, 2""")
def index_percentile(spark, sf):
    p = ix.historic_percentile(F.col("score"))
    return _calibrated(spark, sf).groupBy("preset", p.alias("percentile")).agg(F.count(F.lit(1)).alias("days")).withColumn(
        "top_pct", 100 - F.col("percentile"))


@query("zone_distribution", "preset zone days pct:4", f"""
SELECT preset, zone, days, 100.0 * days / SUM(days) OVER (PARTITION BY preset) AS pct
FROM (SELECT preset, {bins('score', BOUNDS, PRESSURE)} AS zone, COUNT(*) AS days FROM calibrated GROUP BY 1, 2)""")
def zone_distribution(spark, sf):
    return ag.zone_distribution(_calibrated(spark, sf), "zone", "preset")


@query("calibration", "preset mu_mentions:6 sd_mentions:6 mu_tone:6 sd_tone:6", """
SELECT preset, AVG(mentions) AS mu_mentions, GREATEST(STDDEV_POP(mentions), 1e-6) AS sd_mentions, AVG(tone) AS mu_tone,
       GREATEST(STDDEV_POP(tone), 1e-6) AS sd_tone FROM media_signal GROUP BY 1""")
def calibration(spark, sf):
    return sc.calibration(fx.media_signal(spark, sf), ["preset"])


@query("anomalous_days", "preset date:d score:6 extreme", f"""
SELECT *, zone = 'EXTREME' AS extreme FROM (SELECT *, {bins('score', BOUNDS, PRESSURE)} AS zone FROM calibrated) WHERE zone IN ('HIGH', 'EXTREME')""")
def anomalous_days(spark, sf):
    return _calibrated(spark, sf).filter(ix.is_anomalous(F.col("zone"))).withColumn("extreme", ix.is_extreme(F.col("zone")))


@query("score_panel", "series_id date:d mentions_used:6 tone_used:6 z_volume:6 z_tone:6 score:6 zone", "SELECT * FROM scored")
def score_panel(spark, sf):
    return pn.scored_panel(spark, sf)


@query("excess_effect", "series_id date:d raw_abs_effect:1 excess_effect:1 media_share_pct:3", "SELECT * FROM scored")
def excess_effect(spark, sf):
    return pn.scored_panel(spark, sf)


@query("source_totals", "raw_abs_media_effect:0 excess_effect:0 avg_score:6 avg_media_share_pct:3 n_days n_manipulation n_alert n_elevated excess_share_pct:5", f"""
SELECT *, 100.0 * excess_effect / (raw_abs_media_effect + 1e-9) AS excess_share_pct FROM (
SELECT SUM(ABS(effect_used)) AS raw_abs_media_effect, SUM(excess_effect) AS excess_effect, AVG(score) AS avg_score,
       AVG(media_share_pct) AS avg_media_share_pct, COUNT(*) AS n_days,
       {', '.join(f"COUNT(*) FILTER (WHERE zone = '{z}') AS n_{z.lower()}" for z in (ALARM[4], ALARM[3], ALARM[2]))} FROM scored)""")
def source_totals(spark, sf):
    return ag.source_totals(pn.scored_panel(spark, sf))


def _preset_sql(signals: str) -> str:
    """The first preset in order that has more than 100 known days."""
    return f"""
SELECT preset, COUNT(*) AS days, AVG(mentions) AS mentions_mean FROM {signals} WHERE preset = (
  SELECT preset FROM (SELECT preset, COUNT(mentions) AS n FROM {signals} GROUP BY 1)
  JOIN (VALUES ('balanced', 1), ('sensitive', 2), ('strong', 3)) AS o(preset, place) USING (preset) WHERE n >= 101 ORDER BY place LIMIT 1) GROUP BY 1"""


def _primary(signals):
    picked = primary_preset(signals, ["balanced", "sensitive", "strong"], 101)
    return picked.groupBy("preset").agg(F.count(F.lit(1)).alias("days"), F.avg("mentions").alias("mentions_mean"))


@query("primary_preset", "preset days mentions_mean:6", _preset_sql("media_signal"))
def primary_preset_query(spark, sf):
    return _primary(pn.signals(spark, sf))


cte("thin_signal", """
SELECT preset, date, tone, CASE WHEN preset <> 'balanced' OR date < DATE '1995-03-01' THEN mentions END AS mentions FROM media_signal""")


@query("primary_preset_fallback", "preset days mentions_mean:6", _preset_sql("thin_signal"))
def primary_preset_fallback(spark, sf):
    """The preferred preset has two months of data only, so the next one is taken."""
    known = (F.col("preset") != "balanced") | (F.col("date") < F.to_date(F.lit("1995-03-01")))
    return _primary(pn.signals(spark, sf).withColumn("mentions", F.when(known, F.col("mentions"))))


# Feature panels ---------------------------------------------------------------------

from pulsepanel.operators.features import context_features, feature_names  # noqa: E402

_NAMES = feature_names("")


@query("news_features_87", "series_id date:d " + " ".join(f"{n}:5" for n in _NAMES), "SELECT * FROM news_panel")
def news_features_87(spark, sf):
    return pn.news_panel(spark, sf)


@query("context_features", "series_id date:d weekday:i month:i is_weekend:1 abnormal_x_volatility:6 abnormal_x_regime:6 has_news:1 has_bad_news:1", """
SELECT series_id, date, ISODOW(date) - 1 AS weekday, MONTH(date) AS month, CAST(ISODOW(date) >= 6 AS INTEGER) AS is_weekend,
       COALESCE(abnormal_logret, 0) * COALESCE(vol_30, 0) AS abnormal_x_volatility, COALESCE(abnormal_logret, 0) * COALESCE(regime, 0) AS abnormal_x_regime,
       CAST(news_mentions > 0 AS INTEGER) AS has_news, CAST(news_bad_intensity > 0 AS INTEGER) AS has_bad_news FROM news_panel""")
def context_features_query(spark, sf):
    return context_features(pn.news_panel(spark, sf), "")


@query("news_flags", "series_id days attention weekend bad_news", """
SELECT series_id, COUNT(*) AS days, CAST(SUM(news_extreme_attention) AS BIGINT) AS attention, CAST(SUM(news_weekend) AS BIGINT) AS weekend,
       COUNT(*) FILTER (WHERE news_bad_intensity > 0) AS bad_news FROM news_panel GROUP BY 1""")
def news_flags(spark, sf):
    return pn.news_panel(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("news_extreme_attention").cast("bigint").alias("attention"),
        F.sum("news_weekend").cast("bigint").alias("weekend"), F.count_if(F.col("news_bad_intensity") > 0).alias("bad_news"))


# Models ------------------------------------------------------------------------------

from pulsepanel.operators import models as md  # noqa: E402
from pulsepanel.plans.oracle import RIDGE, _XS, news_sql, solver  # noqa: E402

_FRAME = " ".join(f"{x}:6" for x in _XS)


@query("model_frame", f"series_id date:d logret:6 {_FRAME}", "SELECT * FROM model_frame")
def model_frame(spark, sf):
    return pn.model_frame(spark, sf)


@query("baseline_ols", "series_id date:d expected_logret:6 abnormal_logret:6 abnormal_z60:6 return_pct:4 expected_return_pct:4 abnormal_return_pct:4", "SELECT * FROM baseline")
def baseline_ols(spark, sf):
    return pn.baseline_panel(spark, sf)


cte("ols_stats", """
SELECT *, 1 - ssr / sst AS r2, 1 - (ssr / sst) * (n - 1) / (n - k) AS adj_r2,
       n * (LN(2 * PI()) + LN(ssr / n) + 1) + 2 * k AS aic, n * (LN(2 * PI()) + LN(ssr / n) + 1) + k * LN(n) AS bic
FROM (SELECT series_id, COUNT(*) AS n, 14 AS k, SUM(abnormal_logret * abnormal_logret) AS ssr, COUNT(*) * VAR_POP(logret) AS sst FROM baseline GROUP BY 1)""")


@query("ols_summary", "series_id n r2:6 adj_r2:6 aic:4 bic:4", "SELECT * FROM ols_stats")
def ols_summary(spark, sf):
    return md.fit_ols(pn.model_frame(spark, sf), "logret", md.baseline_features(), ["series_id"])


@query("ols_coefficients", "series_id feature coefficient:6", f"""
SELECT series_id, UNNEST([{', '.join(repr(x) for x in ['const', *_XS])}]) AS feature, UNNEST(w) AS coefficient FROM ols_fit""")
def ols_coefficients(spark, sf):
    fits = md.fit_ols(pn.model_frame(spark, sf), "logret", md.baseline_features(), ["series_id"])
    names = F.array(*[F.lit(n) for n in ["const", *md.baseline_features()]])
    return fits.select("series_id", F.explode(F.arrays_zip(names.alias("feature"), F.col("beta"))).alias("c")).select(
        "series_id", F.col("c.feature").alias("feature"), F.col("c.beta").alias("coefficient"))


@query("ridge_effect", "series_id date:d segment:i media_logret:6 media_logret_oof:6", "SELECT * FROM effect")
def ridge_effect(spark, sf):
    return pn.effect_panel(spark, sf)


@query("media_effect", "series_id date:d media_effect:1 media_effect_oof:1 media_effect_abs:1 media_share_of_move:4", "SELECT * FROM effect")
def media_effect(spark, sf):
    return pn.scored_panel(spark, sf)


@query("cv_oof", "series_id fold n_train n_test", """
SELECT r.series_id, r.fold, r.n_train, f.n_test FROM ridge r
JOIN (SELECT series_id, segment, COUNT(*) AS n_test FROM folded GROUP BY 1, 2) f ON f.series_id = r.series_id AND f.segment = r.fold WHERE r.fold > 0
""".replace("r.fold, r.n_train", "CAST(r.fold AS INTEGER) AS fold, r.n_train"))
def cv_oof(spark, sf):
    folds = pn.ridge_fits(spark, sf).select("series_id", F.explode("folds").alias("f")).select(
        "series_id", F.col("f.fold").alias("fold"), F.col("f.n").alias("n_train"))
    tests = pn.scored_panel(spark, sf).groupBy("series_id", F.col("segment").alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    return folds.filter(F.col("fold") > 0).join(tests, ["series_id", "fold"])


_METRICS = """COUNT(*) AS n, AVG(ABS(y - p)) AS mae, SQRT(AVG((y - p) * (y - p))) AS rmse, 1 - SUM((y - p) * (y - p)) / NULLIF(COUNT(*) * VAR_POP(y), 0) AS r2"""
cte("fold_metrics", f"""
SELECT series_id, segment, {_METRICS} FROM (SELECT series_id, segment, abnormal_logret AS y, media_logret_oof AS p FROM effect) WHERE p IS NOT NULL GROUP BY 1, 2""")


@query("cv_fold_metrics", "series_id segment:i n mae:6 rmse:6 r2:6", "SELECT * FROM fold_metrics")
def cv_fold_metrics(spark, sf):
    return md.regression_metrics(pn.scored_panel(spark, sf), "abnormal_logret", "media_logret_oof", ["series_id", "segment"])


@query("cv_metrics", "series_id folds mae_mean:6 rmse_mean:6 r2_mean:6 mae_std:6 rmse_std:6 r2_std:6", f"""
SELECT series_id, COUNT(*) AS folds, {', '.join(f'AVG({m}) AS {m}_mean, STDDEV_POP({m}) AS {m}_std' for m in ('mae', 'rmse', 'r2'))} FROM fold_metrics GROUP BY 1""")
def cv_metrics(spark, sf):
    return md.cv_summary(cv_fold_metrics(spark, sf), ["series_id"])


@query("in_sample_metrics", "series_id n mae:6 rmse:6 r2:6", f"""
SELECT series_id, {_METRICS} FROM (SELECT series_id, abnormal_logret AS y, media_logret AS p FROM effect) GROUP BY 1""")
def in_sample_metrics(spark, sf):
    return md.regression_metrics(pn.scored_panel(spark, sf), "abnormal_logret", "media_logret", ["series_id"])


@query("coef_table", "series_id feature coef:6 coef_abs:6 mean:6 scale:6", f"""
SELECT *, ABS(coef) AS coef_abs FROM (SELECT series_id, UNNEST([{', '.join(repr(x) for x in RIDGE)}]) AS feature,
  UNNEST(list_transform(w, lambda v, i: v * sd[i])) AS coef, UNNEST(mu) AS mean, UNNEST(sd) AS scale FROM ridge WHERE fold = 0)""")
def coef_table(spark, sf):
    return md.coefficient_table(pn.ridge_fits(spark, sf), ["series_id"], pn.RIDGE_FEATURES)


# Feature screening over all four streams ------------------------------------------------

_wide = "wide_input"
cte("wide_input", "SELECT b.series_id, b.date, b.mcap, b.abnormal_logret, b.abnormal_usd, " + ", ".join(
    f"s.{v}_{p} AS news_{v}{k}" for k, p in pn.STREAMS.items() for v in ("mentions", "tone")) +
    " FROM baseline b LEFT JOIN wide_signal s USING (date)")
for _s in pn.STREAMS:
    cte(f"wide{_s}", news_sql(_wide, _s))
    _wide = f"wide{_s}"
_CANDS = pn.candidate_features()
cte("screen", f"""
SELECT series_id, feature, pos, AVG(CAST(x IS NOT NULL AS INTEGER)) AS non_null, STDDEV_POP(COALESCE(x, 0)) AS spread,
       COUNT(x) AS n_pairs, CASE WHEN COUNT(x) >= 50 AND STDDEV_POP(x) > 0 THEN CORR(x, y) END AS r
FROM (SELECT series_id, y, UNNEST([{', '.join(repr(c) for c in _CANDS)}]) AS feature, UNNEST(RANGE({len(_CANDS)})) AS pos,
             UNNEST([{', '.join(f'CAST({c} AS DOUBLE)' for c in _CANDS)}]) AS x
      FROM (SELECT *, abnormal_logret AS y FROM {_wide}))
GROUP BY 1, 2, 3""")


def _named(df):
    names = F.array(*[F.lit(c) for c in _CANDS])
    return df.withColumn("feature", F.get(names, F.col("pos")))


@query("feature_filter", "series_id feature non_null:6 spread:5 usable", "SELECT *, non_null >= 0.8 AND spread > 0 AS usable FROM screen")
def feature_filter(spark, sf):
    df = _named(pn.screened(spark, sf))
    return df.withColumn("usable", (F.col("non_null") >= 0.8) & (F.col("spread") > 0))


@query("feature_top_k", "series_id feature place:i r_abs:6", """
SELECT *, ABS(r) AS r_abs FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ROUND(ABS(r), 12) DESC, pos) AS place FROM screen
  WHERE non_null >= 0.8 AND spread > 0 AND r IS NOT NULL) WHERE place <= 60""")
def feature_top_k(spark, sf):
    return _named(pn.selected(spark, sf)).withColumn("r_abs", F.abs("r"))


# The screened fit in SQL: selected vectors, one matrix per fold, greedy pruning, elimination.
K = 60
cte("chosen", f"""
SELECT series_id, LIST(pos ORDER BY place) AS pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY ROUND(ABS(r), 12) DESC, pos) AS place FROM screen
  WHERE non_null >= 0.8 AND spread > 0 AND r IS NOT NULL) WHERE place <= {K} GROUP BY 1""")
cte("picked", f"""
SELECT series_id, date, mcap, abnormal_logret, CASE WHEN rn <= n - 5 * (n // 6) THEN 0 ELSE 1 + (rn - 1 - (n - 5 * (n // 6))) // (n // 6) END AS segment,
       LEN(pos) AS used, list_concat([1.0::DOUBLE], list_transform(range(1, {K + 1}), lambda i: CASE WHEN i <= LEN(pos) THEN COALESCE(f[pos[i] + 1], 0) ELSE 0 END), [abnormal_logret]) AS v
FROM (SELECT series_id, date, mcap, abnormal_logret, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _CANDS)}] AS f,
        ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn, COUNT(*) OVER (PARTITION BY series_id) AS n FROM {_wide} WHERE abnormal_logret IS NOT NULL)
JOIN chosen USING (series_id)""")
_half = ", ".join(f"SUM(v[{a}] * v[{b}])" for a in range(1, K + 3) for b in range(a, K + 3))
_at = f"(least(i, j) - 1) * {K + 2} - ((least(i, j) - 1) * (least(i, j) - 2)) // 2 + greatest(i, j) - least(i, j) + 1"
cte("picked_half", f"SELECT series_id, segment, MAX(used) AS used, [{_half}] AS h FROM picked GROUP BY 1, 2")
cte("picked_gram", f"""
SELECT series_id, fold, MAX(used) AS used, [{', '.join(f'SUM(h[{a}])' for a in range(1, (K + 2) * (K + 3) // 2 + 1))}] AS h
FROM picked_half JOIN (SELECT UNNEST(RANGE(6)) AS fold) k ON fold = 0 OR segment < fold GROUP BY 1, 2""")
cte("picked_full", f"SELECT series_id, fold, used, list_transform(range(1, {K + 3}), lambda i: list_transform(range(1, {K + 3}), lambda j: h[{_at}])) AS g FROM picked_gram")
cte("picked_corr", f"""
SELECT series_id, used, list_transform(range(1, {K + 3}), lambda i: list_transform(range(1, {K + 3}), lambda j:
  ROUND(COALESCE(ABS(g[i][j] / g[1][1] - g[1][i] * g[1][j] / (g[1][1] * g[1][1])) / NULLIF(SQRT(GREATEST(g[i][i] / g[1][1] - POW(g[1][i] / g[1][1], 2), 0)
  * GREATEST(g[j][j] / g[1][1] - POW(g[1][j] / g[1][1], 2), 0)), 0), 0), 12))) AS r FROM picked_full WHERE fold = 0""")
cte("close_pairs", f"""
SELECT series_id, used, list_transform(r, lambda q: q[{K + 2}]) AS tgt,
       list_filter(list_transform(range(0, {K * K}), lambda t: [t // {K} + 1, t % {K} + 1]), lambda p: p[1] < p[2] AND p[2] <= used AND r[p[1] + 1][p[2] + 1] >= 0.97) AS pairs FROM picked_corr""")
cte("pruning", f"""
SELECT series_id, 0 AS step, pairs, tgt, list_transform(range(1, {K + 1}), lambda i: i <= used) AS alive FROM close_pairs
UNION ALL SELECT series_id, step + 1, pairs, tgt, CASE WHEN alive[pairs[step + 1][1]] AND alive[pairs[step + 1][2]] THEN
  list_transform(alive, lambda a, k: a AND k <> CASE WHEN tgt[pairs[step + 1][1] + 1] >= tgt[pairs[step + 1][2] + 1] THEN pairs[step + 1][2] ELSE pairs[step + 1][1] END) ELSE alive END
FROM pruning WHERE step < LEN(pairs)""", keep=False)
cte("kept", "SELECT series_id, alive FROM pruning WHERE step = LEN(pairs)")
cte("screened_live", f"""
SELECT series_id, fold, used, g, alive, list_transform(alive, lambda a, i: a AND g[i + 1][i + 1] - g[1][i + 1] * g[1][i + 1] / g[1][1] > 1e-12 * g[i + 1][i + 1]) AS live
FROM picked_full JOIN kept USING (series_id)""")
cte("screened_system", f"""
SELECT series_id, fold, list_transform(live, lambda a, i: list_concat(
  list_transform(live, lambda b, j: CASE WHEN a AND b THEN (g[i + 1][j + 1] - g[1][i + 1] * g[1][j + 1] / g[1][1]) * CASE WHEN i = j THEN 1 + 10.0 / g[1][1] ELSE 1 END WHEN i = j THEN 1.0 ELSE 0.0 END),
  [CASE WHEN a THEN g[i + 1][{K + 2}] - g[1][i + 1] * g[1][{K + 2}] / g[1][1] ELSE 0.0 END])) AS m FROM screened_live""")
solver("screened_fit", "screened_system", "series_id, fold", K)
cte("screened_ridge", f"""
SELECT series_id, fold, w, g, alive, live, (g[1][{K + 2}] - list_sum(list_transform(w, lambda x, i: x * g[1][i + 1]))) / g[1][1] AS icept FROM screened_fit JOIN screened_live USING (series_id, fold)""")
cte("screened_effect", f"""
SELECT *, media_logret * COALESCE(mcap, 0) AS media_effect, media_logret_oof * COALESCE(mcap, 0) AS media_effect_oof FROM (
SELECT p.*, a.icept + list_sum(list_transform(a.w, lambda x, i: x * v[i + 1])) AS media_logret, b.icept + list_sum(list_transform(b.w, lambda x, i: x * v[i + 1])) AS media_logret_oof
FROM picked p JOIN screened_ridge a ON a.series_id = p.series_id AND a.fold = 0 LEFT JOIN screened_ridge b ON b.series_id = p.series_id AND b.fold = p.segment AND p.segment > 0)""")


@query("feature_pruned", "series_id n_chosen:i n_kept:i", "SELECT series_id, LEN(pos) AS n_chosen, LEN(list_filter(alive, lambda a: a)) AS n_kept FROM kept JOIN chosen USING (series_id)")
def feature_pruned(spark, sf):
    fits = pn.news_effect(spark, sf)[1]
    return fits.select("series_id", F.size("chosen").alias("n_chosen"), F.size("kept").alias("n_kept"))


@query("news_effect", "series_id date:d segment:i media_logret:6 media_logret_oof:6 media_effect:0 media_effect_oof:0", "SELECT * FROM screened_effect")
def news_effect(spark, sf):
    return pn.news_effect(spark, sf)[0]


@query("news_effect_coefficients", "series_id feature coef:6 coef_abs:6 mean:5 scale:5", f"""
SELECT *, ABS(coef) AS coef_abs FROM (SELECT series_id, [{', '.join(repr(c) for c in _CANDS)}][pos[i] + 1] AS feature, g[1][i + 1] / g[1][1] AS mean, w[i] * sd AS coef, sd AS scale FROM (
  SELECT *, SQRT((g[i + 1][i + 1] - g[1][i + 1] * g[1][i + 1] / g[1][1]) / g[1][1]) AS sd FROM (SELECT series_id, pos, w, g, alive, UNNEST(RANGE(1, 61)) AS i FROM screened_ridge JOIN chosen USING (series_id) WHERE fold = 0) WHERE alive[i]))""")
def news_effect_coefficients(spark, sf):
    return md.coefficient_table(pn.news_effect(spark, sf)[1], ["series_id"], _CANDS, chosen="chosen")


@query("news_effect_summary", "series_id n mae:6 rmse:6 r2:6 abs_effect:0 mean_abs_logret:6", f"""
SELECT * FROM (SELECT series_id, {_METRICS} FROM (SELECT series_id, abnormal_logret AS y, media_logret_oof AS p FROM screened_effect) WHERE p IS NOT NULL GROUP BY 1)
JOIN (SELECT series_id, SUM(ABS(media_effect)) AS abs_effect, AVG(ABS(media_logret)) AS mean_abs_logret FROM screened_effect GROUP BY 1) USING (series_id)""")
def news_effect_summary(spark, sf):
    daily = pn.news_effect(spark, sf)[0]
    sums = daily.groupBy("series_id").agg(
        F.sum("media_effect_abs").alias("abs_effect"), F.avg(F.abs("media_logret")).alias("mean_abs_logret"))
    return md.regression_metrics(daily, "abnormal_logret", "media_logret_oof", ["series_id"]).join(sums, "series_id")


@query("complete_rows", "series_id n", "SELECT series_id, COUNT(*) AS n FROM model_frame GROUP BY 1")
def complete_rows(spark, sf):
    frame = pn.model_frame(spark, sf)
    return cl.complete_rows(frame, md.baseline_features()).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
