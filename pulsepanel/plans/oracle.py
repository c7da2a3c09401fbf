"""Reference SQL for the queries: named common table expressions and a builder.

``sql_for`` picks the expressions a statement mentions, in order, and rounds
the output columns by the same specification the Spark side uses.
"""

from __future__ import annotations

import re

from pulsepanel.operators.events import PEAK_PRESETS
from pulsepanel.operators.models import WEEKDAYS, baseline_features

CTES: dict[str, str] = {}
MATERIALIZED = set()


def cte(name: str, sql: str, keep: bool = True) -> None:
    CTES[name] = sql.strip()
    if keep:
        MATERIALIZED.add(name)


def solver(name: str, source: str, keys: str, size: int) -> None:
    """``name``: solution list ``w`` per key of the augmented systems in ``source``.

    Gauss-Jordan elimination over nested lists, one recursion step per column.
    """
    step = (
        "list_transform(m, lambda r, i: CASE WHEN i = step + 1 "
        "THEN list_transform(r, lambda v: v / m[step + 1][step + 1]) "
        "ELSE list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)"
    )
    cte(f"{name}_steps", f"""
        SELECT {keys}, 0 AS step, m FROM {source}
        UNION ALL SELECT {keys}, step + 1, {step} FROM {name}_steps WHERE step < {size}""", keep=False)
    cte(name, f"SELECT {keys}, list_transform(m, lambda r: r[{size + 1}]) AS w FROM {name}_steps WHERE step = {size}")


def normal_equations(xs: list[str], y: str) -> str:
    rows = [
        "[" + ", ".join([f"SUM({a} * {b})" for b in xs] + [f"SUM({a} * {y})"]) + "]" for a in xs
    ]
    return "[" + ", ".join(rows) + "]"


def round_expr(token: str) -> str:
    name, _, kind = token.partition(":")
    if not kind:
        return name
    if kind == "d":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    return f"ROUND(CAST({name} AS DOUBLE), {kind}) + CAST(0 AS DOUBLE) AS {name}"


_uses: dict[str, frozenset[str]] = {}


def mentions(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", text)) & CTES.keys()


def needed(sql: str) -> list[str]:
    """Expressions a statement needs, directly or not, in order of definition."""
    seen: set[str] = set()
    todo = list(mentions(sql))
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            if name not in _uses:
                _uses[name] = mentions(CTES[name])
            todo += _uses[name] - seen
    return [n for n in CTES if n in seen]


def sql_for(sql: str, spec: str) -> str:
    parts = [
        f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}(\n{CTES[n]}\n)" for n in needed(sql)
    ]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    cols = ", ".join(round_expr(t) for t in spec.split())
    return f"{head}SELECT {cols} FROM (\n{sql}\n) AS result"


# Window clauses reused below.
W = "(PARTITION BY series_id ORDER BY date)"


def rows(n: int, part: str = "series_id", order: str = "date") -> str:
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def zscore(x: str, n: int, part: str = "series_id") -> str:
    w = rows(n, part)
    return (
        f"CASE WHEN COUNT({x}) OVER {w} = {n} THEN ({x} - AVG({x}) OVER {w}) "
        f"/ NULLIF(STDDEV_POP({x}) OVER {w}, 0) END"
    )


def ret(x: str, part: str = "series_id") -> str:
    p = f"CASE WHEN {x} > 0 THEN {x} END"
    return f"LN({p} / LAG({p}) OVER (PARTITION BY {part} ORDER BY date))"


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + EXP(-LEAST(GREATEST({x}, -20.0), 20.0))))"


def clip3(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN LEAST(GREATEST({x}, -3.0), 3.0) END"


def bins(x: str, bounds, labels) -> str:
    whens = " ".join(f"WHEN {x} < {b} THEN '{v}'" for b, v in zip(bounds, labels))
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{labels[-1]}' END"


ALARM = ("CALM", "NORMAL", "ELEVATED", "ALERT", "MANIPULATION")
PRESSURE = ("MINIMAL", "BASELINE", "ELEVATED", "HIGH", "EXTREME")
BOUNDS = ("0.47", "0.53", "0.59", "0.65")

# Fixtures ----------------------------------------------------------------------

cte("price_panel", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
       CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * COUNT(*)) AS price,
       CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS mcap, COUNT(*) AS volume
FROM orders GROUP BY 1, 2""")
cte("macro_long", """
SELECT l_returnflag AS control, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * COUNT(*)) AS value
FROM lineitem GROUP BY 1, 2""")
cte("macro_wide", """
SELECT date, MAX(CASE WHEN control = 'A' THEN value END) AS ctl_a, MAX(CASE WHEN control = 'N' THEN value END) AS ctl_n,
       MAX(CASE WHEN control = 'R' THEN value END) AS ctl_r FROM macro_long GROUP BY 1""")
cte("media_signal", """
SELECT p.preset AS preset, CAST(l.l_shipdate AS DATE) AS date, COUNT(*) AS mentions,
       CAST(SUM(CAST(ROUND((l.l_discount - l.l_tax) * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS tone
FROM lineitem l JOIN (SELECT 'sensitive' AS preset, 1 AS lo UNION ALL SELECT 'balanced', 20 UNION ALL SELECT 'strong', 40) p
  ON l.l_quantity >= p.lo GROUP BY 1, 2""")
cte("balanced_signal", "SELECT date, mentions, tone FROM media_signal WHERE preset = 'balanced'")
cte("wide_signal", "SELECT date, " + ", ".join(
    f"MAX(CASE WHEN preset = '{p}' THEN {v} END) AS {v}_{p}" for p in ("balanced", "strong", "sensitive")
    for v in ("mentions", "tone")) + " FROM media_signal GROUP BY 1")
cte("news_records", """
SELECT CAST(l_shipdate AS DATE) AS day, l_linenumber AS file_no, l_quantity >= 20 AS matched,
       CASE WHEN l_discount > 0 THEN CAST(ROUND((l_discount - l_tax) * 100) AS DOUBLE) END AS tone FROM lineitem""")
cte("stream_records", """
SELECT ts, user_id AS source, event_type, CAST(CAST(ROUND(value * 100) AS BIGINT) AS DOUBLE) / 100.0 AS tone,
       event_type <> 'error' AS matched, event_id FROM events""")
HOST = "LOWER(REGEXP_EXTRACT(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
cte("articles", f"""
SELECT CONCAT('EVT_', CAST(page_id % 10 AS VARCHAR)) AS event_id, page_id AS article_id, url,
       REPLACE({HOST}, 'www.', '') AS domain, 1 + page_id % 5 AS num_articles, page_id % 3 AS num_mentions,
       CASE WHEN page_id % 7 <> 0 THEN CAST((page_id % 21) - 10 AS DOUBLE) END AS avg_tone FROM pages""")
cte("article_records", f"""
SELECT CAST(page_id AS VARCHAR) AS record_id, DATE '1995-01-01' + CAST(page_id * 37 % 2400 AS INTEGER) AS date,
       url AS source_url, {HOST} AS source_domain, 1 + page_id % 5 AS num_articles, page_id % 3 AS num_mentions,
       CAST((page_id % 21) - 10 AS DOUBLE) AS avg_tone FROM pages""")

# Features and baseline -----------------------------------------------------------

cte("features", f"""
SELECT *, CASE WHEN logret > 0 THEN 1 WHEN logret IS NOT NULL THEN -1 END AS regime,
       CASE WHEN COUNT(logret) OVER {rows(30)} >= 30 THEN STDDEV_SAMP(logret) OVER {rows(30)} END AS vol_30
FROM (SELECT *, {ret('price')} AS logret FROM price_panel)""")
cte("aligned", "SELECT p.*, m.ctl_a, m.ctl_n, m.ctl_r FROM price_panel p LEFT JOIN macro_wide m USING (date)")
_RUN = "(PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
cte("filled", "SELECT series_id, date, price, mcap, volume, " + ", ".join(
    f"LAST_VALUE({c} IGNORE NULLS) OVER {_RUN} AS {c}" for c in ("ctl_a", "ctl_n", "ctl_r")) + " FROM aligned")
_XS = baseline_features()
cte("model_frame", f"""
SELECT series_id, date, price, mcap, logret, {', '.join(_XS)} FROM (
  SELECT *, LAG(logret, 1) OVER {W} AS logret_lag1, LAG(logret, 2) OVER {W} AS logret_lag2, LAG(logret, 3) OVER {W} AS logret_lag3,
         LAG(vol_30) OVER {W} AS vol_30_lag1,
         {', '.join(f"CAST(ISODOW(date) - 1 = {k} AS INTEGER)::DOUBLE AS wd_{k}" for k in WEEKDAYS)}
  FROM (SELECT *, CASE WHEN COUNT(logret) OVER {rows(30)} >= 30 THEN STDDEV_SAMP(logret) OVER {rows(30)} END AS vol_30
        FROM (SELECT *, {ret('price')} AS logret, {', '.join(f"{ret(c)} AS {c}_logret" for c in ('ctl_a', 'ctl_n', 'ctl_r'))}
              FROM filled)))
WHERE logret IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in _XS)}""")
_ONE = ["1.0::DOUBLE", *_XS]
cte("ols_system", f"SELECT series_id, {normal_equations(_ONE, 'logret')} AS m FROM model_frame GROUP BY 1")
solver("ols_fit", "ols_system", "series_id", len(_ONE))
cte("baseline", f"""
SELECT *, EXP(abnormal_logret) * 100 - 100 AS abnormal_return_pct, EXP(logret) * 100 - 100 AS return_pct,
       EXP(expected_logret) * 100 - 100 AS expected_return_pct, {zscore('abnormal_logret', 60)} AS abnormal_z60,
       LAG(mcap) OVER {W} AS mcap_lag1, LAG(mcap) OVER {W} * EXP(expected_logret) AS mcap_hat,
       mcap - LAG(mcap) OVER {W} * EXP(expected_logret) AS abnormal_usd
FROM (SELECT *, logret - expected_logret AS abnormal_logret
      FROM (SELECT f.*, {' + '.join(f'o.w[{i + 1}] * {x}' for i, x in enumerate(_ONE))} AS expected_logret
            FROM model_frame f JOIN ols_fit o USING (series_id)))""")

# News block, ridge, score ----------------------------------------------------------


def news_sql(source: str, s: str = "", part: str = "series_id") -> str:
    """The 87 columns of one stream over ``source`` (keys, news_mentions, news_tone)."""
    from pulsepanel.operators.features import LAGS, STD_WIDTHS, WIDTHS

    m, t, lg = f"news_mentions{s}", f"news_tone{s}", f"news_log_mentions{s}"
    cross, bad, good = f"news_tone_x_log_mentions{s}", f"news_bad_intensity{s}", f"news_good_intensity{s}"
    z = {lg: f"news_log_mentions_z30{s}", t: f"news_tone_z30{s}", bad: f"news_bad_intensity_z30{s}"}
    neg, pos = f"news_negative_tone{s}", f"news_positive_tone{s}"
    w = f"(PARTITION BY {part} ORDER BY date)"
    a = f"""SELECT * REPLACE (COALESCE(CAST({m} AS DOUBLE), 0) AS {m},
        CASE WHEN COALESCE({m}, 0) > 0 THEN COALESCE({t}, 0) ELSE 0 END AS {t}) FROM {source}"""
    b = f"SELECT *, LN(1 + {m}) AS {lg}, GREATEST(-{t}, 0) AS {neg}, GREATEST({t}, 0) AS {pos} FROM ({a})"
    c = f"SELECT *, {t} * {lg} AS {cross}, {neg} * {lg} AS {bad}, {pos} * {lg} AS {good} FROM ({b})"
    d = f"SELECT *, {', '.join(f'{zscore(x, 30, part)} AS {n}' for x, n in z.items())} FROM ({c})"
    cols = [
        f"CASE WHEN {z[lg]} >= 2.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS news_extreme_attention{s}",
        f"CASE WHEN ISODOW(date) >= 6 AND {m} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS news_weekend{s}",
    ]
    for x in (lg, t, cross, bad, good, *z.values(), m):
        cols += [f"LAG({x}, {k}) OVER {w} AS {x}_lag{k}" for k in LAGS]
    for x in (m, lg, t, bad, good):
        for n in WIDTHS:
            cols += [f"AVG({x}) OVER {rows(n, part)} AS {x}_ma{n}", f"SUM({x}) OVER {rows(n, part)} AS {x}_sum{n}"]
    for x in (lg, t, bad):
        cols += [
            f"CASE WHEN COUNT({x}) OVER {rows(n, part)} >= 2 THEN STDDEV_POP({x}) OVER {rows(n, part)} END AS {x}_std{n}"
            for n in STD_WIDTHS]
    return f"SELECT *, {', '.join(cols)} FROM ({d})"


cte("news_input", """
SELECT b.*, f.vol_30, f.regime, f.volume, s.mentions AS news_mentions, s.tone AS news_tone, s.mentions, s.tone
FROM baseline b LEFT JOIN features f USING (series_id, date) LEFT JOIN balanced_signal s USING (date)""")
cte("news_panel", news_sql("news_input"))
cte("folded", """
SELECT *, CASE WHEN size = 0 OR rn <= n - 5 * size THEN 0 ELSE 1 + (rn - 1 - (n - 5 * size)) // size END AS segment
FROM (SELECT *, n // 6 AS size FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn, COUNT(*) OVER (PARTITION BY series_id) AS n
  FROM news_panel WHERE abnormal_logret IS NOT NULL))""")
RIDGE = [
    "news_log_mentions", "news_tone", "news_tone_x_log_mentions", "news_bad_intensity",
    "news_log_mentions_lag1", "news_tone_lag1", "news_log_mentions_ma7", "news_tone_std7",
]
_RX = [f"COALESCE({x}, 0)" for x in RIDGE]


def _ridge_system() -> str:
    """Centred normal equations with alpha times each feature's variance added."""
    y, a = "abnormal_logret", "10.0"
    rows_ = []
    for i, p in enumerate(_RX):
        cells = []
        for j, q in enumerate(_RX):
            c = f"(SUM({p} * {q}) - SUM({p}) * SUM({q}) / COUNT(*))"
            cells.append(f"{c} * (1.0 + {a} / COUNT(*))" if i == j else c)
        cells.append(f"SUM({p} * {y}) - SUM({p}) * SUM({y}) / COUNT(*)")
        rows_.append("[" + ", ".join(cells) + "]")
    return "[" + ", ".join(rows_) + "]"


cte("ridge_system", f"""
SELECT series_id, fold, COUNT(*) AS n_train, [{', '.join(f'AVG({x})' for x in _RX)}] AS mu, AVG(abnormal_logret) AS mu_y,
       [{', '.join(f'STDDEV_POP({x})' for x in _RX)}] AS sd, {_ridge_system()} AS m
FROM folded JOIN (SELECT UNNEST(RANGE(6)) AS fold) k ON k.fold = 0 OR folded.segment < k.fold
GROUP BY 1, 2""")
solver("ridge_fit", "ridge_system", "series_id, fold", len(RIDGE))
cte("ridge", """
SELECT r.series_id, r.fold, n_train, mu, sd, f.w,
       mu_y - list_sum(list_transform(f.w, lambda v, i: v * mu[i])) AS intercept
FROM ridge_system r JOIN ridge_fit f ON r.series_id = f.series_id AND r.fold = f.fold""")
_DOT = " + ".join(f"{{r}}.w[{i + 1}] * {x}" for i, x in enumerate(_RX))
cte("effect", f"""
SELECT *, media_logret * COALESCE(mcap, 0) AS media_effect, media_logret_oof * COALESCE(mcap, 0) AS media_effect_oof,
       ABS(media_logret * COALESCE(mcap, 0)) AS media_effect_abs,
       ABS(media_logret * COALESCE(mcap, 0)) / NULLIF(ABS(abnormal_usd), 0) AS media_share_of_move
FROM (SELECT d.*, a.intercept + {_DOT.format(r='a')} AS media_logret, b.intercept + {_DOT.format(r='b')} AS media_logret_oof
      FROM folded d JOIN ridge a ON a.series_id = d.series_id AND a.fold = 0
      LEFT JOIN ridge b ON b.series_id = d.series_id AND b.fold = d.segment AND d.segment > 0)""")


def scored_sql(source: str) -> str:
    """Index calibrated on the series' own days, and the weighted effect."""
    p = "(PARTITION BY series_id)"
    return f"""
SELECT *, 100.0 * excess_effect / (ABS(abnormal_usd) + 1e-9) AS media_share_pct,
       {bins('score', BOUNDS, ALARM)} AS zone
FROM (SELECT *, raw_abs_effect * score AS excess_effect
FROM (SELECT *, {sigmoid('score_raw')} AS score, ABS(effect_used) AS raw_abs_effect
FROM (SELECT *, 0.25 * z_volume + 0.20 * z_tone AS score_raw, COALESCE(media_effect_oof, 0) AS effect_used
FROM (SELECT *, {clip3('(mentions_used - mm) / GREATEST(ms, 1e-6)')} AS z_volume,
             {clip3('(tone_used - tm) / GREATEST(ts_, 1e-6)')} AS z_tone
FROM (SELECT *, COALESCE(mentions, mm) AS mentions_used, COALESCE(tone, tm) AS tone_used
FROM (SELECT *, AVG(mentions) OVER {p} AS mm, STDDEV_POP(mentions) OVER {p} AS ms,
             AVG(tone) OVER {p} AS tm, STDDEV_POP(tone) OVER {p} AS ts_ FROM {source}))))))"""


cte("scored", scored_sql("effect"))

# Events ------------------------------------------------------------------------------

_P = PEAK_PRESETS
cte("peak_scores", f"""
SELECT series_id, date, price, mcap, {', '.join(f"{zscore('logret', v.window)} AS z_{p}" for p, v in _P.items())} FROM features""")


def _near(p: str, half: int) -> str:
    return f"MAX(z_{p}) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


cte("peak_candidates", " UNION ALL ".join(
    f"SELECT series_id, '{p}' AS preset, date, price, mcap, z_{p} AS zscore, {v.gap} AS gap FROM "
    f"(SELECT *, {_near(p, v.half)} AS top FROM peak_scores) WHERE z_{p} >= {v.threshold} AND z_{p} = top"
    for p, v in _P.items()))
cte("peak_kept", """
SELECT series_id, preset, gap, MIN(date) AS date FROM peak_candidates GROUP BY 1, 2, 3
UNION ALL
SELECT k.series_id, k.preset, k.gap, MIN(c.date) AS date
FROM peak_kept k JOIN peak_candidates c ON c.series_id = k.series_id AND c.preset = k.preset AND c.date >= k.date + k.gap
GROUP BY 1, 2, 3""", keep=False)
cte("peaks", """
SELECT c.series_id, c.preset, UPPER(c.preset) || '_EVT_' ||
       LPAD(CAST(ROW_NUMBER() OVER (PARTITION BY c.series_id, c.preset ORDER BY c.date) AS VARCHAR), 4, '0') AS event_id,
       c.date AS peak_date, c.date - 7 AS window_start, c.date + 7 AS window_end, c.zscore, c.mcap, c.price, c.gap
FROM peak_candidates c JOIN (SELECT DISTINCT series_id, preset, date FROM peak_kept) k USING (series_id, preset, date)""")
EV = "series_id, preset, event_id, peak_date"


def car_sql(cond: str, p: str) -> str:
    f = f"FILTER (WHERE {cond})"
    return (
        f"SUM(abnormal_logret) {f} AS {p}_car_log, EXP(SUM(abnormal_logret) {f}) * 100 - 100 AS {p}_car_pct, "
        f"AVG(abnormal_logret) {f} AS {p}_mean_logret, AVG(abnormal_return_pct) {f} AS {p}_mean_pct, "
        f"SUM(abnormal_usd) {f} AS {p}_sum_usd, SUM(ABS(abnormal_usd)) {f} AS {p}_abs_usd, COUNT(*) {f} AS {p}_days"
    )


cte("numbered", "SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM baseline")
cte("event_rows", """
SELECT e.series_id, e.preset, e.event_id, e.peak_date, e.window_start, e.window_end, n.rn - p.rn AS off, n.date, n.price, n.mcap,
       n.abnormal_logret, n.abnormal_return_pct, n.abnormal_z60, n.abnormal_usd
FROM peaks e JOIN numbered p ON p.series_id = e.series_id AND p.date = e.peak_date
JOIN numbered n ON n.series_id = p.series_id AND n.rn BETWEEN p.rn - 7 AND p.rn + 29""")
cte("event_returns", f"""
SELECT *, -post_car_log / NULLIF(peak_logret, 0) AS reversal_ratio, SIGN(peak_logret) AS peak_sign, SIGN(post_car_log) AS post_sign,
       CAST(SIGN(peak_logret) * SIGN(post_car_log) < 0 AS INTEGER) AS is_reversal
FROM (SELECT {EV}, window_start, window_end, MAX(price) FILTER (WHERE off = 0) AS price_at_peak,
      MAX(mcap) FILTER (WHERE off = 0) AS mcap_at_peak, MAX(abnormal_logret) FILTER (WHERE off = 0) AS peak_logret,
      MAX(abnormal_return_pct) FILTER (WHERE off = 0) AS peak_pct, MAX(abnormal_z60) FILTER (WHERE off = 0) AS peak_z60,
      MAX(abnormal_usd) FILTER (WHERE off = 0) AS peak_usd,
      {car_sql('off BETWEEN -7 AND -1', 'pre')}, {car_sql('off BETWEEN 1 AND 7', 'post')},
      {', '.join(car_sql(f'off BETWEEN 0 AND {w - 1}', f'w{w}') for w in (3, 7, 14, 30))},
      {car_sql('date BETWEEN window_start AND window_end', 'event')}
      FROM event_rows GROUP BY {EV}, window_start, window_end)""")


def share(num: str, den: str) -> str:
    return f"COALESCE(100.0 * {num} / NULLIF({den}, 0), 0)"


_IN = "s.date BETWEEN e.window_start AND e.window_end"
cte("impact_sums", f"""
SELECT e.series_id, e.preset, e.event_id, e.peak_date, COUNT(s.date) FILTER (WHERE {_IN}) AS event_days_effect,
       {', '.join(f'''COALESCE(SUM({c}) FILTER (WHERE {_IN}), 0) AS sum_effect_{t}, COALESCE(SUM(ABS({c})) FILTER (WHERE {_IN}), 0) AS abs_effect_{t},
       COALESCE(MAX(ABS({c})) FILTER (WHERE {_IN}), 0) AS max_effect_{t}''' for t, c in (('oof', 'media_effect_oof'), ('in', 'media_effect')))},
       {', '.join(f'''COUNT(s.date) FILTER (WHERE ABS(s.date - e.peak_date) <= {w}) AS d{w}_days_effect,
       COALESCE(SUM(ABS(media_effect_oof)) FILTER (WHERE ABS(s.date - e.peak_date) <= {w}), 0) AS d{w}_abs_effect_oof''' for w in (7, 14, 30))}
FROM event_returns e LEFT JOIN scored s ON s.series_id = e.series_id AND s.date BETWEEN e.peak_date - 30 AND e.peak_date + 30
GROUP BY 1, 2, 3, 4""")
cte("impact", f"""
SELECT e.*, i.* EXCLUDE (series_id, preset, event_id, peak_date),
       ROW_NUMBER() OVER (PARTITION BY e.series_id, e.preset ORDER BY e.peak_date) AS event_number,
       {share('abs_effect_oof', 'event_abs_usd')} AS share_event_oof, {share('abs_effect_in', 'event_abs_usd')} AS share_event_in,
       {share('d7_abs_effect_oof', 'w7_abs_usd')} AS share_car7_oof, {share('d14_abs_effect_oof', 'w14_abs_usd')} AS share_car14_oof,
       {share('d30_abs_effect_oof', 'w30_abs_usd')} AS share_car30_oof, {share('max_effect_oof', 'ABS(peak_usd)')} AS share_peak_oof
FROM event_returns e JOIN impact_sums i USING ({EV})""")

# Out-of-sample index -----------------------------------------------------------------------


def zt(x: str, mu: str, sd: str) -> str:
    return clip3(f"({x} - {mu}) / CASE WHEN {sd} > 1e-9 THEN {sd} ELSE 1.0 END")


PX = {"px_volume": "COALESCE(raw_abs_effect, 0)", "px_tone": "ABS(COALESCE(tone_used, 0))", "px_resid": "COALESCE(media_share_pct, 0)"}
cte("proxied", f"""
SELECT *, CASE WHEN date < DATE '2000-01-01' THEN 'TRAIN' ELSE 'TEST' END AS split, {', '.join(f'{e} AS {n}' for n, e in PX.items())} FROM scored""")


def _train(fn: str, x: str) -> str:
    return f"{fn}({x}) FILTER (WHERE split = 'TRAIN') OVER (PARTITION BY series_id)"


cte("oos", f"""
SELECT o.*, t.threshold FROM (
  SELECT *, {sigmoid(' + '.join(f"{w} * {zt(p, _train('AVG', p), _train('STDDEV_POP', p))}" for p, w in zip(PX, ('0.25', '0.20', '0.20'))))} AS oos_score FROM proxied) o
JOIN (SELECT series_id, QUANTILE_CONT(oos_score, 0.7) AS threshold FROM (
  SELECT series_id, split, {sigmoid(' + '.join(f"{w} * {zt(p, _train('AVG', p), _train('STDDEV_POP', p))}" for p, w in zip(PX, ('0.25', '0.20', '0.20'))))} AS oos_score FROM proxied)
  WHERE split = 'TRAIN' GROUP BY 1) t USING (series_id)""")
