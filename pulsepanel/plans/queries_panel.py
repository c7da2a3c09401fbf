"""Queries on prices, controls, text cleaning and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsepanel.functions import clean as cl
from pulsepanel.operators import aggregates as ag
from pulsepanel.operators import joins as jn
from pulsepanel.operators import windows as wn
from pulsepanel.operators.validation import split_by_date
from pulsepanel.plans import fixtures as fx
from pulsepanel.plans import panels as pn
from pulsepanel.plans.oracle import W, rows, zscore
from pulsepanel.plans.registry import query

KEY = "series_id date:d"


@query("price_panel_logret", f"{KEY} price:6 mcap:2 volume logret:6 return_pct:6 direction:6", """
SELECT *, EXP(logret) * 100 - 100 AS return_pct, SIGN(logret) AS direction FROM features WHERE date >= DATE '1995-02-01'""")
def price_panel_logret(spark, sf):
    df = pn.features(spark, sf).filter(F.col("date") >= F.to_date(F.lit("1995-02-01")))
    return df.withColumns({"return_pct": cl.pct_from_logret(F.col("logret")), "direction": cl.sign3(F.col("logret"))})


@query("rolling_vol_30", f"{KEY} vol_30:6", "SELECT * FROM features")
def rolling_vol_30(spark, sf):
    return pn.features(spark, sf)


@query("rolling_z_30", f"{KEY} z:6", f"SELECT *, {zscore('logret', 30)} AS z FROM features")
def rolling_z_30(spark, sf):
    return pn.features(spark, sf).withColumn("z", wn.rolling_zscore(F.col("logret"), wn.ordered(), 30))


@query("local_max_flag", f"{KEY} z:6 is_top candidate", f"""
SELECT *, COALESCE(z = MAX(z) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), FALSE) AS is_top,
       COALESCE(z >= 2.0, FALSE) AS candidate
FROM (SELECT *, {zscore('logret', 30)} AS z FROM features)""")
def local_max_flag(spark, sf):
    df = rolling_z_30(spark, sf)
    return df.withColumns({
        "is_top": wn.local_max(F.col("z"), wn.ordered(), 5), "candidate": F.coalesce(F.col("z") >= 2.0, F.lit(False))})


@query("regime_sign", "series_id regime:0 days", "SELECT series_id, regime, COUNT(*) AS days FROM features GROUP BY 1, 2")
def regime_sign(spark, sf):
    return pn.features(spark, sf).groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("days"))


@query("lag_block", f"{KEY} logret_lag1:6 logret_lag3:6 logret_lag7:6", f"""
SELECT *, {', '.join(f'LAG(logret, {k}) OVER {W} AS logret_lag{k}' for k in (1, 3, 7))} FROM features""")
def lag_block(spark, sf):
    return pn.features(spark, sf).withColumns(wn.lags("logret", wn.ordered(), (1, 3, 7)))


@query("lead_block", f"{KEY} logret_lead1:6 logret_lead2:6 logret_lead3:6", f"""
SELECT *, {', '.join(f'LEAD(logret, {k}) OVER {W} AS logret_lead{k}' for k in (1, 2, 3))} FROM features""")
def lead_block(spark, sf):
    return pn.features(spark, sf).withColumns(wn.leads("logret", wn.ordered(), (1, 2, 3)))


_ROLL = " ".join(f"volume_ma{n}:6 volume_sum{n}:6" for n in (3, 7, 14, 30))


@query("rolling_mean_sum", f"{KEY} {_ROLL}", "SELECT *, " + ", ".join(
    f"AVG(volume) OVER {rows(n)} AS volume_ma{n}, SUM(volume) OVER {rows(n)} AS volume_sum{n}" for n in (3, 7, 14, 30)) + " FROM price_panel")
def rolling_mean_sum(spark, sf):
    return fx.price_panel(spark, sf).withColumns(wn.rolling_mean_sum("volume", wn.ordered(), (3, 7, 14, 30)))


@query("rolling_std_min2", f"{KEY} logret_std7:6 logret_std14:6 logret_std30:6", "SELECT *, " + ", ".join(
    f"CASE WHEN COUNT(logret) OVER {rows(n)} >= 2 THEN STDDEV_POP(logret) OVER {rows(n)} END AS logret_std{n}" for n in (7, 14, 30)) + " FROM features")
def rolling_std_min2(spark, sf):
    return pn.features(spark, sf).withColumns(wn.rolling_pop_std("logret", wn.ordered(), (7, 14, 30)))


@query("difference", f"{KEY} step:6", f"SELECT *, price - LAG(price) OVER {W} AS step FROM price_panel")
def difference(spark, sf):
    return fx.price_panel(spark, sf).withColumn("step", wn.difference("price", wn.ordered()))


@query("drawdown", f"{KEY} cum:6 peak:6 drawdown:6", """
SELECT *, cum - peak AS drawdown FROM (
  SELECT *, MAX(cum) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM (
    SELECT *, SUM(logret) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM features))""")
def drawdown(spark, sf):
    return wn.with_drawdown(pn.features(spark, sf), "logret")


@query("average_rank", f"{KEY} volume place:1", """
SELECT *, RANK() OVER (PARTITION BY series_id ORDER BY volume) + (COUNT(*) OVER (PARTITION BY series_id, volume) - 1) / 2.0 AS place
FROM price_panel""")
def average_rank(spark, sf):
    return fx.price_panel(spark, sf).withColumn("place", wn.average_rank("volume"))


@query("mcap_baseline", f"{KEY} mcap_lag1:2 mcap_hat:1 abnormal_usd:1", "SELECT * FROM baseline")
def mcap_baseline(spark, sf):
    return pn.baseline_panel(spark, sf)


@query("macro_align_left", f"{KEY} price:6 ctl_a:6 ctl_n:6 ctl_r:6", "SELECT * FROM aligned")
def macro_align_left(spark, sf):
    return pn.aligned(spark, sf)


@query("macro_ffill", f"{KEY} ctl_a:6 ctl_n:6 ctl_r:6", "SELECT * FROM filled")
def macro_ffill(spark, sf):
    return wn.forward_fill(pn.aligned(spark, sf), ["ctl_a", "ctl_n", "ctl_r"])


@query("common_days", f"{KEY} volume mentions tone:6", """
SELECT series_id, date, volume, mentions, tone FROM price_panel JOIN balanced_signal USING (date)""")
def common_days(spark, sf):
    return jn.common_days(fx.price_panel(spark, sf), fx.balanced_signal(spark, sf), on=("date",))


@query("panel_merge", f"{KEY} price:6 price_feat:6 vol_30:6 regime:0 mentions:0 tone:6", """
SELECT b.series_id, date, b.price, f.price AS price_feat, f.vol_30, f.regime, s.mentions, s.tone
FROM baseline b LEFT JOIN features f USING (series_id, date) LEFT JOIN balanced_signal s USING (date)""")
def panel_merge(spark, sf):
    feats = pn.features(spark, sf).select("series_id", "date", "price", "vol_30", "regime")
    merged = jn.merge_panel(pn.baseline_panel(spark, sf).select("series_id", "date", "price"), feats, "_feat")
    return jn.attach_signal(merged, fx.balanced_signal(spark, sf))


@query("split_by_date", "split n first_day:d last_day:d", """
SELECT CASE WHEN date < DATE '2000-01-01' THEN 'TRAIN' ELSE 'TEST' END AS split, COUNT(*) AS n, MIN(date) AS first_day, MAX(date) AS last_day
FROM features WHERE logret IS NOT NULL AND vol_30 IS NOT NULL GROUP BY 1""")
def split_by_date_query(spark, sf):
    df = cl.complete_rows(pn.features(spark, sf), ["logret", "vol_30"])
    return split_by_date(df, fx.BOUNDARY).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


# Text cleaning: cells rendered from order prices ---------------------------------

WHOLE = "CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) {div} 100 AS {text})"
_WS, _WD = WHOLE.format(div="div", text="STRING"), WHOLE.format(div="//", text="VARCHAR")
_FRAC = "LPAD(CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 100 AS {text}), 2, '0')"
_FS, _FD = _FRAC.format(text="STRING"), _FRAC.format(text="VARCHAR")


def _cells(whole: str, frac: str) -> dict[str, str]:
    n = f"{whole} || '.' || {frac}"
    comma = f"CASE WHEN LENGTH({whole}) > 3 THEN SUBSTR({whole}, 1, LENGTH({whole}) - 3) || ',' || RIGHT({whole}, 3) ELSE {whole} END || '.' || {frac}"
    return {
        "number": f"""CASE o_orderkey % 8 WHEN 0 THEN {n} WHEN 1 THEN ' ' || {n} WHEN 2 THEN {comma} WHEN 3 THEN '"' || {n} || '"'
            WHEN 4 THEN 'N/A' WHEN 5 THEN '' WHEN 6 THEN '-' ELSE 'nan' END""",
        "abbrev": f"CASE o_orderkey % 6 WHEN 0 THEN {n} || 'K' WHEN 1 THEN {n} || 'm' WHEN 2 THEN {n} || 'B' WHEN 3 THEN {n} WHEN 4 THEN '-' ELSE {n} || 'x' END",
        "percent": f"CASE o_orderkey % 4 WHEN 0 THEN '-' || RIGHT({whole}, 2) || ',' || {frac} || '%' WHEN 1 THEN RIGHT({whole}, 2) || '.' || {frac} || '%' WHEN 2 THEN 'n/a' ELSE ' ' || RIGHT({whole}, 1) || ' %' END",
    }


CELLS, CELLS_SQL = _cells(_WS, _FS), _cells(_WD, _FD)


def _text(spark, sf, cell: str):
    return fx.table(spark, sf, "orders").select("o_orderkey", F.expr(CELLS[cell]).alias("raw"))


@query("parse_numbers", "o_orderkey raw value:2", f"""
SELECT o_orderkey, raw, CASE WHEN bare NOT IN ('', '-', 'nan') THEN TRY_CAST(bare AS DOUBLE) END AS value
FROM (SELECT *, REGEXP_REPLACE(TRIM(raw), '[ ,"]', '', 'g') AS bare FROM (SELECT o_orderkey, {CELLS_SQL['number']} AS raw FROM orders))""")
def parse_numbers(spark, sf):
    return _text(spark, sf, "number").withColumn("value", cl.parse_number(F.col("raw")))


@query("parse_abbrev", "o_orderkey raw value:0", f"""
SELECT o_orderkey, raw, CASE WHEN REGEXP_FULL_MATCH(raw, '[0-9]*\\.?[0-9]+[KMBkmb]?') THEN
       CAST(REGEXP_EXTRACT(raw, '^[0-9.]+') AS DOUBLE) * CASE UPPER(RIGHT(raw, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END END AS value
FROM (SELECT o_orderkey, {CELLS_SQL['abbrev']} AS raw FROM orders)""")
def parse_abbrev(spark, sf):
    return _text(spark, sf, "abbrev").withColumn("value", cl.parse_abbrev(F.col("raw")))


@query("parse_percent", "o_orderkey raw value:4", f"""
SELECT o_orderkey, raw, TRY_CAST(TRIM(REPLACE(REPLACE(TRIM(raw), '%', ''), ',', '.')) AS DOUBLE) AS value
FROM (SELECT o_orderkey, {CELLS_SQL['percent']} AS raw FROM orders)""")
def parse_percent(spark, sf):
    return _text(spark, sf, "percent").withColumn("value", cl.parse_percent(F.col("raw")))


@query("parse_dates", "o_orderkey raw day:d compact:d", """
SELECT o_orderkey, raw, TRY_CAST(CASE WHEN raw <> 'bad' THEN SUBSTR(raw, 1, 10) END AS DATE) AS day,
       CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS compact
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00:00 UTC'
      WHEN 2 THEN ' ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE 'bad' END AS raw FROM orders)
""".replace("SUBSTR(raw, 1, 10)", "SUBSTR(TRIM(raw), 1, 10)"))
def parse_dates(spark, sf):
    day = F.col("o_orderdate").cast("date").cast("string")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" 00:00:00 UTC"))).when(k == 2, F.concat(F.lit(" "), day)).otherwise("bad")
    packed = F.when(k == 3, "2001-1x").otherwise(F.concat(F.replace(day, F.lit("-"), F.lit("")), F.lit("103000")))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", raw.alias("raw"), cl.parse_date(raw).alias("day"), cl.parse_compact_date(packed).alias("compact"))


_INF = "CASE o_orderkey % 4 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END"


@query("clean_inf", "o_orderstatus n kept total:2", f"""
SELECT o_orderstatus, COUNT(*) AS n, COUNT(x) AS kept, CAST(SUM(CAST(ROUND(x * 100) AS BIGINT)) AS DOUBLE) / 100 AS total
FROM (SELECT o_orderstatus, CASE WHEN ISFINITE(y) THEN y END AS x FROM (SELECT o_orderstatus, {_INF} AS y FROM orders)) GROUP BY 1""")
def clean_inf(spark, sf):
    df = fx.table(spark, sf, "orders").select("o_orderstatus", F.expr(_INF).alias("x"))
    return cl.inf_to_null(df, ["x"]).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("kept"), (F.sum(fx.cents("x")) / 100.0).alias("total"))


@query("safe_numbers", "o_orderkey value:2 filled:2", f"""
SELECT o_orderkey, CASE WHEN ISFINITE(v) THEN v END AS value, COALESCE(CASE WHEN ISFINITE(v) THEN v END, 0) AS filled
FROM (SELECT o_orderkey, TRY_CAST(TRIM(raw) AS DOUBLE) AS v FROM (SELECT o_orderkey, {CELLS_SQL['number']} AS raw FROM orders))""")
def safe_numbers(spark, sf):
    df = _text(spark, sf, "number")
    return df.select("o_orderkey", cl.safe_num(F.col("raw")).alias("value"), cl.safe_num(F.col("raw"), 0.0).alias("filled"))


@query("scalar_transforms", f"{KEY} log_volume:6 neg:6 pos:6 floor_log:6 signed:6 ratio:4 eps:6", """
SELECT *, LN(1 + volume) AS log_volume, GREATEST(-COALESCE(logret, 0), 0) AS neg, GREATEST(COALESCE(logret, 0), 0) AS pos,
       LN(GREATEST(price, 0.1)) AS floor_log,
       SIGN(COALESCE(logret * mcap, 0)) * LN(GREATEST(ABS(COALESCE(logret * mcap, 0)), 1.0)) AS signed,
       COALESCE(100.0 * price / NULLIF(logret, 0), 0) / 1e6 AS ratio, price / (mcap + 1e-9) AS eps FROM features""")
def scalar_transforms(spark, sf):
    x = F.col("logret")
    return pn.features(spark, sf).withColumns({
        "log_volume": cl.log1p_count(F.col("volume").cast("double")), "neg": cl.neg_part(x), "pos": cl.pos_part(x),
        "floor_log": cl.log_floor(F.col("price"), 0.1), "signed": cl.signed_log(x * F.col("mcap")),
        "ratio": cl.safe_ratio_pct(F.col("price"), x) / 1e6, "eps": cl.eps_ratio(F.col("price"), F.col("mcap"))})


@query("calendar_dummies", f"{KEY} weekday:i month:i is_weekend:1 wd_1:1 wd_6:1 m_2:1 m_12:1", """
SELECT series_id, date, ISODOW(date) - 1 AS weekday, MONTH(date) AS month, CAST(ISODOW(date) >= 6 AS INTEGER) AS is_weekend,
       CAST(ISODOW(date) = 2 AS INTEGER) AS wd_1, CAST(ISODOW(date) = 7 AS INTEGER) AS wd_6, CAST(MONTH(date) = 2 AS INTEGER) AS m_2,
       CAST(MONTH(date) = 12 AS INTEGER) AS m_12 FROM price_panel""")
def calendar_dummies(spark, sf):
    d = F.col("date")
    return fx.price_panel(spark, sf).withColumns({
        **cl.calendar_parts(d), **cl.one_hot(F.weekday(d), "wd", list(range(1, 7))), **cl.one_hot(F.month(d), "m", list(range(2, 13)))})


@query("stars", "mark n", """
SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark, COUNT(*) AS n
FROM (SELECT (o_orderkey % 1000) / 10000.0 AS p FROM orders) GROUP BY 1""")
def stars(spark, sf):
    p = (F.col("o_orderkey") % 1000) / 10000.0
    return fx.table(spark, sf, "orders").groupBy(cl.stars(p).alias("mark")).agg(F.count(F.lit(1)).alias("n"))


# Daily signals --------------------------------------------------------------------

@query("signal_by_preset", "preset date:d mentions tone:6", "SELECT * FROM media_signal")
def signal_by_preset(spark, sf):
    return fx.media_signal(spark, sf)


@query("signal_two_stage", "date:d mentions tone:6", """
SELECT day AS date, CAST(SUM(w) AS BIGINT) AS mentions, SUM(t * w) / NULLIF(SUM(CASE WHEN t IS NOT NULL THEN w END), 0) AS tone
FROM (SELECT day, file_no, COUNT(*) FILTER (WHERE matched) AS w, AVG(tone) FILTER (WHERE matched) AS t FROM news_records GROUP BY 1, 2) GROUP BY 1""")
def signal_two_stage(spark, sf):
    return ag.daily_signal_two_stage(fx.news_records(spark, sf))


@query("signal_weighted", "date:d mentions:2 tone:6 n_articles", """
SELECT date, SUM(COALESCE(m, 1)) AS mentions, SUM(CASE WHEN t IS NOT NULL THEN t * COALESCE(m, 1) END) / NULLIF(SUM(CASE WHEN t IS NOT NULL THEN COALESCE(m, 1) END), 0) AS tone,
       COUNT(*) AS n_articles
FROM (SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS m,
      CASE WHEN l_discount > 0 THEN CAST(ROUND((l_discount - l_tax) * 100) AS DOUBLE) END AS t FROM lineitem) GROUP BY 1""")
def signal_weighted(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    tone = fx.cents(F.col("l_discount") - F.col("l_tax")).cast("double")
    return ag.daily_weighted(li.select(
        F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("mentions"),
        F.when(F.col("l_discount") > 0, tone).alias("tone")))


@query("signal_plain", "date:d mentions tone:5", """
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS mentions, AVG(tone) AS tone FROM stream_records GROUP BY 1""")
def signal_plain(spark, sf):
    rec = fx.stream_records(fx.table(spark, sf, "events"))
    return ag.daily_plain(rec.select(F.col("ts").cast("date").alias("date"), "tone"))


@query("signal_mean_per_date", "date:d mentions:6 tone:6", """
SELECT date, AVG(mentions) AS mentions, AVG(tone) AS tone FROM media_signal GROUP BY 1""")
def signal_mean_per_date(spark, sf):
    parts = [pn.signals(spark, sf).filter(F.col("preset") == p) for p in fx.PRESETS]
    return ag.mean_per_date(jn.union_all(*parts), ["mentions", "tone"])


@query("signal_wide", "date:d " + " ".join(f"mentions_{p}:0 tone_{p}:6" for p in fx.PRESETS), "SELECT * FROM wide_signal")
def signal_wide(spark, sf):
    return fx.wide_signal(spark, sf)


@query("keep_first", "series_id date:d price:6 mcap:2", """
SELECT series_id, date, price, mcap FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, DATE_TRUNC('month', date) ORDER BY date) AS k FROM price_panel) WHERE k = 1""")
def keep_first(spark, sf):
    df = fx.price_panel(spark, sf).withColumn("month", F.trunc("date", "month"))
    return jn.keep_one(df, ["series_id", "month"], [F.col("date")])


@query("calendar_missing", "series_id date:d", """
SELECT series_id, CAST(UNNEST(RANGE(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT series_id, MIN(date)::TIMESTAMP AS a, MAX(date)::TIMESTAMP AS b FROM price_panel GROUP BY 1)
EXCEPT SELECT series_id, date FROM price_panel""")
def calendar_missing(spark, sf):
    held = fx.price_panel(spark, sf)
    return jn.missing_days(jn.calendar_of(held, "series_id"), held, on=("series_id", "date"))


@query("calendar_days_held", "month:d days_in_range days_held", """
SELECT CAST(DATE_TRUNC('month', c.date) AS DATE) AS month, COUNT(*) AS days_in_range, COUNT(h.date) AS days_held
FROM (SELECT CAST(UNNEST(RANGE(a, b + INTERVAL 1 YEAR, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT DATE_TRUNC('year', MIN(date))::TIMESTAMP AS a, DATE_TRUNC('year', MAX(date))::TIMESTAMP AS b FROM media_signal)) c
LEFT JOIN (SELECT DISTINCT date FROM media_signal) h USING (date) GROUP BY 1""")
def calendar_days_held(spark, sf):
    """All days of the years that hold a signal."""
    held = fx.media_signal(spark, sf).select("date").distinct().withColumn("h", F.lit(1))
    years = held.select(F.trunc("date", "year").alias("date")).union(
        held.select(F.date_sub(F.trunc(F.add_months("date", 12), "year"), 1).alias("date")))
    days = jn.calendar_of(years)
    return days.join(held, "date", "left").groupBy(F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("days_in_range"), F.count("h").alias("days_held"))


@query("status_summary", "preset n_rows first_day:d last_day:d mentions_mean:6 mentions_std:6 tone_mean:6 zero_share:6", """
SELECT preset, COUNT(*) AS n_rows, MIN(date) AS first_day, MAX(date) AS last_day, AVG(mentions) AS mentions_mean,
       STDDEV_SAMP(mentions) AS mentions_std, AVG(tone) AS tone_mean, AVG(CAST(mentions = 0 AS INTEGER)) AS zero_share FROM media_signal GROUP BY 1""")
def status_summary(spark, sf):
    return ag.status_summary(fx.media_signal(spark, sf), "preset")


_NULLS = ["price", "logret", "vol_30", "regime", "volume"]


@query("null_share", "column_name null_pct:6", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 100.0 * AVG(CAST({c} IS NULL AS INTEGER)) AS null_pct FROM features" for c in _NULLS))
def null_share(spark, sf):
    return ag.null_share(pn.features(spark, sf), _NULLS)


