"""Queries on peaks, event windows, articles and news files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsepanel.functions import topics as tp
from pulsepanel.operators import aggregates as ag
from pulsepanel.operators import events as ev
from pulsepanel.operators import joins as jn
from pulsepanel.plans import fixtures as fx
from pulsepanel.plans import panels as pn
from pulsepanel.plans.oracle import EV, HOST, cte, sigmoid
from pulsepanel.plans.registry import query
from pulsepanel.sources import news as ns
from pulsepanel.sources.workdir import fresh_path, stage

KEYS = "series_id preset event_id peak_date:d"


def _peaks_query(preset: str):
    @query(f"peaks_{preset}", f"{KEYS} window_start:d window_end:d zscore:6 mcap:2 price:6 param_gap:i",
           f"SELECT *, gap AS param_gap FROM peaks WHERE preset = '{preset}'")
    def build(spark, sf):
        return ev.detect_peaks(fx.price_panel(spark, sf), {preset: ev.PEAK_PRESETS[preset]})

    return build


for _p in ev.PEAK_PRESETS:
    _peaks_query(_p)


_CAR = " ".join(f"w{w}_car_log:6 w{w}_car_pct:3 w{w}_mean_logret:6 w{w}_mean_pct:3 w{w}_sum_usd:1 w{w}_abs_usd:1 w{w}_days" for w in (3, 7, 14, 30))


@query("event_car", f"{KEYS} price_at_peak:6 mcap_at_peak:2 peak_logret:6 peak_pct:4 peak_z60:6 peak_usd:1 pre_car_log:6 pre_days post_car_log:6 post_days {_CAR} "
       "event_car_log:6 event_car_pct:3 event_sum_usd:1 event_abs_usd:1 event_days", "SELECT * FROM event_returns")
def event_car(spark, sf):
    return pn.event_returns(spark, sf)


WIDE = 45


def _wide_events(spark, sf):
    """Events whose windows reach further than any fixed width around the peak."""
    return pn.peaks(spark, sf).withColumns({
        "window_start": F.date_sub("peak_date", WIDE), "window_end": F.date_add("peak_date", WIDE)})


@query("event_car_wide", f"{KEYS} event_car_log:6 event_sum_usd:1 event_abs_usd:1 event_days w30_days", f"""
SELECT e.series_id, e.preset, e.event_id, e.peak_date, SUM(b.abnormal_logret) AS event_car_log, SUM(b.abnormal_usd) AS event_sum_usd,
       SUM(ABS(b.abnormal_usd)) AS event_abs_usd, COUNT(*) AS event_days, r.w30_days
FROM peaks e JOIN event_returns r USING (series_id, preset, event_id, peak_date)
JOIN baseline b ON b.series_id = e.series_id AND b.date BETWEEN e.peak_date - {WIDE} AND e.peak_date + {WIDE} GROUP BY 1, 2, 3, 4, r.w30_days""")
def event_car_wide(spark, sf):
    return ev.event_abnormal_returns(pn.baseline_panel(spark, sf), _wide_events(spark, sf))


@query("event_impact_wide", f"{KEYS} event_days_effect sum_effect_oof:0 abs_effect_oof:0 max_effect_oof:0 abs_effect_in:0 d30_days_effect", f"""
SELECT e.series_id, e.preset, e.event_id, e.peak_date, COUNT(s.date) AS event_days_effect, COALESCE(SUM(s.media_effect_oof), 0) AS sum_effect_oof,
       COALESCE(SUM(ABS(s.media_effect_oof)), 0) AS abs_effect_oof, COALESCE(MAX(ABS(s.media_effect_oof)), 0) AS max_effect_oof,
       COALESCE(SUM(ABS(s.media_effect)), 0) AS abs_effect_in, COUNT(s.date) FILTER (WHERE ABS(s.date - e.peak_date) <= 30) AS d30_days_effect
FROM event_returns e LEFT JOIN scored s ON s.series_id = e.series_id AND s.date BETWEEN e.peak_date - {WIDE} AND e.peak_date + {WIDE} GROUP BY 1, 2, 3, 4""")
def event_impact_wide(spark, sf):
    returns = ev.event_abnormal_returns(pn.baseline_panel(spark, sf), _wide_events(spark, sf))
    return ev.event_media_impact(pn.scored_panel(spark, sf), returns)


@query("event_reversal", f"{KEYS} reversal_ratio:4 peak_sign:0 post_sign:0 is_reversal:0", "SELECT * FROM event_returns")
def event_reversal(spark, sf):
    return ev.with_reversal(pn.event_returns(spark, sf))


_W = (3, 7, 14, 30)


@query("event_car_summary", "preset n_events mean_peak_logret:6 median_peak_logret:6 mean_peak_pct:4 share_reversal:6 mean_pre_car_pct:3 mean_post_car_pct:3 mean_event_car_pct:3 mean_event_abs_usd:1 "
       + " ".join(f"mean_w{w}_car_pct:3 median_w{w}_car_pct:3 mean_w{w}_abs_usd:1 sum_w{w}_usd:0" for w in _W), f"""
SELECT preset, COUNT(*) AS n_events, AVG(peak_logret) AS mean_peak_logret, MEDIAN(peak_logret) AS median_peak_logret, AVG(peak_pct) AS mean_peak_pct,
       AVG(is_reversal) AS share_reversal, AVG(pre_car_pct) AS mean_pre_car_pct, AVG(post_car_pct) AS mean_post_car_pct,
       AVG(event_car_pct) AS mean_event_car_pct, AVG(event_abs_usd) AS mean_event_abs_usd,
       {', '.join(f'AVG(w{w}_car_pct) AS mean_w{w}_car_pct, MEDIAN(w{w}_car_pct) AS median_w{w}_car_pct, AVG(w{w}_abs_usd) AS mean_w{w}_abs_usd, SUM(w{w}_sum_usd) AS sum_w{w}_usd' for w in _W)}
FROM event_returns GROUP BY 1""")
def event_car_summary(spark, sf):
    return ev.event_car_summary(pn.event_returns(spark, sf))


@query("event_media_impact", f"{KEYS} event_number:i event_days_effect sum_effect_oof:1 abs_effect_oof:1 max_effect_oof:1 sum_effect_in:1 abs_effect_in:1 max_effect_in:1 "
       + " ".join(f"d{w}_days_effect d{w}_abs_effect_oof:1" for w in (7, 14, 30))
       + " share_event_oof:4 share_event_in:4 share_car7_oof:4 share_car14_oof:4 share_car30_oof:4 share_peak_oof:3", "SELECT * FROM impact")
def event_media_impact(spark, sf):
    return pn.event_impact(spark, sf)


@query("event_summary_rollup", "preset n_events sum_abs_effect:0 mean_abs_effect:1 max_abs_effect:1 mean_share_event:4 median_share_event:4 mean_share_car7:4 mean_share_car14:4 "
       "mean_share_car30:4 mean_event_car_pct:3 mean_car7_pct:3 share_reversal:6", """
SELECT preset, COUNT(*) AS n_events, SUM(abs_effect_oof) AS sum_abs_effect, AVG(abs_effect_oof) AS mean_abs_effect, MAX(abs_effect_oof) AS max_abs_effect,
       AVG(share_event_oof) AS mean_share_event, MEDIAN(share_event_oof) AS median_share_event, AVG(share_car7_oof) AS mean_share_car7,
       AVG(share_car14_oof) AS mean_share_car14, AVG(share_car30_oof) AS mean_share_car30, AVG(event_car_pct) AS mean_event_car_pct,
       AVG(w7_car_pct) AS mean_car7_pct, AVG(is_reversal) AS share_reversal FROM impact GROUP BY ROLLUP (preset)""")
def event_summary_rollup(spark, sf):
    return ev.event_impact_summary(pn.event_impact(spark, sf))


@query("top_events", f"{KEYS} abs_effect_oof:1", "SELECT * FROM impact ORDER BY abs_effect_oof DESC, series_id, preset, event_id LIMIT 50")
def top_events(spark, sf):
    return ev.top_events(pn.event_impact(spark, sf), 50)


GRID = {"w7": (7, 7), "w14": (14, 14), "w30": (30, 30)}
cte("grid_hits", f"""
SELECT e.series_id, e.preset, e.event_id, g.tag AS win, g.b AS before_days, g.a AS after_days, s.date, COALESCE(s.media_effect_oof, 0) AS m,
       COALESCE(s.excess_effect, 0) AS x, COALESCE(s.abnormal_usd, 0) AS u, s.score
FROM peaks e JOIN (VALUES {', '.join(f"('{t}', {b}, {a})" for t, (b, a) in GRID.items())}) g(tag, b, a) ON TRUE
LEFT JOIN scored s ON s.series_id = e.series_id AND s.date BETWEEN e.peak_date - g.b AND e.peak_date + g.a""")
cte("grid", """
SELECT *, 100.0 * sum_abs_excess / CASE WHEN sum_abs_media > 0 THEN sum_abs_media ELSE 1e-9 END AS excess_of_media_pct,
       100.0 * sum_abs_excess / CASE WHEN sum_abs_abnormal > 0 THEN sum_abs_abnormal ELSE 1e-9 END AS excess_of_abnormal_pct
FROM (SELECT series_id, preset, win, before_days, after_days, COUNT(date) AS n_unique_days, COALESCE(SUM(ABS(m)), 0) AS sum_abs_media,
        COALESCE(SUM(ABS(x)), 0) AS sum_abs_excess, COALESCE(SUM(ABS(u)), 0) AS sum_abs_abnormal
      FROM (SELECT DISTINCT series_id, preset, win, before_days, after_days, date, m, x, u FROM grid_hits) GROUP BY 1, 2, 3, 4, 5)
JOIN (SELECT series_id, preset, win, COUNT(*) AS n_peaks, COALESCE(AVG(s), 0) AS avg_score
      FROM (SELECT series_id, preset, win, event_id, AVG(score) AS s FROM grid_hits GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (series_id, preset, win)""")


@query("robustness_grid", "series_id preset win before_days:i after_days:i n_peaks n_unique_days sum_abs_media:1 sum_abs_excess:1 sum_abs_abnormal:1 "
       "excess_of_media_pct:4 excess_of_abnormal_pct:4 avg_score:6", "SELECT * FROM grid")
def robustness_grid(spark, sf):
    return ev.robustness_grid(pn.scored_panel(spark, sf), pn.peaks(spark, sf), GRID).withColumnRenamed("window", "win")


@query("robustness_range", "metric min_pct:4 max_pct:4 mean_pct:4 std_pct:4", " UNION ALL ".join(
    f"SELECT '{c}' AS metric, MIN({c}) AS min_pct, MAX({c}) AS max_pct, AVG({c}) AS mean_pct, STDDEV_POP({c}) AS std_pct FROM grid"
    for c in ("excess_of_media_pct", "excess_of_abnormal_pct")))
def robustness_range(spark, sf):
    grid = robustness_grid(spark, sf)
    return jn.union_all(*[ag.range_summary(grid, c) for c in ("excess_of_media_pct", "excess_of_abnormal_pct")])


@query("event_window_days", "series_id preset date:d", """
SELECT DISTINCT series_id, preset, CAST(UNNEST(RANGE((peak_date - 30)::TIMESTAMP, (peak_date + 31)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM peaks""")
def event_window_days(spark, sf):
    return jn.window_union_days(pn.peaks(spark, sf), 30, 30, "series_id", "preset")


@query("event_member_days", "series_id date:d price:6", """
SELECT series_id, date, price FROM price_panel WHERE (series_id, date) IN (
  SELECT DISTINCT series_id, CAST(UNNEST(RANGE((peak_date - 7)::TIMESTAMP, (peak_date + 8)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) FROM peaks)""")
def event_member_days(spark, sf):
    days = jn.window_union_days(pn.peaks(spark, sf), 7, 7, "series_id")
    return jn.member_days(fx.price_panel(spark, sf), days, on=("series_id", "date"))


# Articles -------------------------------------------------------------------------------

cte("event_articles", """
SELECT DISTINCT ON (series_id, preset, event_id, date, source_url, record_id) r.*, e.series_id, e.preset, e.event_id, e.window_start, e.window_end,
       e.preset || ':' || e.event_id || ':' || CAST(e.window_start AS VARCHAR) || '_' || CAST(e.window_end AS VARCHAR) AS window_key
FROM article_records r JOIN peaks e ON r.date BETWEEN e.window_start AND e.window_end""")


@query("event_articles", "series_id preset event_id record_id date:d source_url source_domain window_key num_articles avg_tone:1", "SELECT * FROM event_articles")
def event_articles(spark, sf):
    return ev.event_articles(fx.article_records(spark, sf), pn.peaks(spark, sf))


# URL words that occur in the given pages.
STRONG, AMBIGUOUS, CONTEXT = r"\b(bets|pills)\b", r"\b(fr|de)\b", r"\b(com|http|page|ref|utm_source)\b"
DOMAINS = ["spam-farm.example.org", "therin.example"]


def _url_sql(url: str, domains, strong: str, ambiguous: str, context: str, anchor: str) -> str:
    host = HOST.replace("(url,", f"({url},")
    known = "|".join(d.replace(".", "\\.") for d in domains)
    return (
        f"(REGEXP_MATCHES(REPLACE({host}, 'www.', ''), '{known}', 'i') OR REGEXP_MATCHES(LOWER({url}), '{strong}') OR "
        f"(REGEXP_MATCHES(LOWER({url}), '{ambiguous}') AND (LEN(REGEXP_EXTRACT_ALL(LOWER({url}), '{context}')) >= 2 OR CONTAINS(LOWER({url}), '{anchor}'))))")


@query("article_url_filter", "page_id keep keep_default", f"""
SELECT page_id, {_url_sql('url', DOMAINS, STRONG, AMBIGUOUS, CONTEXT, 'blog')} AS keep,
       {_url_sql('url', tp.ON_TOPIC_DOMAINS, tp.STRONG_URL, tp.AMBIGUOUS_URL, tp.CONTEXT_URL, 'bitcoin')} AS keep_default FROM pages""")
def article_url_filter(spark, sf):
    url = F.col("url")
    return fx.table(spark, sf, "pages").select(
        "page_id", tp.match_article_url(url, DOMAINS, STRONG, AMBIGUOUS, CONTEXT, "blog").alias("keep"),
        tp.match_article_url(url).alias("keep_default"))


LOW, TRUSTED = ["example.com", "spam-farm.example.org"], ["example.net"]


def _class_sql(d: str) -> str:
    def suffix(names) -> str:
        return " OR ".join(f"{d} = '{n}' OR ENDS_WITH({d}, '.{n}')" for n in names)

    return f"CASE WHEN {suffix(LOW)} THEN 'low_cred' WHEN {suffix(TRUSTED)} THEN 'trusted' ELSE 'unknown' END"


@query("domain_class", "domain cred articles", f"SELECT domain, {_class_sql('domain')} AS cred, COUNT(*) AS articles FROM articles GROUP BY 1, 2")
def domain_class(spark, sf):
    counts = fx.articles(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("articles"))
    return counts.withColumn("cred", tp.classify_domain(F.col("domain"), LOW, TRUSTED))


def _stats_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, SUM(w) AS total_mentions, SUM(CASE WHEN cred = 'low_cred' THEN w ELSE 0 END) AS low_cred_mentions,
       SUM(CASE WHEN cred = 'trusted' THEN w ELSE 0 END) AS trusted_mentions, SUM(CASE WHEN cred = 'unknown' THEN w ELSE 0 END) AS unknown_mentions,
       SUM(CASE WHEN cred = 'low_cred' THEN w ELSE 0 END) / SUM(w) AS low_cred_ratio, SUM(CASE WHEN cred = 'trusted' THEN w ELSE 0 END) / SUM(w) AS trusted_ratio,
       SUM(ts) / NULLIF(SUM(tn), 0) AS mean_tone, SUM(w * w) / (SUM(w) * SUM(w)) AS source_hhi
FROM (SELECT {keys}, domain, {_class_sql('domain')} AS cred, SUM(COALESCE(NULLIF(CAST(num_articles AS DOUBLE), 0), NULLIF(CAST(num_mentions AS DOUBLE), 0), 1)) AS w,
             SUM(avg_tone) AS ts, COUNT(avg_tone) AS tn FROM {source} GROUP BY {keys}, domain) GROUP BY {keys}"""


@query("article_stats", "event_id total_mentions:2 low_cred_mentions:2 trusted_mentions:2 unknown_mentions:2 low_cred_ratio:6 trusted_ratio:6 mean_tone:6",
       _stats_sql("articles", "event_id"))
def article_stats(spark, sf):
    per_domain = ag.domain_weights(fx.articles(spark, sf), ["event_id"])
    return ag.article_stats(per_domain, tp.classify_domain(F.col("domain"), LOW, TRUSTED), ["event_id"])


@query("source_hhi", "event_id source_hhi:6", _stats_sql("articles", "event_id"))
def source_hhi(spark, sf):
    return article_stats(spark, sf)


cte("event_article_stats", _stats_sql("(SELECT *, REPLACE(source_domain, 'www.', '') AS domain FROM event_articles)", EV.replace(", peak_date", "")))


def _event_article_stats(spark, sf):
    keys = ["series_id", "preset", "event_id"]
    arts = event_articles(spark, sf).withColumn("domain", F.replace(F.col("source_domain"), F.lit("www."), F.lit("")))
    return ag.article_stats(ag.domain_weights(arts, keys), tp.classify_domain(F.col("domain"), LOW, TRUSTED), keys)


@query("event_article_stats", "series_id preset event_id total_mentions:2 low_cred_ratio:6 trusted_ratio:6 mean_tone:6 source_hhi:6", "SELECT * FROM event_article_stats")
def event_article_stats(spark, sf):
    return _event_article_stats(spark, sf)


# Advanced event metrics ----------------------------------------------------------------------

cte("reversal", f"""
SELECT *, CASE WHEN shock_reversal IS NOT NULL THEN LEAST(GREATEST(shock_reversal, 0), 1) END AS temporary_share,
       1 - CASE WHEN shock_reversal IS NOT NULL THEN LEAST(GREATEST(shock_reversal, 0), 1) END AS permanent_share
FROM (SELECT {EV}, CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN ABS(dn) / NULLIF(ABS(up), 0) ELSE dnf / NULLIF(upf, 0) END AS shock_reversal
FROM (SELECT e.series_id, e.preset, e.event_id, e.peak_date, SUM(logret) FILTER (WHERE s.date <= e.peak_date + 2) AS up, SUM(logret) FILTER (WHERE s.date > e.peak_date + 2) AS dn,
      AVG(ABS(abnormal_usd)) FILTER (WHERE s.date <= e.peak_date + 2) AS upf, AVG(ABS(abnormal_usd)) FILTER (WHERE s.date > e.peak_date + 2) AS dnf
      FROM event_returns e LEFT JOIN scored s ON s.series_id = e.series_id AND s.date BETWEEN e.peak_date AND e.peak_date + 7 GROUP BY 1, 2, 3, 4))""")


@query("shock_reversal", f"{KEYS} shock_reversal:5 temporary_share:5 permanent_share:5", "SELECT * FROM reversal")
def shock_reversal(spark, sf):
    return ev.shock_reversal(pn.event_returns(spark, sf), pn.scored_panel(spark, sf), "logret", "abnormal_usd")


_PARTS = {"s1": "total_mentions", "s2": "ABS(mean_tone)", "s3": "source_hhi", "s4": "ABS(peak_usd)", "s5": "shock_reversal"}


def _z5(s: str) -> str:
    mu, sd = f"AVG({s}) OVER (PARTITION BY preset)", f"STDDEV_POP({s}) OVER (PARTITION BY preset)"
    return f"CASE WHEN {sd} >= 1e-9 THEN LEAST(GREATEST(({s} - {mu}) / NULLIF({sd}, 0), -3.0), 3.0) ELSE 0 END"


cte("advanced", f"""
SELECT *, low_credibility_impact / (low_credibility_impact + credible_impact + 1e-9) AS credibility_ratio,
       CASE WHEN composite >= 0.7 THEN 'HIGH' WHEN composite >= 0.55 THEN 'MODERATE' WHEN composite >= 0.45 THEN 'LOW-MODERATE' ELSE 'LOW' END AS composite_label
FROM (SELECT *, {sigmoid('composite_raw')} AS composite, COALESCE(abs_effect_oof, 0) * COALESCE(trusted_ratio, 0.20) AS credible_impact,
      COALESCE(abs_effect_oof, 0) * COALESCE(low_cred_ratio, 0.25) AS low_credibility_impact
FROM (SELECT *, {' + '.join(f'{w} * {_z5(s)}' for s, w in zip(_PARTS, ('0.25', '0.20', '0.20', '0.20', '0.15')))} AS composite_raw
FROM (SELECT i.*, COALESCE(a.total_mentions, 0) AS total_mentions, a.low_cred_ratio, a.trusted_ratio, a.mean_tone, a.source_hhi,
             r.shock_reversal, r.temporary_share, r.permanent_share, {', '.join(f'COALESCE({e}, 0) AS {s}' for s, e in _PARTS.items())}
      FROM impact i LEFT JOIN event_article_stats a USING (series_id, preset, event_id) LEFT JOIN reversal r USING ({EV}))))""")


def _advanced(spark, sf):
    def build():
        return ev.advanced_event_metrics(pn.event_impact(spark, sf), _event_article_stats(spark, sf), shock_reversal(spark, sf))

    return stage(spark, sf, "advanced", build)


@query("advanced_event_metrics", f"{KEYS} abs_effect_oof:1 total_mentions:2 mean_tone:5 source_hhi:5 shock_reversal:5 temporary_share:5 permanent_share:5 composite:6 composite_label", "SELECT * FROM advanced")
def advanced_event_metrics(spark, sf):
    return _advanced(spark, sf)


@query("event_composite", f"{KEYS} composite_raw:6 composite:6 composite_label", "SELECT * FROM advanced")
def event_composite(spark, sf):
    return _advanced(spark, sf)


@query("credibility_impact", f"{KEYS} credible_impact:1 low_credibility_impact:1 credibility_ratio:5", "SELECT * FROM advanced")
def credibility_impact(spark, sf):
    return _advanced(spark, sf)


@query("top5_events", f"{KEYS} composite:6", "SELECT * FROM advanced ORDER BY composite DESC, series_id, preset, event_id LIMIT 5")
def top5_events(spark, sf):
    return jn.top_n(_advanced(spark, sf), 5, "composite", "series_id", "preset", "event_id")


@query("advanced_summary", "preset n_events mean_composite:6 median_composite:6 high moderate_or_more mean_hhi:5 mean_reversal:4 sum_credible:0 sum_low_credibility:0", """
SELECT preset, COUNT(*) AS n_events, AVG(composite) AS mean_composite, MEDIAN(composite) AS median_composite, COUNT(*) FILTER (WHERE composite >= 0.70) AS high,
       COUNT(*) FILTER (WHERE composite >= 0.55) AS moderate_or_more, AVG(source_hhi) AS mean_hhi, AVG(shock_reversal) AS mean_reversal,
       SUM(credible_impact) AS sum_credible, SUM(low_credibility_impact) AS sum_low_credibility FROM advanced GROUP BY ROLLUP (preset)""")
def advanced_summary(spark, sf):
    stats = {
        "n_events": F.count(F.lit(1)), "mean_composite": F.avg("composite"), "high": F.count_if(F.col("composite") >= 0.70),
        "moderate_or_more": F.count_if(F.col("composite") >= 0.55), "mean_hhi": F.avg("source_hhi"), "mean_reversal": F.avg("shock_reversal"),
        "sum_credible": F.sum("credible_impact"), "sum_low_credibility": F.sum("low_credibility_impact")}
    return ag.grouped_summary(_advanced(spark, sf), "preset", stats, {"median_composite": "composite"}, total=True)


# News files rendered from the given documents and pages ------------------------------------------

WORDS = {"all": ["worthless", "license", "tionhent", "@"], "balanced": ["worthless", "license"], "sensitive": ["worthless", "license", "the ther"], "strong": ["license"]}
TOPICS = {"all": ["LANG_FR", "LANG_ES"], "balanced": ["SRC13;"], "sensitive": ["LANG_FR"], "strong": ["SRC13;"]}
_TEXT = "REGEXP_REPLACE(text, '[\\t\\r\\n]+', ' ', 'g')"


def gkg_lines(spark, sf):
    """27-field tab rows; the whole text sits in field 22."""
    d = fx.table(spark, sf, "documents")
    day = F.date_format(F.date_add(F.to_date(F.lit("2015-11-01")), (F.col("doc_id") % 500).cast("int")), "yyyyMMdd")
    tone = F.when(F.col("doc_id") % 13 == 0, "n/a").otherwise(F.concat(((F.col("doc_id") % 41) - 20).cast("string"), F.lit(".25,1,2")))
    fields = {
        0: F.col("doc_id").cast("string"), 1: F.concat(day, F.lit("000000")), 3: F.col("source"),
        7: F.concat(F.lit("LANG_"), F.upper("lang"), F.lit(";"), F.upper("source"), F.lit(";")), 11: tone, 15: tone,
        22: F.regexp_replace("text", r"[\t\r\n]+", " ")}
    return d.select(F.concat_ws("\t", *[fields.get(i, F.lit("")) for i in range(ns.GKG_WIDTH)]).alias("value"))


def _write_text(spark, df, name: str) -> str:
    path = fresh_path(spark, name)
    df.write.text(path)
    return path


def _topic_sql(p: str) -> str:
    words = "|".join(w for w in WORDS[p])
    line = f"(source || ' ' || {_TEXT} || ' LANG_' || UPPER(lang) || ';' || UPPER(source) || ';')"
    themes = "('LANG_' || UPPER(lang) || ';' || UPPER(source) || ';')"
    return f"(REGEXP_MATCHES({line}, '{words}', 'i') OR REGEXP_MATCHES({themes}, '{'|'.join(TOPICS[p])}', 'i'))"


cte("gkg", " UNION ALL ".join(f"""
SELECT '{p}' AS preset, doc_id, DATE '2015-11-01' + CAST(doc_id % 500 AS INTEGER) AS day, {_topic_sql(p)} AS matched,
       CASE WHEN doc_id % 13 <> 0 THEN CAST(CAST((doc_id % 41) - 20 AS VARCHAR) || '.25' AS DOUBLE) END AS tone, lang, source FROM documents""" for p in WORDS))


@query("gkg_scan", "preset day:d mentions tone:6", """
SELECT preset, day, COUNT(*) FILTER (WHERE matched) AS mentions, AVG(tone) FILTER (WHERE matched) AS tone FROM gkg GROUP BY 1, 2""")
def gkg_scan(spark, sf):
    path = _write_text(spark, gkg_lines(spark, sf), "gkg")
    return ag.daily_signal_of_files(ns.scan_gkg(spark, path, WORDS, TOPICS), "preset", row_mean=True).withColumnRenamed("date", "day")


@query("gkg_topic_daily", "date:d mentions tone:6", f"""
SELECT day AS date, COUNT(*) AS mentions, AVG(tone) AS tone FROM (SELECT day, tone, lang, source FROM gkg WHERE preset = 'all')
WHERE REGEXP_MATCHES('LANG_' || UPPER(lang), 'LANG_FR|LANG_ES', 'i') OR REGEXP_MATCHES(source, 'src1', 'i') GROUP BY 1""")
def gkg_topic_daily(spark, sf):
    path = _write_text(spark, gkg_lines(spark, sf), "gkg")
    frame = ns.gkg_frame(ns.read_news_lines(spark, path).filter(F.col("format") == "gkg"))
    return ag.daily_plain(ns.match_gkg_topic(frame, ["src1"], TOPICS["all"]))


def event_lines(spark, sf):
    """58-column event rows of the given pages."""
    p = fx.table(spark, sf, "pages")
    k = F.col("page_id")
    day = F.date_format(F.date_add(F.to_date(F.lit("1995-01-01")), (k * 37 % 2400).cast("int")), "yyyyMMdd")
    cells = {
        "record_id": k.cast("string"), "sql_date": F.when(k % 17 == 0, "notadate").otherwise(day), "event_code": (k % 200).cast("string"),
        "event_root_code": (k % 20).cast("string"), "goldstein": ((k % 21) / 2.0 - 5).cast("string"), "num_mentions": F.when(k % 5 == 0, "").otherwise((k % 9).cast("string")),
        "num_sources": (k % 4).cast("string"), "num_articles": (1 + k % 5).cast("string"), "avg_tone": ((k % 21) - 10).cast("string"), "source_url": F.col("url")}
    at = {i: cells[n] for n, i in ns.EVENT_INDEX.items()}
    at[6], at[16] = F.lit("therin agency"), F.lit("other")
    return p.select(*[at.get(i, F.lit("")).alias(c) for i, c in enumerate(ns.EVENT_COLUMNS)])


def _write_events(spark, sf) -> str:
    path = fresh_path(spark, "export")
    event_lines(spark, sf).write.csv(path, sep="\t")
    return path


@query("news_events_scan", "record_id date:d event_code event_root_code goldstein:2 num_mentions:0 num_sources:0 num_articles:0 avg_tone:2 source_url source_domain", f"""
SELECT CAST(page_id AS VARCHAR) AS record_id, DATE '1995-01-01' + CAST(page_id * 37 % 2400 AS INTEGER) AS date, CAST(page_id % 200 AS VARCHAR) AS event_code,
       CAST(page_id % 20 AS VARCHAR) AS event_root_code, (page_id % 21) / 2.0 - 5 AS goldstein, CASE WHEN page_id % 5 <> 0 THEN page_id % 9 END AS num_mentions,
       page_id % 4 AS num_sources, 1 + page_id % 5 AS num_articles, (page_id % 21) - 10 AS avg_tone, url AS source_url, {HOST} AS source_domain
FROM pages WHERE page_id % 17 <> 0 AND {_url_sql('url', DOMAINS, STRONG, AMBIGUOUS, CONTEXT, 'blog')}""")
def news_events_scan(spark, sf):
    return ns.scan_news_events(
        spark, _write_events(spark, sf), lambda url: tp.match_article_url(url, DOMAINS, STRONG, AMBIGUOUS, CONTEXT, "blog"))


@query("news_events_daily", "date:d mentions:2 tone:6 n_articles", """
SELECT date, SUM(COALESCE(m, 1)) AS mentions, SUM(t * COALESCE(m, 1)) / NULLIF(SUM(COALESCE(m, 1)), 0) AS tone, COUNT(*) AS n_articles
FROM (SELECT DATE '1995-01-01' + CAST(page_id * 37 % 2400 AS INTEGER) AS date, CASE WHEN page_id % 5 <> 0 THEN page_id % 9 END AS m, (page_id % 21) - 10 AS t
      FROM pages WHERE page_id % 17 <> 0 AND REGEXP_MATCHES(url, 'blog|pills', 'i')) GROUP BY 1""")
def news_events_daily(spark, sf):
    raw = ns.read_events_tab(spark, _write_events(spark, sf))
    return ag.daily_weighted(ns.events_daily_input(ns.match_events_topic(raw, ["blog", "pills"])))


@query("news_formats", "format rows", "SELECT 'gkg' AS format, COUNT(*) AS rows FROM documents UNION ALL SELECT 'events', COUNT(*) FROM pages")
def news_formats(spark, sf):
    lines = event_lines(spark, sf).select(F.concat_ws("\t", *ns.EVENT_COLUMNS).alias("value"))
    path = _write_text(spark, jn.union_all(gkg_lines(spark, sf), lines), "mixed")
    return ns.read_news_lines(spark, path).groupBy("format").agg(F.count(F.lit(1)).alias("rows"))


# Out-of-sample checks per event ---------------------------------------------------------------------

@query("event_validation", f"{KEYS} split score_mean:6 score_max:6 excess_sum:1 above_threshold n_days", f"""
SELECT {EV}, CASE WHEN peak_date >= DATE '2000-01-01' THEN 'TEST' ELSE 'TRAIN' END AS split, AVG(oos_score) AS score_mean, MAX(oos_score) AS score_max,
       SUM(excess_effect) AS excess_sum, AVG(oos_score) > MAX(threshold) AS above_threshold, COUNT(*) AS n_days
FROM peaks JOIN oos USING (series_id) WHERE date BETWEEN peak_date - 3 AND peak_date + 2 GROUP BY {EV}""")
def event_validation(spark, sf):
    return ev.event_validation(pn.validated(spark, sf), pn.peaks(spark, sf), fx.BOUNDARY)
