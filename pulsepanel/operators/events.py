"""Peak detection and event studies on panels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepanel.functions.clean import clip, eps_ratio, pct_from_logret, safe_ratio_pct, sign3
from pulsepanel.functions.index import composite_label, sigmoid
from pulsepanel.operators.aggregates import grouped_summary
from pulsepanel.operators.joins import events_x_daily, events_x_rows, number_rows, salted_join, top_n
from pulsepanel.sources.recordstore import days_of_windows, records_of_days
from pulsepanel.operators.windows import event_id, local_max, log_return, min_gap_dates, ordered, rolling_zscore


class PeakParams(NamedTuple):
    window: int
    threshold: float
    half: int
    gap: int


# Peak presets, window half-width, CAR widths.
PEAK_PRESETS = {
    "strong": PeakParams(90, 3.0, 7, 21),
    "balanced": PeakParams(30, 2.8, 5, 21),
    "sensitive": PeakParams(45, 2.0, 3, 7),
}
EVENT_PRE = EVENT_POST = 7
CAR_WIDTHS = (3, 7, 14, 30)
COMPOSITE_WEIGHTS = (0.25, 0.20, 0.20, 0.20, 0.15)

EVENT_KEYS = ["series_id", "preset", "event_id", "peak_date"]


def detect_peaks(panel: DataFrame, presets: dict[str, PeakParams] = PEAK_PRESETS, start: str | None = None) -> DataFrame:
    """Local maxima of the rolling z-score of log returns, thinned by a minimum gap.

    All presets share one sort per series; the candidates are then few.
    """
    w = ordered()
    work = panel.filter(F.col("date") >= F.to_date(F.lit(start))) if start else panel
    work = work.withColumn("__ret", log_return(F.col("price"), w))
    work = work.withColumns({f"__z_{p}": rolling_zscore(F.col("__ret"), w, v.window) for p, v in presets.items()})
    marks = [
        F.when(
            (F.col(f"__z_{p}") >= v.threshold) & local_max(F.col(f"__z_{p}"), w, v.half),
            F.struct(F.lit(p).alias("preset"), F.col(f"__z_{p}").alias("zscore"), F.lit(v.gap).alias("gap")),
        )
        for p, v in presets.items()
    ]
    candidates = (
        work.select("series_id", "date", "price", "mcap", F.array_compact(F.array(*marks)).alias("hits"))
        .select("series_id", "date", "price", "mcap", F.explode("hits").alias("h"))
        .select("series_id", "date", "price", "mcap", "h.*")
    )
    kept = min_gap_dates(candidates, F.col("gap"), "series_id", "preset")
    peaks = candidates.join(kept, ["series_id", "preset", "date"])
    number = F.row_number().over(ordered("series_id", "preset"))

    def param(i: int) -> Column:
        pick = F.when(F.lit(False), None)
        for p, v in presets.items():
            pick = pick.when(F.col("preset") == p, F.lit(v[i]))
        return pick

    return peaks.select(
        "series_id", "preset", event_id(F.col("preset"), number).alias("event_id"), F.col("date").alias("peak_date"),
        F.date_sub("date", EVENT_PRE).alias("window_start"), F.date_add("date", EVENT_POST).alias("window_end"),
        "zscore", "mcap", "price",
        param(0).alias("param_window"), param(1).alias("param_threshold"), param(2).alias("param_half"),
        param(3).alias("param_gap"), F.lit(EVENT_PRE).alias("param_pre"), F.lit(EVENT_POST).alias("param_post"),
    )


def car(cond: Column, prefix: str) -> dict[str, Column]:
    """Cumulative abnormal return over the rows where ``cond`` holds."""
    def pick(c: str) -> Column:
        return F.when(cond, F.col(c))

    total = F.sum(pick("abnormal_logret"))
    return {
        f"{prefix}_car_log": total,
        f"{prefix}_car_pct": pct_from_logret(total),
        f"{prefix}_mean_logret": F.avg(pick("abnormal_logret")),
        f"{prefix}_mean_pct": F.avg(pick("abnormal_return_pct")),
        f"{prefix}_sum_usd": F.sum(pick("abnormal_usd")),
        f"{prefix}_abs_usd": F.sum(F.abs(pick("abnormal_usd"))),
        f"{prefix}_days": F.count_if(F.coalesce(cond, F.lit(False))),
    }


def event_abnormal_returns(daily: DataFrame, events: DataFrame, pre: int = 7, post: int = 7, widths=CAR_WIDTHS) -> DataFrame:
    """Peak-day values, drift before, continuation after, CARs and reversal.

    Row offsets drive pre, post and CAR windows; the event window is by
    calendar days, as long as the event says.  One join serves all, with
    conditional aggregation by offset.
    """
    need = ["abnormal_logret", "abnormal_return_pct", "abnormal_z60", "abnormal_usd"]
    numbered = number_rows(daily.select("series_id", "date", F.col("price").alias("p"), F.col("mcap").alias("m"), *need))
    ev = events.select(*EVENT_KEYS, "window_start", "window_end")
    # A series has one row a day at most, so days to the window's ends bound the rows to them.
    to_start = F.coalesce(F.date_diff("peak_date", "window_start"), F.lit(0))
    to_end = F.coalesce(F.date_diff("window_end", "peak_date"), F.lit(0))
    before = F.greatest(F.lit(max(pre, 0)), to_start)
    after = F.greatest(F.lit(max([post, *[w - 1 for w in widths]])), to_end)
    rows = events_x_rows(ev, numbered, before, after)
    off, date = F.col("offset"), F.col("date")

    def at_peak(c: str) -> Column:
        return F.max(F.when(off == 0, F.col(c)))

    aggs = {
        "price_at_peak": at_peak("p"), "mcap_at_peak": at_peak("m"),
        "peak_logret": at_peak("abnormal_logret"), "peak_pct": at_peak("abnormal_return_pct"),
        "peak_z60": at_peak("abnormal_z60"), "peak_usd": at_peak("abnormal_usd"),
        **car(off.between(-pre, -1), "pre"), **car(off.between(1, post), "post"),
    }
    for w in widths:
        aggs |= car(off.between(0, w - 1), f"w{w}")
    aggs |= car(date.between(F.col("window_start"), F.col("window_end")), "event")
    out = rows.groupBy(*EVENT_KEYS, "window_start", "window_end").agg(*[c.alias(n) for n, c in aggs.items()])
    return with_reversal(out)


def with_reversal(events: DataFrame) -> DataFrame:
    """Minus post over peak, both signs, and 1 when they oppose."""
    flip = sign3(F.col("peak_logret")) * sign3(F.col("post_car_log"))
    return events.withColumns({
        "reversal_ratio": -F.col("post_car_log") / F.nullif(F.col("peak_logret"), F.lit(0.0)),
        "peak_sign": sign3(F.col("peak_logret")),
        "post_sign": sign3(F.col("post_car_log")),
        "is_reversal": (flip < 0).cast("int"),
    })


def event_car_summary(ev: DataFrame, widths=CAR_WIDTHS) -> DataFrame:
    stats = {
        "n_events": F.count(F.lit(1)),
        "mean_peak_logret": F.avg("peak_logret"), "mean_peak_pct": F.avg("peak_pct"),
        "share_reversal": F.avg("is_reversal"),
        "mean_pre_car_pct": F.avg("pre_car_pct"), "mean_post_car_pct": F.avg("post_car_pct"),
        "mean_event_car_pct": F.avg("event_car_pct"), "mean_event_abs_usd": F.avg("event_abs_usd"),
    }
    medians = {"median_peak_logret": "peak_logret"}
    for w in widths:
        stats |= {
            f"mean_w{w}_car_pct": F.avg(f"w{w}_car_pct"),
            f"mean_w{w}_abs_usd": F.avg(f"w{w}_abs_usd"),
            f"sum_w{w}_usd": F.sum(f"w{w}_sum_usd"),
        }
        medians[f"median_w{w}_car_pct"] = f"w{w}_car_pct"
    return grouped_summary(ev, "preset", stats, medians)


def event_media_impact(daily: DataFrame, events: DataFrame, fallback: int = 30) -> DataFrame:
    """Media effect inside each event window and in +-7, 14, 30 days of the peak.

    ``events`` is the abnormal-return table; its columns are carried along.
    An event without both bounds gets ``fallback`` days on either side.
    Shares divide calendar windows by the row windows of the CARs.
    """
    whole = F.col("window_start").isNotNull() & F.col("window_end").isNotNull()
    ws = F.when(whole, F.col("window_start")).otherwise(F.date_sub("peak_date", fallback))
    we = F.when(whole, F.col("window_end")).otherwise(F.date_add("peak_date", fallback))
    ev = events.withColumns({"window_start": ws, "window_end": we})
    effect = daily.select("series_id", "date", F.lit(1).alias("hit"), "media_effect", "media_effect_oof")
    before = F.greatest(F.lit(30), F.date_diff("peak_date", "window_start"))
    after = F.greatest(F.lit(30), F.date_diff("window_end", "peak_date"))
    rows = events_x_daily(ev.select(*EVENT_KEYS, "window_start", "window_end"), effect, before, after, how="left")
    inside = F.col("date").between(F.col("window_start"), F.col("window_end"))

    def pick(c: str, cond: Column) -> Column:
        return F.coalesce(F.when(cond, F.col(c)), F.lit(0.0))

    aggs = {"event_days_effect": F.count(F.when(inside, F.col("hit")))}
    for tag, c in (("oof", "media_effect_oof"), ("in", "media_effect")):
        x = pick(c, inside)
        aggs |= {f"sum_effect_{tag}": F.sum(x), f"abs_effect_{tag}": F.sum(F.abs(x)), f"max_effect_{tag}": F.max(F.abs(x))}
    for w in (7, 14, 30):
        near = F.abs("offset") <= w
        aggs[f"d{w}_days_effect"] = F.count(F.when(near, F.col("hit")))
        aggs[f"d{w}_abs_effect_oof"] = F.sum(F.abs(pick("media_effect_oof", near)))
    sums = rows.groupBy(*EVENT_KEYS).agg(*[c.alias(n) for n, c in aggs.items()])
    out = ev.join(sums, EVENT_KEYS)
    return out.withColumns({
        "event_number": F.row_number().over(ordered("series_id", "preset", by="peak_date")),
        "share_event_oof": safe_ratio_pct(F.col("abs_effect_oof"), F.col("event_abs_usd")),
        "share_event_in": safe_ratio_pct(F.col("abs_effect_in"), F.col("event_abs_usd")),
        "share_car7_oof": safe_ratio_pct(F.col("d7_abs_effect_oof"), F.col("w7_abs_usd")),
        "share_car14_oof": safe_ratio_pct(F.col("d14_abs_effect_oof"), F.col("w14_abs_usd")),
        "share_car30_oof": safe_ratio_pct(F.col("d30_abs_effect_oof"), F.col("w30_abs_usd")),
        "share_peak_oof": safe_ratio_pct(F.col("max_effect_oof"), F.abs("peak_usd")),
    })


def event_impact_summary(impact: DataFrame) -> DataFrame:
    stats = {
        "n_events": F.count(F.lit(1)),
        "sum_abs_effect": F.sum("abs_effect_oof"), "mean_abs_effect": F.avg("abs_effect_oof"),
        "max_abs_effect": F.max("abs_effect_oof"), "mean_share_event": F.avg("share_event_oof"),
        "mean_share_car7": F.avg("share_car7_oof"), "mean_share_car14": F.avg("share_car14_oof"),
        "mean_share_car30": F.avg("share_car30_oof"), "mean_event_car_pct": F.avg("event_car_pct"),
        "mean_car7_pct": F.avg("w7_car_pct"), "share_reversal": F.avg("is_reversal"),
    }
    return grouped_summary(impact, "preset", stats, {"median_share_event": "share_event_oof"}, total=True)


def top_events(impact: DataFrame, n: int = 50) -> DataFrame:
    return top_n(impact, n, "abs_effect_oof", "series_id", "preset", "event_id")


def robustness_grid(daily: DataFrame, events: DataFrame, windows: dict[str, tuple[int, int]], keys=("series_id", "preset")) -> DataFrame:
    """Per preset and window: sums over distinct days and the mean event score.

    A day covered by several events counts once: each day first learns which
    windows reach it, then one conditional aggregation serves all windows.
    """
    before = max(b for b, _ in windows.values())
    after = max(a for _, a in windows.values())
    rows = events_x_daily(
        events.select(*EVENT_KEYS).distinct(),
        daily.select("series_id", "date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in
                                            ("media_effect_oof", "excess_effect", "abnormal_usd", "score")]),
        before, after, how="left",
    ).withColumn("hit", F.col("score").isNotNull())
    reach = {t: F.col("hit") & F.col("offset").between(-b, a) for t, (b, a) in windows.items()}
    day = rows.groupBy(*keys, "series_id", "date") if "series_id" not in keys else rows.groupBy(*keys, "date")
    values = ("media_effect_oof", "excess_effect", "abnormal_usd")
    days = day.agg(*[F.bool_or(c).alias(t) for t, c in reach.items()], *[F.first(v).alias(v) for v in values])
    sums = []
    for t in windows:
        sums.append(F.count_if(F.col(t)).alias(f"{t}_days"))
        sums += [F.coalesce(F.sum(F.when(F.col(t), F.abs(F.col(v)))), F.lit(0.0)).alias(f"{t}_{v}") for v in values]
    per_event = rows.groupBy(*EVENT_KEYS).agg(*[F.avg(F.when(c, F.col("score"))).alias(t) for t, c in reach.items()])
    scores = per_event.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_peaks"), *[F.coalesce(F.avg(t), F.lit(0.0)).alias(f"{t}_score") for t in windows])
    wide = days.groupBy(*keys).agg(*sums).join(scores, list(keys))
    cells = F.array(*[
        F.struct(
            F.lit(t).alias("window"), F.lit(b).alias("before_days"), F.lit(a).alias("after_days"),
            F.col(f"{t}_days").alias("n_unique_days"), F.col(f"{t}_media_effect_oof").alias("sum_abs_media"),
            F.col(f"{t}_excess_effect").alias("sum_abs_excess"), F.col(f"{t}_abnormal_usd").alias("sum_abs_abnormal"),
            F.col(f"{t}_score").alias("avg_score"))
        for t, (b, a) in windows.items()
    ])
    out = wide.select(*keys, "n_peaks", F.explode(cells).alias("c")).select(*keys, "n_peaks", "c.*")

    def share(den: str) -> Column:
        return 100.0 * F.col("sum_abs_excess") / F.when(F.col(den) > 0, F.col(den)).otherwise(1e-9)

    return out.withColumns({"excess_of_media_pct": share("sum_abs_media"), "excess_of_abnormal_pct": share("sum_abs_abnormal")})


def shock_reversal(events: DataFrame, daily: DataFrame, ret: str, fallback: str | None = None) -> DataFrame:
    """|sum of days 3..7| over |sum of days 0..2|; mean absolute fallback values.

    The temporary share is the index capped at 1, the permanent one its rest.
    """
    fb = F.abs(F.col(fallback)) if fallback else F.lit(None).cast("double")
    d = daily.select("series_id", "date", F.col(ret).alias("__r"), fb.alias("__f"))
    rows = events_x_daily(events.select(*EVENT_KEYS), d, 0, 7, how="left")
    early, late = F.col("offset") <= 2, F.col("offset") > 2
    s = rows.groupBy(*EVENT_KEYS).agg(
        F.sum(F.when(early, F.col("__r"))).alias("up"), F.sum(F.when(late, F.col("__r"))).alias("dn"),
        F.avg(F.when(early, F.col("__f"))).alias("upf"), F.avg(F.when(late, F.col("__f"))).alias("dnf"),
    )
    main = F.abs("dn") / F.nullif(F.abs("up"), F.lit(0.0))
    back = F.col("dnf") / F.nullif(F.col("upf"), F.lit(0.0))
    index = F.when(F.col("up").isNotNull() & F.col("dn").isNotNull(), main).otherwise(back)
    out = s.select(*EVENT_KEYS, index.alias("shock_reversal"))
    temporary = clip(F.col("shock_reversal"), 0.0, 1.0)
    return out.withColumns({"temporary_share": temporary, "permanent_share": 1.0 - temporary})


def event_composite(events: DataFrame, group: str = "preset") -> DataFrame:
    """Five weighted z-scores over all events of a group, squashed to (0, 1)."""
    parts = {
        "s1": F.coalesce("total_mentions", F.lit(0.0)), "s2": F.coalesce(F.abs("mean_tone"), F.lit(0.0)),
        "s3": F.coalesce("source_hhi", F.lit(0.0)), "s4": F.coalesce(F.abs("peak_usd"), F.lit(0.0)),
        "s5": F.coalesce("shock_reversal", F.lit(0.0)),
    }
    df = events.withColumns(parts)
    stats = df.groupBy(group).agg(
        *[F.avg(s).alias(f"{s}_mu") for s in parts], *[F.stddev_pop(s).alias(f"{s}_sd") for s in parts])
    df = df.join(stats, group)
    raw = F.lit(0.0)
    for s, weight in zip(parts, COMPOSITE_WEIGHTS):
        z = clip((F.col(s) - F.col(f"{s}_mu")) / F.when(F.col(f"{s}_sd") >= 1e-9, F.col(f"{s}_sd")), -3.0, 3.0)
        raw = raw + weight * F.coalesce(z, F.lit(0.0))
    df = df.withColumn("composite_raw", raw)
    return df.withColumn("composite", sigmoid(F.col("composite_raw"))).withColumn(
        "composite_label", composite_label(F.col("composite"))
    ).drop(*parts, *[f"{s}_{k}" for s in parts for k in ("mu", "sd")])


def credibility_impact(events: DataFrame) -> DataFrame:
    """Effect split by trusted and low-credibility shares (defaults .20 and .25)."""
    effect = F.coalesce("abs_effect_oof", F.lit(0.0))
    good = effect * F.coalesce("trusted_ratio", F.lit(0.20))
    bad = effect * F.coalesce("low_cred_ratio", F.lit(0.25))
    return events.withColumns({
        "credible_impact": good, "low_credibility_impact": bad, "credibility_ratio": eps_ratio(bad, bad + good),
    })


def advanced_event_metrics(impact: DataFrame, articles: DataFrame, reversal: DataFrame, group: str = "preset") -> DataFrame:
    """Impact, article statistics, reversal, composite and credibility per event.

    ``articles`` has one row per (series_id, preset, event_id), so the join on
    the event key cannot fan out.
    """
    out = impact.join(articles, [k for k in EVENT_KEYS if k in articles.columns], "left").join(reversal, EVENT_KEYS, "left")
    out = out.withColumn("total_mentions", F.coalesce("total_mentions", F.lit(0.0)))
    return credibility_impact(event_composite(out, group))


def event_validation(daily: DataFrame, events: DataFrame, boundary: str) -> DataFrame:
    """Mean and largest score in [-3, +2] days of each event, against a threshold."""
    rows = events_x_daily(
        events.select(*EVENT_KEYS), daily.select("series_id", "date", "oos_score", "excess_effect", "threshold"), 3, 2)
    return rows.groupBy(*EVENT_KEYS).agg(
        F.avg("oos_score").alias("score_mean"), F.max("oos_score").alias("score_max"),
        F.sum("excess_effect").alias("excess_sum"), F.max("threshold").alias("threshold"), F.count(F.lit(1)).alias("n_days"),
    ).withColumns({
        "split": F.when(F.col("peak_date") >= F.to_date(F.lit(boundary)), "TEST").otherwise("TRAIN"),
        "above_threshold": F.col("score_mean") > F.col("threshold"),
    })


def records_in_windows(records: DataFrame, windows: DataFrame, salts: int = 1) -> DataFrame:
    """Each record joined to every event window that holds its day.

    Windows become one row per day, so this is an equi-join.  A day that holds
    a large part of all records is split by adaptive execution; ``salts``
    above 1 spreads every day beforehand instead.
    """
    days = windows.select(
        "series_id", "preset", "event_id", "window_start", "window_end",
        F.explode(F.sequence("window_start", "window_end")).alias("date"),
    )
    return salted_join(records, days, ["date"], salts) if salts > 1 else records.join(days, "date")


def event_articles(records: DataFrame, windows: DataFrame, salts: int = 1) -> DataFrame:
    """Record x window fan-out, each composite key once.

    Only records of days inside windows are taken up; of a table with a folder
    per day no other is read.  An event has one window, so it is enough that no
    record comes twice; the fan-out itself is never shuffled.
    """
    records = records_of_days(records, days_of_windows(windows))
    rows = records_in_windows(records.dropDuplicates(["date", "source_url", "record_id"]), windows, salts)
    key = F.format_string("%s:%s:%s_%s", "preset", "event_id", F.col("window_start").cast("string"), F.col("window_end").cast("string"))
    return rows.withColumn("window_key", key)
