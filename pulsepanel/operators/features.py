"""Market features and the news feature blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pulsepanel.functions.clean import calendar_parts, neg_part, pos_part
from pulsepanel.operators.windows import (
    lags, log_return, means_of_sums, ordered, regime_sign, rolling_pop_std, rolling_std, rolling_sums, rolling_zscore,
)

# Lag and window widths of the news block.
LAGS, WIDTHS, STD_WIDTHS, Z_WIDTH = (1, 3, 7), (3, 7, 14, 30), (7, 14, 30), 30
LAGGED = ("log", "tone", "cross", "bad", "good", "log_z", "tone_z", "bad_z", "mentions")
AVERAGED = ("mentions", "log", "tone", "bad", "good")
SPREAD = ("log", "tone", "bad")


def market_features(panel: DataFrame) -> DataFrame:
    w = ordered()
    out = panel.withColumn("logret", log_return(F.col("price"), w))
    return out.withColumns({"vol_30": rolling_std(F.col("logret"), w, 30), "regime": regime_sign(F.col("logret"))})


def _base_names(s: str) -> dict[str, str]:
    return {
        "mentions": f"news_mentions{s}", "tone": f"news_tone{s}", "log": f"news_log_mentions{s}",
        "neg": f"news_negative_tone{s}", "pos": f"news_positive_tone{s}", "cross": f"news_tone_x_log_mentions{s}",
        "bad": f"news_bad_intensity{s}", "good": f"news_good_intensity{s}", "log_z": f"news_log_mentions_z{Z_WIDTH}{s}",
        "tone_z": f"news_tone_z{Z_WIDTH}{s}", "bad_z": f"news_bad_intensity_z{Z_WIDTH}{s}",
        "attention": f"news_extreme_attention{s}", "weekend": f"news_weekend{s}",
    }


def news_base(df: DataFrame, suffix: str) -> DataFrame:
    """Counts and tone per day with missing as 0; tone only on days with news."""
    n = _base_names(suffix)
    m = F.coalesce(F.col(n["mentions"]).cast("double"), F.lit(0.0))
    t = F.when(m > 0, F.coalesce(F.col(n["tone"]), F.lit(0.0))).otherwise(0.0)
    df = df.withColumns({n["mentions"]: m, n["tone"]: t})
    log, tone = F.log1p(n["mentions"]), F.col(n["tone"])
    return df.withColumns({
        n["log"]: log, n["neg"]: neg_part(tone), n["pos"]: pos_part(tone), n["cross"]: tone * log,
        n["bad"]: neg_part(tone) * log, n["good"]: pos_part(tone) * log,
    })


SEEN = "__seen"


def news_scores(suffix: str, w: WindowSpec) -> dict[str, Column]:
    n, seen = _base_names(suffix), F.col(SEEN)
    return {
        n["log_z"]: rolling_zscore(F.col(n["log"]), w, Z_WIDTH, seen),
        n["tone_z"]: rolling_zscore(F.col(n["tone"]), w, Z_WIDTH, seen),
        n["bad_z"]: rolling_zscore(F.col(n["bad"]), w, Z_WIDTH, seen),
        n["weekend"]: ((F.weekday("date") >= 5) & (F.col(n["mentions"]) > 0)).cast("double"),
    }


def news_windows(suffix: str, w: WindowSpec) -> dict[str, Column]:
    """27 lags, 20 sums and 9 deviations."""
    n = _base_names(suffix)
    out: dict[str, Column] = {}
    for k in LAGGED:
        out |= lags(n[k], w, LAGS)
    for k in AVERAGED:
        out |= rolling_sums(n[k], w, WIDTHS)
    for k in SPREAD:
        out |= rolling_pop_std(n[k], w, STD_WIDTHS, F.col(SEEN))
    return out


def news_derived(suffix: str) -> dict[str, Column]:
    """20 means and the attention flag, without looking at rows again."""
    n = _base_names(suffix)
    out = {n["attention"]: F.coalesce((F.col(n["log_z"]) >= 2.0).cast("double"), F.lit(0.0))}
    for k in AVERAGED:
        out |= means_of_sums(n[k], WIDTHS, F.col(SEEN))
    return out


def feature_names(suffix: str) -> list[str]:
    """The 87 engineered columns of one news stream, in order."""
    n = _base_names(suffix)
    out = [n[k] for k in ("log", "neg", "pos", "cross", "bad", "good", "log_z", "tone_z", "bad_z", "attention", "weekend")]
    out += [f"{n[k]}_lag{i}" for k in LAGGED for i in LAGS]
    out += [f"{n[k]}_{f}{i}" for k in AVERAGED for i in WIDTHS for f in ("ma", "sum")]
    return out + [f"{n[k]}_std{i}" for k in SPREAD for i in STD_WIDTHS]


def news_features(df: DataFrame, suffixes: list[str], *keys: str) -> DataFrame:
    """News blocks for every stream on one shuffle and one sort per series.

    Base columns, z-scores, what looks back at them, and what follows from
    those: four projections, whatever the number of streams.
    """
    w = ordered(*keys)
    for s in suffixes:
        df = news_base(df, s)

    def add(frame: DataFrame, build) -> DataFrame:
        cols: dict[str, Column] = {}
        for s in suffixes:
            cols |= build(s)
        return frame.select("*", *[c.alias(k) for k, c in cols.items()])

    df = df.withColumn(SEEN, F.row_number().over(w))
    df = add(df, lambda s: news_scores(s, w))
    df = add(df, lambda s: news_windows(s, w))
    return add(df, news_derived).drop(SEEN)


def context_features(df: DataFrame, suffix: str) -> DataFrame:
    """Calendar parts, abnormal return times volatility and regime, news flags."""
    n = _base_names(suffix)

    def z(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    return df.withColumns({
        **calendar_parts(F.col("date")),
        "abnormal_x_volatility": z("abnormal_logret") * z("vol_30"),
        "abnormal_x_regime": z("abnormal_logret") * z("regime"),
        "has_news": (z(n["mentions"]) > 0).cast("double"),
        "has_bad_news": (z(n["bad"]) > 0).cast("double"),
    })


def select_feature_columns(df: DataFrame, prefix: str = "news_", exclude: tuple = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c not in exclude]
