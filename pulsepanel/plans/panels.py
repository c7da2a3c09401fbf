"""The composed daily pipeline: baseline, attribution, score, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.operators.events import detect_peaks, event_abnormal_returns, event_media_impact
from pulsepanel.operators.features import feature_names, market_features, news_features
from pulsepanel.operators.gram import VECTOR, vector
from pulsepanel.operators.joins import align_to_calendar, attach_signal, merge_panel, wide_by_preset
from pulsepanel.operators.models import (
    baseline, baseline_features, feature_vector, filter_features, fit_ridge_cv, fold_segments, prepare_model_frame,
    score_ridge, screen_features, top_k_features,
)
from pulsepanel.operators.scoring import excess_effect, score_days
from pulsepanel.operators.validation import oos_index
from pulsepanel.plans import fixtures as fx
from pulsepanel.sources.workdir import stage

RIDGE_FEATURES = [
    "news_log_mentions", "news_tone", "news_tone_x_log_mentions", "news_bad_intensity",
    "news_log_mentions_lag1", "news_tone_lag1", "news_log_mentions_ma7", "news_tone_std7",
]
ALPHA, SPLITS = 10.0, 5
#: Layout of daily tables that joins and windows read by series.
BY_SERIES = ("series_id", "date")


# Daily tables.  Everything below the daily grain is aggregated once per session;
# the pipeline then reads these small tables instead of scanning the raw ones again.

def prices(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "prices", lambda: fx.price_panel(spark, sf))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "signals", lambda: fx.media_signal(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return market_features(fx.price_panel(spark, sf))


def aligned(spark: SparkSession, sf: str, panel: DataFrame | None = None) -> DataFrame:
    """Prices with the day-keyed controls; days without a control stay NULL."""
    panel = fx.price_panel(spark, sf) if panel is None else panel
    return align_to_calendar(panel, fx.macro_wide(spark, sf), on=("date",))


def model_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: the fit and the scoring both read it."""
    return stage(spark, sf, "frame", lambda: prepare_model_frame(aligned(spark, sf, prices(spark, sf))), BY_SERIES)


def baseline_panel(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "baseline", lambda: baseline(model_frame(spark, sf), baseline_features()), BY_SERIES)


def panel_with_market(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline days with volatility and regime of the feature table."""
    base = baseline_panel(spark, sf)
    extra = market_features(prices(spark, sf)).select("series_id", "date", "vol_30", "regime", "volume")
    return merge_panel(base, extra, "_feat")


def news_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline days with the balanced stream's news block."""
    sig = signals(spark, sf).filter(F.col("preset") == "balanced").select(
        "date", F.col("mentions").alias("news_mentions"), F.col("tone").alias("news_tone"),
        F.col("mentions"), F.col("tone"))
    return news_features(attach_signal(panel_with_market(spark, sf), sig), [""])


def news_table(spark: SparkSession, sf: str) -> DataFrame:
    """Target, level and the modelled features, written once for fit and scoring."""
    keep = ["series_id", "date", "price", "mcap", "volume", "logret", "vol_30", "regime", "expected_logret", "abnormal_logret",
            "abnormal_return_pct", "abnormal_z60", "abnormal_usd", "mentions", "tone", *RIDGE_FEATURES]
    return stage(spark, sf, "news", lambda: news_panel(spark, sf).select(*keep), BY_SERIES)


def ridge_rows(df: DataFrame, names: list[str], y: str = "abnormal_logret") -> DataFrame:
    known = fold_segments(df.filter(F.col(y).isNotNull()), ["series_id"], SPLITS)
    return known.withColumn(VECTOR, vector([F.lit(1.0), *[F.col(n) for n in names], F.col(y)]))


def ridge_fits(spark: SparkSession, sf: str) -> DataFrame:
    rows = ridge_rows(news_table(spark, sf), RIDGE_FEATURES)
    return fit_ridge_cv(rows, ["series_id"], len(RIDGE_FEATURES) + 2, ALPHA, SPLITS)


def effect_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = fold_segments(news_table(spark, sf).filter(F.col("abnormal_logret").isNotNull()), ["series_id"], SPLITS)
    with_vec = feature_vector(panel, RIDGE_FEATURES)
    return score_ridge(with_vec, ridge_fits(spark, sf), ["series_id"], "__f").drop("__f")


SCORED = [
    "series_id", "date", "price", "mcap", "volume", "logret", "vol_30", "regime", "expected_logret", "abnormal_logret",
    "abnormal_return_pct", "abnormal_z60", "abnormal_usd", "mentions", "tone", "segment", "media_logret", "media_logret_oof",
    "media_effect", "media_effect_oof", "media_effect_abs", "media_share_of_move", "mentions_used", "tone_used",
    "z_volume", "z_tone", "score_raw", "score", "zone", "effect_used", "raw_abs_effect", "excess_effect", "media_share_pct",
]


def scored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Effect, index, zone and excess effect per series and day."""
    def build() -> DataFrame:
        return excess_effect(score_days(effect_panel(spark, sf))).select(*SCORED)

    return stage(spark, sf, "scored", build, BY_SERIES)


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "peaks", lambda: detect_peaks(prices(spark, sf)))


def event_returns(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return event_abnormal_returns(baseline_panel(spark, sf), peaks(spark, sf))

    return stage(spark, sf, "event_returns", build)


def event_impact(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "impact", lambda: event_media_impact(scored_panel(spark, sf), event_returns(spark, sf)))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return stage(spark, sf, "oos", lambda: oos_index(scored_panel(spark, sf), fx.BOUNDARY), BY_SERIES)


# The full attribution with screening and pruning ------------------------------

STREAMS = {"_all": "balanced", "_balanced": "balanced", "_strong": "strong", "_sensitive": "sensitive"}


def wide_news_panel(spark: SparkSession, sf: str) -> DataFrame:
    """All four streams; ``_all`` is the first preset that has data."""
    wide = wide_by_preset(signals(spark, sf), list(fx.PRESETS), ["mentions", "tone"]).select("date", *[
        F.col(f"{v}_{p}").alias(f"news_{v}{s}") for s, p in STREAMS.items() for v in ("mentions", "tone")])
    base = baseline_panel(spark, sf).select("series_id", "date", "mcap", "abnormal_logret", "abnormal_usd")
    return news_features(attach_signal(base, wide), list(STREAMS))


def candidate_features() -> list[str]:
    raw = [f"news_{v}{s}" for s in STREAMS for v in ("mentions", "tone")]
    return raw + [n for s in STREAMS for n in feature_names(s)]


def candidate_panel(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        df = fold_segments(wide_news_panel(spark, sf).filter(F.col("abnormal_logret").isNotNull()), ["series_id"], SPLITS)
        return feature_vector(df, candidate_features()).select(
            "series_id", "date", "mcap", "abnormal_logret", "abnormal_usd", "segment", "__f")

    return stage(spark, sf, "candidates", build, BY_SERIES)


def screened(spark: SparkSession, sf: str) -> DataFrame:
    return screen_features(candidate_panel(spark, sf), "abnormal_logret", ["series_id"])


def selected(spark: SparkSession, sf: str, k: int = 60) -> DataFrame:
    return top_k_features(filter_features(screened(spark, sf)), ["series_id"], k)


def news_effect(spark: SparkSession, sf: str, k: int = 60, prune_at: float = 0.97) -> tuple[DataFrame, DataFrame]:
    """(daily effects, fits): screen, keep the strongest, prune copies, fit, score."""
    chosen = selected(spark, sf, k).groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "pos"))), lambda s: s["pos"]).alias("chosen"))
    panel = candidate_panel(spark, sf).join(chosen, "series_id")
    picked = F.transform("chosen", lambda i: F.coalesce(F.get(F.col("__f"), i), F.lit(0.0)))
    rows = panel.withColumn("picked", picked).withColumn("used", F.size("chosen"))
    padded = F.concat("picked", F.array_repeat(F.lit(0.0), F.lit(k) - F.col("used")))
    vec = F.concat(F.array(F.lit(1.0)), padded, F.array(F.col("abnormal_logret")))
    fits = fit_ridge_cv(
        rows.select("series_id", "used", "segment", vec.alias(VECTOR)), ["series_id"], k + 2, ALPHA, SPLITS, prune_at
    ).join(chosen, "series_id")
    daily = score_ridge(rows, fits.select("series_id", "kept", "folds"), ["series_id"], "picked")
    return daily.drop("__f", "picked", "chosen", "used"), fits
