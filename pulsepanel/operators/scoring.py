"""Daily scoring: calibration, index, zones and excess effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.functions.clean import eps_ratio
from pulsepanel.functions.index import (
    ALARM_LABELS, FALLBACK, PRESSURE_LABELS, W_TONE, W_VOLUME, ZONE_DETAILS, sigmoid, z_clip, zone,
)


def calibration(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of mentions and tone per key."""
    def sd(c: str, fallback: float) -> Column:
        return F.greatest(F.when(F.count(c) > 1, F.stddev_pop(c)).otherwise(fallback), F.lit(1e-6))

    return df.groupBy(*keys).agg(
        F.coalesce(F.avg("mentions"), F.lit(FALLBACK.mu_mentions)).alias("mu_mentions"),
        sd("mentions", FALLBACK.sd_mentions).alias("sd_mentions"),
        F.coalesce(F.avg("tone"), F.lit(FALLBACK.mu_tone)).alias("mu_tone"),
        sd("tone", FALLBACK.sd_tone).alias("sd_tone"),
    )


def score_days(df: DataFrame, *keys: str, labels: tuple = ALARM_LABELS) -> DataFrame:
    """Index calibrated on the group's own days; missing inputs are neutral.

    The statistics ride on a window over the same key as the other ordered
    work, so no extra shuffle and no join is planned.
    """
    w = Window.partitionBy(*(keys or ("series_id",)))

    def moments(c: str, mu0: float, sd0: float) -> tuple[Column, Column]:
        mu = F.coalesce(F.avg(c).over(w), F.lit(mu0))
        sd = F.when(F.count(c).over(w) > 1, F.stddev_pop(c).over(w)).otherwise(sd0)
        return mu, F.greatest(sd, F.lit(1e-6))

    m_mu, m_sd = moments("mentions", FALLBACK.mu_mentions, FALLBACK.sd_mentions)
    t_mu, t_sd = moments("tone", FALLBACK.mu_tone, FALLBACK.sd_tone)
    out = df.withColumns({"__mm": m_mu, "__ms": m_sd, "__tm": t_mu, "__ts": t_sd})
    out = out.withColumns({
        "mentions_used": F.coalesce("mentions", F.col("__mm")), "tone_used": F.coalesce("tone", F.col("__tm"))})
    out = out.withColumns({
        "z_volume": z_clip(F.col("mentions_used"), F.col("__mm"), F.col("__ms")),
        "z_tone": z_clip(F.col("tone_used"), F.col("__tm"), F.col("__ts")),
    }).drop("__mm", "__ms", "__tm", "__ts")
    out = out.withColumn("score_raw", W_VOLUME * F.col("z_volume") + W_TONE * F.col("z_tone"))
    out = out.withColumn("score", sigmoid(F.col("score_raw")))
    return out.withColumn("zone", zone(F.col("score"), labels))


def excess_effect(df: DataFrame, effect: str = "media_effect_oof", actual: str = "abnormal_usd") -> DataFrame:
    """|effect| weighted by the score, and its share of the abnormal move."""
    used = F.coalesce(F.col(effect), F.lit(0.0))
    out = df.withColumns({"effect_used": used, "raw_abs_effect": F.abs(used)})
    out = out.withColumn("excess_effect", F.col("raw_abs_effect") * F.col("score"))
    return out.withColumn("media_share_pct", 100.0 * eps_ratio(F.col("excess_effect"), F.abs(actual)))


def zone_table(spark) -> DataFrame:
    return spark.createDataFrame(ZONE_DETAILS, "zone string, lower double, upper double, description string, note string")


def zone_details(df: DataFrame) -> DataFrame:
    """Five fixed rows joined to the zone labels."""
    return df.join(F.broadcast(zone_table(df.sparkSession)), "zone", "left")


def zone_of(df: DataFrame, score: str = "score") -> DataFrame:
    return df.withColumn("zone", zone(F.col(score), PRESSURE_LABELS))
