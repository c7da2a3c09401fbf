"""Exact quantiles of groups that may be too large for one task.

``F.percentile`` keeps every distinct value of a group in one task's memory.
That is fine for one series (bounded by the calendar) but not for "all events
of a preset".  Here a group is cut by approximate split points into buckets,
bucket counts give each wanted rank its bucket, and only those buckets are
sorted.  The result is exact: the approximation only chooses the cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], buckets: int = 256) -> DataFrame:
    """One row per key with a column per wanted quantile, linear interpolation."""
    # Equal values collapse before any ordering, so ties cannot overload a bucket.
    vals = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    grid = F.lit([i / buckets for i in range(1, buckets)]).cast("array<double>")
    cuts = vals.groupBy(*keys).agg(
        F.percentile_approx("__v", grid, F.lit(20 * buckets)).alias("__cuts"),
        F.sum("__c").alias("__n"),
    )
    # One row per group of a fixed, small key set: keys name presets or splits.
    placed = vals.join(cuts, keys).withColumn(
        "__b", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    )
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    offsets = (
        placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"), F.max("__n").alias("__n"))
        .withColumn("__hi", F.sum("__bc").over(by_bucket))
        .withColumn("__lo", F.col("__hi") - F.col("__bc"))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("__n") - 1)).alias("pos"))
        for name, p in probs.items()
    ])
    # Zero-based ranks floor(pos) and ceil(pos) fall into [lo, hi) of some bucket.
    marks = (
        offsets.withColumn("__w", F.explode(wanted))
        .withColumn("__r", F.explode(F.array_distinct(F.array(F.floor("__w.pos"), F.ceil("__w.pos")))))
        .filter((F.col("__r") >= F.col("__lo")) & (F.col("__r") < F.col("__hi")))
        .select(*keys, "__b", "__lo", F.col("__w.name").alias("__name"), F.col("__w.pos").alias("__pos"), "__r")
    )
    hot = placed.join(marks.select(*keys, "__b").distinct(), [*keys, "__b"], "left_semi")
    in_bucket = Window.partitionBy(*keys, "__b").orderBy("__v")
    ranked = hot.withColumn("__up", F.sum("__c").over(in_bucket)).withColumn("__dn", F.col("__up") - F.col("__c"))
    hits = (
        ranked.select(*keys, "__b", "__v", "__up", "__dn")
        .join(marks, [*keys, "__b"])
        .filter((F.col("__r") - F.col("__lo") >= F.col("__dn")) & (F.col("__r") - F.col("__lo") < F.col("__up")))
    )
    frac = F.col("__pos") - F.floor("__pos")
    weight = F.when(F.col("__r") == F.floor("__pos"), 1.0 - frac).otherwise(frac)
    return hits.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("__name") == name, F.col("__v") * weight)).alias(name) for name in probs
    ])
