"""Joins, set operations, de-duplication and calendar operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsepanel.functions.topics import host_suffixes


def align_to_calendar(base: DataFrame, *others: DataFrame, on=("series_id", "date")) -> DataFrame:
    """Left joins on the base calendar; days the others lack stay NULL."""
    out = base
    for other in others:
        out = out.join(other, list(on), "left")
    return out


def merge_panel(base: DataFrame, other: DataFrame, suffix: str, on=("series_id", "date")) -> DataFrame:
    """Left join; a column the base already has arrives under a suffix."""
    renamed = other.select(
        *on, *[F.col(c).alias(c + suffix if c in base.columns else c) for c in other.columns if c not in on]
    )
    return base.join(renamed, list(on), "left")


def attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a table with unique keys; NULLs in a key are equal."""
    other = small.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(other, on, "left").drop(*[f"__k_{k}" for k in keys])


def classify_by_table(df: DataFrame, domain: str, classes: DataFrame, out: str = "cred", default: str = "unknown") -> DataFrame:
    """Class of each row's domain by a table (domain, cred, priority) of any size.

    A domain matches an entry that it equals or is a subdomain of.  The
    smallest priority wins, then the longest entry.  Each distinct domain is
    unfolded into its suffixes, which meet the table by equality; rows get
    their domain's class back, NULL domains the default.
    """
    d = F.trim(F.replace(F.lower(F.coalesce(F.col(domain), F.lit(""))), F.lit("www."), F.lit("")))
    rows = df.withColumn("__domain", d)
    parts = rows.select("__domain").distinct().select("__domain", F.posexplode(host_suffixes(F.col("__domain"))).alias("__cut", "__suffix"))
    table = classes.select(F.lower("domain").alias("__suffix"), F.col("cred").alias("__cred"), F.col("priority").alias("__priority"))
    hits = parts.join(table, "__suffix").groupBy("__domain").agg(
        F.min_by("__cred", F.struct("__priority", "__cut", "__cred")).alias("__cred"))
    return rows.join(hits, "__domain", "left").withColumn(out, F.coalesce("__cred", F.lit(default))).drop("__domain", "__cred")


def attach_signal(market: DataFrame, signal: DataFrame) -> DataFrame:
    """One day-keyed signal attached to every series."""
    return market.join(signal, "date", "left")


def common_days(a: DataFrame, b: DataFrame, on=("series_id", "date")) -> DataFrame:
    return a.join(b, list(on), "inner")


def wide_by_preset(signal: DataFrame, presets: list[str], values: list[str]) -> DataFrame:
    """One row per day with ``value_preset`` columns; NULL where a preset is absent."""
    cells = [
        F.first(F.when(F.col("preset") == p, F.col(v)), ignorenulls=True).alias(f"{v}_{p}")
        for p in presets for v in values
    ]
    return signal.groupBy("date").agg(*cells)


def window_days(events: DataFrame, start: Column, end: Column, *carry: str) -> DataFrame:
    """One row per event and day of its window; window length is a parameter."""
    return events.select(*carry, F.explode(F.sequence(start, end)).alias("date"))


def events_x_daily(
    events: DataFrame, daily: DataFrame, before: int | Column, after: int | Column, peak: str = "peak_date", how: str = "inner"
) -> DataFrame:
    """Calendar-window join as an equi-join on (series_id, date).

    Adds ``offset`` = days from the peak.  The window is exploded on the event
    side, which avoids a range join's nested loop.  Days before and after may
    be columns of the event.
    """
    return (
        events.withColumn("offset", F.explode(offsets(before, after)))
        .withColumn("date", F.date_add(peak, F.col("offset")))
        .join(daily, ["series_id", "date"], how)
    )


def offsets(before: int | Column, after: int | Column) -> Column:
    first, last = (c if isinstance(c, Column) else F.lit(c) for c in (before, after))
    return F.sequence(-first, last)


def events_x_rows(events: DataFrame, numbered: DataFrame, before: int | Column, after: int | Column) -> DataFrame:
    """Row-offset window around the row of the exact peak date.

    ``numbered`` carries ``rn``.  Events without a row on their peak date drop
    out; windows are clipped at the ends of the series.
    """
    anchored = events.join(
        numbered.select("series_id", F.col("date").alias("peak_date"), F.col("rn").alias("__peak_rn")),
        ["series_id", "peak_date"],
    )
    return (
        anchored.withColumn("offset", F.explode(offsets(before, after)))
        .withColumn("rn", F.col("__peak_rn") + F.col("offset"))
        .drop("__peak_rn")
        .join(numbered, ["series_id", "rn"], "inner")
    )


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Inner join that spreads each key of ``big`` over ``salts`` tasks.

    For record tables where one day may hold a large part of all rows.  The
    small side is repeated once per salt; the big side is shuffled once.
    """
    spread = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"]).drop("__salt")


def missing_days(wanted: DataFrame, held: DataFrame, on=("date",)) -> DataFrame:
    return wanted.join(held.select(*on).distinct(), list(on), "left_anti")


def member_days(df: DataFrame, days: DataFrame, on=("date",)) -> DataFrame:
    return df.join(days, list(on), "left_semi")


def calendar_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    bounds = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return spark.range(1).select(F.explode(bounds).alias("date"))


def calendar_of(df: DataFrame, *keys: str, date: str = "date") -> DataFrame:
    """Every day from the first to the last one held (per key)."""
    span = df.groupBy(*keys).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    return span.select(*keys, F.explode(F.sequence("__a", "__b")).alias("date"))


def window_union_days(events: DataFrame, before: int, after: int, *keys: str) -> DataFrame:
    """Distinct days covered by any window."""
    days = F.sequence(F.date_sub("peak_date", before), F.date_add("peak_date", after))
    return events.select(*keys, F.explode(days).alias("date")).distinct()


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    ``max_by``-style aggregation instead of a row_number window: it combines on
    the map side, so a key that holds most rows never lands in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    pick = F.min_by(F.struct(*rest), ranked).alias("__row")
    return df.groupBy(*keys).agg(pick).select(*keys, "__row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    pick = F.max_by(F.struct(*rest), ranked).alias("__row")
    return df.groupBy(*keys).agg(pick).select(*keys, "__row.*").select(*df.columns)


def dedupe_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per composite key; hash aggregation drops copies map-side first."""
    return df.dropDuplicates(keys)


def top_n(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)


def argmax_abs(df: DataFrame, value: str, ties: list[str], *keys: str) -> DataFrame:
    """Row with the largest |value| per key; ``ties`` makes the pick repeatable."""
    seen = df.filter(F.col(value).isNotNull())
    return keep_one(seen, list(keys), [-F.abs(F.col(value)), *[F.col(t) for t in ties]])


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def number_rows(df: DataFrame, *keys: str, by: str = "date", name: str = "rn") -> DataFrame:
    w = Window.partitionBy(*(keys or ("series_id",))).orderBy(by)
    return df.withColumn(name, F.row_number().over(w))
