"""Joining days to windows of any length without one row a day.

A window of length L goes to the level k with 2^(k-1) < L <= 2^k and is cut at
multiples of 2^k: it lies in one or two bins of its level.  A point looks into
one bin of every level that exists, at most about twenty.  So both sides meet
by equality on (keys, level, bin), and a residual comparison decides.  The
work follows the matches and not the lengths, and windows of a week and of
thirty years may lie in one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepanel.operators.joins import window_days

#: Mean days a window up to which one row a day is cheaper than two bins and a point a level.
SHORT_WINDOW = 48


def _days(c: Column) -> Column:
    return F.unix_date(c.cast("date")).cast("bigint")


def interval_join(
    windows: DataFrame, points: DataFrame, keys: list[str], start: str = "window_start", end: str = "window_end", at: str = "date",
) -> DataFrame:
    """Inner join of points to the windows that hold them, ends included.

    Windows with an unknown end, or that end before they start, hold nothing;
    overlapping and repeated windows each get their rows.
    """
    a, b = _days(F.col(start)), _days(F.col(end))
    # Levels by comparison with powers of two, exact for every length a date can have.
    length = b - a + 1
    level = sum([(length > (1 << k)).cast("int") for k in range(1, 22)], (length > 1).cast("int"))
    held = windows.where(F.col(start) <= F.col(end)).withColumn("__level", level)
    levels = [r[0] for r in held.select("__level").distinct().orderBy("__level").collect()]  # at most 23 numbers

    def bin_of(day: Column, k: Column) -> Column:
        return F.call_function("shiftright", day, k)

    k = F.col("__level")
    first, last = bin_of(a, k), bin_of(b, k)
    cut = held.withColumn("__bin", F.explode(F.array_distinct(F.array(first, last))))
    looked = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", bin_of(_days(F.col(at)), k))
    return cut.join(looked, [*keys, "__level", "__bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__level", "__bin")


def windows_join(
    windows: DataFrame, points: DataFrame, keys: list[str], start: str = "window_start", end: str = "window_end", at: str = "date",
) -> DataFrame:
    """The same rows as ``interval_join``; short windows are spread over their days instead.  Their measured mean length decides."""
    held = windows.where(F.col(start) <= F.col(end))
    mean = held.agg(F.avg(F.datediff(end, start) + 1)).first()[0]
    if mean is None or mean > SHORT_WINDOW:
        return interval_join(windows, points, keys, start, end, at)
    days = window_days(held, F.col(start), F.col(end), *windows.columns)
    return days.withColumnRenamed("date", at).join(points, [*keys, at]) if at != "date" else days.join(points, [*keys, "date"])
