"""Ordered operators on daily panels.

All of them share one window specification, ``partitionBy(keys).orderBy(date)``,
so Spark plans one shuffle and one sort for any number of lag and rolling
columns.  A partition is bounded by the calendar: one row per series and day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pulsepanel.operators.joins import attach
from pulsepanel.sources.workdir import kept_table

KEYS = ("series_id",)


def ordered(*keys: str, by: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(by)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def log_return(price: Column, w: WindowSpec) -> Column:
    p = F.when(price > 0, price)
    return F.ln(p / F.lag(p).over(w))


def rolling_std(
    x: Column, w: WindowSpec, n: int, ddof: int = 1, need: int | None = None, seen: Column | None = None
) -> Column:
    """``seen`` is the row number, for columns without gaps: it replaces the count."""
    fn = F.stddev_samp if ddof else F.stddev_pop
    need = n if need is None else need
    frame = last_rows(w, n)
    held = F.count(x).over(frame) if seen is None else seen
    return F.when(held >= need, fn(x).over(frame))


def rolling_zscore(x: Column, w: WindowSpec, n: int, seen: Column | None = None) -> Column:
    frame = last_rows(w, n)
    z = (x - F.avg(x).over(frame)) / F.nullif(F.stddev_pop(x).over(frame), F.lit(0.0))
    held = F.count(x).over(frame) if seen is None else seen
    return F.when(held >= n, z)


def local_max(x: Column, w: WindowSpec, half: int) -> Column:
    return F.coalesce(x == F.max(x).over(w.rowsBetween(-half, half)), F.lit(False))


def lags(name: str, w: WindowSpec, offsets) -> dict[str, Column]:
    return {f"{name}_lag{k}": F.lag(name, k).over(w) for k in offsets}


def leads(name: str, w: WindowSpec, offsets) -> dict[str, Column]:
    return {f"{name}_lead{k}": F.lead(name, k).over(w) for k in offsets}


def rolling_mean_sum(name: str, w: WindowSpec, widths) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in widths:
        out[f"{name}_ma{n}"] = F.avg(name).over(last_rows(w, n))
        out[f"{name}_sum{n}"] = F.sum(name).over(last_rows(w, n))
    return out


def rolling_sums(name: str, w: WindowSpec, widths) -> dict[str, Column]:
    return {f"{name}_sum{n}": F.sum(name).over(last_rows(w, n)) for n in widths}


def means_of_sums(name: str, widths, seen: Column) -> dict[str, Column]:
    """Means from ready sums of a column without gaps: no second pass over the frame."""
    return {f"{name}_ma{n}": F.col(f"{name}_sum{n}") / F.least(seen, F.lit(n)) for n in widths}


def rolling_pop_std(name: str, w: WindowSpec, widths, seen: Column | None = None) -> dict[str, Column]:
    return {f"{name}_std{n}": rolling_std(F.col(name), w, n, ddof=0, need=2, seen=seen) for n in widths}


def forward_fill(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    frame = running(ordered(*keys))
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in cols})


def regime_sign(logret: Column) -> Column:
    return F.when(logret > 0, 1).when(logret.isNotNull(), -1)


def difference(x: str, w: WindowSpec) -> Column:
    return F.col(x) - F.lag(x).over(w)


def with_drawdown(df: DataFrame, ret: str, *keys: str) -> DataFrame:
    """Adds ``cum``, ``peak`` and ``drawdown`` of a return column."""
    frame = running(ordered(*keys))
    out = df.withColumn("cum", F.sum(ret).over(frame))
    out = out.withColumn("peak", F.max("cum").over(frame))
    return out.withColumn("drawdown", F.col("cum") - F.col("peak"))


def average_rank(x: str, *keys: str) -> Column:
    """Rank within the group, ties share the mean of their places."""
    ahead = F.rank().over(Window.partitionBy(*(keys or KEYS)).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*(keys or KEYS), x))
    return F.when(F.col(x).isNotNull(), ahead + (ties - 1) / 2.0)


def lagged_level(level: Column, expected_logret: Column, w: WindowSpec) -> dict[str, Column]:
    """Yesterday's level moved by today's expected return, and what is left."""
    hat = F.lag(level).over(w) * F.exp(expected_logret)
    return {"level_lag1": F.lag(level).over(w), "level_hat": hat, "abnormal_level": level - hat}


def event_id(prefix: Column, number: Column) -> Column:
    return F.format_string("%s_EVT_%04d", F.upper(prefix), number)


def min_gap_dates(df: DataFrame, gap_days: Column | int, *keys: str, date: str = "date") -> DataFrame:
    """Greedy thinning: keep a day when it lies >= gap after the last kept day.

    Needs the last *kept* day, so it folds over the sorted days of one series;
    that array holds at most one entry per calendar day.
    """
    keys = keys or KEYS
    gap = F.lit(gap_days) if isinstance(gap_days, int) else gap_days
    days = F.array_sort(F.collect_set(date))

    def step(kept: Column, day: Column) -> Column:
        # get() is NULL on the empty array, where the first test already decides.
        last = F.get(kept, F.size(kept) - 1)
        clear = (F.size(kept) == 0) | (F.datediff(day, last) >= F.col("__gap"))
        return F.when(clear, F.concat(kept, F.array(day))).otherwise(kept)

    folded = df.groupBy(*keys).agg(days.alias("__days"), F.max(gap).alias("__gap"))
    kept = F.aggregate("__days", F.array().cast("array<date>"), step)
    return folded.select(*keys, F.explode(kept).alias(date))


def min_gap_dates_linked(df: DataFrame, gap_days: Column | int, *keys: str, date: str = "date") -> DataFrame:
    """The same days as ``min_gap_dates``, for many candidates a series: no list of a series is ever gathered.

    Every candidate points at its successor, the first candidate at least the
    gap away; kept are the days on the chain from the first one.  Successors
    come from one ordered pass: days and days plus gap are sorted together,
    latest first, and carry the last day seen.  Then pointers double: with
    jumps of 1, 2, 4, ... successors, the days reached double each round, so a
    chain of n days takes log n rounds of equi-joins.
    """
    keys = keys or KEYS
    gap = F.lit(gap_days) if isinstance(gap_days, int) else gap_days
    days = df.groupBy(*keys, F.unix_date(date).alias("__day")).agg(F.max(gap).alias("__gap"))
    days = days.withColumn("__gap", F.max("__gap").over(Window.partitionBy(*keys)))
    asked = F.explode(F.array(
        F.struct(F.col("__day").alias("t"), F.lit(0).alias("kind")), F.struct((F.col("__day") + F.greatest("__gap", F.lit(1))).alias("t"), F.lit(1).alias("kind"))))
    both = days.select(*keys, "__day", asked.alias("q")).select(*keys, "__day", "q.*")
    latest = Window.partitionBy(*keys).orderBy(F.col("t").desc(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("kind") == 0, F.col("t")), ignorenulls=True).over(latest)
    jumps = kept_table(both.withColumn("__to", seen).where("kind = 1").select(*keys, "__day", "__to"), "successors")
    kept, n = kept_table(jumps.groupBy(*keys).agg(F.min("__day").alias("__day")), "kept"), -1
    while (held := kept.count()) != n:
        n = held
        reached = attach(kept, jumps, [*keys, "__day"]).where("__to IS NOT NULL").select(*keys, F.col("__to").alias("__day"))
        kept = kept_table(kept.unionByName(reached).distinct(), "kept")
        ahead = jumps.withColumnsRenamed({"__day": "__mid", "__to": "__far"})
        jumps = attach(jumps.withColumnRenamed("__to", "__mid"), ahead, [*keys, "__mid"]).select(*keys, "__day", F.col("__far").alias("__to"))
        jumps = kept_table(jumps, "jumps")
    return kept.select(*keys, F.date_from_unix_date("__day").alias(date))


def column_threshold(df: DataFrame, x: str, *keys: str) -> Column:
    """x over the median of its group (missing counts as 0)."""
    return F.coalesce(F.col(x), F.lit(0.0)) > F.median(x).over(Window.partitionBy(*(keys or KEYS)))


def sum_flags(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])
