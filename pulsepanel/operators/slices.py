"""Ordered operators on series too long for one task.

A window partitioned by series puts a series into one task.  Here a series is
cut into ranges of its order column; a range computes its own part with the
ordinary window functions, a small table of one row a range is combined in
order, and what a range needs from before it comes back by an equi-join:

* a count, so that every row gets its number (``numbered``) and slices of equal
  size can be cut from then on; the rows are sorted by Spark's range exchange;
* the last known value (``forward_fill``), a running sum and maximum
  (``running``, ``with_drawdown``);
* for rolling frames, copies of the rows just before the slice (``rolling``).

Equal values of the order column are taken in the order of the tie columns, or
in an arbitrary one, as in the plain window.  Missing keys form a series of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pulsepanel.operators.joins import attach
from pulsepanel.operators.windows import running as up_to_here
from pulsepanel.sources.workdir import kept_table

#: Ranges a group of values is cut into; rows a slice.
RANGES, ROWS = 256, 1 << 20
SLICE, PLACE = "__slice", "__rn"


def cut_ranges(df: DataFrame, keys: list[str], by: str, ranges: int = RANGES) -> DataFrame:
    """Adds the range of each row: how many of the series' approximate quantiles lie below it."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(by, shares, ranges * 20).alias("__cuts"))
    placed = attach(df, cuts, keys)
    return placed.withColumn(SLICE, F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(by))), F.lit(0))).drop("__cuts")


def numbered(df: DataFrame, keys: list[str], by: str, ties: tuple[str, ...] = (), rows: int = ROWS, ranges: int | None = None) -> DataFrame:
    """Rows with their number in the series and slices of ``rows`` rows.

    Rows are in the order of ``by``, a number, day or time, and of ``ties`` where it is equal.
    Spark deals them to ranges of that order (``ranges`` of them, else as its shuffles are set),
    sorts each and numbers its rows; the sorted rows are written once, and a row's number is its
    own plus what the ranges before it hold of its series.
    """
    order = [*keys, by, *ties]
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    placed = kept_table(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1 - F.col("__first")
    out = attach(placed, kept_table(counts.select(*keys, "__part", shift.alias("__shift")), "offsets"), [*keys, "__part"])
    out = out.withColumn(PLACE, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
    return out.withColumn(SLICE, F.floor((F.col(PLACE) - 1) / rows).cast("bigint"))


def within(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(PLACE)


def carried(cut: DataFrame, keys: list[str], parts: dict[str, Column], over: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """One row a slice, written: aggregates ``parts`` of the slices before it, combined by ``over``."""
    per_slice = cut.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in parts.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return kept_table(per_slice.select(*keys, SLICE, *[c(before).alias(n) for n, c in over.items()]), "carried")


def forward_fill(cut: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Last known value of each column up to the row; ``cut`` comes from ``numbered``."""
    parts = {f"__last_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col(PLACE))) for c in cols}
    over = {n: (lambda w, n=n: F.last(n, ignorenulls=True).over(w)) for n in parts}
    own = cut.withColumns({c: F.last(c, ignorenulls=True).over(up_to_here(within(keys))) for c in cols})
    out = attach(own, carried(cut, keys, parts, over), [*keys, SLICE])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__last_{c}")) for c in cols}).drop(*parts)


def running(cut: DataFrame, keys: list[str], sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """Running sums and maxima, output name -> column."""
    parts = {f"__{n}": F.sum(c) for n, c in sums.items()} | {f"__{n}": F.max(c) for n, c in maxima.items()}
    over = {f"__{n}": (lambda w, n=n: F.sum(f"__{n}").over(w)) for n in sums}
    over |= {f"__{n}": (lambda w, n=n: F.max(f"__{n}").over(w)) for n in maxima}
    w = up_to_here(within(keys))
    own = cut.withColumns({n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.max(c).over(w) for n, c in maxima.items()})
    out = attach(own, carried(cut, keys, parts, over), [*keys, SLICE])
    total = {n: F.when(F.col(f"__{n}").isNull(), F.col(n)).otherwise(F.coalesce(F.col(n), F.lit(0)) + F.col(f"__{n}")) for n in sums}
    return out.withColumns(total | {n: F.greatest(n, f"__{n}") for n in maxima}).drop(*parts)


def with_drawdown(cut: DataFrame, ret: str, keys: list[str]) -> DataFrame:
    """Adds ``cum``, ``peak`` and ``drawdown`` of a return column."""
    summed = running(cut, keys, {"cum": ret}, {})
    peaked = running(summed, keys, {}, {"peak": "cum"})
    return peaked.withColumn("drawdown", F.col("cum") - F.col("peak"))


def rolling(cut: DataFrame, keys: list[str], width: int, columns: Callable[[WindowSpec], dict[str, Column]], rows: int = ROWS) -> DataFrame:
    """Columns over frames of at most ``width`` rows that end at the row.

    The last ``width - 1`` rows of a slice are copied to the next; their own
    results are dropped there.  ``columns`` gets the window of the slice.
    """
    if width - 1 > rows:
        raise ValueError("a frame may reach into the slice before it, not further")
    tail = cut.where((F.col(PLACE) - 1) % rows >= rows - (width - 1)).withColumn(SLICE, F.col(SLICE) + 1)
    both = cut.withColumn("__halo", F.lit(False)).unionByName(tail.withColumn("__halo", F.lit(True)))
    return both.withColumns(columns(within(keys))).where("NOT __halo").drop("__halo")


def prefix_counts(counts: DataFrame, keys: list[str], value: str, cols: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``below_c``: the sum of ``c`` over smaller values of the group.

    ``counts`` has one row per (keys, value).  No group is sorted in one task:
    values are dealt to ranges by approximate cuts, ranges add up, and each
    range is sorted alone.
    """
    placed = cut_ranges(counts, keys, value, ranges)
    per_range = placed.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(f"__{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*keys, SLICE, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in cols])
    local = Window.partitionBy(*keys, SLICE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in cols})
    out = attach(own, offsets, [*keys, SLICE])
    return out.withColumns({f"below_{c}": F.col(f"below_{c}") + F.col(f"__{c}") for c in cols}).drop(SLICE, *[f"__{c}" for c in cols])


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank): average rank of each distinct value in its group; ties share the mean of their places."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_counts(counts, keys, value, ["n"])
    return ranked.select(*keys, value, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias("rank"))
