"""Aggregations: daily signals, summaries, correlations and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.functions.clean import clip
from pulsepanel.functions.moments import safe_corr
from pulsepanel.operators.joins import attach
from pulsepanel.operators.quantiles import exact_quantiles
from pulsepanel.operators.slices import prefix_counts
from pulsepanel.sources.workdir import kept_table


# Daily signals -------------------------------------------------------------

def file_totals(records: DataFrame, *keys: str) -> DataFrame:
    """Matches and tone sums per file of (day, file_no, matched, tone) records."""
    hit = F.col("matched")
    toned = F.when(hit, F.col("tone"))
    return records.groupBy(*keys, "day", "file_no").agg(
        F.count_if(hit).alias("w"), F.sum(toned).alias("tone_sum"), F.count(toned).alias("tone_n"))


def daily_signal_of_files(per_file: DataFrame, *keys: str, row_mean: bool = False) -> DataFrame:
    """Day totals; tone is the match-weighted mean of file means.

    With ``row_mean`` it is the plain mean over toned records instead.  Days
    whose records never match keep a row with 0 mentions and no tone.
    """
    t = F.col("tone_sum") / F.nullif(F.col("tone_n"), F.lit(0))
    weight = F.sum(F.when(F.col("tone_n") > 0, F.col("w")))
    staged = F.sum(t * F.col("w")) / F.nullif(weight, F.lit(0))
    plain = F.sum("tone_sum") / F.nullif(F.sum("tone_n"), F.lit(0))
    return (
        per_file.groupBy(*keys, "day")
        .agg(F.sum("w").alias("mentions"), (plain if row_mean else staged).alias("tone"))
        .withColumnRenamed("day", "date")
    )


def daily_signal_two_stage(records: DataFrame, *keys: str) -> DataFrame:
    return daily_signal_of_files(file_totals(records, *keys), *keys)


def daily_weighted(events: DataFrame, *keys: str) -> DataFrame:
    """Sum of mentions (missing = 1), mention-weighted tone of toned rows, row count."""
    m = F.coalesce(F.col("mentions"), F.lit(1.0))
    toned = F.col("tone").isNotNull()
    return events.groupBy(*keys, "date").agg(
        F.sum(m).alias("mentions"),
        (F.sum(F.when(toned, F.col("tone") * m)) / F.nullif(F.sum(F.when(toned, m)), F.lit(0.0))).alias("tone"),
        F.count(F.lit(1)).alias("n_articles"),
    )


def daily_plain(records: DataFrame, *keys: str) -> DataFrame:
    """Record count and plain mean tone."""
    return records.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("mentions"), F.avg("tone").alias("tone")
    )


def mean_per_date(signal: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    return signal.groupBy(*keys, "date").agg(*[F.avg(c).alias(c) for c in cols])


# Summaries -----------------------------------------------------------------

def safe_sum(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def safe_abs_sum(c: str) -> Column:
    return F.coalesce(F.sum(F.abs(c)), F.lit(0.0))


def safe_max_abs(c: str) -> Column:
    return F.coalesce(F.max(F.abs(c)), F.lit(0.0))


def zone_distribution(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Days and percent per zone; the window runs over the zone counts only."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("days"))
    total = F.sum("days").over(Window.partitionBy(*(keys or (F.lit(1),))))
    return counts.withColumn("pct", 100.0 * F.col("days") / total)


def source_totals(df: DataFrame, zone_col: str = "zone") -> DataFrame:
    """One row of totals over the scored panel."""
    return df.agg(
        safe_abs_sum("effect_used").alias("raw_abs_media_effect"),
        safe_sum("excess_effect").alias("excess_effect"),
        F.avg("score").alias("avg_score"),
        F.avg("media_share_pct").alias("avg_media_share_pct"),
        F.count(F.lit(1)).alias("n_days"),
        *[F.count_if(F.col(zone_col) == z).alias(f"n_{z.lower()}") for z in ("MANIPULATION", "ALERT", "ELEVATED")],
    ).withColumn(
        "excess_share_pct", 100.0 * F.col("excess_effect") / (F.col("raw_abs_media_effect") + 1e-9)
    )


def grouped_summary(
    df: DataFrame, group: str, stats: dict[str, Column], medians: dict[str, str], total: bool = False
) -> DataFrame:
    """Statistics per group, with a grand total row (group NULL) when asked for.

    ``rollup`` expands the plain statistics map-side; medians are exact and
    distributed, because a group of events is not bounded by the calendar.
    All columns share one pass, with the column's name as a second key.
    """
    mark = F.coalesce(F.col(group), F.lit("\u0000total")).alias("__k")
    plain = df.rollup(group) if total else df.groupBy(group)
    table = plain.agg(*[c.alias(n) for n, c in stats.items()]).select("*", mark)
    spread = df.withColumn(group, F.explode(F.array(F.col(group), F.lit(None).cast("string")))) if total else df
    cells = F.array(*[F.struct(F.lit(n).alias("__m"), F.col(v).cast("double").alias("__x")) for n, v in medians.items()])
    long = spread.select(mark, F.explode(cells).alias("c")).select("__k", "c.*")
    found = exact_quantiles(long, ["__k", "__m"], "__x", {"__q": 0.5})
    wide = found.groupBy("__k").agg(*[F.max(F.when(F.col("__m") == n, F.col("__q"))).alias(n) for n in medians])
    return table.join(wide, "__k", "left").drop("__k")


def range_summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(
        F.min(value).alias("min_pct"), F.max(value).alias("max_pct"),
        F.avg(value).alias("mean_pct"), F.stddev_pop(value).alias("std_pct"),
    ).select(F.lit(value).alias("metric"), "*")


def describe_series(df: DataFrame, value: str, keys: list[str], sample: bool = True, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, std and percentiles; groups are series, bounded by the calendar."""
    std = F.stddev_samp if sample else F.stddev_pop
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), std(value).alias("std"),
        *[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in probs],
    )


def status_summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.avg("mentions").alias("mentions_mean"), F.stddev_samp("mentions").alias("mentions_std"),
        F.avg("tone").alias("tone_mean"),
        F.avg((F.col("mentions") == 0).cast("double")).alias("zero_share"),
    )


def null_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Percent of missing cells per column, long form, one pass."""
    wide = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_pct")


def winsorise(df: DataFrame, cols: list[str], *keys: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip to the group's own quantiles; groups with <= 10 values are left alone."""
    w = Window.partitionBy(*(keys or ("series_id",)))
    bounds = {}
    for c in cols:
        bounds[f"__lo_{c}"] = F.percentile(c, F.lit(lo)).over(w)
        bounds[f"__hi_{c}"] = F.percentile(c, F.lit(hi)).over(w)
        bounds[f"__n_{c}"] = F.count(c).over(w)
    out = df.withColumns(bounds)
    clipped = {
        c: F.when(F.col(f"__n_{c}") > 10, clip(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}"))).otherwise(F.col(c))
        for c in cols
    }
    return out.withColumns(clipped).drop(*bounds)


# Correlation and fits --------------------------------------------------------

def pearson_over(x: Column, y: Column, least: int, floor: float = 1e-12) -> dict[str, Column]:
    """Aggregates for r and n over rows where both sides are present.

    r is NULL below ``least`` rows or when either side does not vary.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    ok = (n >= least) & (F.stddev_pop(a) > floor) & (F.stddev_pop(b) > floor)
    return {"n": n, "r": F.when(ok, safe_corr(x, y))}


def pearson(df: DataFrame, x: str, y: str, keys: list[str], least: int = 10) -> DataFrame:
    aggs = pearson_over(F.col(x), F.col(y), least)
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])


def melt_pairs(df: DataFrame, keys: list[str], xs: list[str], ys: list[str]) -> DataFrame:
    """Long (predictor, target, x, y) rows; the pair list is a plan-time constant."""
    pairs = F.array(*[
        F.struct(F.lit(x).alias("predictor"), F.lit(y).alias("target"),
                 F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for x in xs for y in ys
    ])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def correlation_grid(df: DataFrame, keys: list[str], xs: list[str], ys: list[str], least: int = 10) -> DataFrame:
    """Pearson r for every (predictor, target); one pass, no melt, map-side combined."""
    cells = []
    for x in xs:
        for y in ys:
            a = pearson_over(F.col(x), F.col(y), least)
            cells.append(F.struct(
                F.lit(x).alias("predictor"), F.lit(y).alias("target"), a["n"].alias("n"), a["r"].alias("r")))
    wide = df.groupBy(*keys).agg(F.array(*cells).alias("cells"))
    return wide.select(*keys, F.explode("cells").alias("c")).select(*keys, "c.*")


def spearman_grid(df: DataFrame, keys: list[str], xs: list[str], ys: list[str], least: int = 10) -> DataFrame:
    """Pearson r of average ranks over pairwise complete rows.

    Equal (x, y) pairs are counted first; ranks belong to distinct values and
    come from ranges of them, so no group is sorted in one task.
    """
    long = melt_pairs(df, keys, xs, ys).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    by = [*keys, "predictor", "target"]
    pairs = kept_table(long.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    ranks = {c: prefix_counts(pairs.groupBy(*by, c).agg(F.sum("n").alias("n")), by, c, ["n"]).select(
        *by, c, (F.col("below_n") + (F.col("n") + 1) / 2.0).alias(f"r{c}")) for c in ("x", "y")}
    ranked = attach(attach(pairs, ranks["x"], [*by, "x"]), ranks["y"], [*by, "y"])
    # The mean rank of a group is (N + 1) / 2; centred sums keep their digits.
    total = ranked.groupBy(*by).agg(F.sum("n").alias("__all"))
    w, a, b = F.col("n"), F.col("rx") - (F.col("__all") + 1) / 2.0, F.col("ry") - (F.col("__all") + 1) / 2.0
    sums = attach(ranked, total, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    rho = F.when((F.col("n") >= least) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))
    return sums.select(*by, "n", rho.alias("rho"))


def linear_fit(df: DataFrame, x: str, y: str, keys: list[str], least: int = 11) -> DataFrame:
    """Slope, intercept, r2, RMSE and MAE; the residual pass joins one row per key."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    w = Window.partitionBy(*keys)
    line = df.filter(both).withColumns({
        "__n": F.count(F.lit(1)).over(w),
        "__sl": F.regr_slope(b, a).over(w),
        "__ic": F.regr_intercept(b, a).over(w),
    })
    e = F.col(y) - (F.col("__sl") * F.col(x) + F.col("__ic"))
    return (
        line.filter(F.col("__n") >= least).groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"), F.first("__sl").alias("slope"), F.first("__ic").alias("intercept"),
            F.pow(safe_corr(x, y), 2.0).alias("r2"),
            F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        )
    )


def incremental_r2(df: DataFrame, y: str, x1: str, x2: str, keys: list[str], least: int = 51) -> DataFrame:
    """R2 of (x1, x2) minus R2 of x2 alone, not below 0; closed form of three r."""
    full = df.filter(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    c = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        safe_corr(x1, y).alias("r1"), safe_corr(x2, y).alias("r2"), safe_corr(x1, x2).alias("r12"),
    )
    both = (F.pow("r1", 2.0) + F.pow("r2", 2.0) - 2.0 * F.col("r1") * F.col("r2") * F.col("r12")) / F.nullif(
        1.0 - F.pow("r12", 2.0), F.lit(0.0))
    return c.select(
        *keys, "n", F.pow("r2", 2.0).alias("r2_single"), both.alias("r2_both"),
        F.when(F.col("n") >= least, F.greatest(both - F.pow("r2", 2.0), F.lit(0.0))).alias("incremental_r2"),
    )


# Article statistics ----------------------------------------------------------

def article_weight() -> Column:
    """Articles, else mentions, else 1; zero counts as absent."""
    return F.coalesce(
        F.nullif(F.col("num_articles").cast("double"), F.lit(0.0)),
        F.nullif(F.col("num_mentions").cast("double"), F.lit(0.0)),
        F.lit(1.0),
    )


def domain_weights(articles: DataFrame, keys: list[str]) -> DataFrame:
    """(event, domain) totals: map-side combined, so a hot event spreads by domain."""
    return articles.groupBy(*keys, "domain").agg(
        F.sum(article_weight()).alias("weight"),
        F.sum("avg_tone").alias("tone_sum"), F.count("avg_tone").alias("tone_n"),
    )


def article_stats(per_domain: DataFrame, credibility: Column, keys: list[str]) -> DataFrame:
    """Per event: total and by-class mentions, mean tone and source concentration."""
    cred = per_domain.withColumn("cred", credibility)
    part = {k: F.sum(F.when(F.col("cred") == k, F.col("weight")).otherwise(0.0)) for k in ("low_cred", "trusted", "unknown")}
    total = F.sum("weight")
    return cred.groupBy(*keys).agg(
        total.alias("total_mentions"),
        *[c.alias(f"{k}_mentions") for k, c in part.items()],
        (part["low_cred"] / F.nullif(total, F.lit(0.0))).alias("low_cred_ratio"),
        (part["trusted"] / F.nullif(total, F.lit(0.0))).alias("trusted_ratio"),
        (F.sum("tone_sum") / F.nullif(F.sum("tone_n"), F.lit(0))).alias("mean_tone"),
        # sum of squared shares = sum of squares over the squared sum
        (F.sum(F.col("weight") * F.col("weight")) / F.nullif(total * total, F.lit(0.0))).alias("source_hhi"),
    )
