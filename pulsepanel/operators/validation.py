"""Out-of-sample validation and comparison with a benchmark index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.functions.clean import clip
from pulsepanel.functions.index import market_regime, sigmoid
from pulsepanel.functions.pvalues import corr_pvalue, ks_exact_pvalue, ks_pvalue, normal_pvalue
from pulsepanel.operators.aggregates import incremental_r2, linear_fit, pearson, pearson_over, spearman_grid
from pulsepanel.operators.joins import attach, number_rows
from pulsepanel.operators.slices import prefix_counts
from pulsepanel.operators.windows import average_rank

# Weights of volume, tone and residual; walk-forward sizes.
WEIGHTS = (0.25, 0.20, 0.20)
TRAIN_ROWS, TEST_ROWS = 365, 30


def split_by_date(df: DataFrame, boundary: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("date") < F.to_date(F.lit(boundary)), "TRAIN").otherwise("TEST"))


def proxies(df: DataFrame) -> DataFrame:
    """Volume, tone and residual proxies; missing counts as 0."""
    return df.withColumns({
        "px_volume": F.coalesce("raw_abs_effect", F.lit(0.0)),
        "px_tone": F.abs(F.coalesce("tone_used", F.lit(0.0))),
        "px_resid": F.coalesce("media_share_pct", F.lit(0.0)),
    })


PROXIES = ("px_volume", "px_tone", "px_resid")


def _blend(z: list[Column]) -> Column:
    return sigmoid(sum((w * x for w, x in zip(WEIGHTS[1:], z[1:])), WEIGHTS[0] * z[0]))


def _z(x: Column, mu: Column, sd: Column) -> Column:
    return clip((x - mu) / F.when(sd > 1e-9, sd).otherwise(1.0), -3.0, 3.0)


def oos_index(df: DataFrame, boundary: str, quantile: float = 0.70) -> DataFrame:
    """Index scaled by training days only, and the training quantile as threshold."""
    w = Window.partitionBy("series_id")
    out = proxies(split_by_date(df, boundary))
    train = F.col("split") == "TRAIN"
    stats = {}
    for p in PROXIES:
        stats[f"{p}_mu"] = F.avg(F.when(train, F.col(p))).over(w)
        stats[f"{p}_sd"] = F.stddev_pop(F.when(train, F.col(p))).over(w)
    out = out.withColumns(stats)
    out = out.withColumn("oos_score", _blend([_z(F.col(p), F.col(f"{p}_mu"), F.col(f"{p}_sd")) for p in PROXIES]))
    cut = F.percentile(F.when(train, F.col("oos_score")), F.lit(quantile)).over(w)
    return out.withColumn("threshold", cut).drop(*PROXIES, *stats)


def oos_index_components(df: DataFrame, boundary: str, parts=("z_volume", "z_tone", "z_resid")) -> DataFrame:
    """Variant on ready z components: training rows on their own moments,
    test rows on the training mean and sample deviation; missing is 0."""
    w = Window.partitionBy("series_id")
    out = split_by_date(df, boundary)
    train = F.col("split") == "TRAIN"
    z = []
    for p in parts:
        filled = F.coalesce(F.col(p), F.lit(0.0))
        own_mu = F.avg(F.when(train, filled)).over(w)
        own_sd = F.stddev_pop(F.when(train, filled)).over(w)
        mu = F.avg(F.when(train, F.col(p))).over(w)
        sd = F.stddev_samp(F.when(train, F.col(p))).over(w)
        own = clip((filled - own_mu) / F.greatest(own_sd, F.lit(1e-9)), -3.0, 3.0)
        other = clip((filled - mu) / F.greatest(sd, F.lit(1e-9)), -3.0, 3.0)
        z.append(F.when(train, own).otherwise(other))
    return out.withColumn("oos_score", _blend(z))


def train_calibration(scored: DataFrame) -> DataFrame:
    return scored.groupBy("series_id").agg(
        F.count_if(F.col("split") == "TRAIN").alias("n_train"), F.count_if(F.col("split") == "TEST").alias("n_test"),
        F.max("threshold").alias("threshold"),
    )


def distribution_shift(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov and Mann-Whitney between splits, and the mean verdict.

    Equal values are merged before the running counts, so ties cost nothing;
    the counts below a value come from ranges of values, so no group is sorted
    in one task.
    """
    train, test = F.col("split") == "TRAIN", F.col("split") == "TEST"
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count_if(train).alias("a"), F.count_if(test).alias("b"))
    totals = counts.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = attach(prefix_counts(counts, keys, value, ["a", "b"]), totals, keys)
    t = F.col("a") + F.col("b")
    ca, cb = F.col("below_a") + F.col("a"), F.col("below_b") + F.col("b")
    below = F.col("below_a") + F.col("below_b")
    c = c.withColumns({
        "gap": F.abs(ca / F.nullif(F.col("na"), F.lit(0)) - cb / F.nullif(F.col("nb"), F.lit(0))),
        "whole_gap": F.abs(ca * F.col("nb") - cb * F.col("na")),
        "rank_a": F.col("a") * (below + (t + 1) / 2.0),
        "tie": (t * t * t - t).cast("double"),
    })
    s = c.groupBy(*keys).agg(
        F.max("na").alias("n_train"), F.max("nb").alias("n_test"), F.max("gap").alias("ks_stat"), F.max("whole_gap").alias("ks_gap"),
        F.sum("rank_a").alias("ra"), F.sum("tie").alias("ties"),
        (F.sum(F.col(value) * F.col("a")) / F.nullif(F.max("na"), F.lit(0))).alias("mean_train"),
        (F.sum(F.col(value) * F.col("b")) / F.nullif(F.max("nb"), F.lit(0))).alias("mean_test"),
    )
    n1, n2 = F.col("n_train").cast("double"), F.col("n_test").cast("double")
    n = n1 + n2
    u1 = F.col("ra") - n1 * (n1 + 1) / 2.0
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / F.nullif(spread, F.lit(0.0))
    diff = F.abs(F.col("mean_test") - F.col("mean_train"))
    return s.select(
        *keys, "n_train", "n_test", "ks_stat", "ks_gap", u1.alias("u_stat"), z.alias("mw_z"),
        "mean_train", "mean_test", diff.alias("mean_diff"),
        F.when(diff < 0.03, "stable").when(diff < 0.07, "moderate").otherwise("unstable").alias("verdict"),
    )


def with_shift_pvalues(shift: DataFrame) -> DataFrame:
    """Two-sided p-values: Kolmogorov-Smirnov by the limiting distribution (``ks_p``) and, up to a size, exact (``ks_p_exact``)."""
    return shift.withColumns({
        "ks_p_exact": ks_exact_pvalue(F.col("ks_gap"), F.col("n_train"), F.col("n_test")),
        "ks_p_kind": F.lit("limiting"),
        "ks_p": ks_pvalue(F.col("ks_stat"), F.col("n_train"), F.col("n_test")),
        "mw_p": F.least(normal_pvalue(F.greatest(F.col("mw_z"), F.lit(0.0))), F.lit(1.0)),
    })


def predictive_performance(df: DataFrame, x: str = "oos_score", y: str = "excess_effect") -> DataFrame:
    """Fit per split, with the loss of R2 from training to test rows."""
    filled = df.withColumn(y, F.coalesce(y, F.lit(0.0)))
    keys = ["series_id", "split"]
    fit = linear_fit(filled, x, y, keys).join(pearson(filled, x, y, keys).select(*keys, "r"), keys)
    w = Window.partitionBy("series_id")
    tr = F.max(F.when(F.col("split") == "TRAIN", F.col("r2"))).over(w)
    te = F.max(F.when(F.col("split") == "TEST", F.col("r2"))).over(w)
    return fit.withColumn("r2_loss_pct", F.when(tr > 0, 100.0 * (tr - te) / tr))


def walk_forward(df: DataFrame, boundary: str, train: int = TRAIN_ROWS, test: int = TEST_ROWS) -> DataFrame:
    """Correlation on each test block, scaled by the rows before it.

    The rows before a block are summed by running sums at its start and
    ``train`` rows earlier, on values centred per series, so no row is copied
    and all grouping stays on the series partitioning.
    """
    w = Window.partitionBy("series_id")
    rows = number_rows(proxies(df)).withColumns({
        "rn": F.col("rn") - 1, "n": F.count(F.lit(1)).over(w),
        "y": F.coalesce("excess_effect", F.lit(0.0)),
    }) if "rn" not in df.columns else df
    last = F.ceil((F.col("n") - train - test) / F.lit(test)) - 1  # blocks with start < n - train - test
    order = w.orderBy("rn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    for p in PROXIES:
        rows = rows.withColumn(f"{p}_all", F.avg(p).over(w)).withColumn(f"{p}_c", F.col(p) - F.col(f"{p}_all"))
    rows = rows.withColumns({f"{p}_s1": F.coalesce(F.sum(f"{p}_c").over(before), F.lit(0.0)) for p in PROXIES})
    rows = rows.withColumns({f"{p}_s2": F.coalesce(F.sum(F.col(f"{p}_c") * F.col(f"{p}_c")).over(before), F.lit(0.0)) for p in PROXIES})
    for p in PROXIES:
        mean, square = ((F.col(f"{p}_{s}") - F.lag(f"{p}_{s}", train).over(order)) / F.lit(train) for s in ("s1", "s2"))
        rows = rows.withColumns({f"{p}_m": F.col(f"{p}_all") + mean, f"{p}_d": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))})
    past = F.col("rn") - train
    tested = rows.filter(past >= 0).withColumn("block", F.floor(past / F.lit(test)).cast("int")).filter(F.col("block") <= last)
    block, start = Window.partitionBy("series_id", "block"), F.pmod(F.col("rn") - train, F.lit(test)) == 0
    scored = tested.withColumns({
        f"{p}_{to}": F.max(F.when(start, F.col(f"{p}_{of}"))).over(block) for p in PROXIES for to, of in (("mu", "m"), ("sd", "d"))}).withColumn(
        "roll", _blend([_z(F.col(p), F.col(f"{p}_mu"), F.col(f"{p}_sd")) for p in PROXIES]))
    agg = pearson_over(F.col("roll"), F.col("y"), 10)
    out = scored.groupBy("series_id", "block").agg(
        F.min("date").alias("test_start"), F.max("date").alias("test_end"),
        F.count(F.lit(1)).alias("n_test"), agg["r"].alias("r"))
    return out.withColumns({
        "r2": F.col("r") * F.col("r"),
        "period": F.when(F.col("test_start") >= F.to_date(F.lit(boundary)), "TEST").otherwise("TRAIN_PERIOD"),
    })


def yearly_rollup(blocks: DataFrame) -> DataFrame:
    """Blocks, mean r and share of significant blocks per year of the block start."""
    p = corr_pvalue(F.col("r"), F.col("n_test"))
    return blocks.withColumn("p", p).groupBy("series_id", F.year("test_start").alias("year")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("r").alias("mean_r"),
        (100.0 * F.avg(F.coalesce((F.col("p") < 0.05).cast("double"), F.lit(0.0)))).alias("significant_pct"))


def regime_stability(df: DataFrame, x: str = "oos_score", y: str = "excess_effect", least: int = 20) -> DataFrame:
    r = df.withColumns({"regime": market_regime(F.col("logret")), "__y": F.coalesce(y, F.lit(0.0))})
    agg = pearson_over(F.col(x), F.col("__y"), 10)
    return (
        r.filter(F.col("regime") != "unknown").groupBy("series_id", "split", "regime")
        .agg(F.count(F.lit(1)).alias("n_days"), F.avg(x).alias("score_mean"), agg["r"].alias("r"))
        .filter(F.col("n_days") >= least)
    )


def benchmark_compare(df: DataFrame, keys: list[str], score: str = "score", bench: str = "bench_norm", outcome: str = "excess_effect", ret: str = "logret") -> DataFrame:
    """Overlap, correlations of index and benchmark, and the index's advantage."""
    ov = df.filter(F.col(score).isNotNull() & F.col(bench).isNotNull()).withColumns({
        "__o": F.coalesce(outcome, F.lit(0.0)), "__r": F.coalesce(ret, F.lit(0.0))})

    def r(x: str, y: str) -> Column:
        return pearson_over(F.col(x), F.col(y), 20)["r"]

    base = ov.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_overlap"), r(score, bench).alias("r_pair"),
        r(score, "__o").alias("r_score_outcome"), r(bench, "__o").alias("r_bench_outcome"),
        r(score, "__r").alias("r_score_return"), r(bench, "__r").alias("r_bench_return"))
    rho = spearman_grid(ov, keys, [score], [bench], 20).select(*keys, F.col("rho").alias("rho_pair"))
    inc = incremental_r2(ov, "__o", score, bench, keys).select(*keys, "incremental_r2")
    return (
        base.join(rho, keys, "left").join(inc, keys, "left")
        .withColumn("advantage", F.col("r_score_outcome") - F.col("r_bench_outcome"))
    )


def rank_pair(df: DataFrame, x: str, *keys: str) -> DataFrame:
    return df.withColumn(f"{x}_rank", average_rank(x, *keys))
