"""Back-test of threshold rules on the daily score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.operators.windows import log_return, ordered, with_drawdown

# Position below and at or above the threshold.  The last two rules coincide.
RULES = {"long_short": (1.0, -1.0), "long_only": (1.0, 0.0), "cash_on_high": (1.0, 0.0)}


def prepare_returns(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows with a score and a return; the return falls back to the price."""
    ret = F.col("logret") if "logret" in df.columns else log_return(F.col("price"), ordered())
    out = df.withColumn("ret", ret)
    ok = (F.abs("ret") != float("inf")) & ~F.isnan("ret")
    return out.filter(F.col(score).isNotNull() & F.col("ret").isNotNull() & ok).select("series_id", "date", F.col(score).alias("score"), "ret")


def positions(score: Column, threshold: Column, below: float, above: float) -> Column:
    return F.when(score < threshold, below).when(score.isNotNull(), above)


def strategy_returns(df: DataFrame, quantile: float = 0.70, threshold: float | None = None, train_until: str | None = None) -> DataFrame:
    """Yesterday's position times today's return for each rule.

    The threshold is a given number, a quantile of all days, or, without
    looking ahead, a quantile of the days before ``train_until``.
    """
    if threshold is not None:
        cut = F.lit(float(threshold))
    else:
        seen = F.when(F.col("date") < F.to_date(F.lit(train_until)), F.col("score")) if train_until else F.col("score")
        cut = F.percentile(seen, F.lit(quantile)).over(Window.partitionBy("series_id"))
    w = ordered()
    out = df.withColumn("threshold", cut)
    held = {
        f"__{r}": F.lag(positions(F.col("score"), F.col("threshold"), *legs)).over(w) for r, legs in RULES.items()}
    out = out.withColumns(held)
    cells = F.array(
        F.struct(F.lit("hold").alias("rule"), F.lit(1.0).alias("position")),
        *[F.struct(F.lit(r).alias("rule"), F.col(f"__{r}").alias("position")) for r in RULES])
    return (
        out.select("series_id", "date", "score", "ret", "threshold", F.explode(cells).alias("c"))
        .select("series_id", "date", "score", "ret", "threshold", "c.*")
        .filter(F.col("position").isNotNull())
        .withColumn("strategy_ret", F.col("position") * F.col("ret"))
    )


def performance(returns: DataFrame, keys: list[str], ret: str = "strategy_ret") -> DataFrame:
    """Total return, yearly Sharpe (365 days, population deviation), drawdown, active days."""
    sd = F.stddev_pop(ret)
    return with_drawdown(returns, ret, *keys).groupBy(*keys).agg(
        F.sum(ret).alias("total_return"),
        F.when(F.count(ret) >= 2, F.avg(ret) / F.nullif(sd, F.lit(0.0)) * math.sqrt(365)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count_if(F.col(ret) != 0).alias("active_days"),
    )


def compare_to_hold(perf: DataFrame) -> DataFrame:
    """Better Sharpe and smaller drawdown than holding, per rule."""
    hold = perf.filter(F.col("rule") == "hold").select(
        "series_id", F.col("sharpe").alias("hold_sharpe"), F.col("max_drawdown").alias("hold_drawdown"))
    no = F.lit(False)
    return perf.filter(F.col("rule") != "hold").join(hold, "series_id").select(
        "series_id", "rule",
        F.coalesce(F.col("sharpe") > F.col("hold_sharpe"), no).alias("better_sharpe"),
        F.coalesce(F.abs("max_drawdown") < F.abs("hold_drawdown"), no).alias("lower_drawdown"))
