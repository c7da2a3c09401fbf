"""Baseline regression and ridge attribution per series, fitted on Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepanel.functions.clean import complete_rows, inf_to_null, one_hot, pct_from_logret
from pulsepanel.operators.gram import (
    VECTOR, dot, dot_arrays, gram, ols, segment_grams, segment_sums, solve_rows, spd_solve, triangle, vector,
)
from pulsepanel.operators.windows import (
    forward_fill, lagged_level, lags, log_return, ordered, regime_sign, rolling_std, rolling_zscore,
)

CONTROLS = ["ctl_a", "ctl_n", "ctl_r"]
WEEKDAYS = [1, 2, 3, 4, 5, 6]


def baseline_features(controls: list[str] = CONTROLS, include_regime: bool = False, months: bool = False) -> list[str]:
    names = ["logret_lag1", "logret_lag2", "logret_lag3", "vol_30_lag1", *[f"{c}_logret" for c in controls]]
    names += ["regime"] if include_regime else []
    names += [f"wd_{k}" for k in WEEKDAYS]
    return names + ([f"m_{k}" for k in range(2, 13)] if months else [])


def prepare_model_frame(
    panel: DataFrame, controls: list[str] = CONTROLS, ffill: bool = True,
    include_regime: bool = False, months: bool = False,
) -> DataFrame:
    """Returns, control returns, lags, volatility lag and dummies; complete rows only.

    ``include_regime`` adds the sign of the same day's target, which looks ahead;
    it is off unless asked for.
    """
    w = ordered()
    df = forward_fill(panel, controls) if ffill else panel
    df = df.withColumns({
        "logret": log_return(F.col("price"), w),
        **{f"{c}_logret": log_return(F.col(c), w) for c in controls},
    })
    df = df.withColumns({"vol_30": rolling_std(F.col("logret"), w, 30), "regime": regime_sign(F.col("logret"))})
    df = df.withColumns({**lags("logret", w, (1, 2, 3)), **lags("vol_30", w, (1,))})
    dummies = one_hot(F.weekday("date"), "wd", WEEKDAYS)
    if months:
        dummies |= one_hot(F.month("date"), "m", list(range(2, 13)))
    features = baseline_features(controls, include_regime, months)
    out = df.withColumns(dummies).select("series_id", "date", "price", "mcap", "logret", *features)
    return complete_rows(inf_to_null(out, ["logret", *features]), ["logret", *features])


OLS_SCHEMA = "n bigint, beta array<double>, ssr double, r2 double, adj_r2 double, aic double, bic double"


def fit_ols(frame: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """One row per key: coefficients (constant first) and fit statistics."""
    width = len(xs) + 2
    rows = frame.select(*keys, vector([F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]).alias(VECTOR))
    k = len(xs) + 1

    def solve(row: dict) -> list[dict]:
        g = triangle(np.asarray(row["g"], float), width)
        n = int(round(g[0, 0]))
        if n <= k:
            return []
        beta, ssr = ols(g, list(range(k)), k)
        sst = g[k, k] - g[0, k] ** 2 / n
        r2 = 1.0 - ssr / sst
        minus2ll = n * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0)
        return [{
            "n": n, "beta": beta.tolist(), "ssr": ssr, "r2": r2,
            "adj_r2": 1.0 - (1.0 - r2) * (n - 1) / (n - k),
            "aic": minus2ll + 2 * k, "bic": minus2ll + k * math.log(n),
        }]

    return solve_rows(gram(rows, keys, width), keys, OLS_SCHEMA, solve)


def baseline(frame: DataFrame, xs: list[str], z_window: int = 60) -> DataFrame:
    """Expected and abnormal return, its z-score, percent and level effects."""
    fits = fit_ols(frame, "logret", xs, ["series_id"])
    expected = dot(F.col("beta"), [F.lit(1.0), *[F.col(x) for x in xs]])
    w = ordered()
    out = frame.join(fits.select("series_id", "beta", "r2", "adj_r2", "aic", "bic"), "series_id")
    out = out.withColumn("expected_logret", expected).drop("beta")
    out = out.withColumn("abnormal_logret", F.col("logret") - F.col("expected_logret"))
    level = lagged_level(F.col("mcap"), F.col("expected_logret"), w)
    return out.withColumns({
        "abnormal_z60": rolling_zscore(F.col("abnormal_logret"), w, z_window),
        "return_pct": pct_from_logret(F.col("logret")),
        "expected_return_pct": pct_from_logret(F.col("expected_logret")),
        "abnormal_return_pct": pct_from_logret(F.col("abnormal_logret")),
        "mcap_lag1": level["level_lag1"],
        "mcap_hat": level["level_hat"],
        "abnormal_usd": level["abnormal_level"],
    })


# Feature screening -----------------------------------------------------------

def feature_vector(df: DataFrame, features: list[str], name: str = "__f") -> DataFrame:
    """All candidate features as one array (NULL entries kept)."""
    return df.withColumn(name, F.array(*[F.col(f).cast("double") for f in features]))


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts, means and central sums per column of x, as rows of one array.

    Rows: all, non-null, mean and squares of x with 0 for NULL, pairs, mean of
    x and y, squares of x and y, products.  Values are taken relative to the
    first of each column, so a constant column has squares of exactly zero.
    """
    def centred(v: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = known.sum(axis=0)
        base = v[known.argmax(axis=0), np.arange(v.shape[1])]
        d = np.where(known, v - base, 0.0)
        mean = d.sum(axis=0) / np.maximum(n, 1)
        return n, np.where(n > 0, base + mean, 0.0), np.where(known, d - mean, 0.0)

    seen = ~np.isnan(x)
    filled = np.where(seen, x, 0.0)
    rows, mean0, dev0 = centred(filled, np.ones_like(seen))
    pair = seen & ~np.isnan(y)[:, None]
    n, mean_x, dx = centred(filled, pair)
    _, mean_y, dy = centred(np.broadcast_to(np.nan_to_num(y)[:, None], x.shape), pair)
    return np.stack([rows, seen.sum(axis=0), mean0, (dev0**2).sum(axis=0), n, mean_x, mean_y, (dx**2).sum(axis=0), (dy**2).sum(axis=0), (dx * dy).sum(axis=0)])


def _add_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    out = a + b
    for n, x, y, cells in ((0, 2, 2, ((3, 2, 2),)), (4, 5, 6, ((7, 5, 5), (8, 6, 6), (9, 5, 6)))):
        total = np.maximum(out[n], 1)
        share = a[n] * b[n] / total
        for cell, i, j in cells:
            out[cell] += (b[i] - a[i]) * (b[j] - a[j]) * share
        for m in {x, y}:
            out[m] = np.where(a[n] == 0, b[m], a[m] + (b[m] - a[m]) * b[n] / total)
    return out


def screen_features(df: DataFrame, y: str, keys: list[str], vec: str = "__f") -> DataFrame:
    """Per (key, position): coverage, spread and correlation with the target.

    Each task keeps one array of moments per key; the arrays meet in one
    exchange and only their results become rows.
    """
    key_fields = [df.schema[k] for k in keys]
    part_schema = T.StructType([*key_fields, T.StructField("m", T.ArrayType(T.DoubleType()))])
    out_schema = T.StructType([*key_fields, *T.StructType.fromDDL("pos int, non_null double, spread double, n_pairs bigint, r double").fields])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in range(len(keys))]
            flat = batch.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False)
            if not batch.num_rows:
                continue
            x, target = flat.reshape(batch.num_rows, -1), batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(float)
            names = pd.DataFrame({k: batch.column(i).to_pandas() for i, k in enumerate(keys)})
            for key, rows in names.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                now = _moments(x[rows], target[rows])
                sums[key] = _add_moments(sums[key], now) if key in sums else now
        if sums:
            columns = [pa.array([key[i] for key in sums], kinds[i]) for i in range(len(keys))]
            columns.append(pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, [*keys, "m"])

    def merge(t: pa.Table) -> pa.Table:
        total = None
        for m in t.column("m"):
            m = m.values.to_numpy().reshape(10, -1)
            total = m if total is None else _add_moments(total, m)
        rows, seen, _, square0, n, _, _, xx, yy, xy = total
        varies = (n >= 50) & (xx > 0) & (yy > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (xy / n) / (np.sqrt(xx / n) * np.sqrt(yy / n))
        width = total.shape[1]
        columns = {k: pa.array([t.column(k)[0].as_py()] * width, t.column(k).type) for k in keys}
        return pa.table(columns | {
            "pos": pa.array(np.arange(width, dtype=np.int32)), "non_null": pa.array(seen / rows), "spread": pa.array(np.sqrt(square0 / rows)),
            "n_pairs": pa.array(n.astype(np.int64)), "r": pa.array(np.where(varies, r, 0.0), mask=~varies)})

    picked = df.select(*keys, F.col(y).cast("double").alias("__y"), F.col(vec).alias("__v"))
    return picked.mapInArrow(partial, part_schema).groupBy(*keys).applyInArrow(merge, out_schema)


def filter_features(screen: DataFrame, min_non_null: float = 0.80) -> DataFrame:
    return screen.filter((F.col("non_null") >= min_non_null) & (F.col("spread") > 0))


def top_k_features(screen: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Strongest |r| first, ties by position.  Rounding makes exact copies tie."""
    strength = F.round(F.abs("r"), 12)
    w = Window.partitionBy(*keys).orderBy(strength.desc(), "pos")
    return (
        screen.filter(F.col("r").isNotNull())
        .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    )


# Ridge with time-ordered folds ------------------------------------------------

def fold_segments(df: DataFrame, keys: list[str], n_splits: int = 5) -> DataFrame:
    """Segment 0 trains first; fold k is tested on segment k, trained on all before.

    A fold tests n // (n_splits + 1) rows; the remainder stays in segment 0.
    """
    w = Window.partitionBy(*keys)
    rn = F.row_number().over(w.orderBy("date"))
    n = F.count(F.lit(1)).over(w)
    size = F.floor(n / (n_splits + 1)).cast("int")
    first = n - size * n_splits
    seg = F.when((size == 0) | (rn <= first), 0).otherwise(1 + F.floor((rn - 1 - first) / F.nullif(size, F.lit(0))))
    return df.withColumn("segment", seg.cast("int"))


RIDGE_SCHEMA = (
    "kept array<int>, folds array<struct<fold:int, n:bigint, beta:array<double>>>, "
    "coef array<double>, means array<double>, scales array<double>"
)


def ridge_from_gram(g: np.ndarray, xs: list[int], y: int, alpha: float):
    """Ridge on standardised features with a free intercept, from raw moments."""
    n = g[0, 0]
    mean = g[0, xs] / n
    cov = g[np.ix_(xs, xs)] - n * np.outer(mean, mean)
    var = np.diag(cov) / n
    floor = 1e-12 * np.maximum(g[xs, xs] / n, 1e-300)  # below it, rounding noise only
    scale = np.where(var > floor, np.sqrt(np.maximum(var, 0.0)), 1.0)
    xy = (g[xs, y] - mean * g[0, y]) / scale
    coef = spd_solve(cov / np.outer(scale, scale) + alpha * np.eye(len(xs)), xy)
    raw = coef / scale
    return coef, mean, scale, np.concatenate([[g[0, y] / n - raw @ mean], raw])


def prune_collinear(corr: np.ndarray, target: np.ndarray, limit: float) -> list[int]:
    """Walk pairs in order; of a pair at or above the limit the weaker one goes."""
    alive = dict.fromkeys(range(len(target)))
    for i in range(len(target)):
        for j in range(i + 1, len(target)):
            if i not in alive:
                break
            if j in alive and corr[i, j] >= limit:
                alive.pop(j if target[i] >= target[j] else i)
    return list(alive)


def _correlations(g: np.ndarray, width: int) -> np.ndarray:
    n = g[0, 0]
    cov = g / n - np.outer(g[0], g[0]) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(cov / np.outer(sd, sd))
    # Twelve digits make exact copies tie, whatever the order of the partial sums.
    return np.round(np.nan_to_num(r, nan=0.0, posinf=0.0), 12)


def fit_ridge_cv(
    rows: DataFrame, keys: list[str], width: int, alpha: float = 10.0, n_splits: int = 5,
    prune_at: float | None = None,
) -> DataFrame:
    """Ridge per key for every fold and for all rows (fold 0), from one pass.

    ``rows`` carries ``segment`` and the vector (1, features..., target); an
    optional ``used`` counts the real features when vectors are zero-padded.
    """
    has_used = "used" in rows.columns
    group = [*keys, "used"] if has_used else keys
    grams = segment_grams(rows, group, "segment", width)
    y = width - 1

    def solve(row: dict) -> list[dict]:
        segs, mats = segment_sums(row, width)
        total = mats.sum(axis=0)
        xs = list(range(1, 1 + (int(row["used"]) if has_used else width - 2)))
        if prune_at is not None:
            r = _correlations(total, width)
            xs = [xs[i] for i in prune_collinear(r[np.ix_(xs, xs)], r[xs, y], prune_at)]
        folds = []
        for k in range(1, n_splits + 1):
            train = mats[segs < k].sum(axis=0)
            if train[0, 0] >= 1 and (segs == k).any():
                folds.append({"fold": k, "n": int(round(train[0, 0])), "beta": ridge_from_gram(train, xs, y, alpha)[3].tolist()})
        coef, mean, scale, beta = ridge_from_gram(total, xs, y, alpha)
        folds.insert(0, {"fold": 0, "n": int(round(total[0, 0])), "beta": beta.tolist()})
        return [{
            "kept": [i - 1 for i in xs], "folds": folds,
            "coef": coef.tolist(), "means": mean.tolist(), "scales": scale.tolist(),
        }]

    return solve_rows(grams, group, RIDGE_SCHEMA, solve)


def score_ridge(df: DataFrame, fits: DataFrame, keys: list[str], vec: str, mcap: str = "mcap", actual: str = "abnormal_usd") -> DataFrame:
    """In-sample and out-of-fold prediction, and their level effects."""
    out = df.join(fits.select(*keys, "kept", "folds"), keys)
    x = F.concat(F.array(F.lit(1.0)), F.transform("kept", lambda i: F.coalesce(F.get(F.col(vec), i), F.lit(0.0))))

    def predict(fold: Column) -> Column:
        fit = F.filter("folds", lambda f: f["fold"] == fold)
        return F.when(F.size(fit) > 0, dot_arrays(F.get(fit, F.lit(0))["beta"], x))

    out = out.withColumns({
        "media_logret": predict(F.lit(0)),
        "media_logret_oof": F.when(F.col("segment") > 0, predict(F.col("segment"))),
    }).drop("kept", "folds")
    level = F.coalesce(F.col(mcap), F.lit(0.0))
    return out.withColumns({
        "media_effect": F.col("media_logret") * level,
        "media_effect_oof": F.col("media_logret_oof") * level,
        "media_effect_abs": F.abs(F.col("media_logret") * level),
        "media_share_of_move": F.abs(F.col("media_logret") * level) / F.abs(F.nullif(F.col(actual), F.lit(0.0))),
    })


def regression_metrics(df: DataFrame, y: str, pred: str, keys: list[str]) -> DataFrame:
    """MAE, RMSE and R2 over rows that have a prediction."""
    e = F.col(y) - F.col(pred)
    sst = F.count(F.lit(1)) * F.var_pop(y)
    return df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"),
    )


def cv_summary(per_fold: DataFrame, keys: list[str]) -> DataFrame:
    return per_fold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.avg(m).alias(f"{m}_mean") for m in ("mae", "rmse", "r2")],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in ("mae", "rmse", "r2")],
    )


def coefficient_table(fits: DataFrame, keys: list[str], features: list[str], chosen: str | None = None) -> DataFrame:
    """Feature, coefficient on the scaled features, its size, mean and scale.

    ``chosen`` names an array of positions when each key has its own selection.
    """
    names = F.array(*[F.lit(f) for f in features])
    where = F.transform("kept", lambda i: F.get(F.col(chosen), i) if chosen else i)
    rows = F.arrays_zip(where.alias("pos"), F.col("coef"), F.col("means"), F.col("scales"))
    return fits.select(*keys, F.explode(rows).alias("c")).select(
        *keys, F.get(names, F.col("c.pos")).alias("feature"), F.col("c.coef").alias("coef"),
        F.abs("c.coef").alias("coef_abs"), F.col("c.means").alias("mean"), F.col("c.scales").alias("scale"),
    )
