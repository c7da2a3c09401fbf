"""Tail probabilities for result rows, as Arrow-batched column functions.

They run on one row per test, never on data rows.  The special functions are
short numpy forms because no statistics package is assumed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction, vectorised."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, u = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tiny = 1e-300
    c = np.ones_like(u)
    d = 1.0 - (p + q) * u / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))
        step = np.ones_like(u)
        for k in (even, odd):
            d = 1.0 + k * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(u) + q * np.log1p(-u)
        ) / p
    value = np.where(u <= 0.0, 0.0, np.where(u >= 1.0, 1.0, front * h))
    return np.where(swap, 1.0 - value, value)


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma: series below a + 1, fraction above."""
    def one(a: float, x: float) -> float:
        if x <= 0.0:
            return 1.0
        scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1.0:
            term = total = 1.0 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1.0
                term *= x / k
                total += term
            return 1.0 - total * scale
        b, c = x + 1.0 - a, 1e300
        d = 1.0 / b
        h = d
        for i in range(1, 10000):
            an = -i * (i - a)
            b += 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1.0) < 1e-16:
                break
        return h * scale
    return np.array([one(float(p), float(q)) for p, q in np.broadcast(a, x)])


def normal_cdf(z) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2.0))


def _masked(fn, *cols: pd.Series) -> pd.Series:
    arrays = [c.to_numpy(dtype=float) for c in cols]
    ok = np.all([np.isfinite(v) for v in arrays], axis=0)
    out = np.full(len(arrays[0]), np.nan)
    if ok.any():
        out[ok] = fn(*[v[ok] for v in arrays])
    # None, not NaN, so that missing reaches Spark as NULL.
    return pd.Series(out, dtype="object").where(ok, None)


@F.pandas_udf(T.DoubleType())
def _corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    # Two-sided p of a correlation: 1 - r^2 is the beta argument of its t value.
    return _masked(lambda r, n: betainc(n / 2 - 1, 0.5, np.clip(1 - r * r, 0, 1)), r, n.where(n > 2))


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(lambda f, a, b: betainc(b / 2, a / 2, b / (b + a * np.maximum(f, 0.0))), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, k: pd.Series) -> pd.Series:
    return _masked(lambda x, k: gamma_upper(k / 2, x / 2), x, k)


@F.pandas_udf(T.DoubleType())
def _normal_tail2(z: pd.Series) -> pd.Series:
    return _masked(lambda z: _erfc(np.abs(z) / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def _ks_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    def tail(d, n, m):
        en = np.sqrt(n * m / (n + m))
        k = np.arange(1, 101)[:, None]
        s = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * (k * en * d) ** 2), axis=0)
        return np.where(en * d < 0.2, 1.0, np.clip(s, 0.0, 1.0))
    return _masked(tail, d, n, m)


def corr_pvalue(r: Column, n: Column) -> Column:
    return _corr_p(r.cast("double"), n.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _f_tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_pvalue(x: Column, k: Column) -> Column:
    return _chi2_tail(x.cast("double"), k.cast("double"))


def normal_pvalue(z: Column) -> Column:
    return _normal_tail2(z.cast("double"))


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Limiting distribution of the two-sample statistic."""
    return _ks_tail(d.cast("double"), n.cast("double"), m.cast("double"))


#: Samples up to this size get the exact distribution.
KS_EXACT_MOST = 10_000


def ks_exact(gap: int, n: int, m: int) -> float:
    """P(D >= gap / (n m)) for two samples of n and m values without ties, by lattice paths.

    A path from (0, 0) to (n, m) takes a step per value in order; the statistic
    stays below the gap where |i m - j n| < gap all along.  ``inside[i]`` is
    the share of the paths to (i, k - i) that have stayed below it; the step
    that led there was one of the i or one of the k - i, at random.
    """
    n, m = sorted((int(n), int(m)))
    if gap <= 0:
        return 1.0
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for k in range(1, n + m + 1):
        low = max(0, k - m, (k * n - gap) // (n + m) + 1)
        high = min(n, k, (k * n + gap - 1) // (n + m))
        if low > high:
            return 1.0
        i = np.arange(low, high + 1)
        before = inside[i - 1] if low else np.concatenate([[0.0], inside[low:high]])
        fresh = (before * i + inside[low:high + 1] * (k - i)) / k
        inside[max(0, low - 1):high + 2] = 0.0
        inside[low:high + 1] = fresh
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


@F.pandas_udf(T.DoubleType())
def _ks_exact(gap: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    known = gap.notna() & (n > 0) & (m > 0) & (np.maximum(n, m) <= KS_EXACT_MOST)
    return pd.Series([ks_exact(int(g), int(a), int(b)) if ok else None for ok, g, a, b in zip(known, gap, n, m)], dtype="float64")


def ks_exact_pvalue(gap: Column, n: Column, m: Column) -> Column:
    """Exact p of the statistic gap / (n m), a whole number over the product of the sizes; NULL for samples over ``KS_EXACT_MOST``."""
    return _ks_exact(gap.cast("double"), n.cast("double"), m.cast("double"))


# Published response surfaces and critical values.
# MacKinnon (1994), constant only: z = polynomial in tau, p = normal cdf(z).
UNIT_ROOT_P = {
    1: {"max": 2.74, "min": -18.83, "star": -1.61,
        "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"max": 0.92, "min": -18.86, "star": -2.62,
        "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)},
}
# MacKinnon (2010), constant only, 5 %: b0 + b1/T + b2/T^2 + b3/T^3.
UNIT_ROOT_CV5 = {1: (-2.86154, -2.8903, -4.234, -40.040), 2: (-3.33613, -6.1101, -6.823, 0.0)}
# Kwiatkowski et al. (1992), level.
KPSS_LEVEL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
# MacKinnon, Haug and Michelis (1999), constant, trace, 95 %, by k - r.
JOHANSEN_TRACE95 = {1: 3.8415, 2: 15.4943, 3: 29.7961, 4: 47.8545, 5: 69.8189}


def unit_root_pvalue(tau: float, n_vars: int = 1) -> float:
    t = UNIT_ROOT_P[n_vars]
    if tau > t["max"]:
        return 1.0
    if tau < t["min"]:
        return 0.0
    coef = t["small"] if tau <= t["star"] else t["large"]
    return float(normal_cdf(sum(c * tau**i for i, c in enumerate(coef))))


def unit_root_cv5(n_obs: int, n_vars: int = 1) -> float:
    return sum(b / n_obs**i for i, b in enumerate(UNIT_ROOT_CV5[n_vars]))


def kpss_pvalue(stat: Column) -> Column:
    """Linear between the tabulated points and held at the outer ones."""
    expr = F.when(stat.isNull(), None).when(stat <= KPSS_LEVEL[0][0], KPSS_LEVEL[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_LEVEL, KPSS_LEVEL[1:]):
        expr = expr.when(stat <= x1, p0 + (stat - x0) * ((p1 - p0) / (x1 - x0)))
    return expr.otherwise(KPSS_LEVEL[-1][1])
