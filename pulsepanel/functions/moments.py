"""Second moments that stay quiet on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson r over rows with both sides; NULL when a side does not vary.

    The built-in ``corr`` divides by zero there, an error in ANSI mode even
    when the result is not asked for.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
