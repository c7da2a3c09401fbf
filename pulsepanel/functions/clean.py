"""Cleaning and scalar column functions.  All are built-in expressions.

Missing is always NULL inside the library: text parsers and ``inf_to_null``
turn NaN and infinities into NULL, because Spark aggregates count NaN.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def _decimal(text: Column) -> Column:
    # The guard keeps Java-only spellings such as "1.0d" out.
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def parse_number(c: Column) -> Column:
    """"4,745.10" -> 4745.1; blank and word-for-missing cells -> NULL."""
    return _decimal(F.regexp_replace(_strip(c), r'[ ,"]', ""))


def parse_percent(c: Column) -> Column:
    """"-11,39%" -> -11.39 (here a comma is the decimal point)."""
    bare = F.regexp_replace(_strip(c), r'[%"]', "")
    return _decimal(_strip(F.translate(bare, ",", ".")))


def parse_abbrev(c: Column) -> Column:
    """"146.84K" -> 146840.0, with K, M and B suffixes; else NULL."""
    text = F.regexp_replace(_strip(c), r'[ ,"]', "")
    pattern = r"^([0-9]*\.?[0-9]+)([KMBkmb])?$"
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.when(text.rlike(pattern), number * scale)


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    names = floating if cols is None else floating & set(cols)
    return df.withColumns({n: finite(F.col(n)) for n in sorted(names)})


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where every listed column is present.

    Same result as ``dropna``, kept as one CASE: a separate not-null predicate
    per derived column makes the optimizer's constraint inference grow
    exponentially with the number of columns.
    """
    gap = F.lit(False)
    for c in cols:
        gap = gap | F.col(c).isNull()
    return df.filter(F.when(gap, False).otherwise(True))


def safe_num(c: Column, fill: float | None = None) -> Column:
    """Coerce to double; what cannot be read is NULL, or ``fill`` when given."""
    value = finite(c.try_cast("double"))
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def parse_date(c: Column) -> Column:
    """First ten characters as an ISO day (drops " UTC" and times)."""
    return F.to_date(F.try_to_timestamp(F.substring(_strip(c), 1, 10), F.lit("yyyy-MM-dd")))


def parse_compact_date(c: Column) -> Column:
    """"20240131..." -> 2024-01-31."""
    head = F.substring(_strip(c), 1, 8)
    day = F.to_date(F.try_to_timestamp(head, F.lit("yyyyMMdd")))
    return F.when(head.rlike(r"^[0-9]{8}$"), day)


def log1p_count(c: Column) -> Column:
    return F.log1p(F.coalesce(c, F.lit(0.0)))


def neg_part(c: Column) -> Column:
    return F.greatest(-F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def pos_part(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def log_floor(c: Column, floor: float) -> Column:
    """ln of the value raised to ``floor``; NULL stays NULL."""
    return F.when(c.isNotNull(), F.ln(F.greatest(c, F.lit(float(floor)))))


def signed_log(c: Column) -> Column:
    x = F.coalesce(c, F.lit(0.0))
    return F.signum(x) * F.ln(F.greatest(F.abs(x), F.lit(1.0)))


def pct_from_logret(c: Column) -> Column:
    return F.expm1(c) * 100.0


def sign3(c: Column) -> Column:
    return F.signum(c)


def stars(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    )


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def calendar_parts(date: Column) -> dict[str, Column]:
    return {
        "weekday": F.weekday(date),
        "month": F.month(date),
        "is_weekend": (F.weekday(date) >= 5).cast("double"),
    }


def one_hot(c: Column, prefix: str, levels: list[int]) -> dict[str, Column]:
    """One 0/1 column per level; pass the levels without the dropped one."""
    return {f"{prefix}_{k}": (c == k).cast("double") for k in levels}


def safe_ratio_pct(num: Column, den: Column) -> Column:
    """100 * num / den, and 0 where the denominator is missing or zero."""
    return F.coalesce(100.0 * num / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def eps_ratio(num: Column, den: Column, eps: float = 1e-9) -> Column:
    return num / (den + F.lit(eps))


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """NULL-safe clip: greatest/least skip NULLs, so guard for them."""
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


# Plan-time helpers ---------------------------------------------------------

def snake_case(name: str) -> str:
    words = re.findall(r"\w+", str(name).replace("﻿", ""))
    return re.sub(r"_{2,}", "_", "_".join(words)).strip("_").lower()


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def resolve_alias(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def add_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Duplicate columns under second names when those are still free."""
    fresh = {new: F.col(old) for old, new in aliases.items() if old in df.columns and new not in df.columns}
    return df.withColumns(fresh) if fresh else df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
