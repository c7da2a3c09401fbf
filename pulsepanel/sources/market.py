"""Readers for price, macro and futures files and for daily panels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.functions.clean import (
    normalise_names, parse_abbrev, parse_date, parse_number, parse_percent, require_columns, resolve_alias,
)
from pulsepanel.operators.joins import keep_one

# Date spellings of futures files, in the order they are tried.
FUTURES_DATES = ("M/d/yyyy", "d.M.yyyy", "yyyy-M-d", "d/M/yyyy")
DATE_NAMES = ["date", "data", "day"]


def _csv(spark: SparkSession, path) -> DataFrame:
    """All columns as text, plus the row's place for "first row wins" rules."""
    raw = spark.read.csv(path, header=True)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.select("*", place.alias("__place"))


def _first_per_day(df: DataFrame) -> DataFrame:
    found = df.filter(F.col("date").isNotNull())
    return keep_one(found, ["date"], [F.col("__place")]).drop("__place")


def read_price_csv(spark: SparkSession, path, prefix: str) -> DataFrame:
    raw = require_columns(_csv(spark, path), ["snapped_at", "price", "market_cap", "total_volume"])
    day = parse_date(F.replace(F.col("snapped_at"), F.lit(" UTC"), F.lit("")))
    return _first_per_day(raw.select(
        day.alias("date"), parse_number(F.col("price")).alias(f"{prefix}_price"),
        parse_number(F.col("market_cap")).alias(f"{prefix}_mcap"),
        parse_number(F.col("total_volume")).alias(f"{prefix}_volume"), "__place"))


def read_macro_csv(spark: SparkSession, path, value_col: str, out_col: str) -> DataFrame:
    raw = require_columns(_csv(spark, path), ["observation_date", value_col])
    return _first_per_day(raw.select(
        parse_date(F.col("observation_date")).alias("date"), parse_number(F.col(value_col)).alias(out_col), "__place"))


def read_futures_csv(spark: SparkSession, path, prefix: str = "gold") -> DataFrame:
    """The first date spelling that reads every row of a file is used for it."""
    raw = _csv(spark, path)
    raw = raw.toDF(*[c.strip().strip('"').strip() for c in raw.columns])
    require_columns(raw, ["Date", "Price"])
    text = F.trim(F.col("Date"))

    def read(fmt: str) -> Column:
        return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))

    file = F.col("__place.file_path")
    fits = [F.count(read(f)) == F.count(F.lit(1)) for f in FUTURES_DATES]
    choice = F.coalesce(*[F.when(ok, F.lit(i)) for i, ok in enumerate(fits)], F.lit(-1))
    votes = raw.groupBy(file.alias("__file")).agg(choice.alias("__fmt"))
    day = F.coalesce(*[F.when(F.col("__fmt").isin(i, -1), read(f)) for i, f in enumerate(FUTURES_DATES)])

    def optional(name: str, parse) -> Column:
        return parse(F.col(f"`{name}`")) if name in raw.columns else F.lit(None).cast("double")

    return _first_per_day(raw.withColumn("__file", file).join(votes, "__file").select(
        day.alias("date"), parse_number(F.col("Price")).alias(f"{prefix}_close"),
        optional("Vol.", parse_abbrev).alias(f"{prefix}_volume"),
        optional("Change %", parse_percent).alias(f"{prefix}_chg_pct"), "__place"))


def read_table_any(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """CSV or Parquet by name, snake-case columns, one ``date`` column; ``place`` adds the row's place in the files."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    where = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    df = normalise_names(df).withColumn("__place", where) if place else normalise_names(df)
    name = resolve_alias(df, DATE_NAMES)
    if name is None:
        return df
    return df.withColumn("date", parse_date(F.col(name))) if name == "date" else (
        df.withColumn("date", parse_date(F.col(name))).drop(name))


def read_panel(spark: SparkSession, parquet: str, fallback_csv: str | None = None, keys=("date",)) -> DataFrame:
    """The columnar table when it exists, else the CSV; the first row per key.

    A table that is there but can't be read is an error.
    """
    try:
        df = read_table_any(spark, parquet, place=True)
    except AnalysisException as e:
        if fallback_csv is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = read_table_any(spark, fallback_csv, place=True)
    require_columns(df, ["date"])
    return keep_one(df.filter(F.col("date").isNotNull()), list(keys), [F.col("__place")]).drop("__place")
