"""Bind the given tables to the roles of the library: prices, controls, news.

Money and percent columns are summed as whole cents so that every daily value
is exact, whatever the order in which partial sums meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.functions.topics import domain_of, host_of
from pulsepanel.operators.joins import wide_by_preset

PRESETS = {"balanced": 20, "strong": 40, "sensitive": 1}
BOUNDARY = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str | Column) -> Column:
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("bigint")


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    total, n = F.sum(cents("o_totalprice")).cast("double"), F.count(F.lit(1))
    return o.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")
    ).agg((total / (100.0 * n)).alias("price"), (total / 100.0).alias("mcap"), n.alias("volume"))


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    total, n = F.sum(cents("l_extendedprice")).cast("double"), F.count(F.lit(1))
    return li.groupBy(
        F.col("l_returnflag").alias("control"), F.col("l_shipdate").cast("date").alias("date")
    ).agg((total / (100.0 * n)).alias("value"))


def macro_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = macro_long(spark, sf_dir)
    return m.groupBy("date").agg(*[
        F.max(F.when(F.col("control") == k, F.col("value"))).alias(f"ctl_{k.lower()}") for k in ("A", "N", "R")])


def media_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(preset, date, mentions, tone): nested presets by quantity.

    Aggregated wide per day and unfolded into presets afterwards, so raw rows
    are never multiplied.
    """
    li = table(spark, sf_dir, "lineitem")
    tone = cents(F.col("l_discount") - F.col("l_tax"))
    cells = []
    for p, lo in PRESETS.items():
        inside = F.col("l_quantity") >= lo
        cells.append(F.struct(
            F.lit(p).alias("preset"), F.count_if(inside).alias("mentions"), F.sum(F.when(inside, F.col("t"))).cast("double").alias("total")))
    days = li.select(F.col("l_shipdate").cast("date").alias("date"), tone.alias("t"), "l_quantity").groupBy("date").agg(F.array(*cells).alias("c"))
    c = days.select("date", F.explode("c").alias("c")).select("date", "c.*").where("mentions > 0")
    return c.select("preset", "date", "mentions", (F.col("total") / F.col("mentions")).alias("tone"))


def balanced_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_signal(spark, sf_dir).filter(F.col("preset") == "balanced").select("date", "mentions", "tone")


def wide_signal(spark: SparkSession, sf_dir: str, presets=tuple(PRESETS)) -> DataFrame:
    return wide_by_preset(media_signal(spark, sf_dir), list(presets), ["mentions", "tone"])


def news_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    tone = cents(F.col("l_discount") - F.col("l_tax")).cast("double")
    return li.select(
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_linenumber").alias("file_no"),
        (F.col("l_quantity") >= 20).alias("matched"), F.when(F.col("l_discount") > 0, tone).alias("tone"))


def stream_records(df: DataFrame) -> DataFrame:
    """Role columns of the events table, batch or stream; tone in whole cents."""
    return df.select(
        "ts", F.col("user_id").alias("source"), "event_type", (cents("value") / 100.0).alias("tone"),
        (F.col("event_type") != "error").alias("matched"), "event_id")


def read_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.concat(F.lit("EVT_"), (F.col("page_id") % 10).cast("string")).alias("event_id"),
        F.col("page_id").alias("article_id"), "url", domain_of(F.col("url")).alias("domain"),
        (1 + F.col("page_id") % 5).alias("num_articles"), (F.col("page_id") % 3).alias("num_mentions"),
        F.when(F.col("page_id") % 7 != 0, (F.col("page_id") % 21) - 10).cast("double").alias("avg_tone"))


def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated article rows spread over the price calendar."""
    p = table(spark, sf_dir, "pages")
    day = F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("page_id") * 37 % 2400).cast("int"))
    return p.select(
        F.col("page_id").cast("string").alias("record_id"), day.alias("date"), F.col("url").alias("source_url"),
        host_of(F.col("url")).alias("source_domain"), (1 + F.col("page_id") % 5).alias("num_articles"),
        (F.col("page_id") % 3).alias("num_mentions"), ((F.col("page_id") % 21) - 10).cast("double").alias("avg_tone"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0..100 benchmark value per day."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_linenumber").alias("s"), F.count(F.lit(1)).alias("n"))
    value = (F.col("s") * 7 + F.col("n")) % 101
    return li.select("date", value.alias("bench_value"), (value / 100.0).alias("bench_norm"))
