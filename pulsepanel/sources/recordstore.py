"""Landed records as a table with a folder per day, read by the days that are wanted.

Landing replaces the days it brings and leaves the others alone.  Adaptive
execution deals the rows to writers: a day that holds much of the records is
split over several files, small days share a task.  Readers hand over the days
they need; the distinct days are a broadcast set (at most one entry per
calendar day), and dynamic partition pruning lets Spark list and read only their
folders.  Records without a day lie in a folder of their own and match no day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsepanel.operators.joins import calendar_range, missing_days
from pulsepanel.sources.workdir import source_version


def land_days(records: DataFrame, path: str, day: str = "date") -> str:
    """Write the records' days, whole; a day that is there already is replaced."""
    rows = records.hint("rebalance", F.col(day))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return path


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The whole store; no rows where nothing has landed.  The schema spares a look into the files."""
    if not source_version(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def days_of_windows(windows: DataFrame, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Distinct days that any window covers; windows that end before they start cover none."""
    held = windows.where(F.col(start) <= F.col(end))
    return held.select(F.explode(F.sequence(start, end)).alias("date")).distinct()


def records_of_days(records: DataFrame, days: DataFrame, day: str = "date") -> DataFrame:
    """Records of the given days; folders of other days aren't read.

    The broadcast set has one entry per calendar day at most.
    """
    wanted = days.select(F.col("date").alias(day)).distinct()
    return records.join(F.broadcast(wanted), day, "left_semi").select(*records.columns)


def days_to_fetch(spark: SparkSession, store: DataFrame, start: str, end: str, day: str = "date") -> DataFrame:
    """Calendar days from start to end that have no folder yet; reads folder names only."""
    held = store.select(F.col(day).alias("date")).distinct()
    return missing_days(calendar_range(spark, start, end), held)
