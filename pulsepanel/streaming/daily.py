"""Daily news signals as Structured Streaming jobs.

Days are never closed: records may arrive for any day at any time.  So no job
here keeps a watermark.  Every micro-batch sums what it brings per day and
appends these sums as one numbered batch; readers add up the batches of a day.
A replayed batch rewrites its own folder, so restarts neither lose nor double
a record, and a back-filled day simply gains a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsepanel.functions.index import Calibration, pressure_index, zone
from pulsepanel.sources.sinks import append_days, fold_batches, merge_batches
from pulsepanel.sources.workdir import source_version

SUMS = ["mentions", "tone_sum", "tone_n"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_sums(records: DataFrame, *keys: str) -> DataFrame:
    """(date, keys, mentions, tone_sum, tone_n) of the records at hand."""
    tone = F.when(F.col("matched"), F.col("tone"))
    return records.groupBy(F.to_date("ts").alias("date"), *keys).agg(
        F.count_if("matched").alias("mentions"), F.sum(tone).alias("tone_sum"), F.count(tone).alias("tone_n"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a job's start."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Drain what is available, micro-batch by micro-batch."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_daily(stream: DataFrame, path: str, checkpoint: str, *keys: str, fold_every: int = 50) -> None:
    """Append the sums of each micro-batch to the batched day table under ``path``.

    Every ``fold_every`` batches the job adds them up into one folder, so a
    reader meets a bounded number of them however long the job has run.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        append_days(daily_sums(batch, *keys), path, batch_id)
        if batch_id % fold_every == fold_every - 1:
            fold_batches(batch.sparkSession, path, ["date", *keys], SUMS, batch_id)

    run_batches(stream, checkpoint, write)


def read_days(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(date, keys, mentions, tone) over all batches, compacted ones included."""
    sums = merge_batches(spark, path, ["date", *keys], SUMS)
    return sums.select("date", *keys, "mentions", (F.col("tone_sum") / F.nullif("tone_n", F.lit(0))).alias("tone"))


def run_once_only(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Append each composite key once, however late or often it comes; NULLs in a key are equal.

    The keys are Spark's own state: kept in RocksDB, partitioned by key and
    versioned with the checkpoint, so a micro-batch looks up its own keys and
    reads no others, and a replayed batch sees the state from before it and
    rewrites its folder.  Batches without rows write nothing that later ones
    need.
    """
    with settings(stream.sparkSession, {"spark.sql.streaming.stateStore.providerClass": ROCKS}):
        run_batches(stream.dropDuplicates(keys), checkpoint, lambda batch, batch_id: append_days(batch, f"{path}/records", batch_id))


def read_once_only(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All records so far; with the records' schema also where no batch has written yet."""
    if schema and not source_version(spark, f"{path}/records"):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/records/batch=*")


def live_index(days: DataFrame, calib: Calibration | None = None) -> DataFrame:
    """Index and zone per day on the streamed signal (batch or stream)."""
    score = pressure_index(F.col("mentions").cast("double"), F.col("tone"), calib)
    return days.withColumn("score", score).withColumn("zone", zone(F.col("score")))
