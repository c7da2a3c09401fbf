"""Where intermediate tables and checkpoints go.

A cluster names a shared folder in ``spark.checkpoint.dir``; it is read from
the session.  Only where it is unset and the whole session runs on one machine
is a fresh temporary folder made.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_stages: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; an error where a session over several machines names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-pulsepanel-")
    return _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pulsepanel/{uuid.uuid4().hex}/{name}"


def source_version(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of the files under a folder, as Spark's file system sees them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def stage(
    spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], buckets: tuple[str, str] | None = None, day: str | None = None,
) -> DataFrame:
    """A table written once per session and state of the source, then read by every consumer.

    This cuts lineage with files in the shared folder, so lost executors cost
    only their own tasks, and wide results are not recomputed by each query.
    With ``buckets`` = (key, order) the table is bucketed by the key and sorted
    in buckets, so that joins and windows by the key read it without an
    exchange; with ``day`` it has a folder per day, for readers of some days.
    """
    key = (spark.sparkContext.applicationId, source, source_version(spark, source), name)
    if key not in _stages:
        path, rows, table = fresh_path(spark, name), build(), None
        if buckets:
            n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"pulsepanel_{name}_{uuid.uuid4().hex}"
            # One writer a bucket: the rows are dealt by the hash that bucketing uses.
            rows.repartition(n, buckets[0]).write.bucketBy(n, buckets[0]).sortBy(buckets[1]).option("path", path).saveAsTable(table)
        elif day:
            rows.hint("rebalance", F.col(day)).write.partitionBy(day).parquet(path)
        else:
            rows.write.parquet(path)
        _stages[key] = table or path
    held = _stages[key]
    return spark.table(held) if held.startswith("pulsepanel_") else spark.read.parquet(held)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder; for tables that several steps of one operator read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_table(path_of: DataFrame) -> None:
    """Delete the files of a table under the shared folder, given a frame that was read from it."""
    spark = path_of.sparkSession
    jvm, root = spark.sparkContext._jvm, shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in path_of.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":", 1)[-1].lstrip("/") not in folder:
            raise ValueError(f"{folder} is not under {root}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget_stages() -> None:
    """Next use rebuilds; the bench calls this between measurements."""
    _stages.clear()


def remove_stages(spark: SparkSession) -> int:
    """Delete the session's stage tables; how many there were.  Frames read from them can no longer be used."""
    jvm, mine = spark.sparkContext._jvm, [k for k in _stages if k[0] == spark.sparkContext.applicationId]
    for key in mine:
        held = _stages.pop(key)
        if held.startswith("pulsepanel_"):
            files = spark.table(held).inputFiles()
            spark.sql(f"DROP TABLE {held}")
            held = files[0].rsplit("/", 1)[0] if files else None
        if not held:
            continue
        path = jvm.org.apache.hadoop.fs.Path(held)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)
    return len(mine)
