"""Shared pieces: written tables in the shared folder, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.sources.workdir import fresh_path

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder.

    Cuts lineage so that a lost executor costs only its own tasks, and a table
    with several readers is computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (a, b) -> (node, component).

    ``component`` is the smallest node id reachable.  Every round lets each
    node point at its smallest neighbour if that is smaller than itself,
    shortens the pointers twice, and maps both ends of every edge through
    them; edges inside one pointer tree vanish.  Pointers only fall, so the
    smallest node of a component keeps its own id and is the last one left.
    Each round groups with map-side minima and joins on node ids; no
    neighbour list is ever gathered.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = written(e, "edges")
    labels = None
    while not e.isEmpty():
        ends = e.union(e.select("b", "a"))
        up = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        up = written(up.select("node", F.least("node", "low").alias("up")), "pointers")
        over = up.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        jumped = up.join(over, up.up == over.mid).select("node", F.col("top").alias("up"))
        jumped = jumped.join(over, jumped.up == over.mid).select("node", F.col("top").alias("up"))
        up = written(jumped, "jumped")
        at_a = up.select(F.col("node").alias("a"), F.col("up").alias("low_a"))
        at_b = up.select(F.col("node").alias("b"), F.col("up").alias("low_b"))
        moved = e.join(at_a, "a").join(at_b, "b")
        e = written(
            moved.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).where("a < b").distinct(),
            "edges")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), F.col("up").alias("lower"))
            labels = labels.join(step, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
