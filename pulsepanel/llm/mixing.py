"""Mixing sources to target weights with a time-varying curriculum.

Native: DataFrame functions only.  Each source gets a target share of all
words; its documents stand in a fixed pseudo-random order, and copies are
taken from that order, epoch after epoch, until the target is met.  A source's
weight over training time is a piecewise linear schedule; its integral says
how many of its words have been demanded by time t, and the inverse of that
integral gives every copy its training position in [0, 1).  Sorting all copies
by range of position yields the training order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.llm.common import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Rates at knots (time, rate) for sources of weight 1, 2, 3: early, steady, late.
SCHEDULES = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (1.0, 1.5)]]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """(source, rank, source_size, weight, target) from (source, size).

    Weights repeat over the sources in code point order, null last.  Targets
    share the total by weight and stop at ``cap`` times the source: with
    sources in order of capacity per weight, the level of all from the first
    uncapped one on is what the capped ones leave, over the weight that is
    left.  One row per source is all that meets in a task here.
    """
    per = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    by_room = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    per = (
        per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("fits", (F.col("total") - F.col("capped")) * F.col("weight") <= F.col("source_size") * cap * F.col("left"))
    )
    first = F.min(F.when(F.col("fits"), F.struct(by_room_key(cap), "rank", "capped", "left"))).over(Window.partitionBy())
    per = per.withColumn("level", first)
    open_ = F.struct(by_room_key(cap), "rank") >= F.struct(F.col("level.room"), F.col("level.rank"))
    share = (F.col("total") - F.col("level.capped")).cast("double") * F.col("weight") / F.col("level.left")
    target = F.when(open_, share).otherwise((F.col("source_size") * cap).cast("double"))
    return written(per.select("source", "rank", "source_size", "weight", target.alias("target")), "targets")


def by_room_key(cap: int) -> Column:
    return (F.col("source_size") * cap / F.col("weight")).alias("room")


def invert_schedule(share: Column, knots: list[tuple[float, float]]) -> Column:
    """Time at which a share of a schedule's integral has passed.

    Between knots the rate is linear and the integral quadratic; the root is
    taken in the form that is stable for a constant rate too.
    """
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, None
    for ((t0, r0), (t1, r1)), area in zip(zip(knots, knots[1:]), areas):
        due = share * F.lit(total) - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * (r1 - r0) / (t1 - t0)) * due, F.lit(0.0)))
        at = F.lit(t0) + F.when(due <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * due / (F.lit(r0) + root))
        out = at if out is None else F.when(share * F.lit(total) < F.lit(before), out).otherwise(at)
        before += area
    return F.least(out, F.lit(knots[-1][0]))


def _inverse(knots: list[tuple[float, float]]) -> Callable[[Column], Column]:
    return lambda share: invert_schedule(share, knots)


def mix(docs: DataFrame, weights: list[int] | None = None, schedules: list | None = None, cap: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", digits: int = 3, keep: str = "row") -> DataFrame:
    """Per row of ``docs``: its columns in struct ``keep``, doc_id, size, source_size, target, copies, taken, positions.

    A document's place in its source is the running sum of sizes in md5 order
    of the id.  The order is cut into 16^``digits`` buckets, sums of buckets
    are added up first, and rows only meet inside a bucket, so a source that
    holds most rows is still spread over all tasks.  Copy e of a document is
    taken if the middle of the document, e rounds into the source, lies before
    the target, so a source is met to within half a document and no document
    is taken more than ``cap`` times.

    Null text has size 0; null source is a source of its own; null ids sort
    first; rows that repeat an id stand side by side, smaller ones first.
    Documents of size 0 are taken as their place says and add no words.  Empty
    tables give empty results.
    """
    weights = weights or [1, 2, 3]
    schedules = schedules or SCHEDULES
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(keep), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"), F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("place"),
    )
    targets = source_targets(rows.select("source", "size"), weights, cap)
    rows = rows.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, rows.source.eqNullSafe(targets.source)).drop("source")
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    run = F.sum("bucket_size").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sums.select("rank", "bucket", F.coalesce(run, F.lit(0)).alias("bucket_start")), "bucket-starts")
    inside = F.sum("size").over(Window.partitionBy("rank", "bucket", "bucket_start").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(starts, ["rank", "bucket"]).withColumn("offset", F.col("bucket_start") + F.coalesce(inside, F.lit(0)))
    middles = F.array(*[(2 * (F.col("offset") + e * F.col("source_size")) + F.col("size")).cast("double") for e in range(cap)])
    taken = F.filter(middles, lambda m: m < 2 * F.col("target"))
    share = F.transform(taken, lambda m: m / (2 * F.col("target")))
    position = None
    for i in range(len(weights)):
        at = F.transform(share, _inverse(schedules[i % len(schedules)]))
        position = at if position is None else F.when((F.col("rank") - 1) % len(weights) == i, at).otherwise(position)
    rows = rows.withColumn("positions", position)
    copies = F.size("positions").cast("long")
    return rows.select(keep, "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "positions")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, each repeated as often as the mix takes it; columns of ``docs``."""
    rows = mix(docs, keep="row", **options).select("row", F.explode("positions").alias("position"))
    # Ties by place differ only between rows of one source at one point; the id settles them.
    return rows.orderBy("position", "row.doc_id").select("row.*") if "doc_id" in docs.columns else rows.orderBy("position").select("row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM per),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM ranked),
roomy AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS room, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM weighed),
filled AS (
  SELECT *,
    CAST(coalesce(sum(source_size * 3) OVER (ORDER BY room, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    CAST(sum(weight) OVER (ORDER BY room, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_weight
  FROM roomy),
level AS (
  SELECT room AS room0, rank AS rank0, capped AS capped0, left_weight AS left0 FROM filled
  WHERE (total - capped) * weight <= source_size * 3 * left_weight ORDER BY room, rank LIMIT 1),
targets AS (
  SELECT source, rank, source_size,
    CASE WHEN (room, rank) >= (room0, rank0) THEN CAST(total - capped0 AS DOUBLE) * weight / left0 ELSE CAST(source_size * 3 AS DOUBLE) END AS target
  FROM filled, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY coalesce(md5(CAST(s.doc_id AS VARCHAR)), ''), s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CAST(2 * start + size AS DOUBLE) / (2 * target) AS share,
    CAST(2 * start + size < 2 * target AS INT) + CAST(2 * (start + source_size) + size < 2 * target AS INT)
      + CAST(2 * (start + 2 * source_size) + size < 2 * target AS INT) AS copies
  FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN (rank - 1) % 3 = 1 THEN share WHEN (rank - 1) % 3 = 0 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share))
    ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END, 9) END AS position
FROM counted
"""
