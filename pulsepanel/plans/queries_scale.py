"""Queries of the forms for data that no single task can hold: day stores, long windows, long series, many candidates, large domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepanel.operators import intervals, joins, slices, windows
from pulsepanel.operators import validation as vd
from pulsepanel.plans import fixtures as fx
from pulsepanel.plans import panels as pn
from pulsepanel.plans.oracle import cte
from pulsepanel.plans.queries_stats import _oos
from pulsepanel.plans.registry import query
from pulsepanel.sources import recordstore as store
from pulsepanel.sources.workdir import fresh_path

# Days and windows ---------------------------------------------------------------------------------------


@query("day_store_resume", "date:d articles mentions:i", """
SELECT date, COUNT(*) AS articles, SUM(num_mentions) AS mentions FROM article_records WHERE date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' GROUP BY 1""")
def day_store_resume(spark, sf):
    """Records of odd days land first, those of two years land once more; then only the days that have no folder are fetched."""
    records = fx.article_records(spark, sf)
    path, first, last = fresh_path(spark, "day_store"), "1995-01-01", "1999-12-31"
    wanted = records.where(F.col("date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    odd = wanted.where(F.dayofyear("date") % 2 == 1)
    store.land_days(odd, path)
    store.land_days(odd.where(F.year("date") < 1997), path)
    missing = store.days_to_fetch(spark, store.read_records(spark, path, records.schema), first, last)
    store.land_days(store.records_of_days(wanted, missing), path)
    held = store.read_records(spark, path, records.schema)
    return held.groupBy("date").agg(F.count(F.lit(1)).alias("articles"), F.sum("num_mentions").alias("mentions"))


def _long_windows(spark, sf) -> DataFrame:
    """Two windows a peak: around the event, and from the peak on for some hundred days up to three years."""
    peaks = pn.peaks(spark, sf).select("series_id", "preset", "event_id", "peak_date", "window_start", "window_end")
    length = 100 + F.dayofyear("peak_date") * 3
    after = F.struct(F.lit("after").alias("kind"), F.col("peak_date").alias("a"), F.date_add("peak_date", length).alias("b"))
    near = F.struct(F.lit("near").alias("kind"), F.col("window_start").alias("a"), F.col("window_end").alias("b"))
    return peaks.withColumn("w", F.explode(F.array(near, after))).select("series_id", "preset", "event_id", "w.*")


@query("event_long_windows", "series_id preset event_id kind n_days volume:i high:2", """
SELECT w.series_id, preset, event_id, kind, COUNT(*) AS n_days, SUM(volume) AS volume, MAX(price) AS high FROM (
  SELECT series_id, preset, event_id, 'near' AS kind, window_start AS a, window_end AS b FROM peaks UNION ALL
  SELECT series_id, preset, event_id, 'after', peak_date, CAST(peak_date + 100 + CAST(dayofyear(peak_date) AS INTEGER) * 3 AS DATE) FROM peaks) w
JOIN price_panel p ON p.series_id = w.series_id AND p.date BETWEEN a AND b GROUP BY 1, 2, 3, 4""")
def event_long_windows(spark, sf):
    rows = intervals.windows_join(_long_windows(spark, sf), pn.prices(spark, sf), ["series_id"], "a", "b")
    return rows.groupBy("series_id", "preset", "event_id", "kind").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("volume").alias("volume"), F.max("price").alias("high"))


# One long series ----------------------------------------------------------------------------------------

SLICE_ROWS, TIES = 1 << 12, ("shipped", "cents", "step", "l_returnflag")
cte("line_series", """
SELECT l_orderkey * 10 + l_linenumber AS line_no, l_returnflag, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents,
       CASE WHEN l_linenumber <= 2 THEN CAST(ROUND(l_extendedprice * 100) AS BIGINT) END AS quote,
       CAST(l_quantity AS BIGINT) - 25 AS step, CAST(l_shipdate AS DATE) AS shipped FROM lineitem""")


def _line_series(spark, sf) -> DataFrame:
    """All order lines as one series: a quote only on first lines, and a step up or down."""
    price = fx.cents("l_extendedprice")
    return fx.table(spark, sf, "lineitem").select(
        F.lit("all").alias("series_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), "l_returnflag", price.alias("cents"),
        F.when(F.col("l_linenumber") <= 2, price).alias("quote"), (F.col("l_quantity").cast("bigint") - 25).alias("step"), F.col("l_shipdate").cast("date").alias("shipped"))


def _cut(spark, sf) -> DataFrame:
    return pn.stage(spark, sf, "line_slices", lambda: slices.numbered(_line_series(spark, sf), ["series_id"], "line_no", TIES, SLICE_ROWS))


@query("long_series_fill", "l_returnflag line_no:i quote:i", """
SELECT * FROM (SELECT line_no, l_returnflag, LAST_VALUE(quote IGNORE NULLS) OVER (ORDER BY line_no, shipped, cents, step, l_returnflag ROWS UNBOUNDED PRECEDING) AS quote FROM line_series) WHERE quote IS NOT NULL""")
def long_series_fill(spark, sf):
    return slices.forward_fill(_cut(spark, sf), ["quote"], ["series_id"]).where("quote IS NOT NULL")


@query("long_series_drawdown", "line_no:i place:i cum:i peak:i drawdown:i", """
SELECT *, cum - peak AS drawdown FROM (SELECT line_no, place, cum, MAX(cum) OVER (ORDER BY line_no, shipped, cents, step, l_returnflag ROWS UNBOUNDED PRECEDING) AS peak FROM (
  SELECT line_no, shipped, cents, step, l_returnflag, ROW_NUMBER() OVER (ORDER BY line_no, shipped, cents, step, l_returnflag) AS place, SUM(step) OVER (ORDER BY line_no, shipped, cents, step, l_returnflag ROWS UNBOUNDED PRECEDING) AS cum FROM line_series))""")
def long_series_drawdown(spark, sf):
    return slices.with_drawdown(_cut(spark, sf), "step", ["series_id"]).withColumnRenamed(slices.PLACE, "place")


@query("long_series_rolling", "line_no:i mean30:4 std30:3 high30:i", """
SELECT line_no, AVG(cents) OVER w AS mean30, CASE WHEN COUNT(cents) OVER w >= 30 THEN STDDEV_SAMP(CAST(cents AS DOUBLE)) OVER w END AS std30, MAX(cents) OVER w AS high30
FROM line_series WINDOW w AS (ORDER BY line_no, shipped, cents, step, l_returnflag ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def long_series_rolling(spark, sf):
    def columns(w) -> dict[str, Column]:
        frame = windows.last_rows(w, 30)
        return {"mean30": F.avg("cents").over(frame), "std30": windows.rolling_std(F.col("cents").cast("double"), w, 30), "high30": F.max("cents").over(frame)}

    return slices.rolling(_cut(spark, sf), ["series_id"], 30, columns, SLICE_ROWS)


@query("long_ranks", "l_returnflag price:i rank:1", """
SELECT DISTINCT l_returnflag, price, RANK() OVER (PARTITION BY l_returnflag ORDER BY price) + (COUNT(*) OVER (PARTITION BY l_returnflag, price) - 1) / 2.0 AS rank
FROM (SELECT l_returnflag, cents // 100 AS price FROM line_series)""")
def long_ranks(spark, sf):
    """Average ranks in three groups that hold all order lines."""
    rows = _line_series(spark, sf).select("l_returnflag", F.floor(F.col("cents") / 100).cast("bigint").alias("price"))
    return slices.value_ranks(rows, ["l_returnflag"], "price")


# Many candidates, large tables, exact tests -------------------------------------------------------------

cte("price_days", "SELECT DISTINCT series_id, date FROM price_panel WHERE volume % 3 <> 1")
cte("gap_chain", """
SELECT series_id, MIN(date) AS date FROM price_days GROUP BY 1 UNION ALL
SELECT series_id, date FROM (SELECT c.series_id, MIN(d.date) AS date FROM gap_chain c JOIN price_days d ON d.series_id = c.series_id AND d.date >= c.date + 9 GROUP BY c.series_id, c.date)""", keep=False)


@query("thinned_days", "series_id date:d", "SELECT * FROM gap_chain")
def thinned_days(spark, sf):
    """Days at least nine apart, greedily, out of most trading days."""
    days = pn.prices(spark, sf).where(F.col("volume") % 3 != 1)
    return windows.min_gap_dates_linked(days, 9, "series_id")


cte("host_table", """
SELECT DISTINCT array_to_string(string_split(domain, '.')[-2:], '.') AS domain, 'parent' AS cred, 2 AS priority FROM articles UNION ALL
SELECT domain, 'listed', 1 FROM (SELECT DISTINCT domain FROM articles WHERE article_id % 3 = 0)""")


@query("domain_class_table", "domain cred articles", """
SELECT a.domain, COALESCE(c.cred, 'unknown') AS cred, COUNT(*) AS articles FROM articles a LEFT JOIN (
  SELECT d.domain, ARG_MIN(t.cred, t.priority * 1000 - LENGTH(t.domain)) AS cred FROM (SELECT DISTINCT domain FROM articles) d
  JOIN host_table t ON d.domain = t.domain OR ENDS_WITH(d.domain, '.' || t.domain) GROUP BY 1) c USING (domain) GROUP BY 1, 2""")
def domain_class_table(spark, sf):
    """Classes from a table that the records themselves fill: listed hosts first, then the domains above them."""
    rows = fx.articles(spark, sf)
    parts = F.split("domain", r"\.")
    parent = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    above = rows.select(parent.alias("domain"), F.lit("parent").alias("cred"), F.lit(2).alias("priority")).distinct()
    listed = rows.where("article_id % 3 = 0").select("domain", F.lit("listed").alias("cred"), F.lit(1).alias("priority")).distinct()
    return joins.classify_by_table(rows, "domain", above.unionByName(listed)).groupBy("domain", "cred").agg(F.count(F.lit(1)).alias("articles"))


# Lattice paths row by row: a running sum over the places that stay below the gap; every row is scaled by n / (n + m).
cte("ks_sizes", """
SELECT series_id, LEAST(n_train, n_test) AS n, GREATEST(n_train, n_test) AS m, CAST(ROUND(ks_stat * n_train * n_test) AS BIGINT) AS gap FROM shift WHERE n_train > 0 AND n_test > 0""")
cte("ks_paths", """
SELECT series_id, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, gap, CAST(0 AS BIGINT) AS i, list_transform(range(0, CAST(m AS BIGINT) + 1), lambda j: CASE WHEN j * n < gap THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM ks_sizes
UNION ALL
SELECT series_id, n, m, gap, i, list(CASE WHEN ABS(i * m - j * n) < gap THEN c ELSE 0.0::DOUBLE END ORDER BY j) FROM (
  SELECT series_id, n, m, gap, i, j, SUM(CASE WHEN ABS(i * m - j * n) < gap THEN x ELSE 0.0::DOUBLE END) OVER (PARTITION BY series_id ORDER BY j) * (CAST(n AS DOUBLE) / (n + m)) AS c FROM (
    SELECT series_id, n, m, gap, i + 1 AS i, UNNEST(a) AS x, UNNEST(range(0, m + 1)) AS j FROM ks_paths WHERE i < n))
GROUP BY series_id, n, m, gap, i""", keep=False)


@query("ks_exact", "series_id n_train:i n_test:i ks_gap:i ks_p_exact:6", """
SELECT s.series_id, s.n_train, s.n_test, p.gap AS ks_gap,
  CASE WHEN p.gap <= 0 OR a[m + 1] <= 0 THEN 1 ELSE LEAST(GREATEST(1 - EXP(LN(a[m + 1]) + n * LN(CAST(n + m AS DOUBLE) / n) - (LGAMMA(n + m + 1) - LGAMMA(n + 1) - LGAMMA(m + 1))), 0), 1) END AS ks_p_exact
FROM shift s JOIN ks_paths p ON p.series_id = s.series_id AND p.i = p.n""")
def ks_exact(spark, sf):
    df = _oos(spark, sf).withColumn("oos_score", F.round("oos_score", 9))
    return vd.with_shift_pvalues(vd.distribution_shift(df, "oos_score", ["series_id"]))
