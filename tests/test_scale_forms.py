"""Forms for data that no single task can hold, against the plain ones."""

import datetime as dt
import glob
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsepanel.functions.pvalues import ks_exact
from pulsepanel.operators import events as ev
from pulsepanel.operators import intervals, joins, slices, windows
from pulsepanel.operators import timeseries as ts
from pulsepanel.operators import validation as vd
from pulsepanel.sources import recordstore as store
from pulsepanel.sources import workdir
from pulsepanel.streaming import daily as st

DAY = dt.date(2020, 1, 1)


def day(i):
    return None if i is None else DAY + dt.timedelta(days=int(i))


# --- day store -----------------------------------------------------------------------------------------------------

RECORDS = "date date, source_url string, record_id string, num_articles int"


def test_only_wanted_days_are_read(spark, tmp_path):
    rows = [(day(i), f"u{i}", str(i), 1) for i in range(60)] + [(day(5), "u5", "5", 1), (None, "x", "none", 1)]
    path = store.land_days(spark.createDataFrame(rows, RECORDS), str(tmp_path / "store"))
    for i in range(20, 60):  # a file that can't be read proves that nobody opens it
        for f in glob.glob(f"{path}/date={day(i)}/*.parquet"):
            os.remove(os.path.join(os.path.dirname(f), "." + os.path.basename(f) + ".crc"))
            open(f, "w").write("broken")
    windows_ = spark.createDataFrame(
        [("s", "p", "E1", day(3), day(6)), ("s", "p", "E2", day(5), day(9)), ("s", "p", "E3", day(50), day(40)), ("s", "p", "E4", None, day(40))],
        "series_id string, preset string, event_id string, window_start date, window_end date")
    held = store.read_records(spark, path, spark.createDataFrame([], RECORDS).schema)
    got = ev.event_articles(held, windows_)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.event_id, r.record_id) for r in got.collect()) == sorted(
        [("E1", str(i)) for i in range(3, 7)] + [("E2", str(i)) for i in range(5, 10)])


def test_landing_again_replaces_days_only(spark, tmp_path):
    path, schema = str(tmp_path / "store"), spark.createDataFrame([], RECORDS).schema
    assert store.read_records(spark, path, schema).collect() == []
    store.land_days(spark.createDataFrame([(day(1), "a", "1", 1), (day(2), "b", "2", 1)], RECORDS), path)
    store.land_days(spark.createDataFrame([(day(2), "c", "3", 1), (day(4), "d", "4", 1)], RECORDS), path)
    held = store.read_records(spark, path, schema)
    assert sorted(r.record_id for r in held.collect()) == ["1", "3", "4"]
    assert sorted(r.date for r in store.days_to_fetch(spark, held, "2020-01-01", "2020-01-06").collect()) == [day(i) for i in (0, 3, 5)]


def test_bucketed_stage_is_read_without_exchange(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 5}", day(i), float(i)) for i in range(200)], "series_id string, date date, x double")
    held = workdir.stage(spark, str(tmp_path), "bucketed", lambda: rows, ("series_id", "date"))
    w = Window.partitionBy("series_id").orderBy("date")
    ranked = held.withColumn("lag", F.lag("x").over(w)).join(held.groupBy("series_id").agg(F.sum("x").alias("all")).hint("merge"), "series_id")
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 200 and workdir.remove_stages(spark) >= 1


# --- intervals -----------------------------------------------------------------------------------------------------


def test_interval_join_equals_between(spark):
    rng = np.random.default_rng(1)
    wins = [("a" if i % 3 else "b", i, day(s), day(s + int(n))) for i, (s, n) in enumerate(zip(rng.integers(-3000, 3000, 80), rng.choice([0, 1, 2, 3, 7, 8, 64, 365, 4000], 80)))]
    wins += [("a", 90, day(5), day(4)), ("a", 91, None, day(4)), ("a", 92, day(1), None), (None, 93, day(0), day(10)), ("a", 0, wins[0][2], wins[0][3])]
    pts = [(k, day(d), int(d)) for k in ("a", "b", None) for d in range(-400, 800, 3)] + [("a", None, 0)]
    w = spark.createDataFrame(wins, "series_id string, n int, window_start date, window_end date")
    p = spark.createDataFrame(pts, "series_id string, date date, x int")
    want = sorted((k, n, d) for k, n, a, b in wins if a and b and k for kk, d, _ in pts if kk == k and d and a <= d <= b)
    for join in (intervals.interval_join, intervals.windows_join):
        assert sorted((r.series_id, r.n, r.date) for r in join(w, p, ["series_id"]).collect()) == want
    short = w.where(F.datediff("window_end", "window_start") < 9)
    days = intervals.windows_join(short, p, ["series_id"])
    assert sorted((r.n, r.date) for r in days.collect()) == sorted((r.n, r.date) for r in intervals.interval_join(short, p, ["series_id"]).collect())
    assert intervals.windows_join(w.limit(0), p, ["series_id"]).collect() == []


# --- slices --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_series(spark):
    rng = np.random.default_rng(4)
    rows = [("one", int(i), None if rng.random() < 0.7 else int(rng.integers(0, 9)), int(rng.integers(-5, 6))) for i in rng.permutation(3000)]
    rows += [("two", int(i), None, 1) for i in range(40)] + [(None, int(i), i if i % 2 else None, -1) for i in range(50)]
    return spark.createDataFrame(rows, "series_id string, at int, x int, step int").repartition(4).cache()


def test_slices_equal_plain_windows(spark, long_series):
    cut = slices.numbered(long_series, ["series_id"], "at", rows=64, ranges=16)
    assert cut.groupBy("series_id", slices.SLICE).count().agg(F.max("count")).first()[0] <= 64
    w = Window.partitionBy("series_id").orderBy("at")
    frame = windows.running(w)
    plain = long_series.select(
        "series_id", "at", F.row_number().over(w).alias("place"), F.last("x", ignorenulls=True).over(frame).alias("x"),
        F.sum("step").over(frame).alias("cum"), F.avg("step").over(windows.last_rows(w, 9)).alias("mean"))
    plain = plain.withColumn("peak", F.max("cum").over(frame)).withColumn("drawdown", F.col("cum") - F.col("peak"))
    want = {(r.series_id, r["at"]): r.asDict() for r in plain.collect()}

    def check(df, **names):
        rows = df.collect()
        assert len(rows) == len(want)
        for r in rows:
            for name, other in names.items():
                assert r[name] == want[r.series_id, r["at"]][other], (name, r)

    check(slices.forward_fill(cut, ["x"], ["series_id"]), x="x", __rn="place")
    check(slices.with_drawdown(cut, "step", ["series_id"]), cum="cum", peak="peak", drawdown="drawdown")
    check(slices.rolling(cut, ["series_id"], 9, lambda s: {"mean": F.avg("step").over(windows.last_rows(s, 9))}, rows=64), mean="mean")
    with pytest.raises(ValueError):
        slices.rolling(cut, ["series_id"], 100, lambda s: {}, rows=64)


def test_rows_are_numbered_where_they_lie(spark, long_series, monkeypatch):
    """A file of the written rows is one stretch of a series: rows are sorted once, by ranges, and get their numbers there."""
    tables = {}
    monkeypatch.setattr(slices, "kept_table", lambda df, name: tables.setdefault(name, workdir.kept_table(df, name)))
    cut = slices.numbered(long_series, ["series_id"], "at", rows=64, ranges=16)
    files = tables["ranges"].where("series_id = 'one'").groupBy(F.input_file_name()).agg(F.count("at").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    stretches = files.collect()
    assert len(stretches) > 8 and all(r.b - r.a + 1 == r.n for r in stretches)
    filled = slices.forward_fill(cut, ["x"], ["series_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in filled  # what slices carry is a written table of known size


def test_ranks_equal_plain_ranks(spark):
    rng = np.random.default_rng(8)
    rows = [("g", float(x)) for x in rng.integers(0, 50, 2000)] + [("h", 1.0)] * 700 + [("h", 2.0), (None, 3.0), (None, 3.0), ("g", None)]
    df = spark.createDataFrame(rows, "series_id string, x double")
    want = {(r.series_id, r.x): r.rank for r in df.where("x IS NOT NULL").withColumn("rank", windows.average_rank("x", "series_id")).collect()}
    assert {(r.series_id, r.x): r["rank"] for r in slices.value_ranks(df, ["series_id"], "x").collect()} == want


# --- exact tests, thinning, classes ---------------------------------------------------------------------------------


def slow_ks(gap, n, m):
    """Share of all orders of n and m values whose statistic reaches the gap."""
    hit = total = 0
    for first in itertools.combinations(range(n + m), n):
        chosen, i, j, worst = set(first), 0, 0, 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        hit, total = hit + (worst >= gap), total + 1
    return hit / total


@pytest.mark.parametrize("n, m", [(1, 1), (3, 4), (5, 5), (2, 9), (6, 7)])
def test_exact_ks_counts_all_orders(n, m):
    for gap in range(0, n * m + 1):
        assert ks_exact(gap, n, m) == pytest.approx(slow_ks(gap, n, m), abs=1e-12) and ks_exact(gap, m, n) == ks_exact(gap, n, m)


def test_exact_ks_of_large_samples(spark):
    assert ks_exact(int(0.05 * 2000 * 2000), 2000, 2000) == pytest.approx(0.013, abs=0.003)
    assert 0 <= ks_exact(10_000 * 9_999, 10_000, 9_999) < 1e-9
    rows = [("s", "TRAIN", float(i)) for i in range(30)] + [("s", "TEST", float(i) + 8.5) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, split string, x double")
    r = vd.with_shift_pvalues(vd.distribution_shift(df, "x", ["series_id"])).first()
    assert r.ks_p_exact == pytest.approx(ks_exact(r.ks_gap, 30, 40)) and r.ks_gap == round(r.ks_stat * 1200) and 0 < r.ks_p_exact < 1


def test_linked_thinning_equals_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", day(d), 5 + k) for k in range(4) for d in rng.integers(0, 900, 250)] + [("lone", day(1), 30), (None, day(1), 2), (None, day(2), 2)]
    df = spark.createDataFrame(rows, "series_id string, date date, gap int")
    linked = windows.min_gap_dates_linked(df, F.col("gap"), "series_id")
    fold = windows.min_gap_dates(df, F.col("gap"), "series_id")
    assert sorted(map(str, linked.collect())) == sorted(map(str, fold.collect()))
    assert windows.min_gap_dates_linked(df.limit(0), 3, "series_id").collect() == []


def test_domain_table(spark):
    table = [("bad.com", "low_cred", 1), ("news.bad.com", "trusted", 2), ("good.org", "trusted", 2), ("org", "other", 3), ("a.good.org", "special", 2)]
    classes = spark.createDataFrame(table, "domain string, cred string, priority int")
    names = ["bad.com", "x.news.bad.com", "notbad.com", "good.org", "WWW.Good.org", "b.a.good.org", "z.org", "", None, "good.org", "com"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "domain string, i int")
    got = {r.i: r.cred for r in joins.classify_by_table(df, "domain", classes).collect()}
    want = ["low_cred", "low_cred", "unknown", "trusted", "trusted", "special", "other", "unknown", "unknown", "trusted", "unknown"]
    assert got == dict(enumerate(want))
    many = spark.range(100_000).select(F.concat(F.lit("d"), "id", F.lit(".net")).alias("domain"), F.lit("bulk").alias("cred"), F.lit(1).alias("priority"))
    assert joins.classify_by_table(spark.createDataFrame([("w.d77.net",)], "domain string"), "domain", many).first().cred == "bulk"


def test_untested_variables_cost_johansen_no_rows(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=300).cumsum()
    rows = [("s", day(i), float(a[i]), float(a[i] + rng.normal()), None if i % 2 else float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double, c double")
    orders = spark.createDataFrame([("s", "a", True), ("s", "b", True), ("s", "c", False)], "series_id string, variable string, is_i1 boolean")
    got = ts.johansen(df, ["series_id"], ["a", "b", "c"], orders=orders).first()
    alone = ts.johansen(df, ["series_id"], ["a", "b"]).first()
    assert got.n_obs == 300 and got.rank == alone.rank and got.variables == ["a", "b"]
    assert np.allclose(got.trace, alone.trace, rtol=1e-6)


def test_once_only_over_runs(spark, tmp_path):
    """An empty first run, repeats across runs and within one, and NULL in a key."""
    schema, src, out, ck = "id int, who string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    assert st.read_once_only(spark, out, spark.createDataFrame([], schema).schema).collect() == []
    for rows in ([], [(1, "a"), (None, "a"), (1, "a")], [(None, "a"), (1, None), (2, "b"), (1, "a")], [(1, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        st.run_once_only(spark.readStream.schema(schema).parquet(src), out, ck, ["id", "who"])
    got = st.read_once_only(spark, out, spark.createDataFrame([], schema).schema).collect()
    assert sorted(map(str, got)) == sorted(f"Row(id={i}, who={w!r})" for i, w in [(1, "a"), (None, "a"), (1, None), (2, "b")])
