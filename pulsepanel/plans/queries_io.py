"""Queries that write files in the source formats and read them back, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsepanel.operators import joins as jn
from pulsepanel.plans import fixtures as fx
from pulsepanel.plans import panels as pn
from pulsepanel.plans.oracle import cte
from pulsepanel.plans.queries_events import event_articles
from pulsepanel.plans.queries_index import _score_sql
from pulsepanel.plans.registry import query
from pulsepanel.sources import market as mk
from pulsepanel.sources import news as ns
from pulsepanel.sources import sinks as sk
from pulsepanel.sources.workdir import fresh_path
from pulsepanel.streaming import daily as st

# Files -------------------------------------------------------------------------------

cte("market_days", "SELECT date, SUM(mcap) AS mcap, SUM(volume) AS volume FROM price_panel GROUP BY 1")
MONEY = "CAST(FLOOR({x}) AS BIGINT)"


def market_days(spark, sf):
    """One row per day over all series, money in whole cents."""
    p = fx.price_panel(spark, sf)
    return p.groupBy("date").agg((F.sum(fx.cents("mcap")) / 100.0).alias("mcap"), F.sum("volume").alias("volume"))


def _money(c: str):
    """Two decimals with thousands separators, as market files print them."""
    return F.format_number(F.col(c), 2)


@query("file_price_csv", "date:d asset_price:2 asset_mcap:2 asset_volume:0", """
SELECT date, mcap AS asset_price, CASE WHEN DAY(date) <> 13 THEN mcap END AS asset_mcap, volume AS asset_volume FROM market_days""")
def file_price_csv(spark, sf):
    d = market_days(spark, sf)
    text = d.select(
        F.concat(F.col("date").cast("string"), F.lit(" 00:00:00 UTC")).alias("snapped_at"), _money("mcap").alias("price"),
        F.when(F.dayofmonth("date") == 13, "null").otherwise(_money("mcap")).alias("market_cap"), F.col("volume").cast("string").alias("total_volume"))
    return mk.read_price_csv(spark, sk.write_csv(text, fresh_path(spark, "price")), "asset")


@query("file_macro_csv", "date:d control:4", "SELECT date, CASE WHEN ISODOW(date) < 6 THEN volume END AS control FROM market_days")
def file_macro_csv(spark, sf):
    d = market_days(spark, sf)
    text = d.select(
        F.col("date").cast("string").alias("observation_date"),
        F.when(F.weekday("date") < 5, F.col("volume").cast("string")).otherwise(".").alias("SERIES"))
    return mk.read_macro_csv(spark, sk.write_csv(text, fresh_path(spark, "macro")), "SERIES", "control")


@query("file_futures_csv", "date:d gold_close:2 gold_volume:0 gold_chg_pct:2", """
SELECT date, mcap AS gold_close, volume * 1000 AS gold_volume, CASE WHEN volume % 2 = 0 THEN -volume / 4.0 ELSE volume / 4.0 END AS gold_chg_pct FROM market_days""")
def file_futures_csv(spark, sf):
    d = market_days(spark, sf)
    sign = F.when(F.col("volume") % 2 == 0, F.lit("-")).otherwise(F.lit(""))
    text = d.select(
        F.date_format("date", "MM/dd/yyyy").alias("Date"), _money("mcap").alias("Price"), F.concat(F.col("volume").cast("string"), F.lit("K")).alias("Vol."),
        F.concat(sign, (F.col("volume") / 4.0).cast("string"), F.lit("%")).alias("Change %"))
    return mk.read_futures_csv(spark, sk.write_csv(text, fresh_path(spark, "futures")))


@query("file_media_signal", "preset date:d mentions:2 tone:6 source_count:2", """
SELECT preset, date, mentions, CASE WHEN mentions % 5 <> 0 THEN tone END AS tone, CASE WHEN preset = 'balanced' THEN mentions END AS source_count FROM media_signal""")
def file_media_signal(spark, sf):
    names = {"balanced": ("date", "mentions", "tone"), "strong": ("data", "liczba_wzmianek", "sredni_tone"), "sensitive": ("Day", "mention count", "avg-tone")}
    paths, signal = {}, pn.signals(spark, sf)
    for p, (d, m, t) in names.items():
        s = signal.filter(F.col("preset") == p)
        cols = [F.col("date").cast("string").alias(d), F.col("mentions").alias(m), F.when(F.col("mentions") % 5 != 0, F.col("tone").cast("string")).otherwise("nan").alias(t)]
        if p == "balanced":
            cols.append(F.col("mentions").alias("sources"))
        paths[p] = sk.write_csv(s.select(*cols), fresh_path(spark, f"signal_{p}"))
    return ns.read_media_signal(spark, paths, source_count=True)


@query("file_benchmark_feed", "date:d bench_value:i bench_norm:4 bench_label", """
SELECT date, bench_value, bench_value / 100.0 AS bench_norm, 'L' || CAST(bench_value % 5 AS VARCHAR) AS bench_label FROM bench""")
def file_benchmark_feed(spark, sf):
    """One JSON document with one record per calendar day."""
    b = fx.benchmark(spark, sf)
    rec = F.struct(
        F.unix_timestamp(F.col("date").cast("timestamp")).cast("string").alias("timestamp"), F.col("bench_value").cast("string").alias("value"),
        F.concat(F.lit("L"), (F.col("bench_value") % 5).cast("string")).alias("value_classification"))
    doc = b.agg(F.sort_array(F.collect_list(rec)).alias("data"))
    return ns.read_benchmark_feed(spark, sk.write_jsonl(doc, fresh_path(spark, "feed")))


@query("file_articles_jsonl", "series_id preset event_id record_id date source_url num_articles:0 avg_tone:1 window_key", """
SELECT series_id, preset, event_id, record_id, CAST(date AS VARCHAR) AS date, source_url, num_articles, avg_tone, window_key FROM event_articles""")
def file_articles_jsonl(spark, sf):
    """Lines as they land: original names, whole numbers as 5.0 or as text."""
    rows = event_articles(spark, sf)
    odd = F.crc32(F.col("record_id").cast("binary")) % 2 == 0
    names = {"record_id": "gdelt_globaleventid", "date": "data", "source_url": "url", "source_domain": "domain", "preset": "okno_preset",
             "window_start": "okno_start", "window_end": "okno_koniec", "window_key": "okno_key"}
    lines = rows.withColumn("num_articles", F.when(odd, F.col("num_articles").cast("double").cast("string")).otherwise(F.col("num_articles").cast("string")))
    path = sk.write_jsonl(lines.withColumnsRenamed(names), fresh_path(spark, "articles"))
    return ns.read_articles_jsonl(spark, path)


@query("file_panel_parquet", "series_id date:d price:6 mcap:2", "SELECT * FROM price_panel")
def file_panel_parquet(spark, sf):
    path = sk.write_parquet(fx.price_panel(spark, sf).withColumnRenamed("date", "data"), fresh_path(spark, "panel.parquet"))
    return mk.read_panel(spark, path, keys=("series_id", "date"))


@query("file_panel_fallback", "series_id date:d price:6 volume:0", "SELECT * FROM price_panel")
def file_panel_fallback(spark, sf):
    """No columnar table under the first path, so the CSV is read; of two rows for a day the first stays."""
    panel = fx.price_panel(spark, sf)
    twice = panel.withColumn("place", F.lit(0)).union(panel.withColumn("price", F.col("price") / 2).withColumn("place", F.lit(1)))
    csv = sk.write_csv(twice.coalesce(1).sortWithinPartitions("place").drop("place"), fresh_path(spark, "panel_csv"))
    df = mk.read_panel(spark, fresh_path(spark, "absent.parquet"), csv, keys=("series_id", "date"))
    return df.select("series_id", "date", F.col("price").try_cast("double").alias("price"), F.col("volume").try_cast("double").alias("volume"))


@query("file_sorted_panel", "file_no:i series_id date:d", """
SELECT 0 AS file_no, series_id, date FROM price_panel""")
def file_sorted_panel(spark, sf):
    """Rows that come before a row of an earlier file or of their own file would have file_no 1; there are none."""
    path = sk.write_sorted(fx.price_panel(spark, sf).select("series_id", "date"), fresh_path(spark, "sorted"), ["date", "series_id"], 4)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    span = rows.groupBy("file").agg(F.min(F.struct("date", "series_id")).alias("lo"), F.max(F.struct("date", "series_id")).alias("hi"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    late = span.select("file", F.max("hi").over(earlier).alias("reached"))
    return rows.join(late, "file", "left").select(
        F.coalesce((F.struct("date", "series_id") <= F.col("reached")).cast("int"), F.lit(0)).alias("file_no"), "series_id", "date")


@query("file_signal_partitioned", "preset n mentions_total", "SELECT preset, COUNT(*) AS n, CAST(SUM(mentions) AS BIGINT) AS mentions_total FROM media_signal GROUP BY 1")
def file_signal_partitioned(spark, sf):
    path = sk.write_parquet(fx.media_signal(spark, sf), fresh_path(spark, "signals"), "preset")
    return spark.read.parquet(path).groupBy("preset").agg(F.count(F.lit(1)).alias("n"), F.sum("mentions").alias("mentions_total"))


@query("file_json_summary", "preset n_events", "SELECT preset, COUNT(*) AS n_events FROM peaks GROUP BY 1")
def file_json_summary(spark, sf):
    counts = pn.peaks(spark, sf).groupBy("preset").agg(F.count(F.lit(1)).alias("n_events"))
    path = sk.write_jsonl(sk.json_summary(counts), fresh_path(spark, "summary"))
    back = spark.read.schema("summary array<struct<preset:string, n_events:bigint>>").json(path)
    return back.select(F.explode("summary").alias("s")).select("s.*")


@query("signal_keep_last", "date:d mentions tone:6", """
SELECT date, COALESCE(s.mentions, w.mentions) AS mentions, CASE WHEN s.date IS NOT NULL THEN s.tone ELSE w.tone END AS tone
FROM (SELECT * FROM media_signal WHERE preset = 'sensitive') w FULL JOIN (SELECT * FROM media_signal WHERE preset = 'strong') s USING (date)""")
def signal_keep_last(spark, sf):
    """A later batch replaces the days it brings."""
    path = fresh_path(spark, "days")
    for batch, preset in enumerate(("sensitive", "strong")):
        days = pn.signals(spark, sf).filter(F.col("preset") == preset).drop("preset")
        sk.append_days(days, path, batch)
    return spark.read.parquet(sk.compact(spark, path, fresh_path(spark, "compacted"), ["date"]))


@query("signal_resume", "date:d", """
SELECT DISTINCT date FROM (SELECT date FROM media_signal WHERE preset = 'sensitive') WHERE date NOT IN (SELECT date FROM media_signal WHERE preset = 'strong')""")
def signal_resume(spark, sf):
    """Days still to do: held by the wide preset, missing from the narrow one."""
    s = pn.signals(spark, sf)
    wanted = s.filter(F.col("preset") == "sensitive").select("date")
    return jn.missing_days(wanted, s.filter(F.col("preset") == "strong"))


# Streams -----------------------------------------------------------------------------------

cte("stream_days", """
SELECT CAST(ts AS DATE) AS date, COUNT(*) FILTER (WHERE matched) AS mentions, AVG(tone) FILTER (WHERE matched) AS tone FROM stream_records GROUP BY 1""")


def _stream_days(spark, sf):
    stream = fx.stream_records(fx.read_event_stream(spark, sf))
    path, ckpt = fresh_path(spark, "stream_days"), fresh_path(spark, "ckpt")
    st.run_daily(stream, path, ckpt)
    return st.read_days(spark, path)


@query("stream_daily_signal", "date:d mentions tone:5", "SELECT * FROM stream_days")
def stream_daily_signal(spark, sf):
    return _stream_days(spark, sf)


@query("stream_backfill", "date:d mentions tone:5", "SELECT * FROM stream_days")
def stream_backfill(spark, sf):
    """Three runs on one checkpoint: the middle days, then older ones, then the latest; compacted after two."""
    events = fx.table(spark, sf, "events")
    day = F.dayofmonth("ts")
    landing, path, ckpt = (fresh_path(spark, n) for n in ("landing", "backfill", "ckpt"))
    for i, part in enumerate((day.between(11, 20), day <= 10, day > 20)):
        events.where(part).write.parquet(f"{landing}/run={i}")
        stream = spark.readStream.schema(events.schema).parquet(f"{landing}/run=*")
        st.run_daily(fx.stream_records(stream), path, ckpt)
    done = sk.compact_sums(spark, path, fresh_path(spark, "backfill_compacted"), ["date"], st.SUMS)
    return st.read_days(spark, done)


@query("stream_dedupe", "date:d records sources", """
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS records, COUNT(DISTINCT source) AS sources FROM (SELECT DISTINCT event_id, ts, source FROM stream_records) GROUP BY 1""")
def stream_dedupe(spark, sf):
    """The source is read twice in one stream; every record comes out once."""
    a, b = (fx.stream_records(fx.read_event_stream(spark, sf)) for _ in range(2))
    path = fresh_path(spark, "stream_once")
    st.run_once_only(a.unionByName(b), path, fresh_path(spark, "ckpt"), ["event_id"])
    return st.read_once_only(spark, path, a.schema).groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("source").alias("sources"))


@query("stream_once_runs", "date:d source records", """
SELECT CAST(ts AS DATE) AS date, source, COUNT(*) AS records FROM (
  SELECT DISTINCT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS record_id, source, CAST(ts AS DATE) AS ts FROM stream_records)
GROUP BY 1, 2""")
def stream_once_runs(spark, sf):
    """Three runs over a landing folder: nothing yet, a first part, then all of it again; a fifth of the records have no id."""
    records = fx.stream_records(fx.table(spark, sf, "events")).select(
        F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("record_id"), "source", F.to_date("ts").alias("day"), "matched")
    landing, path, checkpoint = (fresh_path(spark, n) for n in ("landing", "stream_once", "ckpt"))
    for part in (records.where("false"), records.where("record_id % 3 = 0 OR record_id IS NULL"), records):
        part.write.mode("append").parquet(landing)
        st.run_once_only(spark.readStream.schema(records.schema).parquet(landing), path, checkpoint, ["record_id", "source", "day"])
    once = st.read_once_only(spark, path, records.schema)
    return once.groupBy(F.col("day").alias("date"), "source").agg(F.count(F.lit(1)).alias("records"))


@query("stream_upsert", "date:d source mentions tone:5", """
SELECT CAST(ts AS DATE) AS date, source, COUNT(*) FILTER (WHERE matched) AS mentions, AVG(tone) FILTER (WHERE matched) AS tone FROM stream_records GROUP BY 1, 2""")
def stream_upsert(spark, sf):
    stream = fx.stream_records(fx.read_event_stream(spark, sf))
    path = fresh_path(spark, "stream_upsert")
    st.run_daily(stream, path, fresh_path(spark, "ckpt"), "source")
    return st.read_days(spark, path, "source")


@query("stream_index", "date:d score:6 zone", _score_sql("stream_days", "312.4", "274.1", "(-0.8834)", "0.6912").replace(
    "SELECT *, ", "SELECT *, CASE WHEN score < 0.47 THEN 'MINIMAL' WHEN score < 0.53 THEN 'BASELINE' WHEN score < 0.59 THEN 'ELEVATED' WHEN score < 0.65 THEN 'HIGH' ELSE 'EXTREME' END AS zone FROM (SELECT *, ", 1) + ")")
def stream_index(spark, sf):
    return st.live_index(_stream_days(spark, sf))
