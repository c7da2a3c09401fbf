import datetime as dt
import os
import glob
import json

import pytest
from pyspark.sql import functions as F

from pulsepanel.operators.aggregates import daily_plain, daily_signal_of_files, daily_weighted
from pulsepanel.operators.timeseries import primary_preset
from pulsepanel.sources import market as mk
from pulsepanel.sources import news as ns
from pulsepanel.sources import sinks as sk
from pulsepanel.sources.workdir import fresh_path, shared_dir, stage
from pulsepanel.streaming import daily as st


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_price_file(spark, tmp_path):
    p = put(tmp_path / "p.csv", 'snapped_at,price,market_cap,total_volume\n2020-01-02 00:00:00 UTC,"1,000.5",5,nan\n2020-01-01 00:00:00 UTC,1,2,3\n'
            "2020-01-02 00:00:00 UTC,9,9,9\nbad,1,1,1\n")
    got = mk.read_price_csv(spark, p, "btc").orderBy("date").collect()
    assert [tuple(r) for r in got] == [(dt.date(2020, 1, 1), 1.0, 2.0, 3.0), (dt.date(2020, 1, 2), 1000.5, 5.0, None)]
    with pytest.raises(ValueError, match="total_volume"):
        mk.read_price_csv(spark, put(tmp_path / "q.csv", "snapped_at,price,market_cap\n2020-01-01,1,2\n"), "btc")


def test_macro_file(spark, tmp_path):
    p = put(tmp_path / "m.csv", "observation_date,DXY\n2020-01-01,.\n2020-01-02,101.5\n")
    assert [r.dxy for r in mk.read_macro_csv(spark, p, "DXY", "dxy").orderBy("date").collect()] == [None, 101.5]


@pytest.mark.parametrize("dates,want", [
    (["01/02/2020", "12/31/2020"], [(2020, 1, 2), (2020, 12, 31)]), (["02.01.2020", "31.12.2020"], [(2020, 1, 2), (2020, 12, 31)]),
    (["2020-01-02", "2020-12-31"], [(2020, 1, 2), (2020, 12, 31)]), (["02/01/2020", "31/12/2020"], [(2020, 1, 2), (2020, 12, 31)])])
def test_futures_file_votes_on_its_date_format(spark, tmp_path, dates, want):
    rows = "".join(f'"{d}","1,500.25","146.84K","-1.5%"\n' for d in dates)
    p = put(tmp_path / "f.csv", '" Date ","Price","Vol.","Change %"\n' + rows)
    got = mk.read_futures_csv(spark, p).orderBy("date").collect()
    assert [r.date for r in got] == [dt.date(*w) for w in want]
    assert got[0].gold_close == 1500.25 and got[0].gold_volume == pytest.approx(146840.0) and got[0].gold_chg_pct == -1.5


def test_panel_falls_back_to_csv(spark, tmp_path):
    csv = put(tmp_path / "c.csv", "Data,Value X\n2020-01-01 00:00,1\n2020-01-01,2\n")
    got = mk.read_panel(spark, str(tmp_path / "none.parquet"), csv).collect()
    assert len(got) == 1 and got[0].date == dt.date(2020, 1, 1) and "value_x" in got[0]


def test_media_signal_aliases_and_duplicates(spark, tmp_path):
    a = put(tmp_path / "a.csv", "data,liczba_wzmianek,sredni_tone\n2020-01-01,4,-1\n2020-01-01,8,nan\n,1,1\n")
    b = put(tmp_path / "b.csv", "date,mentions\n2020-01-01,3\n")
    got = {r.preset: (r.mentions, r.tone) for r in ns.read_media_signal(spark, {"x": a, "y": b}).collect()}
    assert got == {"x": (6.0, -1.0), "y": (3.0, None)}
    with pytest.raises(ValueError):
        ns.read_media_signal(spark, {"x": put(tmp_path / "n.csv", "a,b\n1,2\n")})


def gkg(day, text, theme="", tone="-1.5,0", width=27):
    f = [""] * width
    f[0], f[1], f[7], f[9], f[15] = "r", day + "000000", theme, text, tone
    return "\t".join(f)


def test_gkg_scan_two_stage(spark, tmp_path):
    put(tmp_path / "g" / "20240101000000.gkg.csv", "\n".join([gkg("20240101", "about BITCOIN", tone="2,1"), gkg("20240101", "bitcoin", tone="bad"), "", gkg("20240101", "else")]))
    put(tmp_path / "g" / "20240101001500.gkg.csv", gkg("20240101", "none", theme="TAX;WEB_BITCOIN", tone="5") + "\n" + "short\trow\n")
    put(tmp_path / "g" / "20240102000000.gkg.csv", gkg("20240102", "nothing"))
    rec = ns.scan_gkg(spark, str(tmp_path / "g"), {"p": ["bitcoin"], "q": ["nope"]}, {"p": ["WEB_BITCOIN"], "q": ["NOPE"]})
    got = {(r.preset, r.date.day): (r.mentions, r.tone) for r in daily_signal_of_files(rec, "preset").collect()}
    # File one: 2 matches, mean tone 2; file two: 1 match, tone 5.
    assert got == {("p", 1): (3, 3.0), ("p", 2): (0, None), ("q", 1): (0, None), ("q", 2): (0, None)}
    plain = {(r.preset, r.date.day): r.tone for r in daily_signal_of_files(rec, "preset", row_mean=True).collect()}
    assert plain[("p", 1)] == 3.5


def test_news_formats(spark, tmp_path):
    assert ns.resolve_news_format("20240101.gkg.csv") == "gkg" and ns.resolve_news_format("a.EXPORT.CSV") == "events"
    assert ns.resolve_news_format("x", 61) == "events" and ns.resolve_news_format("x", 27) == "gkg"
    with pytest.raises(ValueError):
        ns.resolve_news_format("x", 5)
    assert len(ns.EVENT_COLUMNS) == 58 and ns.EVENT_COLUMNS[ns.EVENT_INDEX["avg_tone"]] == "AvgTone" and ns.EVENT_COLUMNS[57] == "SOURCEURL"
    put(tmp_path / "mix" / "a.txt", gkg("20240101", "x") + "\n" + "\t".join(["1"] * 58) + "\n" + "a\tb\n")
    got = {r["format"]: r["count"] for r in ns.read_news_lines(spark, str(tmp_path / "mix")).groupBy("format").count().collect()}
    assert got == {"gkg": 1, "events": 1, None: 1}


def event_row(**kw):
    f = [""] * 58
    for k, v in kw.items():
        f[ns.EVENT_INDEX.get(k) if k in ns.EVENT_INDEX else ns.EVENT_COLUMNS.index(k)] = v
    return "\t".join(f)


def test_event_scan_and_daily(spark, tmp_path):
    url = "https://www.x.com/bitcoin-news"
    p = put(tmp_path / "e.export.csv", "\n".join([
        event_row(record_id="1", sql_date="20240101", num_mentions="3", avg_tone="-2.5", source_url=url),
        event_row(record_id="2", sql_date="20240101", num_mentions="", avg_tone="", source_url=url + "2"),
        event_row(record_id="3", sql_date="notadate", source_url=url), event_row(record_id="4", sql_date="20240101", source_url="https://x.com/plain"),
        event_row(record_id="5", sql_date="20240102", num_mentions="2", avg_tone="1", Actor1Name="Satoshi club", source_url="https://y.com"), "short\trow"]))
    rec = ns.scan_news_events(spark, p).orderBy("record_id").collect()
    assert [(r.record_id, r.num_mentions, r.avg_tone, r.source_domain) for r in rec] == [("1", 3, -2.5, "www.x.com"), ("2", None, None, "www.x.com")]
    raw = ns.match_events_topic(ns.read_events_tab(spark, p))
    got = {r.date.day: (r.mentions, r.tone, r.n_articles) for r in daily_weighted(ns.events_daily_input(raw)).collect()}
    assert got == {1: (4.0, -2.5, 2), 2: (2.0, 1.0, 1)}


def test_gkg_frame_daily(spark, tmp_path):
    row = gkg("20240101", "x", theme="CRYPTO").split("\t")
    row[11] = "4.5,1"
    put(tmp_path / "gkg" / "a.gkg.csv", "\t".join(row) + "\n" + gkg("20240101", "y") + "\n")
    frame = ns.gkg_frame(ns.read_news_lines(spark, str(tmp_path / "gkg")))
    assert [(r.mentions, r.tone) for r in daily_plain(ns.match_gkg_topic(frame)).collect()] == [(1, 4.5)]


def test_articles_skip_bad_lines(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", json.dumps({"event_id": "e", "num_articles": 3, "avg_tone": -1.0, "more": 1}) + "\n\n{broken\n")
    rows = ns.read_articles_jsonl(spark, p).collect()
    assert [(r.event_id, r.num_articles, r.avg_tone) for r in rows if r.event_id] == [("e", 3, -1.0)] and len(rows) == 1


def test_benchmark_feed_keeps_last_record_of_a_day(spark, tmp_path):
    rec = [{"timestamp": "1577836800", "value": "40", "value_classification": "Fear"}, {"timestamp": "1577840400", "value": "60"},
           {"timestamp": "x", "value": "1"}, {"timestamp": "1577923200", "value": "100", "value_classification": "Greed"}]
    p = put(tmp_path / "f.json", json.dumps({"data": rec}, indent=1))
    got = [(r.date.day, r.bench_value, r.bench_norm, r.bench_label) for r in ns.read_benchmark_feed(spark, p).orderBy("date").collect()]
    assert got == [(1, 60, 0.6, ""), (2, 100, 1.0, "Greed")]


def test_sinks_and_keep_last(spark, tmp_path):
    mk_df = lambda rows: spark.createDataFrame(rows, "date date, mentions int")
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    path = str(tmp_path / "days")
    sk.append_days(mk_df([(d1, 1), (d2, 2)]), path, 0)
    sk.append_days(mk_df([(d2, 99)]), path, 1)
    sk.append_days(mk_df([(d2, 5)]), path, 1)  # the same batch again replaces itself
    out = sk.compact(spark, path, str(tmp_path / "out"), ["date"])
    assert {(r.date, r.mentions) for r in spark.read.parquet(out).collect()} == {(d1, 1), (d2, 5)}
    back = spark.read.csv(sk.write_csv(mk_df([(d1, 1)]), str(tmp_path / "csv")), header=True)
    assert back.columns == ["date", "mentions"]
    js = sk.write_jsonl(sk.json_summary(mk_df([(d1, 1), (d2, 2)])), str(tmp_path / "json"))
    assert len(spark.read.json(js).first()["summary"]) == 2


def test_primary_preset_prefers_order_then_coverage(spark):
    df = spark.createDataFrame([("strong", 1), ("strong", 2), ("balanced", None)], "preset string, mentions int")
    assert {r.preset for r in primary_preset(df, ["balanced", "strong"]).collect()} == {"strong"}
    with pytest.raises(ValueError):
        primary_preset(df, ["balanced"], 1)
    assert ns.preset_of_path("/a/events_peaks_Strong.csv") == "strong" and ns.preset_of_path("/a/other.csv") == "other"


def test_stage_writes_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    a = stage(spark, "src", "unit-test", build)
    b = stage(spark, "src", "unit-test", build)
    assert a.count() == b.count() == 3 and len(calls) == 1
    assert fresh_path(spark, "x").startswith(shared_dir(spark))


def stream_rows(spark, path, rows, name):
    spark.createDataFrame(rows, "ts timestamp, id int, tone double, matched boolean").coalesce(1).write.parquet(f"{path}/{name}")


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    first = [(base + dt.timedelta(hours=6 * i), i, float(i), i % 3 > 0) for i in range(12)]
    late = [(base + dt.timedelta(hours=60), 50, 7.0, True), (base + dt.timedelta(hours=80), 51, 1.0, True), (base + dt.timedelta(hours=80), 51, 1.0, True)]
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "ts timestamp, id int, tone double, matched boolean"

    def run():
        s = spark.readStream.schema(schema).parquet(src + "/*")
        st.run_daily(s, out, ck)

    stream_rows(spark, src, first, "a")
    run()
    stream_rows(spark, src, late, "b")
    run()
    run()  # nothing new: nothing changes
    got = {r.date: (r.mentions, round(r.tone, 9)) for r in st.read_days(spark, out).collect()}
    want = spark.createDataFrame(first + late, schema).filter("matched").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.avg("tone").alias("t"))
    assert got == {r.date: (r.n, round(r.t, 9)) for r in want.collect()}
    live = st.live_index(st.read_days(spark, out)).collect()
    assert all(0 < r.score < 1 and r.zone for r in live)


def test_stream_dedupes_across_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for name in ("a", "b"):
        stream_rows(spark, src, [(base + dt.timedelta(hours=i), i, 1.0, True) for i in range(5)], name)
        s = spark.readStream.schema("ts timestamp, id int, tone double, matched boolean").parquet(src + "/*")
        st.run_once_only(s, out, ck, ["id"])
    assert sorted(r.id for r in st.read_once_only(spark, out).collect()) == [0, 1, 2, 3, 4]


def test_backfilled_days_are_kept_and_compacted(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for name, day in (("a", 30), ("b", 10), ("c", 31), ("d", 10)):
        stream_rows(spark, src, [(dt.datetime(2024, 1, day, 5), i, float(i), i != 2) for i in range(7)], name)
        st.run_daily(spark.readStream.schema("ts timestamp, id int, tone double, matched boolean").parquet(src + "/*"), out, ck)
    want = {10: (12, 19 / 6), 30: (6, 19 / 6), 31: (6, 19 / 6)}
    for path in (out, sk.compact_sums(spark, out, str(tmp_path / "small"), ["date"], st.SUMS)):
        got = {r.date.day: (r.mentions, r.tone) for r in st.read_days(spark, path).collect()}
        assert got == {k: (n, pytest.approx(t)) for k, (n, t) in want.items()}


def test_gkg_day_of_odd_file_names(spark, tmp_path):
    put(tmp_path / "g" / "part-00000-12340506-9a1c.txt", gkg("20200101", "bitcoin") + "\n")
    put(tmp_path / "g" / "20240101000000.gkg.csv", gkg("20200101", "bitcoin") + "\n")
    rec = ns.scan_gkg(spark, str(tmp_path / "g"), {"p": ["bitcoin"]}, {"p": ["NONE"]})
    assert sorted(r.day for r in rec.collect()) == [dt.date(2020, 1, 1), dt.date(2024, 1, 1)]


def test_articles_keep_rows_with_odd_numbers(spark, tmp_path):
    lines = [{"event_id": "a", "num_mentions": 5.0, "gdelt_globaleventid": "7", "data": "2020-01-01"}, {"event_id": "b", "num_articles": "3", "url": "u", "okno_key": "k"},
             {"event_id": "c", "num_articles": "many", "article_domain": "d"}]
    p = put(tmp_path / "a.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n[broken\n")
    got = {r.event_id: r for r in ns.read_articles_jsonl(spark, p).collect()}
    assert (got["a"].num_mentions, got["a"].record_id, got["a"].date) == (5, "7", "2020-01-01")
    assert (got["b"].num_articles, got["b"].source_url, got["b"].window_key) == (3, "u", "k")
    assert got["c"].num_articles is None and got["c"].source_domain == "d" and len(got) == 3
    assert ns.broken_article_lines(spark, p).first().broken_lines == 1


def test_panel_keeps_the_first_row_and_reports_damage(spark, tmp_path):
    spark.createDataFrame([("2020-01-01", 9.0), ("2020-01-01", 3.0)], "date string, price double").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert [r.price for r in mk.read_panel(spark, str(tmp_path / "p.parquet")).collect()] == [9.0]
    put(tmp_path / "bad.parquet" / "part-0.parquet", "this is no table")
    csv = put(tmp_path / "c.csv", "date,price\n2020-01-01,1\n")
    with pytest.raises(Exception):
        mk.read_panel(spark, str(tmp_path / "bad.parquet"), csv).collect()


def test_summary_has_a_bound(spark):
    with pytest.raises(ValueError):
        sk.json_summary(spark.range(20), most=10)


def test_sorted_files(spark, tmp_path):
    path = sk.write_sorted(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), str(tmp_path / "s"), ["v"], 4)
    assert [r.v for r in spark.read.parquet(path).coalesce(1).collect()] and sum(1 for _ in (tmp_path / "s").glob("*.parquet")) > 1
    got = [r.v for f in sorted((tmp_path / "s").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert got == list(range(1000))


def test_job_folds_its_batches(spark, tmp_path):
    """Readers before, between and after folds see the same sums; old batches go, the last ones stay."""
    base = dt.datetime(2024, 1, 1)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    early = None
    for k in range(9):
        stream_rows(spark, src, [(base + dt.timedelta(hours=7 * i + k), i, float(k), i % 2 == 0) for i in range(6)], f"r{k}")
        st.run_daily(spark.readStream.schema("ts timestamp, id int, tone double, matched boolean").parquet(src + "/*"), out, ck, fold_every=3)
        days = st.read_days(spark, out)
        early = days if k == 7 else early
        assert days.agg(F.sum("mentions")).first()[0] == 3 * (k + 1)
    assert early.agg(F.sum("mentions")).first()[0] == 24  # a reader from before the last fold goes on
    held = sorted(os.path.basename(p) for p in glob.glob(out + "/*=*"))
    assert held == ["batch=6", "batch=7", "batch=8", "fold=5", "fold=8"]
