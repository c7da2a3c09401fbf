from datetime import date

import pytest
from pyspark.sql import functions as F

from pulsepanel.functions import clean as cl
from pulsepanel.functions import topics as tp


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_parse_number(spark):
    cells = ["4,745.10", "1575032004", " 12 ", '"7.5"', "", None, "nan", "null", "-", "1.0d", "abc", "-3e2", ".5"]
    assert apply(spark, cl.parse_number, cells) == [4745.10, 1575032004.0, 12.0, 7.5, None, None, None, None, None, None, None, -300.0, 0.5]


def test_parse_percent_and_abbrev(spark):
    assert apply(spark, cl.parse_percent, ["-11.39%", "1,5%", "x", None]) == [-11.39, 1.5, None, None]
    got = apply(spark, cl.parse_abbrev, ["0.57K", "146.84k", "1.23M", "2.1B", "12", "-", "", "1Q", None])
    assert got[:5] == pytest.approx([570.0, 146840.0, 1230000.0, 2.1e9, 12.0]) and got[5:] == [None] * 4


def test_dates(spark):
    assert apply(spark, cl.parse_date, ["2015-10-31 00:00:00 UTC", "2016-02-30", "bad", None]) == [date(2015, 10, 31), None, None, None]
    assert apply(spark, cl.parse_compact_date, ["20240131123000", "2024013", None]) == [date(2024, 1, 31), None, None]


def test_non_finite_becomes_missing(spark):
    assert apply(spark, cl.finite, [1.0, float("nan"), float("inf"), -float("inf"), None], "double") == [1.0, None, None, None, None]
    assert apply(spark, lambda c: cl.safe_num(c, 0.0), ["1.5", "nan", "x", None]) == [1.5, 0.0, 0.0, 0.0]


def test_clip_keeps_missing(spark):
    assert apply(spark, lambda c: cl.clip(c, -3.0, 3.0), [None, 9.0, -9.0, 1.0], "double") == [None, 3.0, -3.0, 1.0]


def test_names():
    assert [cl.snake_case(n) for n in ("﻿ Change % ", "Vol.", "avg-tone", "A  B__c")] == ["change", "vol", "avg_tone", "a_b_c"]


def test_alias_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "data int, x int")
    assert cl.resolve_alias(df, ["date", "data"]) == "data" and cl.resolve_alias(df, ["q"]) is None
    assert cl.add_aliases(df, {"data": "date", "x": "data"}).columns == ["data", "x", "date"]
    with pytest.raises(ValueError, match="q"):
        cl.require_columns(df, ["x", "q"])


def test_complete_rows_equals_dropna(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4), (None, None)], "a int, b int")
    assert cl.complete_rows(df, ["a", "b"]).collect() == df.dropna().collect()


def test_tone(spark):
    got = apply(spark, tp.parse_tone, ["-2.5,1,2", "3", "150,1", "x", "", None, " -1,0"])
    assert got == [-2.5, 3.0, None, None, None, None, -1.0]


def test_domains(spark):
    assert apply(spark, tp.domain_of, ["https://www.News.Example.com:80/a?b", "ftp://a.org", "no url"]) == ["news.example.com:80", "a.org", ""]
    names = ["ccn.com", "m.ccn.com", "xccn.com", "reuters.com", "www.ft.com", None, "news.bitcoin.com", "bitcoin.com"]
    assert apply(spark, tp.classify_domain, names) == [
        "low_cred", "low_cred", "unknown", "trusted", "trusted", "unknown", "low_cred", "unknown"]


def test_url_filter_has_two_tiers(spark):
    urls = [
        "https://x.com/bitcoin-price-up", "https://x.com/btc-sale", "https://x.com/btc-wallet-price", "https://www.coindesk.com/anything",
        "https://x.com/blockchain-consulting", "https://x.com/plain", None]
    assert apply(spark, tp.match_article_url, urls) == [True, False, True, True, False, False, False]


def test_topic_needs_keyword_or_theme_field(spark):
    row = ["id", "20240101", "", "src", "", "", "", "TAX;WEB_BITCOIN", ""]
    lines = ["\t".join(row), "\t".join(row[:7] + ["", ""]), "a\tBitCoin", "WEB_BIT\tnone"]
    got = apply(spark, lambda c: tp.match_topic(c, ["satoshi", "bitcoin"], ["WEB_BITCOIN"]), lines)
    assert got == [True, False, True, False]
