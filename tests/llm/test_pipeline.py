"""Registered queries, SQL and the pipeline on the smallest tables."""

import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SMALL
from pulsepanel.llm import queries
from test_catalog import canon


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_all_are_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sources = docs.columns, {}
    rows = {r.doc_id: r for r in docs.collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        seen.append(docs)
        if name != "pack":
            assert docs.columns == columns
    start, language, lined, near, mixture, packed = seen
    assert {r.doc_id for r in language.collect()} == {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in lined.collect()} == {r.doc_id for r in language.collect()}
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert all(set(texts[d].split("\n")) <= set(rows[d].text.split("\n")) | {""} for d in texts)
    from test_neardups import slow_groups
    from test_text_ops import slow_mix

    label = slow_groups(texts)
    kept = {r.doc_id: r for r in near.collect()}
    assert set(kept) == set(label.values())
    want = collections.Counter()
    for d, size, _, _, taken in slow_mix([(r.doc_id, r.text, r.lang, r.source) for r in kept.values()]):
        want[d] = taken // size if size else None
    got = collections.Counter(r.doc_id for r in mixture.collect())
    assert all(got[d] == n for d, n in want.items() if n is not None)
    assert sum(r.length for r in packed.collect() if r.start == 0) > 0
    assert sum(got.values()) == sum(r.start == 0 for r in packed.collect())


def test_run(spark):
    out = corpus_pipeline.query(spark, SMALL)
    assert out.columns[0] == "doc_id" and out.count() > 0
