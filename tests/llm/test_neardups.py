"""Near-duplicate documents and the pipeline's stage against brute-force five-word Jaccard similarity."""

import numpy as np
import pytest

import corpus_pipeline
from conftest import SMALL
from pulsepanel.llm import neardups
from test_text_ops import awkward, frame, slow_components


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts, least=0.8):
    """Smallest id of each id's group."""
    sets, ids = {d: slow_set(t) for d, t in texts.items()}, sorted(texts)
    alike = lambda a, b: len(a & b) >= least * len(a | b)  # noqa: E731  two empty sets are
    return slow_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if alike(sets[a], sets[b])])


def edited_texts():
    """Copies with scattered one-word edits, from nearly equal to below 0.8; a chain; a large group of near copies."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]
    texts = []
    for n in (150, 300, 800):
        for share in (0.002, 0.01, 0.018, 0.022, 0.025, 0.03, 0.05):
            base = fresh(n)
            texts.append(" ".join(base))
            for _ in range(2):
                copy = list(base)
                for i in rng.choice(n, max(1, int(share * n)), replace=False):
                    copy[i] = f"e{rng.integers(10 ** 9)}"
                texts.append(" ".join(copy))
    chain = fresh(200)
    for i in range(6):
        texts.append(" ".join(chain[8 * i:] + fresh(8 * i)))
    base = fresh(100)
    for i in range(90):
        copy = list(base)
        copy[i] = f"g{i}"
        texts.append(" ".join(copy))
    return {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("options", [{}, {"dense": 1, "block": 8}])
def test_groups_match_brute_force(spark, options):
    texts = edited_texts()
    got = {r.doc_id: r.component_id for r in neardups.near_duplicate_groups(frame(spark, list(texts.items())), **options).collect()}
    want = slow_groups(texts)
    assert len(set(want.values())) < len(texts) - 90 and got == want


def test_awkward_rows(spark):
    rows = awkward()
    got = neardups.near_duplicate_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (100, 101, 102)} == {100}
    assert {r.component_id for r in got if r.doc_id in (None, 0)} == {0}
    kept = neardups.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and 103 not in ids and 101 not in ids and {0, 1, 3, 100} <= set(ids)
    assert neardups.keep_one(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lined = corpus_pipeline.line_dedup(spark, corpus_pipeline.language(spark, docs, SMALL), SMALL).cache()
    texts = {r.doc_id: r.text for r in lined.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, lined, SMALL).collect()}
    assert kept == set(slow_groups(texts).values())


def test_fingerprints_link_without_bands(spark):
    """SimHash alone links what lies within two bits at Jaccard 0.8, and nothing below that similarity."""
    texts = edited_texts()
    got = {r.doc_id: r.component_id for r in neardups.near_duplicate_groups(frame(spark, list(texts.items())), bands=0).collect()}
    prints = {d: neardups.fingerprint_of([s := neardups.shingle_set(t)], len(s)) for d, t in texts.items()}
    sets = {d: slow_set(t) for d, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = [(a, b) for a in texts for b in texts if b < a and prints[a] != prints[b] and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2 and alike(a, b)]
    assert len(near) > 10 and all(got[a] == got[b] for a, b in near)
    whole = slow_groups(texts)
    assert all(whole[d] == whole[c] for d, c in got.items())
