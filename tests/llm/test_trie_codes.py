"""Conversation tree, byte-level BPE and vector codes against brute force."""

import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsepanel.llm import bytepairs, codebooks, prefixtrie

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- conversation tree ---------------------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, depth int, p1 string, members long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TALK).repartition(3)


def slow_tree(rows):
    """Every node by its sequence of turns."""
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = said.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(all(len(q) <= len(p) or q[:len(p)] != p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed=3, convs=120):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        c = int(c * 3 if c % 2 else rng.integers(0, 700))
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], ["hi", "yes", "n\u00e4ive \U0001f600", ""][int(rng.integers(0, 3 if t else 2))]))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [(9001, 1, None, "a"), (9001, None, "user", None), (9002, None, "user", ""), (9002, 1, "", "a"), (-150, 0, "user", "hi"),
             (9100, 0, "user", "only"), (9155, 0, "user", "own"), (None, 0, "user", "lost"), (9200, 5, "u", "same"), (9200, 5, "u", "same")]
    rows += [(9300, t, "u", str(t % 7)) for t in range(40)] + [(9301, t, "u", str(t % 7)) for t in range(40)]
    return rows


@pytest.mark.parametrize("shards", [(256, 4096), (3, 4)])
def test_tree(spark, monkeypatch, shards):
    monkeypatch.setattr(prefixtrie, "BAND", shards[0])
    monkeypatch.setattr(prefixtrie, "SHARD_CONVERSATIONS", shards[1])
    rows = talks()
    got = prefixtrie.conversation_tree(talk(spark, rows))
    assert sorted([tuple(r) for r in got.collect()], key=str) == slow_tree(rows)


def test_tree_of_nothing(spark):
    assert prefixtrie.conversation_tree(talk(spark, [])).collect() == []
    assert prefixtrie.conversation_tree(talk(spark, [(None, 1, "u", "a")])).collect() == []


def test_many_copies_of_one_conversation(spark, monkeypatch):
    """A node whose end list comes from many shards has the digest of the whole list."""
    monkeypatch.setattr(prefixtrie, "SHARD_CONVERSATIONS", 8)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 900) for t in range(3)]
    got = prefixtrie.conversation_tree(talk(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == slow_tree(rows)
    assert any(r.ends_sha256 == hashlib.sha256(",".join(map(str, range(900))).encode()).hexdigest() for r in got)


def test_long_conversation_is_cut_into_bands(spark):
    n = 3 * prefixtrie.BAND + 10
    rows = [(c, t, "user", "x" * (c if t == n - 1 else 2)) for c in (1000, 1100) for t in range(n)]
    got = {(r.conv_id, r.depth): r for r in prefixtrie.conversation_tree(talk(spark, rows)).collect()}
    assert len(got) == n + 2 and got[1000, n - 1].n_children == 2 and got[1100, n].parent_conv_id == 1000
    assert got[1000, 0].n_leaves == 2 and got[1000, 0].saved_tokens == 2 * (n - 1)


# --- byte-level BPE ------------------------------------------------------------------------------------------------

ODD = [
    None, "", "a", " ", "\n", " " * 300 + "x", "x" * 3000, "ab" * 40 + " " + "zq" * 900, "\t" * 700, "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8" * 60,
    "\u65e5\u672c \u6f22\u5b57\u304b\u306a\u3002\u00e9migr\u00e9 \u00dcBER stra\u00dfe", "\u0870\u0871 \U000107b1x \U00011f50", "don't we'll I'M 12,345.678\r\n\n  \t tail  ",
    "a\x00b\x7f\x80\x85 y\u2003z", "\U0001f600\U0001f600 \U0001f469\u200d\U0001f467 \U0001f1e9\U0001f1ea", "<|endoftext|>", "\u0301\u0301 \ufeff x"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("known", [1 << 17, 3, 0])
def test_ids_and_bytes(spark, library, known):
    texts = [*ODD, *ODD[:3], " ".join(f"word{i % 50} Wort{i}" for i in range(4000))]
    rows = [(i % 7, t, "kept", 5, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, ids int, decoded string").repartition(3)
    got = bytepairs.round_trip(docs, RANKS, public_tokenizers.PATTERN, most_known=known)
    got = got.select("*", bytepairs.little_endian(got.ids).alias("packed")).collect()
    assert len(got) == len(rows) and all(r.words == "kept" for r in got)
    want = collections.Counter((d, t, tuple(library.encode_ordinary(t or ""))) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.text, tuple(r.ids)) for r in got) == want
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert all(bytes(r.packed) == struct.pack(f"<{len(r.ids)}I", *r.ids) for r in got)


def test_no_rows_and_bad_ids(spark, library):
    some = spark.createDataFrame([("one two",), (None,)], "text string")
    apart = bytepairs.decode(bytepairs.encode(some, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert {r.text: (r.ids, bytes(r.decoded)) for r in apart} == {"one two": (library.encode_ordinary("one two"), b"one two"), None: ([], b"")}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bytepairs.encode(docs, RANKS, public_tokenizers.PATTERN).collect() == []
    ids = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {None if r.decoded is None else bytes(r.decoded) for r in bytepairs.decode(ids, RANKS).collect()} == {None, b""}
    for bad in ([-1], [1 << 20], [None]):
        with pytest.raises(Exception, match="no token has the id"):
            bytepairs.decode(spark.createDataFrame([(bad,)], "ids array<int>"), RANKS).collect()


def test_constants_stay_out_of_rows(spark):
    """The optimizer binds the maps inside the lambda: no operator hands them on as a column."""
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    for rows in (bytepairs.encode(docs, RANKS, public_tokenizers.PATTERN), bytepairs.round_trip(docs, RANKS, public_tokenizers.PATTERN)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "AS __constant" not in plan and "/rows" not in "".join(rows.inputFiles())


def test_texts_are_read_once(spark, library):
    """One pass looks words up in batches, long words included; packed ids are those of the array."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = bytepairs.round_trip(docs, RANKS, public_tokenizers.PATTERN, most_known=3, keep=["doc_id"], packed=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "xxhash64" not in plan
    rows = {r.doc_id: bytes(r.ids) for r in got.collect()}
    assert got.columns == ["doc_id", "ids", "decoded"]
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert rows[i] == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst \u00e9\u00fc\u4e2d", max_size=60))
def test_heap_merges_like_the_library(text):
    own = test_heap_merges_like_the_library.__dict__
    if "ranks" not in own:
        own["ranks"] = bytepairs.read_ranks(RANKS)
        own["library"] = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own["ranks"], special_tokens={})
    if text:
        assert bytepairs.merge_long(text.encode(), own["ranks"]) == own["library"].encode_ordinary(text)


def test_heap_is_fast_on_a_long_word():
    ranks = bytepairs.read_ranks(RANKS)
    word = bytes(np.random.default_rng(0).integers(97, 123, 300_000, dtype=np.uint8))
    ids = bytepairs.merge_long(word, ranks)
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in ids) == word


# --- vector codes --------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, state long"


def slow_codes(rows, entries=16, rounds=6, parts=8):
    kept = [(i, [math.floor(4096 * float(x)) for x in e], lab) for i, e, lab in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out, by_length = [], collections.defaultdict(list)
    for r in kept:
        by_length[len(r[1])].append(r)
    for n, group in by_length.items():
        group.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [(p * n // parts, (p + 1) * n // parts) for p in range(parts)]
        books = [[r[1][a:b] for r in group[:entries]] for a, b in cuts]

        def nearest(part, book):
            return min((sum((x - c) ** 2 for x, c in zip(part, entry)), j) for j, entry in enumerate(book))

        for _ in range(rounds):
            for p, (a, b) in enumerate(cuts):
                held = collections.defaultdict(list)
                for r in group:
                    held[nearest(r[1][a:b], books[p])[1]].append(r[1][a:b])
                for j, members in held.items():
                    books[p][j] = [sum(c) // len(members) for c in zip(*members)]
        digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
        for i, v, lab in group:
            best = [nearest(v[a:b], book) for (a, b), book in zip(cuts, books)]
            out.append((i, lab, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), digest))
    per = collections.Counter()
    for _, lab, _, e, _ in out:
        per[lab] += e
    return collections.Counter((i, lab, code, e, per[lab], digest) for i, lab, code, e, digest in out)


def clustered(seed=5, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 0.4
    rows = [(i, (centres[i % 12] + rng.normal(size=dim) * 0.1).astype(np.float32).tolist(), int(i % 4) if i % 9 else None) for i in range(n)]
    rows += [(5000 + i, rows[3][1], 1) for i in range(60)] + [(7, rows[9][1], 2), (7, rows[9][1], 2), (None, rows[1][1], 0)]
    rows += [(6000, None, 1), (6001, [1.0] * (dim - 1) + [None], 1), (6002, [float("nan")] * dim, 1), (6003, [float("inf")] + [0.0] * (dim - 1), 1),
             (6004, [0.5] * 8, 1), (6005, [0.25, -0.5] * 4, 3), (6006, [0.1, 0.2, 0.3], None), (6007, [], 1), (6008, [0.0] * dim, 2)]
    return rows


def codes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "v", "c", 3) for r in rows], VECTORS).repartition(5)
    out = codebooks.compress(df, **options).collect()
    return collections.Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


def test_codes(spark):
    assert codes(spark, clustered()) == slow_codes(clustered())


def test_codes_of_few_rows(spark):
    few = clustered()[:5]
    assert codes(spark, few) == slow_codes(few)
    assert codes(spark, []) == {}
    with pytest.raises(Exception, match="too large for exact integer codes"):
        codes(spark, [(1, [4e9] * 8, 1)])


def test_bounds_spare_rescans_and_change_nothing():
    """Rows whose bounds part keep the entry that a full scan gives; most rows are not rescanned."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 6))[rng.integers(0, 12, 5000)] * 4000 + rng.normal(size=(5000, 6)) * 300).astype(np.int64)
    history = x[:16][None]
    state = np.zeros(len(x), codebooks.STATE)
    codebooks.rescan(state, np.arange(len(x)), x, history[0], 0)
    scanned = 0
    for _ in range(8):
        sums = np.stack([x[state["entry"] == j].sum(0) // max(1, (state["entry"] == j).sum()) for j in range(16)])
        history = np.concatenate([history, sums[None]])
        scanned += codebooks.reassign(state, x, history)
        assert (state["entry"] == codebooks.distances(x, history[-1]).argmin(1)).all()
    assert scanned < 0.5 * 8 * len(x)
