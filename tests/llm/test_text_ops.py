"""Text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsepanel.llm import langid, lines, mixing, packing, passages, pieces, simhash
from pulsepanel.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, row string, node long, size long, place string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    """(doc_id, text[, lang[, source]]) rows with columns that clash with internal names."""
    full = [(*r, *[None] * (4 - len(r)), 1, 2, "x", 3, 4, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def random_texts(seed, n, words=60):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocab, rng.integers(3, words))) for _ in range(n)]


def awkward():
    texts = random_texts(1, 30)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, " \n\t ", None, "s1"), (None, texts[0], "en", "s0"), (103, texts[1], "en", "s2")]
    rows += [(3, texts[3], "en", "s3"), (3, texts[3], "en", "s3"), (104, " ".join(texts * 40), "en", "s1"), (105, "12 %% !!", "en", "s0")]
    return rows


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert simhash.simhash_groups(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert packing.pack(none, vocabulary()).count() == 0
    assert mixing.mix(none).count() == 0
    assert langid.predicted(none).count() == 0
    assert pieces.token_counts(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert passages.repeated_passages(none).count() == 0


# SimHash

def slow_fingerprint(text, n=3):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("words", [3, 5])
def test_fingerprints(spark, words):
    rows = awkward()
    got = simhash.fingerprints(frame(spark, rows), words).collect()
    want = sorted(((r[0] is None, r[0]), slow_fingerprint(r[1], words)) for r in rows)
    assert sorted(((r.doc_id is None, r.doc_id), r.fp % (1 << 64)) for r in got) == want


@pytest.mark.parametrize("distance, segments, dense", [(2, 5, 64), (2, 5, 1), (2, 7, 3), (1, 4, 64), (1, 4, 1)])
def test_simhash_links_all_pairs(spark, distance, segments, dense):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    prints = set(base)
    for f in base[:25]:
        for _ in range(6):
            g = f
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                g ^= 1 << int(bit)
            prints.add(g - (1 << 64) if g >= 1 << 63 else g)
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance, segments, dense).collect()
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= distance]
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= distance for r in edges)
    assert slow_components(prints, [(r.a, r.b) for r in edges]) == slow_components(prints, near)


def test_simhash_groups(spark):
    rows = awkward()
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(r[0], r[1]): slow_fingerprint(r[1]) for r in rows}
    for r in got:
        close = [d for (d, _), p in prints.items() if d is not None and p == r.fp % (1 << 64)]
        assert r.component_id <= min(close)
    assert {r.component_id for r in got if r.doc_id in (100, 101, 102)} == {100}
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and 103 not in ids and 101 not in ids and {0, 1, 3, 100} <= set(ids)


def test_components_of_a_long_path_and_a_star(spark):
    from pulsepanel.llm.common import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 900 - i) for i in range(80)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in slow_components({x for e in edges for x in e}, edges).items() if k in got} and len(got) == 61 + 81 + 2


# Lines

def slow_lines(rows, min_docs=5, min_chars=40):
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in ls] for _, ls in cut]
    low = lambda d: -(1 << 63) if d is None else d
    held = collections.defaultdict(list)
    for (d, _), ks in zip(cut, keys):
        for k in set(ks):
            held[k].append(low(d))
    gone = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for (d, ls), ks in zip(cut, keys):
        kept = [x for x, k in zip(ls, ks) if not (k in gone and gone[k] != low(d))]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (r[0] is None, r))


def line_rows():
    rng = np.random.default_rng(3)
    pool = [f"{t} and some more words to be long enough" for t in random_texts(5, 12, 8)] + ["short", "", "É" * 39, "É" * 40]
    rows = []
    for i in range(60):
        picked = [pool[j] for j in rng.integers(0, len(pool), 6)]
        rows.append((i, "\n".join(("  " + x.upper() + "\t") if rng.random() < 0.3 and x.isascii() else x for x in picked)))
    return rows + [(None, pool[0]), (None, pool[0]), (7, pool[1]), (7, pool[1]), (200, None), (201, ""), (202, "\n\n"), (203, "\n".join(pool * 300))]


@pytest.mark.parametrize("options", [{}, {"in_memory": 0, "group": 20, "shard_lines": 3}, {"shard_lines": 2}])
def test_line_dedup(spark, options):
    rows = line_rows()
    got = lines.dedup_lines(frame(spark, rows), **options).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r)) == slow_lines(rows)


def test_line_dedup_keeps_columns(spark):
    docs = frame(spark, line_rows())
    new = lines.rewritten(docs)
    assert new.columns == docs.columns
    assert all(r.n_chars == len(r.text) and r.h1 == 2 for r in new.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 5000])
def test_perfect_hash(n):
    h = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, (n, 2))
    h[: n // 3, 0] = 5  # equal first halves still part
    mph = lines.PerfectHash.build(h)
    assert sorted(mph.index(h).tolist()) == list(range(n))
    assert (mph.index(h + 1) < n).all()


# Packing

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = awkward() + [(300, "a  b\n\n c<|endoftext|> d's 12 日本語 ẞ", None, None), (301, "x " * 9000, None, None)]
    library = Tokenizer.from_file(vocabulary())
    pieces_ = packing.pack(frame(spark, rows), vocabulary(), room=256, group_docs=16).collect()
    per = collections.defaultdict(list)
    for p in pieces_:
        assert p.length == len(p.ids) // 2 and p.ids_crc32 == zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes())
        per[p.doc_id, p.doc_tokens].append(p)
    for d, text, *_ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        found = sorted(per[d, len(want)], key=lambda p: p.start)
        copies = sum(r[0] == d and r[1] == text for r in rows)
        assert sum(p.length for p in found) == copies * len(want)
        if copies == 1:
            assert [i for p in found for i in np.frombuffer(p.ids, "<u2")] == want
            assert [p.start for p in found] == np.cumsum([0] + [p.length for p in found])[:-1].tolist()
    held = padded = 0
    for seq in collections.Counter(p.sequence_id for p in pieces_):
        inside = sorted((p.offset, p.length) for p in pieces_ if p.sequence_id == seq)
        assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()
        n = sum(x for _, x in inside)
        assert n <= 256
        held += n
        padded += 0 if n & (n - 1) == 0 else 256 - n
    assert padded < 0.02 * held


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 101, rng.integers(1, 80)).tolist()
        bins = packing.first_fit_decreasing(sizes, 100)
        room, slow = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            j = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
            if j == len(room):
                room.append(100)
                slow.append([])
            room[j] -= sizes[i]
            slow[j].append(i)
        assert bins == slow


# Mixing

def slow_mix(rows, cap=3):
    import hashlib

    sizes = [len(WORDS.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(rows, sizes) if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    capped = set()
    while True:
        left = sum(sizes) - sum(cap * total[s] for s in capped)
        share = {s: cap * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        over = {s for s in sources if share[s] > cap * total[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        own = sorted((hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else "", n, r[0]) for r, n in zip(rows, sizes) if r[3] == s)
        at = 0
        for _, n, d in own:
            out.append((d, n, total[s], share[s], n * sum(at + e * total[s] + n / 2 < share[s] for e in range(cap))))
            at += n
    return out


def test_mixing(spark):
    rows = awkward() + [(400 + i, "a few words only", "en", "tiny") for i in range(3)]
    got = mixing.mix(frame(spark, rows), digits=1)
    found = sorted(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    want = sorted(slow_mix(rows), key=str)
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])
    order = mixing.mixed(frame(spark, rows))
    assert order.columns == frame(spark, rows).columns
    again = mixing.mixed(frame(spark, rows))
    assert [r.doc_id for r in order.collect()] == [r.doc_id for r in again.collect()]
    assert order.count() == got.agg(F.sum("copies")).first()[0]
    assert not got.queryExecution.executedPlan.toString().count("Python") if hasattr(got, "queryExecution") else "Python" not in got._jdf.queryExecution().toString()


def test_schedule_inverse(spark):
    knots = [(0.0, 2.0), (0.25, 0.0), (0.5, 1.0), (1.0, 1.0)]
    t = np.linspace(0, 1, 101)
    rate = np.interp(np.linspace(0, 1, 100_001), *zip(*knots))
    area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    share = np.interp(t, np.linspace(0, 1, 100_001), area / area[-1])
    rows = spark.createDataFrame([(float(a), float(s)) for a, s in zip(t, share)], "t double, s double")
    got = rows.select("t", mixing.invert_schedule(F.col("s"), knots).alias("x")).collect()
    assert all(abs(r.t - r.x) < 2e-3 for r in got)


# Language

def test_language(spark):
    rng = np.random.default_rng(0)
    kinds = {"aa": ["the", "tion", "ing", "and", "er"], "bb": ["der", "ung", "sch", "ß", "ein"], "cc": ["ción", "que", "ñ", "los", "ez"]}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        words = ["".join(rng.choice(kinds[lang], rng.integers(1, 4))) for _ in range(rng.integers(5, 60))]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), lang if i % 5 else None, "s"))
    rows += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 !", "cc", "s"), (None, rows[0][1], "aa", "s"), (0, rows[0][1], "aa", "s"), (903, rows[1][1] * 400, None, "s")]
    got = langid.predicted(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: list(kinds)[i % 3] for i in range(240)} | {903: "bb"}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = langid.keep_identified(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - 3
    clash = frame(spark, rows).withColumns({"score": F.lit(1), "bits": F.lit(2), "lang_pred": F.lit("q")})
    assert {(r.score, r.bits, r.lang_pred) for r in langid.keep_identified(clash).collect()} == {(1, 2, "q")}
    unlabelled = langid.predicted(frame(spark, [(1, "some text", None, None)])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


def test_phrases_are_greedy_longest_matches():
    rng = np.random.default_rng(2)
    samples = {k: "".join(rng.choice(list("abc d"), 400)) for k in "xy"}
    model = langid.Model({k: " ".join(v.split()) for k, v in samples.items()})
    texts = ["".join(rng.choice(list("abcde "), n)) for n in (1, 5, 200, 256, 257, 900)] + ["zzz", ""]
    for text in texts:
        norm = langid.letters_of(text)
        got = model.phrases([model.encode(text)])[0] if norm else [0, 0]
        for lang, n in zip(model.langs, got):
            sample, phrases = " ".join(samples[lang].split()), 0
            for at in range(0, len(norm), langid.BLOCK):
                block, i = norm[at:at + langid.BLOCK], 0
                while i < len(block):
                    j = i + 1
                    while j < len(block) and block[i:j + 1] in sample and block[i] in sample:
                        j += 1
                    i, phrases = j, phrases + 1
            assert n == phrases


# Word pieces

def test_piece_counts(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    vocab = ["▁", "▁a", "▁ab", "abc", "b", "bc", "bcd", "cde", "▁abcd", "ee", "▁xyz"]
    automaton = pieces.LongestMatch(vocab)

    @settings(max_examples=400, deadline=None)
    @given(st.text("abcdexyz▁é日", max_size=14))
    def same(word):
        assert automaton.count(word) == pieces.greedy_count(word, set(vocab))

    same()
    path = vocabulary("piece_bpe_32k.model")
    rows = awkward() + [(500, "naïve 日本 " + "q" * 5000, None, None)]
    got = pieces.token_counts(frame(spark, rows), path).collect()
    known = set(pieces.load_pieces(path))
    want = sorted((str(r[0]), len((r[1] or "").split()), sum(pieces.greedy_count("▁" + w, known) for w in (r[1] or "").split()))
                  for r in rows if len(r[1] or "") < 9000)
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got if r.n_words < 3000) == want


# Passages

def test_passages(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]
    shared, line = fresh(51), fresh(60)
    rows = [(i, " ".join(fresh(200))) for i in range(40)]
    rows += [(100 + i, " ".join(fresh(30 + 7 * i) + shared + fresh(40)).upper() if i == 1 else " ".join(fresh(30 + 7 * i) + shared + fresh(40))) for i in range(4)]
    for i in range(3):  # lines with an edit every 25 words or so
        edited = list(line)
        edited[29] = f"e{i}"
        rows.append((200 + i, "\n".join([" ".join(fresh(20)), " ".join(edited), " ".join(fresh(20))])))
    rows += [(300, None), (301, ""), (None, " ".join(shared)), (0, rows[0][1]), (302, " ".join(fresh(25) * 4)), (303, " ".join(fresh(120_000)))]
    short = fresh(50)
    rows += [(400 + i, " ".join(fresh(50) + short + fresh(50))) for i in range(3)]
    got = {r.doc_id: r for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {100, 101, 102, 103, 200, 201, 202}
    assert got[100].removed_words == 0 and got[101].removed_words == 51 and got[202].removed_words == 60 and got[200].removed_words == 0
    assert all(s.start >= 30 + 7 * i and s.start + s.words <= 81 + 7 * i for i in range(4) for s in got[100 + i].spans)
    blocks = {r.doc_id: r for r in passages.repeated_passages(frame(spark, rows), block=1).collect()}
    assert set(blocks) == set(got)


@pytest.mark.parametrize("slots", [64, 1 << 26])
def test_passage_bounds_for_any_table(spark, slots, monkeypatch):
    """Runs of 50 words or more, with few slots nearly all of which are taken: true bounds, and none of 50 words."""
    monkeypatch.setattr(passages, "SLOTS", slots)
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]
    rows, want = [], {}
    for k, size in enumerate([50, 51, 52, 55, 60, 65, 70, 90, 110, 111, 150, 200, 260] * 3):
        shared = fresh(size)
        for side in range(2):
            before = int(rng.integers(40, 160))
            rows.append((2 * k + side, " ".join(fresh(before) + shared + fresh(120))))
            if size > 50:
                want[2 * k + side] = [(before, size, side == 1)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert got == want


def slow_runs(rows, run=51):
    """{doc_id: [(start, words, removed)]} by every run of every document, and the documents that hold it."""
    texts, held = {}, {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(text.lower().split())
    for doc, all_words in texts.items():
        for words in all_words:
            for i in range(len(words) - run + 1):
                held.setdefault(tuple(words[i:i + run]), set()).add(doc)
    out = {}
    for doc, (words, *_) in texts.items():
        state = [0] * len(words)
        for i in range(len(words) - run + 1):
            docs = held[tuple(words[i:i + run])]
            if len(docs) > 1:
                for j in range(i, i + run):
                    state[j] = max(state[j], 1 if min(docs) == doc else 2)
        if any(state):
            cuts = [0, *(j for j in range(1, len(words)) if state[j] != state[j - 1]), len(words)]
            out[doc] = [(x, y - x, state[x] == 2) for x, y in zip(cuts, cuts[1:]) if state[x]]
    return out


@pytest.mark.parametrize("slots", [64, 1 << 26])
def test_runs_match_brute_force(spark, slots, monkeypatch):
    """Texts put together from shared pieces of many lengths, copies, runs twice in one document, and one very frequent piece."""
    monkeypatch.setattr(passages, "SLOTS", slots)
    rng = np.random.default_rng(33)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10 ** 9, n)]
    pieces_ = [fresh(n) for n in rng.integers(20, 160, 40)]
    rows = []
    for doc in range(150):
        words = []
        for _ in range(rng.integers(1, 6)):
            p = pieces_[min(rng.geometric(0.1), 40) - 1]
            a = rng.integers(0, len(p) // 3)
            words += p[a:len(p) - rng.integers(0, len(p) // 3)] + fresh(rng.integers(0, 30))
        rows.append((doc, " ".join(words)))
    rows += [(200 + i, rows[3 * i][1]) for i in range(20)]
    twice, tail = fresh(60), fresh(80)
    rows += [(300, " ".join(twice + tail + fresh(50) + twice + fresh(70))), (301, " ".join(fresh(40) + twice + tail)), (302, " ".join(twice + fresh(9) + twice))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in passages.repeated_passages(frame(spark, rows), similarity=1.0).collect()}
    assert got == slow_runs(rows)


def test_words_of_slices():
    text = "\u039f\u0394\u039f\u03a3 Ab\u2003c\x1cd \n" * 3000
    whole = passages.word_hashes(text)
    passages.SLICE, before = 7, passages.SLICE
    try:
        assert (passages.word_hashes(text) == whole).all() and len(whole) == 12_000
    finally:
        passages.SLICE = before


def test_connected_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sets = []
        for _ in range(6):
            base = rng.integers(0, 200, 20)
            for _ in range(4):
                s = base.copy()
                s[rng.integers(0, 20, rng.integers(0, 4))] = rng.integers(0, 200)
                sets.append(np.unique(s))
        near = [(i, j) for i in range(len(sets)) for j in range(i)
                if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        want = slow_components(range(len(sets)), near)
        label = passages.connected(sets, np.full(len(sets), -1), 0.8)
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def test_block_starts_and_span_hashes():
    """Blocks are the plain union of run starts around repeated stretches; a text's prefix sums are taken once for all its spans."""
    rng = np.random.default_rng(5)
    for n in (51, 52, 90, 700):
        words = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        at = np.flatnonzero(rng.random(n - 29) < 0.06)
        repeated = rng.random(len(at)) < 0.5
        first, size = passages.run_blocks(at, repeated, n, 51, 30)
        again, want = at[repeated].tolist(), set()
        for i, a in enumerate(again):
            end = a
            for b in again[i + 1:]:
                end = b if b - end <= 30 else end
            want |= set(range(max(0, a - 21), min(end, n - 51) + 1))
        got = [x for f, k in zip(first.tolist(), size.tolist()) for x in range(f, f + k)]
        assert got == sorted(want)
        assert all(not ((at > f) & (at < f + k)).any() for f, k in zip(first, size))
        held = passages.Spans(words)
        with np.errstate(over="ignore"):
            once = held.hashes(np.arange(n - 29), np.full(n - 29, 30))
            moved = passages.Spans(words[7:]).hashes(np.arange(n - 36), np.full(n - 36, 30))
            sums = {k: id(v) for k, v in held.sums.items()}
            held.hashes(np.zeros(1, int), np.ones(1, int))
        assert all((a[7:] == b).all() for a, b in zip(once, moved)) and sums == {k: id(v) for k, v in held.sums.items()}
