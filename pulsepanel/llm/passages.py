"""Passages that repeat across documents: paragraph MinHash banding, exact verification, components.

Two kinds of paragraph are compared.  Lines of at least ``min_words`` words
are described by the set of their word 5-shingles; MinHash values are cut into
bands, lines that collide in a band are verified by exact Jaccard similarity,
and verified links are clustered by components.  A passage may also stand in
the middle of different lines; so every document is also cut into stretches of
``stretch`` words that start where a shingle has the smallest hash in its
neighbourhood.  Where a text repeats, the same stretches start at the same
words: every verbatim run of ``min_words`` + 1 words holds at least one whole
stretch.  Equal stretches have similarity 1, and all their bands are one key.

The documents are read three times.  The first pass counts stretches.  The
second one places the blocks of run starts around repeated stretches, cut where
stretches start, and describes lines.  Where a block stands in several
documents, one of them speaks for its runs: the third pass places single runs
of blocks that stand once or belong to their smallest document, and gives the
shingles of one line a class.  Between passes a bit table of fixed size tells
what can matter.  The bit tables only save work: exact joins decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import components, written

SHINGLE = 5
SLOTS = 1 << 26
BITS = np.uint64(64)
SLICE = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = {base: pow(base, -1, 1 << 64) for base in BASES}
HOT = 2000
_powers: dict[int, np.ndarray] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word of a lower-cased text; long texts are split in slices, which bounds the list of words."""
    if len(text) <= SLICE:
        return np.frombuffer(b"".join(map(xxhash.xxh64_digest, text.lower().split())), np.uint64)
    parts, at = [], 0
    while at < len(text):
        space = re.compile(r"\s").search(text, at + SLICE)
        end = space.start() if space else len(text)
        parts.append(np.frombuffer(b"".join(map(xxhash.xxh64_digest, text[at:end].lower().split())), np.uint64))
        at = end
    return np.concatenate(parts)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all word 5-shingles."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, m in enumerate(multipliers(SHINGLE, 11)):
        total += words[j:j + n] * m
    return mix(total)


def sliding(best: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """Smallest or largest value of every run of ``size``, by runs of doubling length."""
    span, out = 1, x
    while 2 * span <= size:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[:len(x) - size + 1], out[size - span:])


def stretches(words: np.ndarray, g: np.ndarray, min_words: int, stretch: int) -> np.ndarray:
    """Starts of the stretches of a document."""
    reach = min_words + 1 - stretch + 1  # starts of a stretch inside the shortest run that has to be found
    starts = len(words) - stretch + 1
    if starts < reach:
        return np.zeros(0, np.int64)
    # A start is taken if its shingle is the smallest of some neighbourhood that it lies in.
    low = sliding(np.minimum, g[:starts], reach)
    edge = np.zeros(reach - 1, np.uint64)
    return np.flatnonzero(g[:starts] == sliding(np.maximum, np.concatenate([edge, low, edge]), reach))


def long_lines(text: str, min_words: int) -> list[tuple[int, int]]:
    """(first word, words) of the lines with at least ``min_words`` words."""
    out, at = [], 0
    for line in text.split("\n"):
        n = len(line.split())
        if n >= min_words:
            out.append((at, n))
        at += n
    return out


def line_hashes(words: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    h1 = [xxhash.xxh64_intdigest(words[a:a + n].tobytes(), 1) for a, n in spans]
    h2 = [xxhash.xxh32_intdigest(words[a:a + n].tobytes(), 2) for a, n in spans]
    return np.array(h1, np.uint64).view(np.int64), np.array(h2, np.uint32).view(np.int32)


def band_keys(g: np.ndarray, spans: list[tuple[int, int]], bands: int, rows: int) -> list[list[int]]:
    """One key per band from the MinHash values of each span of words, given the document's shingles."""
    lows = np.empty((len(spans), bands * rows), np.uint64)  # shingle hashes are mixed already; odd factors reorder them
    times = multipliers(bands * rows, 53)
    for i, (a, n) in enumerate(spans):
        low = None
        for at in range(a, a + n - SHINGLE + 1, 4096):  # bounds memory for very long lines
            part = (g[at:min(at + 4096, a + n - SHINGLE + 1), None] * times).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        lows[i] = low
    keys = (lows.reshape(-1, bands, rows) * multipliers(rows, 71)).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    return mix(keys).view(np.int64).tolist()


def _map(docs: DataFrame, schema: str, types: list[pa.DataType], rows_of: Callable) -> DataFrame:
    """Rows from each (doc_id, text): ``rows_of(doc_id, text)`` gives lists or arrays, one per column."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    found = [rows_of(d, t.as_py() or "") for d, t in zip(part.column(0).to_pylist(), part.column(1))]
                    columns = [pa.array([v for f in found for v in f[i]], types[i]) if pa.types.is_list(types[i]) else
                               pa.array(np.concatenate([np.asarray(f[i], types[i].to_pandas_dtype()) for f in found]), types[i]) for i in range(len(types))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the values' slots: at most SLOTS / 64 longs reach the driver, 8 MB whatever the input."""
    slot = F.pmod(F.col(column), F.lit(SLOTS))
    words = keys.select((slot / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    out = np.zeros(SLOTS // 64, np.int64)
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h % SLOTS).astype(np.uint64)
    return (bits[slot // BITS] >> (slot % BITS)) & np.uint64(1) == 1


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, at least n of them; kept for the next text."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 4096), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.cumprod(held, dtype=np.uint64)
    return held


class Spans:
    """Hashes of spans of a text's words: two polynomials modulo 2^64, whose prefix sums are taken once for all spans."""

    def __init__(self, words: np.ndarray):
        self.words, self.sums = words, {}

    def polynomial(self, base: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(self.words)
        if base not in self.sums:
            self.sums[base] = np.zeros(n + 1, np.uint64)
            np.cumsum(self.words * powers(base, n)[:n], out=self.sums[base][1:])
        sums = self.sums[base]
        return mix((sums[starts + sizes] - sums[starts]) * powers(INVERSES[base], n + 1)[starts] + sizes.astype(np.uint64))

    def first(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.polynomial(BASES[0], starts, sizes).view(np.int64)

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, second hash) of each span."""
        second = self.polynomial(BASES[1], starts, sizes) >> np.uint64(32)
        return self.first(starts, sizes), second.astype(np.uint32).view(np.int32)


def run_blocks(at: np.ndarray, repeated: np.ndarray, n_words: int, run: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, starts) of blocks: starts of runs that hold a repeated stretch, cut where any stretch starts.

    Stretches that overlap or touch are one chain; the starts between count as well.
    """
    again = at[repeated]
    if not len(again):
        return again, again
    cuts = np.flatnonzero(np.diff(again) > stretch) + 1
    lows = np.maximum(0, again[np.concatenate([[0], cuts])] - run + stretch)
    highs = np.minimum(again[np.concatenate([cuts - 1, [-1]])], n_words - run) + 1
    some = lows < highs
    starts = np.flatnonzero(covered(lows[some], (highs - lows)[some], n_words))
    piece = np.searchsorted(at, starts, "right")
    cuts = np.flatnonzero((np.diff(piece) != 0) | (np.diff(starts) != 1)) + 1
    cuts = np.concatenate([[0], cuts])[:len(starts)].astype(np.int64)
    return starts[cuts], np.diff(np.append(cuts, len(starts)))


def looked_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with their row of ``found`` by (h1, h2); ``found`` has the count ``n`` of each key's rows.

    Keys with more than a ``HOT``-th of all rows, fewer than ``HOT`` of them whatever the input, are sent to
    the rows; all others have few rows a key and meet by a shuffle.
    """
    total = rows.count()
    hot = found.where(F.col("n") * HOT > total)
    spread = rows.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    return rows.join(F.broadcast(hot), ["h1", "h2"]).unionByName(spread.join(found.where(F.col("n") * HOT <= total), ["h1", "h2"]))


def shared(rows: DataFrame) -> DataFrame:
    """(h1, h2, keeper, last, n): first and last document of each text."""
    return rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


def speaker(h1: str, doc: str) -> Column:
    """One long for a text and the document that speaks for it."""
    return F.col(h1).bitwiseXOR(F.col(doc)).alias("slot")


def repeated_runs(blocks: DataFrame, classes: DataFrame, runs: DataFrame, run: int) -> DataFrame:
    """(doc_id, start, words, keeper): places of all runs of words that stand in two documents or more.

    A block that stands in a smaller document is decided as a whole.  The runs
    of all other blocks are in ``runs``, and so are each run's smallest
    document and, but for one case, a second one: a document may hold a run
    twice, once in a block that it speaks for and once elsewhere.  Runs that
    only one document placed, and more than once, therefore look at the
    documents of their blocks.  A longer passage is the union of its runs.
    """
    whole = looked_up(blocks, classes.where("keeper < last"))
    whole = whole.select("doc_id", "start", (F.col("words") + run - 1).alias("words"), "keeper")
    many = written(shared(runs).where("n > 1"), "repeated-runs")
    bits = runs.sparkSession.sparkContext.broadcast(bit_table(many, "h1"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_table(bits.value, b.column("h1").to_numpy())))

    met = written(looked_up(runs.mapInArrow(known, runs.schema), many), "met-runs")
    single = met.where("keeper = last")
    other = classes.where("keeper < last").select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    held = single.join(other, ["b1", "b2"]).select("h1", "h2").distinct()
    ends = met.where("keeper < last").unionByName(single.join(held, ["h1", "h2"], "left_semi").select(met.columns))
    return whole.unionByName(ends.select("doc_id", "start", F.lit(run).alias("words"), "keeper"))


def connected(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """Component number of each set under Jaccard similarity ``least`` or more.

    Grows one component at a time: each member is compared with all sets that
    are in no component yet, which is every comparison that can matter.
    Sets of one side of two aren't compared; a side of -1 is compared with all.
    """
    sizes = np.array([len(s) for s in sets])
    flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    label, number = np.full(len(sets), -1), 0
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed], queue = number, [seed]
        while queue:
            i = queue.pop()
            open_ = np.flatnonzero((label < 0) & ((side < 0) | (side != side[i])))
            open_ = open_[np.minimum(sizes[open_], sizes[i]) >= least * np.maximum(sizes[open_], sizes[i])]
            if not len(open_):
                continue
            if 2 * len(open_) > len(sets):
                shared = np.add.reduceat(np.isin(flat, sets[i]), start)[open_]
            else:
                part = np.concatenate([sets[j] for j in open_])
                shared = np.add.reduceat(np.isin(part, sets[i]), np.concatenate([[0], np.cumsum(sizes[open_])])[:-1])
            new = open_[shared >= least * (sizes[open_] + sizes[i] - shared)]
            label[new] = number
            queue += new.tolist()
        number += 1
    return label


def line_bands(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Classes in the band buckets that they share with others (h1, h2, key, blocks), and each bucket's (key, n, blocks)."""
    banded = classes.select("h1", "h2", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "line-bands")
    return written(banded.join(sizes.drop("n"), "key"), "line-members"), sizes


def near_lines(lines: DataFrame, classes: DataFrame, members: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, start, words, keeper): every long line with an equal or similar line in another document."""
    # The id of a class in the graph; two classes with equal h1 would be one node, a chance of 2^-64 a pair.
    sets = sets.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    mine = F.pmod(F.col("h2"), F.col("blocks"))
    grid = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = grid.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).join(sets, ["h1", "h2"])

    def verify(t: pa.Table) -> pa.Table:
        """Each block pair of a band bucket by itself; a task gets a few hundred rows of them at once."""
        h, key, lo, hi, mine = (t.column(c).to_numpy() for c in ("h1", "key", "lo", "hi", "mine"))
        sets_ = [s.values.to_numpy() for s in t.column("shingles")]
        order = np.lexsort((hi, lo, key))
        same = (np.diff(key[order]) == 0) & (np.diff(lo[order]) == 0) & (np.diff(hi[order]) == 0)
        low = h.copy()
        for part in np.split(order, np.flatnonzero(~same) + 1):
            side = np.full(len(part), -1) if lo[part[0]] == hi[part[0]] else (mine[part] == hi[part]).astype(int)
            label = connected([sets_[i] for i in part], side, similarity)
            least = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, label, h[part])
            low[part] = least[label]
        linked = low != h
        return pa.table([pa.array(h[linked]), pa.array(low[linked])], ["a", "b"])

    # Rows as the verification gets them: each member once per block of its bucket.
    slots = max(1, (sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // 500)
    slot = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(slots)).alias("slot")
    edges = grid.groupBy(slot).applyInArrow(verify, "a long, b long")
    comp = components(edges)
    of = classes.select("h1", "h2", "n", "first", "last").join(comp, classes.h1 == comp.node, "left")
    of = written(of.select("h1", "h2", "n", "first", "last", F.coalesce("component", "h1").alias("component")), "line-components")
    groups = of.groupBy("component").agg(F.min("first").alias("keeper"), F.max("last").alias("last")).where("keeper < last").drop("last")
    kept = written(of.join(groups, "component").select("h1", "h2", "n", "keeper"), "line-keepers")
    return looked_up(lines, kept).select("doc_id", "start", "words", "keeper")


SPANS = "doc_id long, n_passages long, repeated_words long, removed_words long, spans array<struct<start:int,words:int,removed:boolean>>"


def covered(starts: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Which words of a document lie in one of the spans."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + words, -1)
    return step.cumsum()[:-1] > 0


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _merge(places: DataFrame) -> DataFrame:
    """One row per document: its repeated runs and lines, joined where they touch; bounded by the document's length."""
    span = F.struct("start", "words", (F.col("doc_id") != F.col("keeper")).alias("removed"))
    per = places.groupBy("doc_id").agg(F.collect_list(span).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans = [], []
            for doc, found in zip(b.column(0).to_pylist(), b.column(1)):
                start, words, removed = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                length = int((start + words).max())
                gone = covered(start[removed], words[removed], length)
                state = np.where(gone, 2, covered(start, words, length).astype(int))
                cuts = [0, *(np.flatnonzero(np.diff(state)) + 1).tolist(), length]
                ids.append(doc)
                spans.append([{"start": x, "words": y - x, "removed": bool(state[x] == 2)} for x, y in zip(cuts, cuts[1:]) if state[x]])
            total = [sum(s["words"] for s in x) for x in spans]
            removed = [sum(s["words"] for s in x if s["removed"]) for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("removed", pa.bool_())]))
            arrays = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in ([len(x) for x in spans], total, removed)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SPANS.split(", ")])

    return per.mapInArrow(run, SPANS)


def repeated_passages(docs: DataFrame, min_words: int = 50, stretch: int = 30, similarity: float = 0.8, bands: int = 8, rows: int = 4,
                      block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares a passage with another: doc_id, n_passages, repeated_words, removed_words, spans.

    ``spans`` are stretches of words (first word, words) that stand in another
    document as well; ``removed`` ones have a copy in a document with a smaller
    id and go, the others are what is kept.  Found are all verbatim runs of
    more than ``min_words`` words up to their first and last word, and longer
    lines with a similar line elsewhere; a line at Jaccard 0.8 is missed with a chance of
    1.5 %.  Shorter runs aren't reported.

    Null and empty texts hold nothing; rows without an id take no part; rows
    that repeat an id are one document; repeats inside one document aren't
    repeats across documents.  An empty table gives an empty result; other
    columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    send, run = docs.sparkSession.sparkContext.broadcast, min_words + 1

    def cut(doc: int, text: str):
        w = word_hashes(text)
        at = stretches(w, grams(w), min_words, stretch)
        return *Spans(w).hashes(at, np.full(len(at), stretch)), np.full(len(at), doc)

    h, place = [pa.int64(), pa.int32(), pa.int64()], [pa.int32(), pa.int32()]
    counted = shared(_map(picked, "h1 long, h2 int, doc_id long", h, cut))
    bits = send(bit_table(written(counted.where("keeper < last").select("h1"), "repeated-stretches"), "h1"))

    def blocks_of(w: np.ndarray, g: np.ndarray, spans: Spans):
        at = stretches(w, g, min_words, stretch)
        first, n = run_blocks(at, in_table(bits.value, spans.first(at, np.full(len(at), stretch))), len(w), run, stretch)
        return first, n, *spans.hashes(first, n + run - 1)

    def describe(doc: int, text: str):
        w = word_hashes(text)
        g = grams(w)
        first, n, b1, b2 = blocks_of(w, g, Spans(w))
        lines = long_lines(text, run)
        h1, h2 = line_hashes(w, lines)
        keys = [None] * len(first) + band_keys(g, lines, bands, rows)
        starts, sizes = np.concatenate([first, [a for a, _ in lines]]), np.concatenate([n, [k for _, k in lines]])
        return np.concatenate([b1, h1]), np.concatenate([b2, h2]), np.full(len(keys), doc), starts, sizes, keys

    described = _map(picked, "h1 long, h2 int, doc_id long, start int, words int, keys array<long>", [*h, *place, pa.list_(pa.int64())], describe)
    described = written(described, "blocks-and-lines")
    blocks = described.where("keys IS NULL").drop("keys")
    lines = described.where("keys IS NOT NULL")
    block_classes = written(shared(blocks), "block-classes")
    speaks = send(bit_table(block_classes.select(speaker("h1", "keeper")), "slot"))
    # One class per text; classes are what is banded, so copies of a line meet nobody.
    per = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    classes = written(per, "line-classes")
    members, sizes = line_bands(classes, block)
    alike = members.select("h1", "h2").distinct().join(classes.select("h1", "h2", "first"), ["h1", "h2"])
    asked = send(bit_table(alike.select(speaker("h1", "first")), "slot"))

    def single(doc: int, text: str):
        w = word_hashes(text)
        g = grams(w)
        held = Spans(w)
        first, n, b1, b2 = blocks_of(w, g, held)
        mine = in_table(speaks.value, b1 ^ doc)
        first, n, b1, b2 = first[mine], n[mine], b1[mine], b2[mine]
        starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        h1, h2 = held.hashes(starts, np.full(len(starts), run))
        spans = long_lines(text, run)
        l1, l2 = line_hashes(w, spans)
        some = np.unique(l1, return_index=True)[1]
        some = some[in_table(asked.value, l1[some] ^ doc)]
        sets = [np.unique(g[a:a + k - SHINGLE + 1]).view(np.int64) for a, k in (spans[i] for i in some)]
        none = np.zeros(len(some), np.int64)
        return (np.concatenate([h1, l1[some]]), np.concatenate([h2, l2[some]]), np.full(len(starts) + len(some), doc), np.concatenate([starts, none]),
                np.concatenate([np.repeat(b1, n), none]), np.concatenate([np.repeat(b2, n), none]), [None] * len(starts) + sets)

    placed = _map(picked, "h1 long, h2 int, doc_id long, start int, b1 long, b2 int, shingles array<long>",
                  [*h, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())], single)
    placed = written(placed, "runs-and-shingles")
    runs = placed.where("shingles IS NULL").drop("shingles")
    sets = placed.where("shingles IS NOT NULL").select("h1", "h2", "shingles")
    found = repeated_runs(blocks, block_classes, runs, run)
    return _merge(found.unionByName(near_lines(lines.drop("keys"), classes, members, sizes, sets, similarity)))
