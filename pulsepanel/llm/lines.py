"""Line deduplication against a sharded minimal perfect hash.

Line keys are hashed to 128 bits.  Spark counts, per distinct hash, the
documents that hold it and the largest document id.  The hashes of lines to be
removed are dealt to shards by their first bits; every shard becomes one row
holding a minimal perfect hash (levels of bit arrays, ranks by prefix counts)
and flat arrays of fingerprints, counts and keepers in its order.  Documents
then probe these arrays: in place while the whole index is below
``in_memory`` bytes, and otherwise by sending the hashes, without text, to
their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import ASCII_SPACE, written

NO_ID = -(1 << 63)
INDEX = "shard int, sizes array<long>, bits binary, ranks binary, prints binary, counts binary, keepers binary"
FLUSH = 200_000


def key_hashes(lines: list[str], min_chars: int) -> tuple[list[int], np.ndarray]:
    """Positions of the lines whose key is long enough, and their hashes as an (n, 2) array."""
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(ASCII_SPACE)) >= min_chars:
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes.lower touches A-Z only
    return at, np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n, keeper) per distinct line key; columns doc_id and text.

    Each task sums what it has seen before it hands rows to the shuffle, so a
    line that most documents share costs one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(a, b, n, top) for (a, b), (n, top) in seen.items()]
            seen.clear()
            columns = zip(*rows) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["h1", "h2", "n", "keeper"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                _, h = key_hashes((text.as_py() or "").split("\n"), min_chars)
                doc = NO_ID if doc is None else doc
                for k in set(map(tuple, h.tolist())):
                    got = seen.get(k)
                    if got is None:
                        seen[k] = [1, doc]
                    else:
                        got[0] += 1
                        got[1] = max(got[1], doc)
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    part = docs.mapInArrow(run, "h1 long, h2 long, n long, keeper long")
    return part.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash of each (h1, h2) for a level."""
    with np.errstate(over="ignore"):
        x = h[:, 0].view(np.uint64) + h[:, 1].view(np.uint64) * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct (h1, h2) rows.

    At each level the remaining keys fall on a bit array of twice their
    number; those alone on a bit get it, the others go on.  A key's index is
    the number of set bits before its own.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, flags = [], []
        while len(h):
            size = 64 * -(-2 * len(h) // 64)
            spot = (_mix(h, len(sizes)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(spot, minlength=size)
            sizes.append(size)
            flags.append(taken == 1)
            h = h[taken[spot] != 1]
        bits = np.packbits(np.concatenate(flags) if flags else np.zeros(0, bool), bitorder="little")
        ones = np.bitwise_count(bits.view(np.uint64)).astype(np.int64) if len(bits) else np.zeros(0, np.int64)
        return cls(sizes, bits, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))

    def index(self, h: np.ndarray) -> np.ndarray:
        """Index of each key; -1 where no level has a bit for it (never for a key of the set)."""
        out = np.full(len(h), -1, np.int64)
        words, base, left = self.bits.view(np.uint64), 0, np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            spot = (_mix(h[left], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out


def build_index(hot: DataFrame, shards: int) -> DataFrame:
    """One row per shard: perfect hash and arrays of the lines in (h1, h2, n, keeper)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf[["h1", "h2"]].to_numpy(np.int64)
        mph = PerfectHash.build(h)
        order = np.empty(len(h), np.int64)
        order[mph.index(h)] = np.arange(len(h))
        flat = [pdf[c].to_numpy(np.int64)[order].tobytes() for c in ("h2", "n", "keeper")]
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "sizes": [mph.sizes], "bits": [mph.bits.tobytes()], "ranks": [mph.ranks.tobytes()],
            "prints": [flat[0]], "counts": [flat[1]], "keepers": [flat[2]]})

    return hot.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, INDEX)


class Shard:
    """Probe side of one index row."""

    def __init__(self, row):
        self.mph = PerfectHash(list(row["sizes"]), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["ranks"], np.uint32))
        self.prints, self.counts, self.keepers = (np.frombuffer(row[c], np.int64) for c in ("prints", "counts", "keepers"))

    def drops(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """True for each key of the index held by a document that isn't its keeper."""
        i = self.mph.index(h)
        known = i >= 0
        known[known] = self.prints[i[known]] == h[known, 1]
        known[known] = self.keepers[i[known]] != doc[known]
        return known


def _without(lines: list[str], gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines)


def _schema(docs: DataFrame) -> str:
    return f"doc_id long, row {docs.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"


def _rows(batch: pa.RecordBatch, lines: list[int], dropped: list[int], kept: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("row"), *arrays], ["doc_id", "row", "n_lines", "n_dropped", "kept"])


def _probe_in_place(docs: DataFrame, index: DataFrame, shards: int, min_chars: int) -> DataFrame:
    rows = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {r["shard"]: Shard(r) for r in rows.value}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            split = [(t.as_py() or "").split("\n") for t in texts]
            found = [key_hashes(x, min_chars) for x in split]
            h = np.concatenate([x[1] for x in found]) if found else np.zeros((0, 2), np.int64)
            sizes = [len(x[0]) for x in found]
            doc = np.repeat(np.array([NO_ID if d is None else d for d in ids], np.int64), sizes)
            drop = np.zeros(len(h), bool)
            shard = h[:, 0] % shards
            for s in np.unique(shard):
                if s in known:
                    mine = np.flatnonzero(shard == s)
                    drop[mine] = known[s].drops(h[mine], doc[mine])
            gone, at = [], 0
            for (where, _), n in zip(found, sizes):
                gone.append({where[j] for j in np.flatnonzero(drop[at:at + n])})
                at += n
            yield _rows(b, [len(x) for x in split], [len(g) for g in gone], [_without(x, g) for x, g in zip(split, gone)])

    return docs.mapInArrow(run, _schema(docs))


def _probe_by_shard(docs: DataFrame, hot: DataFrame, index: DataFrame, shards: int, min_chars: int, group: int) -> DataFrame:
    """Hashes travel to their shard, hits travel back to their document.

    A shard with lines that very many documents hold is dealt to several
    groups, each with a copy of its small index row.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, h1, h2 = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                _, h = key_hashes((text.as_py() or "").split("\n"), min_chars)
                if len(h):
                    h = np.unique(h, axis=0)
                    docs_ += [doc] * len(h)
                    h1.append(h[:, 0])
                    h2.append(h[:, 1])
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h1, h2)]
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(flat[0]), pa.array(flat[1])], ["doc_id", "h1", "h2"])

    def look(_, probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(probes):
            return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "h1": pd.Series([], dtype="int64"), "h2": pd.Series([], dtype="int64")})
        h = probes[["h1", "h2"]].to_numpy(np.int64)
        doc = probes["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        hit = Shard(rows.iloc[0]).drops(h, doc)
        return pd.DataFrame({"doc_id": probes["doc_id"].astype("Int64")[hit], "h1": h[hit, 0], "h2": h[hit, 1]})

    spread = hot.groupBy(F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).agg((F.sum("n") / group).cast("int").alias("more"))
    probes = docs.select("doc_id", "text").mapInArrow(hashes, "doc_id long, h1 long, h2 long").withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    probes = probes.join(spread, "shard").withColumn("salt", F.pmod(F.hash("doc_id", "h2"), F.col("more") + 1))
    copies = index.join(spread, "shard").select(*index.columns, F.explode(F.sequence(F.lit(0), "more")).alias("salt"))
    hits = probes.drop("more").groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(look, "doc_id long, h1 long, h2 long")
    gone = hits.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))  # at most a document's own lines

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, counts, kept = [], [], []
            for text, gone_ in zip(b.column("text"), b.column("gone").to_pylist()):
                x = (text.as_py() or "").split("\n")
                bad = {(g["h1"], g["h2"]) for g in gone_ or ()}
                where, h = key_hashes(x, min_chars) if bad else ([], np.zeros((0, 2), np.int64))
                out = {i for i, k in zip(where, map(tuple, h.tolist())) if k in bad}
                lines.append(len(x))
                counts.append(len(out))
                kept.append(_without(x, out))
            yield _rows(b, lines, counts, kept)

    both = docs.join(gone, docs.doc_id.eqNullSafe(gone.of), "left").select("doc_id", "text", "row", "gone")
    return both.mapInArrow(drop, _schema(docs))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, shard_lines: int = 65_536, in_memory: int = 64 << 20,
                group: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, kept) per row of ``docs``; struct ``row`` holds its other columns.

    A line whose key (stripped, A-Z lower-cased) has ``min_chars`` code points
    or more and occurs in ``min_docs`` rows or more is dropped everywhere but in
    the row with the largest doc_id that holds it, where all its occurrences
    stay.  A null or empty text is one empty line.  A null id counts as a
    document and as the smallest id; rows that repeat an id count one by one
    and are treated alike.  An empty table gives an empty result.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*rest).alias("row"))
    bare = docs.select("doc_id", "text")
    lines = written(line_counts(bare, min_chars), "lines")
    hot = lines.where(F.col("n") >= min_docs)
    total = lines.agg(F.count(F.when(F.col("n") >= min_docs, 1)).alias("hot"), F.coalesce(F.sum("n"), F.lit(0)).alias("held")).first()
    shards = max(1, -(-total["hot"] // shard_lines))
    in_place = 40 * total["hot"] <= in_memory  # an index takes less than 40 bytes a line
    if not in_place:
        shards = max(shards, -(-total["held"] // group))
    index = written(build_index(hot, shards), "line-index")
    if in_place:
        return _probe_in_place(docs, index, shards, min_chars)
    return _probe_by_shard(docs, hot, index, shards, min_chars, group)


def rewritten(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; ``n_chars``, where there is one, counts the new text.

    A null text becomes empty; all other columns stay as they are.
    """
    done = dedup_lines(docs, text_col=text_col, **options)
    new = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
