"""Near-duplicate documents: five-word shingles at Jaccard similarity 0.8.

A document is the set of its word 5-shingles; one of fewer words is a single
shingle.  Exact Jaccard similarity of whole sets decides every link; the
candidates come from SimHash.  The 64-bit fingerprints of the sets are joined
by pigeonring segments within two bits (``simhash.links``), which finds the
copies with few edits and joins them to groups.

Similarity 0.8 shows as some ten bits, where no segment is selective.  So
MinHash bands look for what two bits leave: pairs of different groups only.  A
pair at similarity s agrees in no band with a chance of (1 - s^rows)^bands: 3
in 100,000 at 0.8 for 20 bands of 4 rows.

Equal sets are one class.  In every band bucket all classes are first compared
with the smallest one, which joins groups of near copies without pairing them.
Only buckets that still hold several components are compared in full: pair by
pair up to ``dense`` classes, else block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import components, written
from pulsepanel.llm.passages import band_keys, bit_table, connected, grams, in_table
from pulsepanel.llm.simhash import fingerprint_of, keep_smallest, links

SHINGLE = 5


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the word 5-shingles; words part at ASCII white space, A-Z count as a-z."""
    parts = (text or "").encode().lower().split()
    words = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts)), np.uint64)
    if 0 < len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(words.tobytes(), len(words))], np.uint64)
    return np.unique(grams(words))


def class_of(found: np.ndarray) -> int:
    """Signed hash of a set; two classes with an equal one would be one, a chance of 2^-64 a pair."""
    return xxhash.xxh64_intdigest(found.tobytes(), 3) - (1 << 63)


def near_fingerprints(classes: DataFrame) -> DataFrame:
    """(a, b) candidate pairs of classes (h, n, fp): the smallest class of a fingerprint with its others, and those of fingerprints within two bits."""
    heads = written(classes.groupBy("fp").agg(F.min(F.struct("h", "n")).alias("head"), F.count(F.lit(1)).alias("held")), "neardup-fingerprints")
    same = classes.join(heads.where("held > 1"), "fp").select(F.col("head.h").alias("a"), F.col("h").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
    at_a = heads.select(F.col("fp").alias("a"), F.col("head").alias("one"))
    at_b = heads.select(F.col("fp").alias("b"), F.col("head").alias("two"))
    near = links(heads.select("fp")).join(at_a, "a").join(at_b, "b").select(
        F.col("one.h").alias("a"), F.col("two.h").alias("b"), F.col("one.n").alias("n_a"), F.col("two.n").alias("n_b"))
    return same.where("a <> b").unionByName(near)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b, ...) whose two classes are similar."""
    first, second = sets.select(F.col("h").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("h").alias("b"), F.col("shingles").alias("t"))
    shared, both = F.size(F.array_intersect("s", "t")), F.size("s") + F.size("t")
    linked = F.exists(F.array(shared), lambda n: n >= F.lit(similarity) * (both - n))  # counts the shared ones once
    return pairs.join(first, "a").join(second, "b").where(linked).select(*pairs.columns)


def linked_blocks(members: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b) edges among the components of large buckets, each pair of blocks by itself; columns key, h, comp and key, n."""
    sizes = written(sizes.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "neardup-blocks")
    rows = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    grid = members.join(sizes.drop("n"), "key").withColumn("mine", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    grid = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = grid.select("key", "h", "comp", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).join(sets, "h")

    def verify(t: pa.Table) -> pa.Table:
        key, lo, hi, mine, comp = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "mine", "comp"))
        found = [s.values.to_numpy() for s in t.column("shingles")]
        order = np.lexsort((hi, lo, key))
        same = (np.diff(key[order]) == 0) & (np.diff(lo[order]) == 0) & (np.diff(hi[order]) == 0)
        low = comp.copy()
        for part in np.split(order, np.flatnonzero(~same) + 1):
            side = np.full(len(part), -1) if lo[part[0]] == hi[part[0]] else (mine[part] == hi[part]).astype(int)
            label = connected([found[i] for i in part], side, similarity)
            least = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, label, comp[part])
            low[part] = least[label]
        linked = low != comp
        return pa.table([pa.array(comp[linked]), pa.array(low[linked])], ["a", "b"])

    slot = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(1, rows // 500))).alias("slot")
    return grid.groupBy(slot).applyInArrow(verify, "a long, b long")


def near_duplicate_groups(docs: DataFrame, similarity: float = 0.8, bands: int = 20, rows: int = 4, dense: int = 64, block: int = 1024,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every document.

    ``component_id`` is the smallest id reachable over pairs of Jaccard
    similarity ``similarity`` or more.  Texts without a word are alike.
    Repeated rows give repeated results; a null id never becomes a component
    id unless a component has no other.  An empty table gives an empty result;
    other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                h, n, fps, keys = [], [], [], []
                for text in b.column(1):
                    found = shingle_set(text.as_py())
                    h.append(class_of(found))
                    n.append(len(found))
                    fps.append(fingerprint_of([found], len(found)))
                    keys.append(band_keys(found, [(0, len(found) + SHINGLE - 1)], bands, rows)[0] if len(found) and bands else [])
                arrays = [b.column(0), pa.array(h, pa.int64()), pa.array(n, pa.int32()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "n", "fp", "keys"])

    def may(a: str, b: str):
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)

    described = written(picked.mapInArrow(describe, "doc_id long, h long, n int, fp long, keys array<long>"), "neardup-documents")
    classes = written(described.groupBy("h").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "neardup-classes")
    near = written(near_fingerprints(classes.select("h", "n", "fp")).where(may("n_a", "n_b")).select("a", "b").distinct(), "neardup-near")
    banded = classes.select("h", "n", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("h", "n")).alias("first")).where("held > 1")
    buckets = written(buckets.select("key", F.col("first.h").alias("first"), F.col("first.n").alias("first_n")), "neardup-buckets")
    members = written(banded.join(buckets, "key"), "neardup-members")
    asked = members.select("h").union(near.select("a")).union(near.select("b")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(asked, "h"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    found = [shingle_set(text.as_py()) for text in b.column(1).slice(at, 500)]
                    h = np.array([class_of(s) for s in found], np.int64)
                    known = np.flatnonzero(in_table(bits.value, h))
                    arrays = [pa.array(h[known]), pa.array([found[i].view(np.int64) for i in known], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["h", "shingles"])

    # One row a class; the bit table only saves work, the joins with candidates drop what else it lets pass.
    sets = written(picked.mapInArrow(again, "h long, shingles array<long>").groupBy("h").agg(F.first("shingles").alias("shingles")), "neardup-sets")

    comp = written(components(verified(near, sets, similarity)), "neardup-linked")
    stars = members.where(F.col("h") != F.col("first")).where(may("n", "first_n")).select(F.col("first").alias("a"), F.col("h").alias("b")).distinct()
    for end in ("a", "b"):  # pairs of one SimHash group are linked already
        stars = stars.join(comp.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        stars = stars.withColumn(f"comp_{end}", F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    edges = verified(written(stars.where("comp_a <> comp_b"), "neardup-pairs"), sets, similarity)
    wider = written(components(edges.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))), "neardup-stars")
    labels = classes.select("h", "rep").join(comp.withColumnRenamed("node", "h"), "h", "left").select("h", "rep", F.coalesce("component", "h").alias("node"))
    labels = labels.join(wider, "node", "left").select("h", "rep", F.coalesce("component", "node").alias("comp"))
    labels = written(labels, "neardup-labels")
    held = written(members.join(labels.drop("rep"), "h").select("key", "h", "n", "first", "comp"), "neardup-held")
    mixed = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "n")
    mixed = written(mixed, "neardup-mixed")
    few = held.where(F.col("h") != F.col("first")).join(mixed.where(F.col("n") <= dense).select("key"), "key")  # the first has met all others
    left = few.select("key", F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
    right = few.select("key", F.col("h").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    pairs = left.join(right, "key").where("a < b and comp_a <> comp_b").where(may("n_a", "n_b")).select("a", "b", "comp_a", "comp_b").distinct()
    edges = verified(pairs, sets, similarity).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    many = mixed.where(F.col("n") > dense)
    if not many.isEmpty():
        edges = edges.union(linked_blocks(held.select("key", "h", "comp"), many, sets, similarity, block))
    more = components(edges).select(F.col("node").alias("comp"), F.col("component").alias("lower"))
    roots = written(labels.join(more, "comp", "left").select("h", "rep", F.coalesce("lower", "comp").alias("root")), "neardup-roots")
    low = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    return described.select("doc_id", "h").join(roots.join(low, "root").select("h", "component_id"), "h").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each near-duplicate group, as ``simhash.keep_smallest`` chooses."""
    return keep_smallest(docs, near_duplicate_groups(docs, **options))
