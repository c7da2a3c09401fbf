"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has bit i set if more than half of its word shingles
have it set in their XXH64.  Two fingerprints link at Hamming distance d or
less.  The 64 bits are cut into m segments on a ring.  If the differences over
all segments sum to at most d, some segment starts a chain whose every prefix
of j segments differs in at most j*d/m bits.  The first c segments of such a
chain, c the largest number with c*d/m < 1, then agree exactly: they are the
join key of that rotation, and the rest of the chain is tested, prefix by
prefix, before the full Hamming check.

Only distinct fingerprints are compared.  A bucket of more than ``dense``
distinct fingerprints is not paired: its members are grouped by a common
point at distance one (at most 65 members a point, whatever the bucket's
size), which links exactly the same pairs in a star.  So the work grows with
the number of distinct fingerprints and not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import components, written

SEED = 42
BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of a text; 0 for one without words."""
    parts = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    shingles = [b" ".join(parts[i:i + words]) for i in range(n)] if words != 3 or n == 1 else [
        b"%b %b %b" % t for t in zip(parts, parts[1:], parts[2:])]
    digest = xxhash.xxh64_intdigest
    return fingerprint_of((np.array([digest(s, SEED) for s in shingles[at:at + (1 << 16)]], np.uint64) for at in range(0, n, 1 << 16)), n)


def fingerprint_of(hashes: Iterable[np.ndarray], n: int) -> int:
    """Signed 64-bit SimHash of ``n`` hashes in several arrays: bit i is set if more than half of them have it; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for part in hashes:
        for at in range(0, len(part), 1 << 12):  # bounds memory for very long texts
            ones += np.unpackbits(part[at:at + (1 << 12)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return picked.mapInArrow(run, "doc_id long, fp long")


def segments_of(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by at most one."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(c: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, max_distance: int = 2, segments: int = 5, dense: int = 64) -> DataFrame:
    """(a, b) edges among distinct fingerprints ``fp`` that connect all pairs within ``max_distance`` (1 or 2).

    Pairs inside dense buckets may be linked through others of the same
    bucket; every edge is a true link.
    """
    if max_distance not in (1, 2) or segments <= max_distance:
        raise ValueError("max_distance is 1 or 2, and there are more segments than that")
    cut = segments_of(segments)
    exact = -(-segments // max_distance) - 1  # chain segments with no difference
    keys = []
    for r in range(segments):
        key = F.lit(0).cast("long")
        for j in range(exact):
            first, width = cut[(r + j) % segments]
            key = F.shiftleft(key, width).bitwiseOR(_part(F.col("fp"), first, width))
        keys.append(F.struct(F.lit(r).alias("rot"), key.alias("key")))
    keyed = written(prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.rot", "k.key"), "segment-keys")
    sizes = written(keyed.groupBy("rot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "segment-buckets")

    few = keyed.join(sizes.where(F.col("n") <= dense).select("rot", "key"), ["rot", "key"], "left_semi")
    left = few.select("rot", "key", F.col("fp").alias("a"))
    right = few.select("rot", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for r in range(segments):
        ok, so_far = F.col("rot") == r, F.lit(0)
        for j in range(exact, segments - 1):
            so_far = so_far + F.bit_count(_part(differ, *cut[(r + j) % segments]))
            ok = ok & (so_far <= (j + 1) * max_distance // segments)
        chain = chain | ok
    pairs = left.join(right, ["rot", "key"]).where(F.col("a") < F.col("b")).where(chain).where(F.bit_count(differ) <= max_distance)

    many = keyed.join(sizes.where(F.col("n") > dense).select("rot", "key"), ["rot", "key"], "left_semi").select("fp").distinct()
    flips = [F.lit(1 << i if i < BITS - 1 else -(1 << i)) for i in range(BITS)]
    if max_distance == 2:  # f and g are within two bits if they share a point within one bit of both
        points = [F.struct(F.lit(0).alias("bit"), F.col("fp").alias("point"))] + [
            F.struct(F.lit(0).alias("bit"), F.col("fp").bitwiseXOR(m).alias("point")) for m in flips]
    else:  # within one bit if they agree with that bit cleared
        points = [F.struct(F.lit(i).alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not(m)).alias("point")) for i, m in enumerate(flips)]
    near = many.select("fp", F.explode(F.array(*points)).alias("p")).groupBy("p").agg(F.collect_list("fp").alias("near"))
    near = near.where(F.size("near") > 1)  # at most 65 members
    stars = near.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a < b")
    return pairs.select("a", "b").union(stars)


def simhash_groups(docs: DataFrame, words: int = 3, max_distance: int = 2, segments: int = 5, dense: int = 64,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document.

    ``component_id`` is the smallest id reachable over links.  A null or empty
    text has fingerprint zero and links like any other.  Repeated rows give
    repeated results; a null id never becomes a component id unless a
    component has no other.  An empty table gives an empty result; other
    columns are ignored.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    comp = components(links(classes.select("fp"), max_distance, segments, dense))
    roots = classes.join(comp, classes.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    roots = written(roots, "fingerprint-roots")
    low = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(roots.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents without all but one of each group (doc_id, component_id): the row with the smallest id stays.

    Rows without an id stay (they can't be told apart).  Rows that repeat the
    smallest id with its text become one; with another text they stay.
    """
    stays = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def keep_one(docs: DataFrame, words: int = 3, **options) -> DataFrame:
    """The documents without all but one of each group of near fingerprints."""
    return keep_smallest(docs, simhash_groups(docs, words, **options))
