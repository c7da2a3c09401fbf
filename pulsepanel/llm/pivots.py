"""Embedding near-duplicates with a pivot-permutation index.

A fixed set of reference points orders itself around every vector; the nearest
few, in order, describe it.  Inverted lists hold, for every pair of pivots,
the vectors that have both among their nearest, so two vectors that meet in a
list share at least two pivots.  Pairs that meet are verified by exact cosine;
a pair counts in the list of its two smallest shared pivots only.

Equal vectors of one label are one class and never compared with each other.
Lists longer than a block are compared block by block, and a block hands on
one row per vector (its links and its local component), never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.llm.common import components, written
from pulsepanel.llm.vafile import usable


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    big = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / big  # keeps squares of very large and very small components finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Up to ``count`` distinct unit vectors per vector length, those with the smallest hash of the vector."""
    picked = vectors.select("v", F.size("v").alias("len"), F.xxhash64("v").alias("h")).dropDuplicates(["len", "h"])
    place = F.row_number().over(Window.partitionBy("len").orderBy("h"))
    out: dict[int, list] = {}
    for r in picked.withColumn("n", place).where(F.col("n") <= count).orderBy("len", "h").collect():
        out.setdefault(r["len"], []).append(r["v"])
    return {n: unit(np.array(v, np.float64)) for n, v in out.items()}


def nearest(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit row, nearest first; ties to smaller numbers."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :prefix]


def compare(a: np.ndarray, b: np.ndarray, near_a: np.ndarray, near_b: np.ndarray, key: tuple[int, int], least: float,
            same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(linked, counted): boolean matrices of pairs at or above ``least``, and of those whose two smallest shared pivots are the key."""
    linked = a @ b.T >= least
    if same:
        np.fill_diagonal(linked, False)
    counted = linked.copy()
    if key[0] != key[1]:
        i, j = np.nonzero(linked)
        for at in range(0, len(i), 1 << 18):
            x, y = near_a[i[at:at + (1 << 18)]], near_b[j[at:at + (1 << 18)]]
            shared = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max)
            low = np.sort(shared, axis=1)[:, :2]
            counted[i[at:at + (1 << 18)], j[at:at + (1 << 18)]] = (low[:, 0] == key[0]) & (low[:, 1] == key[1])
    return linked, counted


def local_roots(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside the block, for both sides."""
    top = np.iinfo(np.int64).max
    la, lb = ids_a.copy(), ids_b.copy()
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1, initial=top))
        nb = np.minimum(lb, np.where(linked, na[:, None], top).min(axis=0, initial=top))
        if (na == la).all() and (nb == lb).all():
            return na, nb
        la, lb = na, nb


def links(classes: DataFrame, least: float, pivots: int, prefix: int, block: int) -> DataFrame:
    """(cid, h1, h2, links, root) per class, block and list with a link, from (cid, h1, h2, label, v, copies).

    A pair has to share two of its ``prefix`` nearest pivots; where fewer than
    two pivots exist, all classes of a label stand in one list.
    """
    shared = classes.sparkSession.sparkContext.broadcast(choose_pivots(classes, pivots))  # at most ``pivots`` vectors per length

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(n) for n in b.schema.names}
            sizes = np.diff(column["v"].offsets.to_numpy())
            keys: list[list[int]] = [[] for _ in range(b.num_rows)]
            prefixes: list[list[int]] = [[] for _ in range(b.num_rows)]
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                rows = column["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                near = nearest(unit(rows), shared.value[int(n)], prefix)
                for i, p in zip(at, near.tolist()):
                    prefixes[i] = p
                    low = sorted(p)
                    keys[i] = [x << 32 | y for x, y in combinations(low, 2)] or [0]
            more = [pa.array(prefixes, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "near", "keys"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    lists = written(classes.mapInArrow(describe, f"{kept}, near array<int>, keys array<long>"), "pivot-prefixes")
    listed = lists.withColumn("key", F.explode("keys")).drop("keys").withColumn("len", F.size("v"))
    group = ["label", "len", "key"]
    sizes = lists.select("label", F.size("v").alias("len"), F.explode("keys").alias("key")).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "pivot-lists")
    listed = listed.join(sizes, group)
    # A row of block m stands on one side of the block pairs (m, m..) and on the other of (..m, m).
    mine = F.pmod(F.xxhash64("cid", "h1"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    listed = listed.withColumn("mine", mine).withColumn("other", other)
    listed = listed.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))

    def verify(t: pa.Table) -> pa.Table:
        """Each block pair of a list by itself; a task gets a few thousand rows of them at once."""
        n = t.column("len")[0].as_py()
        flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks]).to_numpy(zero_copy_only=False)
        rows = unit(flat.reshape(-1, n))
        near = pa.concat_arrays([c.flatten() for c in t.column("near").chunks]).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        cid, copies, mine, key, lo, hi = (t.column(c).to_numpy() for c in ("cid", "copies", "mine", "key", "lo", "hi"))
        label = np.unique(t.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((hi, lo, key, label))
        steps = [np.diff(x[order]) != 0 for x in (label, key, lo, hi)]
        count, root, found = np.zeros(len(rows), np.int64), cid.copy(), np.zeros(len(rows), bool)
        for part in np.split(order, np.flatnonzero(np.any(steps, axis=0)) + 1):
            k, low, high = int(key[part[0]]), lo[part[0]], hi[part[0]]
            a, b = part[mine[part] == low], part[mine[part] == high]
            linked, counted = compare(rows[a], rows[b], near[a], near[b], (k >> 32, k & 0xFFFFFFFF), least, low == high)
            if not linked.any():
                continue
            count[a] = counted @ copies[b]
            root[a], root_b = local_roots(linked, cid[a], cid[b])
            found[a] = linked.any(axis=1)
            if low != high:
                count[b] = copies[a] @ counted
                root[b] = root_b
                found[b] = linked.any(axis=0)
        keep = pa.array(found)
        out = [t.column(c).filter(keep) for c in ("cid", "h1", "h2")] + [pa.array(count[found]), pa.array(root[found])]
        return pa.table(out, ["cid", "h1", "h2", "links", "root"])

    slots = max(1, lists.count() * (prefix * (prefix - 1) // 2) // 4000)
    slot = F.pmod(F.xxhash64("label", "key", "lo", "hi"), F.lit(slots)).alias("slot")
    return listed.groupBy("len", slot).applyInArrow(verify, "cid long, h1 long, h2 long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.93, pivots: int = 128, prefix: int = 5, block: int = 2048,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows of equal, non-null label link at cosine ``least`` or more, in double
    precision.  Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without an id, link with nothing: they have
    no links and are their own component.  Vectors of different length never
    link.  Repeated rows link with each other like any equal vectors.  The
    index is approximate: pairs that share fewer than two of their ``prefix``
    nearest pivots are missed; what is linked is always verified.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    hashed = rows.where("good").select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(7), "v", "label").alias("h2"))
    classes = written(hashed.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("cid"), F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    found = written(links(classes.select("cid", "h1", "h2", "label", "v", "copies"), least, pivots, prefix, block), "vector-links")
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    result = (
        classes.join(counts, ["h1", "h2"], "left").join(comp, classes.cid == comp.node, "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    linked = hashed.select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
