"""Exact top-k inner products with vector-approximation files.

Vectors are dealt to files of bounded size.  A file keeps, next to the exact
vectors, the cell of every component on a grid of 2^bits cells per dimension.
For a query, the cells give an upper and a lower bound of every inner product;
exact vectors are then read in order of their upper bound until the kth best
exact score is above every bound that is left.  Queries meet files in blocks,
and each block hands on its k best only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(wide) > 0) & ~bad, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


class VAFile:
    """Cells, grid and exact rows of one file."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, bits: int = 5):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        self.low = self.exact.min(axis=0)
        span = self.exact.max(axis=0) - self.low + 1
        self.width = -(-span // (1 << bits))  # whole numbers in a cell
        self.cells = ((self.exact - self.low) // self.width).astype(np.uint8)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products (queries, rows), from cells alone.

        Sums of products stay whole in a double below 2^53.
        """
        floor = (self.low + self.cells * self.width).astype(np.float64)
        base = q @ floor.T
        step = (self.width - 1).astype(np.float64)
        up = np.where(q > 0, q, 0) @ step
        down = np.where(q < 0, q, 0) @ step
        return base + down[:, None], base + up[:, None]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, chunk: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, file row, score) of the k best rows per query, the query's own id left out; ties to smaller ids."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), 256):
            q = queries[at:at + 256]
            lower, upper = self.bounds(q.astype(np.float64))
            own = self.ids[None, :] == query_ids[at:at + 256, None]
            lower[own] = upper[own] = -np.inf
            n = lower.shape[1]
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                open_ = np.flatnonzero((upper[i] >= kth[i]) & ~own[i])
                open_ = open_[np.argsort(-upper[i, open_], kind="stable")]
                score, seen = np.zeros(len(open_), np.int64), 0
                while seen < len(open_):
                    if seen >= k and np.partition(score[:seen], seen - k)[seen - k] > upper[i, open_[seen]]:
                        break  # no row that is left can reach the kth score
                    part = open_[seen:seen + chunk]
                    score[seen:seen + len(part)] = self.exact[part] @ q[i]
                    seen += len(part)
                best = np.lexsort((open_[:seen], -score[:seen]))[:k]  # rows are in id order
                found.append((np.full(len(best), at + i), open_[best], score[best]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE, bits: int = 5, file_rows: int = 16_384,
          query_rows: int = 8_192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the largest integer inner product per row of ``queries``.

    Both frames hold an id and a vector, whose components become
    floor(scale * x).  Vectors that are null, empty or hold a null or
    non-finite component, and rows without an id, take no part.  A query meets
    vectors of its own length only and never rows with its own id.  Rows that
    repeat an id are candidates one by one; repeated queries are asked once
    (of several vectors under one id, the smallest).  Fewer than k rows give
    fewer ranks; an empty table gives an empty result.

    A vector travels once per block of queries and a query once per file, so
    blocks are large; a task holds one of each and bounds for 256 queries,
    some 100 MB at the defaults.
    """

    def part(df: DataFrame) -> DataFrame:
        df = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        return df.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"))

    rows = part(vectors)
    asked = part(queries).groupBy("id").agg(F.min("v").alias("v"))
    files = max(1, -(-vectors.count() // file_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    rows = rows.withColumn("file", F.pmod(F.xxhash64("id", "v"), F.lit(files)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("file", F.explode(F.sequence(F.lit(0), F.lit(files - 1))))
    keys = ["len", "file", "block"]
    rows, asked = (x.withColumn("len", F.size("v")).select(*keys, "id", "v") for x in (rows, asked))

    def search(q: pa.Table, f: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not q.num_rows or not f.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        width = q.column("len")[0].as_py()
        file = VAFile(f.column("id").to_numpy(), _matrix(f.column("v"), width), bits)
        ids = q.column("id").to_numpy()
        who, row, score = file.search(ids, _matrix(q.column("v"), width), k)
        return pa.table([pa.array(ids[who]), pa.array(file.ids[row]), pa.array(score)], names)

    near = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
