"""Cross-product matrices of panels: one pass over the data, small solves after.

A row carries its regressors as one ``array<double>`` column.  ``gram`` sums
x xT per group; everything a least-squares fit needs is then a p x p matrix
per group, however many rows went in.  Each task hands on one partial matrix
per group, so a group that holds most rows costs one array a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = "__x"
SMALL = 6  # up to here the products are plain sum() expressions


def vector(cols: list[Column]) -> Column:
    """Missing entries count as 0, the convention of the fitted models."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def triangle(flat, p: int) -> np.ndarray:
    """Symmetric matrix from its row-wise upper triangle."""
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = flat
    return g + np.triu(g, 1).T


def gram(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, g): upper triangle of sum(x xT) over the rows of each group."""
    if width <= SMALL:
        x = [F.col(VECTOR)[i] for i in range(width)]
        cells = [F.sum(x[i] * x[j]) for i in range(width) for j in range(i, width)]
        return df.groupBy(*keys).agg(F.array(*cells).alias("g"))
    partial = _partials(df.select(*keys, VECTOR), keys, width)
    fields = T.StructType([df.schema[k] for k in keys] + [T.StructField("g", T.ArrayType(T.DoubleType()))])

    def merge(t: pa.Table) -> pa.Table:
        total = _rows(t.column("g"), width * (width + 1) // 2).sum(axis=0)
        return _one_row(t, keys, {"g": pa.array([total], pa.list_(pa.float64()))})

    return partial.groupBy(*keys).applyInArrow(merge, fields)


def segment_grams(df: DataFrame, keys: list[str], segment: str, width: int, head: int = 0) -> DataFrame:
    """(keys, segs, grams): per key the matrix of each segment, in one exchange.

    Segments below ``head`` hold one row a key each; they travel as that row
    and not as its matrix.  ``segment_sums`` tells them apart by length.
    """
    by = [*keys, segment]
    partial = _partials(df.select(*by, VECTOR), by, width, head=head)
    fields = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL("segs array<int>, grams array<array<double>>").fields)

    def merge(t: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        for seg, g in zip(t.column(segment).to_pylist(), t.column("g")):
            g = g.values.to_numpy()
            sums[seg] = sums[seg] + g if seg in sums else g
        segs = sorted(sums)
        return _one_row(t, keys, {"segs": pa.array([segs], pa.list_(pa.int32())),
                                  "grams": pa.array([[sums[s] for s in segs]], pa.list_(pa.list_(pa.float64())))})

    return partial.groupBy(*keys).applyInArrow(merge, fields)


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, width)


def _one_row(t: pa.Table, keys: list[str], values: dict[str, pa.Array]) -> pa.Table:
    return pa.table({k: t.column(k).slice(0, 1) for k in keys} | values)


def _partials(df: DataFrame, keys: list[str], width: int, held: int = 256, head: int = 0) -> DataFrame:
    """Upper triangles per key and task; with ``head``, the last key is a segment and those below it pass as single rows."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("g", T.ArrayType(T.DoubleType()))])
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        kinds = None  # one Arrow schema for all that this task hands on

        def flush() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in sums], kinds[i]) for i in range(len(keys))]
            columns.append(pa.array([g[upper] for g in sums.values()], pa.list_(pa.float64())))
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, [*keys, "g"])

        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in range(len(keys))]
            if head:
                first = pc.less(batch.column(len(keys) - 1), head)
                single = batch.filter(first)
                if single.num_rows:
                    yield pa.RecordBatch.from_arrays([*single.columns[:-1], single.columns[-1].cast(pa.list_(pa.float64()))], [*keys, "g"])
                batch = batch.filter(pc.invert(first))
            if not batch.num_rows:
                continue
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            idx = pd.DataFrame({k: batch.column(i).to_pandas() for i, k in enumerate(keys)})
            for key, rows in idx.groupby(keys, sort=False, dropna=False).indices.items():
                part = x[rows].T @ x[rows]
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) > held:
                yield flush()
        if sums:
            yield flush()

    return df.mapInArrow(run, schema)


def solve_rows(df: DataFrame, keys: list[str], schema: str, fn: Callable[[dict], list[dict]]) -> DataFrame:
    """Apply a small matrix function to each row of matrices; rows stay distributed."""
    fields = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(schema).fields)
    names = [f.name for f in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                {**{k: row[k] for k in keys}, **res}
                for row in frame.to_dict("records") for res in fn(row)
            ]
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, fields)


def segment_sums(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    segs = np.asarray(row["segs"], dtype=int)
    mats = [np.asarray(g, float) for g in row["grams"]]
    return segs, np.stack([np.outer(g, g) if len(g) == width else triangle(g, width) for g in mats])


def spd_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric system after scaling its diagonal to one."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    s = a / np.outer(d, d)
    rhs = (b.T / d).T
    low = np.linalg.eigvalsh(s)[0]
    x = np.linalg.solve(s, rhs) if low > 1e-12 else np.linalg.pinv(s, rcond=1e-12, hermitian=True) @ rhs
    return (x.T / d).T


def ols(g: np.ndarray, xs: list[int], y: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares from a cross-product matrix."""
    beta = spd_solve(g[np.ix_(xs, xs)], g[xs, y])
    return beta, float(max(g[y, y] - beta @ g[xs, y], 0.0))


def dot(weights: Column, terms: list[Column]) -> Column:
    """Sum of weights[i] * term_i as a flat expression."""
    total = weights[0] * terms[0]
    for i, t in enumerate(terms[1:], start=1):
        total = total + weights[i] * t
    return total


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
