"""Vector codes by product quantisation, with bounds from the norm of summed moves.

Vectors become integers, are cut into parts, and each part position has a small
codebook that rounds of nearest-entry assignment and averaging refine.  All
sums and distances are exact integers, so the result is the same however rows
are dealt.

* **State.**  For every part of every vector: its entry, an upper bound of the
  distance to it, a lower bound of the distance to any other entry, and the
  round in which each bound was measured (its stamp).  Bounds are kept as they
  were measured and rounded outwards.
* **Bounds.**  The codebooks of all rounds are at hand.  In a later round the
  upper bound grows by the norm of the entry's net displacement since the
  bound's stamp, the lower one falls by the largest net displacement among the
  other entries since its own.  The net displacement is the norm of the sum of
  the moves, never more than the sum of their norms, so entries that come
  back cost nothing.
* **Rescans.**  Where the bounds do not part, the distance to the own entry is
  measured; where that does not settle it, all entries are rescanned.
* **Tables.**  A round reads the rows with their state and writes them anew;
  each task adds one row with the sums of what changed its entry.  These rows
  add up to the next codebooks, the only thing the driver sees.  The table
  before the last is deleted, so two exist at a time.

Rows whose vector is NULL or holds a NULL or non-finite component are dropped;
repeated ids count as rows of their own, also among the start entries, ties by
the vector.  NULL ids sort last.  Vectors of different lengths have codebooks
of their own; a length that the parts do not divide is cut as evenly as it can
be.  With fewer rows than entries there are as many entries as rows; an empty
table gives no rows.  Other columns are left out.  A component of 32,768 or more
in size would overflow the exact integers and raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from pulsepanel.llm.common import written
from pulsepanel.sources.workdir import remove_table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Outward slack for the rounding of norms.
SLACK = 1e-6
STATE = np.dtype([("entry", "u1"), ("upper_at", "u1"), ("lower_at", "u1"), ("upper", "<f4"), ("lower", "<f4")])

#: For one vector length: for every part, entries of all rounds so far, (rounds, entries, width).
History = dict[int, list[np.ndarray]]


def bounds_of(length: int, parts: int) -> list[tuple[int, int]]:
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * largest + 1) ** 2 < 2 ** 53:  # every sum below is then exact in floating point
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - entries) ** 2).sum(2)


def _outwards(up: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nextafter(up.astype(np.float32), np.float32(np.inf)), np.nextafter(low.astype(np.float32), np.float32(-np.inf))


def rescan(state: np.ndarray, rows: np.ndarray, x: np.ndarray, entries: np.ndarray, now: int) -> None:
    if not len(rows):
        return
    d = distances(x[rows], entries)
    best = d.argmin(1)
    at = np.arange(len(rows))
    near = np.sqrt(d[at, best])
    rest = d.astype(np.float64)
    rest[at, best] = np.inf
    up, low = _outwards(near, np.sqrt(rest.min(1)))
    state["entry"][rows], state["upper"][rows], state["lower"][rows] = best, up, low
    state["upper_at"][rows] = state["lower_at"][rows] = now


def reassign(state: np.ndarray, x: np.ndarray, history: np.ndarray) -> int:
    """Bring one part's state to the last round of ``history``; the number of rows rescanned."""
    now, (entries, k) = len(history) - 1, (history[-1], history.shape[1])
    moves = np.sqrt(((history - entries).astype(np.float64) ** 2).sum(2))  # net displacement of each entry since each round
    others = np.zeros_like(moves)
    for j in range(k):
        others[:, j] = np.delete(moves, j, 1).max(1, initial=0.0)
    low = (state["lower"].astype(np.float64) - others[state["lower_at"], state["entry"]]) * (1 - SLACK)
    up = (state["upper"].astype(np.float64) + moves[state["upper_at"], state["entry"]]) * (1 + SLACK)
    open_rows = np.flatnonzero(~(up < low))
    if not len(open_rows):
        return 0
    own = ((x[open_rows] - entries[state["entry"][open_rows]]) ** 2).sum(1)
    near, _ = _outwards(np.sqrt(own), np.zeros(len(own)))
    state["upper"][open_rows], state["upper_at"][open_rows] = near, now
    left = open_rows[~(near * (1 + SLACK) < low[open_rows])]
    rescan(state, left, x, entries, now)
    return len(left)


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row places, components) for every vector length of a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, flat[starts[rows][:, None] + np.arange(n)].astype(np.int64)


def _round(history: History, parts: int):
    """Arrow function of one round: rows with new state, then one row of sums per length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved: dict[int, list[np.ndarray]] = {}
        schema = None
        for batch in batches:
            schema, n = batch.schema, batch.num_rows
            states = np.zeros((n, parts), STATE)
            held = batch.column("state")
            first = held.null_count == n
            if not first:
                states[:] = np.frombuffer(b"".join(held.to_pylist()), STATE).reshape(n, parts)
            for length, rows, v in _groups(batch.column("v")):
                sums = moved.setdefault(length, [np.zeros((h.shape[1], h.shape[2] + 1), np.int64) for h in history[length]])
                for p, (lo, hi) in enumerate(bounds_of(length, parts)):
                    x, state, entries = v[:, lo:hi], states[rows, p], history[length][p]
                    before = state["entry"].copy()
                    if first:
                        rescan(state, np.arange(len(rows)), x, entries[-1], 0)
                    else:
                        reassign(state, x, entries)
                    states[rows, p] = state
                    changed = np.arange(len(rows)) if first else np.flatnonzero(before != state["entry"])
                    weighed = np.concatenate([np.ones((len(changed), 1), np.int64), x[changed]], 1)
                    np.add.at(sums[p], state["entry"][changed], weighed)
                    if not first:
                        np.subtract.at(sums[p], before[changed], weighed)
            yield batch.set_column(batch.schema.get_field_index("state"), "state", pa.array([row.tobytes() for row in states], pa.binary()))
        for length, sums in moved.items():
            flat = np.concatenate([[length], *[s.ravel() for s in sums]])
            columns = [pa.array([flat.tolist()], f.type) if f.name == "moved" else pa.nulls(1, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_nullable(True) for f in schema]))

    return run


def _finish(history: History, parts: int):
    """Arrow function that turns states of the last round into codes and exact errors."""
    digests = {n: hashlib.sha256(",".join(str(c) for p in h for c in p[-1].ravel().tolist()).encode()).hexdigest() for n, h in history.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            states = np.frombuffer(b"".join(batch.column("state").to_pylist()), STATE).reshape(n, parts)
            error, digest = np.zeros(n, np.int64), [""] * n
            for length, rows, v in _groups(batch.column("v")):
                for p, (lo, hi) in enumerate(bounds_of(length, parts)):
                    error[rows] += ((v[:, lo:hi] - history[length][p][-1][states["entry"][rows, p]]) ** 2).sum(1)
                for i in rows:
                    digest[i] = digests[length]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in np.ascontiguousarray(states["entry"])]),
                 pa.array(error), pa.array(digest)],
                names=["id", "label", "code", "error", "codebooks_sha256"])

    return run


def integer_vectors(df: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): usable rows with components floor(scale * x)."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) * scale < 2.0 ** 27, F.floor(x.cast("double") * scale)).otherwise(
        F.raise_error("a component is too large for exact integer codes").cast("bigint")).cast("int"))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id).alias("id"), F.col(label).alias("label"), whole.alias("v"))


def _start(rows: DataFrame, entries: int, parts: int) -> History:
    """Codebooks of round 0: the parts of the rows with the smallest ids, per vector length."""
    order = Window.partitionBy("n").orderBy(F.col("id").asc_nulls_last(), "v")
    first = rows.withColumn("n", F.size("v")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= entries)
    found: dict[int, list] = {}
    for r in first.select("n", "k", "v").orderBy("n", "k").collect():  # entries rows per length
        found.setdefault(r["n"], []).append(r["v"])
    return {n: [np.array(vs, np.int64).reshape(len(vs), n)[None, :, lo:hi] for lo, hi in bounds_of(n, parts)] for n, vs in found.items()}


def _sums(table: DataFrame) -> dict[int, np.ndarray]:
    """What the tasks of a round report, added up per length."""
    told = table.where("moved IS NOT NULL").select(F.element_at("moved", 1).alias("n"), F.posexplode("moved").alias("at", "x")).where("at > 0")
    out: dict[int, dict[int, int]] = {}
    for r in told.groupBy("n", "at").agg(F.sum("x").alias("x")).collect():  # as many rows as codebook components
        out.setdefault(r["n"], {})[r["at"]] = r["x"]
    return {n: np.array([cells[i] for i in sorted(cells)], np.int64) for n, cells in out.items()}


def compress(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256): one row per usable vector."""
    spark: SparkSession = df.sparkSession
    rows = integer_vectors(df, id, vector, label, scale)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType().add("id", kinds["id"]).add("label", kinds["label"]).add("v", ArrayType(IntegerType())).add(
        "state", BinaryType()).add("moved", ArrayType(LongType()))
    state = rows.select("*", F.lit(None).cast("binary").alias("state"), F.lit(None).cast("array<bigint>").alias("moved"))
    history, totals, last = _start(rows, entries, parts), {}, None
    for r in range(rounds + 1):
        table = written(state.mapInArrow(_round(history, parts), schema), f"codes-{r}")
        if last is not None:
            remove_table(last)
        last, state = table, table.where("moved IS NULL")
        if r == rounds:
            break
        for n, told in _sums(table).items():
            totals[n] = totals.get(n, 0) + told
            at = 0
            for p, h in enumerate(history[n]):
                k, width = h.shape[1:]
                cells = totals[n][at:at + k * (width + 1)].reshape(k, width + 1)
                at += cells.size
                used = cells[:, :1] > 0
                fresh = np.where(used, np.floor_divide(cells[:, 1:], np.maximum(cells[:, :1], 1)), h[-1])
                history[n][p] = np.concatenate([h, fresh[None]])
    done = StructType().add("id", kinds["id"]).add("label", kinds["label"]).add("code", StringType()).add("error", LongType()).add(
        "codebooks_sha256", StringType())
    coded = written(state.select("id", "label", "v", "state").mapInArrow(_finish(history, parts), done), "codes")
    per_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    steps = ["""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, len(v) // 8 AS w FROM kept),
comp AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS pos, x FROM flat),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16),
cb0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM comp JOIN first USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 16 + entry) AS best FROM (
    SELECT vec_id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM comp JOIN cb{r} USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""
cb{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, c) AS c FROM cb{r} LEFT JOIN (
    SELECT part, best % 16 AS entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM comp JOIN near{r} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos))""")
    steps.append(f"""
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id)""")
    return ",".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM cb{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


SQL = _sql()
