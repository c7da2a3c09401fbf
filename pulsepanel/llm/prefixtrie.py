"""Prefix tree of conversations from vertical bitmaps.

A node is a distinct sequence of first turns; its members are the
conversations that start with it.  Turns are known by two 64-bit hashes of role
and text, a node by its depth and the running XOR of its turns' hashes, each
mixed with its position.

* **Shards.**  Turn rows are dealt by range of (band, conversation); a band is
  256 positions, so that a very long conversation is many shards as well.  A
  task cuts what it reads, in order, into shards of up to 4,096 conversations.
* **Vertical bitmaps.**  A shard indexes (position, turn) to a bitset of its
  conversations.  From the root (in later bands: from the groups that share a
  path up to the band) a depth-first walk takes the lowest member left,
  intersects the parent's bitset with the posting of that member's next turn,
  and has a child; popcounts give the members, the lowest bit the smallest
  one, and the intersection with the bitset of conversations that end at the
  depth gives the end list.
* **Merge.**  Shards' nodes meet by depth and path: sums, minima, and end lists
  in order.  A shard sends one row for a node however many members it has, so
  a first turn of a third of all conversations costs a row a shard.
* **Subtrees.**  A conversation is smallest member from some depth on
  (``since``), so every node of a subtree is told by exactly one of its
  members; sums over a subtree become sums over the members of its top, one
  aggregation without walking up the tree.
* **End digests.**  SHA-256 needs its list in order.  Lists from one shard are
  hashed there; longer ones are streamed, chunk by chunk, through a running
  hash in sorted partitions.

Rows without a conversation id are left out.  NULL role or text is empty;
turns are ordered with NULL first, equal turns by role and then by hash;
repeated rows are turns of their own.  A table without conversations has no
node, not even the root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.llm.common import written

BAND = 256
SHARD_CONVERSATIONS = 4096
SHARD_ROWS = 1 << 20
PATH = ["depth", "p1", "p2"]


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, n_chars): numbered turns without their texts."""
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    keys = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"),
        F.xxhash64(F.lit(1), who, said).alias("k1"), F.xxhash64(F.lit(2), said, who).alias("k2"), F.length(said).cast("bigint").alias("n_chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "k1", "k2")
    return keys.select("conv_id", F.row_number().over(order).alias("pos"), "k1", "k2", "n_chars")


def grafted(turns: DataFrame, span: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first one of their span: (turns with ``depth``, all conversation ids).

    Conversation c takes the first h turns of c - c % span, h = crc32(c) %
    (most + 1), in place of its own first h.  Only ``most`` turns of one
    conversation a span travel.
    """
    first = turns.where((F.col("conv_id") % span == 0) & (F.col("pos") <= most))
    heads = first.groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "n_chars"))).alias("head"))
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    convs = turns.select("conv_id").distinct().withColumn("h", h)
    convs = convs.join(heads, c - c % span == F.col("of"), "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = written(convs.select("conv_id", "h", "head"), "heads")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.k1", "t.k2", "t.n_chars")
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("n_head")), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), "k1", "k2", "n_chars")
    return taken.unionByName(own), convs.select("conv_id")


def paths(turns: DataFrame) -> DataFrame:
    """Adds the path hashes (p1, p2), the characters before the turn, and whether it is the last."""
    order = Window.partitionBy("conv_id").orderBy("depth")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def mixed(key: str) -> Column:
        return F.xxhash64(F.col(key), F.col("depth"))

    return turns.select(
        "*", F.bit_xor(mixed("k1")).over(run).alias("p1"), F.bit_xor(mixed("k2")).over(run).alias("p2"),
        mixed("k1").alias("x1"), mixed("k2").alias("x2"),
        (F.sum("n_chars").over(run) - F.col("n_chars")).alias("before"), F.lead("depth").over(order).isNull().alias("last"))


class Shard:
    """Vertical bitmaps over the conversations of a shard, in ascending order of their ids."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows = rows
        conv, depth = rows["conv_id"], rows["depth"]
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        self.starts, self.convs, self.base = starts, conv[starts].tolist(), int(depth.min())
        self.sizes = np.diff(np.append(starts, len(conv))).tolist()
        self.keys = list(zip(depth.tolist(), rows["k1"].tolist(), rows["k2"].tolist()))
        self.posting: dict[tuple, int] = {}
        self.ends: dict[int, int] = {}
        local = (np.cumsum(np.concatenate([[True], conv[1:] != conv[:-1]])) - 1).tolist()
        for key, i, last in zip(self.keys, local, rows["last"].tolist()):
            self.posting[key] = self.posting.get(key, 0) | 1 << i
            if last:
                self.ends[key[0]] = self.ends.get(key[0], 0) | 1 << i

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return out

    def nodes(self) -> Iterator[tuple[int, int, int]]:
        """(row of the smallest member, number of members, bitset of those that end) of every node: depth-first over intersections."""
        roots: dict[tuple, int] = {}
        q1, q2 = self.rows["p1"] ^ self.rows["x1"], self.rows["p2"] ^ self.rows["x2"]
        for i, at in enumerate(self.starts.tolist()):
            key = int(q1[at]), int(q2[at])
            roots[key] = roots.get(key, 0) | 1 << i
        stack = [(self.base, bits) for bits in roots.values()]
        starts, sizes = self.starts.tolist(), self.sizes
        while stack:
            depth, left = stack.pop()
            while left:
                i = (left & -left).bit_length() - 1
                at = depth - self.base
                if at >= sizes[i]:  # the conversation, or the band, has no turn here
                    left ^= 1 << i
                    continue
                row = starts[i] + at
                child = left & self.posting[self.keys[row]]
                left ^= child
                ending = child & self.ends.get(depth, 0)
                yield row, child.bit_count(), ending
                if child != ending:
                    stack.append((depth + 1, child))


NODE_SCHEMA = "depth int, p1 bigint, p2 bigint, q1 bigint, q2 bigint, members bigint, smallest bigint, n_chars bigint, before bigint, first_end bigint, ends string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "depth", "k1", "k2", "n_chars", "p1", "p2", "x1", "x2", "before", "last"]

    def emit(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard = Shard(rows)
        found = list(shard.nodes())
        at = np.array([f[0] for f in found])
        ends = [shard.members(f[2]) for f in found]
        pick = {c: rows[c][at] for c in ("depth", "p1", "p2", "x1", "x2", "conv_id", "n_chars", "before")}
        columns = [
            pa.array(pick["depth"], pa.int32()), pa.array(pick["p1"]), pa.array(pick["p2"]), pa.array(pick["p1"] ^ pick["x1"]),
            pa.array(pick["p2"] ^ pick["x2"]), pa.array([f[1] for f in found], pa.int64()), pa.array(pick["conv_id"]),
            pa.array(pick["n_chars"]), pa.array(pick["before"]), pa.array([e[0] if e else None for e in ends], pa.int64()),
            pa.array([",".join(map(str, e)) if e else None for e in ends], pa.string())]
        whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])
        for i in range(0, whole.num_rows, 10_000):
            yield whole.slice(i, 10_000)

    held: list[dict[str, np.ndarray]] = []
    n_convs = n_rows = 0
    latest = None  # (band, conversation) of the last row held
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        band, conv = (rows["depth"] - 1) // BAND, rows["conv_id"]
        fresh = np.ones(len(conv), bool)
        fresh[1:] = (conv[1:] != conv[:-1]) | (band[1:] != band[:-1])
        fresh[0] = latest != (int(band[0]), int(conv[0]))
        borders = np.flatnonzero(fresh).tolist()
        cut = 0
        for k, at in enumerate(borders):
            after = (int(band[at]), int(conv[at]))
            size = (borders[k + 1] if k + 1 < len(borders) else len(conv)) - at
            if latest and (after[0] != latest[0] or n_convs >= SHARD_CONVERSATIONS or n_rows + size > SHARD_ROWS):
                if at > cut:
                    held.append({c: v[cut:at] for c, v in rows.items()})
                cut = at
                if held:
                    yield from emit({c: np.concatenate([h[c] for h in held]) for c in names})
                held, n_convs, n_rows = [], 0, 0
            n_convs, n_rows, latest = n_convs + 1, n_rows + size, after
        if len(conv) > cut:
            held.append({c: v[cut:] for c, v in rows.items()})
            latest = int(band[-1]), int(conv[-1])
    if held:
        yield from emit({c: np.concatenate([h[c] for h in held]) for c in names})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running SHA-256 over chunks that come sorted by node and first id."""
    now, sha = None, None

    def row(key: tuple, sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([sha.hexdigest()])],
            names=[*PATH, "long_sha256"])

    for batch in batches:
        for *key, ends in zip(*[batch.column(c).to_pylist() for c in [*PATH, "ends"]]):
            if key != now:
                if now:
                    yield row(now, sha)
                now, sha = key, hashlib.sha256(ends.encode())
            else:
                sha.update(("," + ends).encode())
    if now:
        yield row(now, sha)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root's rows: one for up to 4,096 conversations in order, with its end list of turnless ones."""
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, SHARD_CONVERSATIONS):
            part = batch.slice(i, SHARD_CONVERSATIONS)
            convs, bare = part.column("conv_id").to_pylist(), part.column("turnless").to_pylist()
            ends = [c for c, b in zip(convs, bare) if b]
            row = (0, 0, 0, None, None, len(convs), convs[0], 0, 0, ends[0] if ends else None, ",".join(map(str, ends)) if ends else None)
            kinds = [pa.int32(), *[pa.int64()] * 9, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)


def shard_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node and shard; ``turns`` with paths."""
    band = F.floor((F.col("depth") - 1) / BAND)
    dealt = turns.withColumn("band", band).repartitionByRange("band", "conv_id").sortWithinPartitions("band", "conv_id", "depth").drop("band")
    first = turns.where("depth = 1").select("conv_id", F.lit(False).alias("turnless"))
    roots = convs.join(first, "conv_id", "left").select("conv_id", F.coalesce("turnless", F.lit(True)).alias("turnless"))
    roots = roots.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    return dealt.mapInArrow(_walk, NODE_SCHEMA).unionByName(roots.mapInArrow(_roots, NODE_SCHEMA))


def end_digests(local: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, long_sha256) of nodes whose end list comes from several shards."""
    long = nodes.where("chunks > 1").select(*PATH)
    chunks = local.where("ends IS NOT NULL").select(*PATH, "first_end", "ends").join(long, PATH, "left_semi")
    return chunks.repartition(*PATH).sortWithinPartitions(*PATH, "first_end").drop("first_end").mapInArrow(
        _digest, "depth int, p1 bigint, p2 bigint, long_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the tree over (conv_id, depth, k1, k2, n_chars) turns; ``convs`` names all conversations, turnless ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256); a node's turns are the first ``depth`` ones of
    conversation ``conv_id``.
    """
    turns = written(paths(turns), "paths")
    local = written(shard_nodes(turns, convs), "shard-nodes")
    nodes = local.groupBy(*PATH).agg(
        F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.sum("members").alias("n_convs"), F.min("smallest").alias("conv_id"),
        F.first("before").alias("before"), F.count("ends").alias("chunks"), F.max("ends").alias("ends"))
    short = F.when(F.col("chunks") < 2, F.sha2(F.coalesce("ends", F.lit("")).cast("binary"), 256))
    nodes = written(nodes.withColumn("short_sha256", short).drop("ends"), "nodes")

    above = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, PATH, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes, "nodes-children")

    # Of a smallest member: the characters before the first node it stands for, and whether it stands for a leaf.
    chains = nodes.groupBy("conv_id").agg(F.min("before").alias("since"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    whole = turns.where("last").select("conv_id", (F.col("before") + F.col("n_chars")).alias("total"))
    told = convs.join(whole, "conv_id", "left").join(chains, "conv_id", "left").select(
        "conv_id", F.coalesce("since", "total", F.lit(0)).alias("since"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = turns.select("conv_id", *PATH, "before").unionByName(
        convs.select("conv_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"),
                     F.lit(0).cast("bigint").alias("before")))
    sums = members.join(told, "conv_id").groupBy(*PATH).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("since") - F.col("before"), F.lit(0))).alias("saved_tokens"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, PATH).join(end_digests(local, nodes), PATH, "left").join(parents, ["depth", "q1", "q2"], "left")
    big = {c: F.col(c).cast("bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    return out.select(*[v.alias(c) for c, v in big.items()], F.coalesce("short_sha256", "long_sha256").alias("ends_sha256"))


def conversation_tree(df: DataFrame) -> DataFrame:
    """The tree of conversations rebuilt on the first turns of their hundred."""
    turns = written(turns_of(df), "turns")
    rebuilt, convs = grafted(turns)
    return trie(rebuilt, convs)


SQL = """
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda crc, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, b: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(crc, x)),
    4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM said)),
heads AS (SELECT c.conv_id, s.pos AS depth, role, text FROM convs c JOIN said s ON s.conv_id = c.base AND s.pos <= c.h),
sizes AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
turns AS (
  SELECT * FROM heads UNION ALL
  SELECT s.conv_id, s.pos - c.h + coalesce(z.n, 0), role, text FROM said s JOIN convs c USING (conv_id) LEFT JOIN sizes z USING (conv_id) WHERE s.pos > c.h),
member AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, NULL AS up, 0 AS n_chars FROM convs UNION ALL
  SELECT conv_id, depth, path, CASE WHEN depth = 1 THEN '' ELSE lag(path) OVER (PARTITION BY conv_id ORDER BY depth) END, n_chars FROM (
    SELECT conv_id, depth, length(text) AS n_chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (
      PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS path FROM turns)),
node AS MATERIALIZED (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars FROM member GROUP BY depth, path),
children AS (SELECT up AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
full_node AS MATERIALIZED (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN children USING (path)),
below AS (
  SELECT m.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * u.n_chars) AS saved
  FROM full_node u JOIN member m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.path),
last AS (SELECT conv_id, arg_max(path, depth) AS path FROM member GROUP BY conv_id),
ended AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node v JOIN below USING (path) LEFT JOIN ended USING (path) LEFT JOIN node p ON p.path = v.up
"""
