"""Byte-level BPE inside Spark: ranked merges folded by higher-order functions.

A rank file gives every token's bytes and its rank, which is also its id.  A
word starts as its single bytes; the neighbouring pair whose joined bytes have
the lowest rank (the leftmost of equals) is merged until no pair has a rank.
Texts are first split into words by the tokenizer's pattern, as Java's regular
expressions see it; where Java's Unicode tables differ from the tokenizer
library's, the letters and digits of the pattern are corrected by the
difference, computed once a session.

* **Rank map.**  One constant array: a hash table with two places for every
  pair of tokens that makes a token, since Spark looks a key of a map up by
  scanning it.
* **Fold.**  ``aggregate`` over as many steps as a word has bytes; the state
  is an array with one long a piece, which holds the rank of the pair it makes
  with its neighbour, its offset and its id.  A merge renews two of them.
* **Distinct words.**  Words are counted over all texts; the commonest
  ``most_known``, and the vocabulary's own, are folded once and broadcast with
  their ids.  Arrow batches look all words of the texts up; any other word is
  folded once in each row that holds it, so no text is ever shuffled and
  nothing grows with the corpus but the count of words.
* **Long words.**  The fold's work grows with the square of a word.  Words of
  more than 65 characters, which may have over 260 bytes, go through a heap of
  pairs with the same merge rule, in n log n steps.

Decoding looks every id's bytes up and concatenates them, in Arrow batches.

Null and empty texts have no ids and decode to no bytes; texts of any length
are encoded whole, rows are independent of each other, repeated rows and other
columns come through unchanged, and an empty table stays empty.  Columns of the
input named like an output are replaced by the output.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from pulsepanel.llm.common import written

#: Words whose ids every task holds, beside the vocabulary's own; the rest are folded row by row.  About 10 MB.
KNOWN_WORDS = 1 << 18
#: Places of the pair table (a vocabulary of 50,000 tokens has about a quarter of a million pairs).
PAIR_SLOTS = 1 << 20
NONE, EMPTY = 0xFFFFF, 1 << 61
LONGS = "array<bigint>"
#: Odd factors that spread the two ids of a pair over the table.
MIXERS = ((0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F))
#: Longer words, which may have more than four times as many bytes, are merged by a heap.
LONG_WORD = 65
#: Words or ids that a task handles at once, but for a longer text.
PIECE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def _library_class(name: str) -> np.ndarray:
    """Code points of a Unicode class as the tokenizer library knows it."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    blocks = ("".join(every[i:i + 4096]) for i in range(0, len(every), 4096))
    return np.array([ord(c) for b in blocks for c in probe.decode(probe.encode_ordinary(b))])


def _java_class(spark: SparkSession, name: str) -> np.ndarray:
    """Code points of a Unicode class as the executors' Java knows it."""
    points = spark.range(0x110000).where("id < 55296 OR id > 57343")
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    return points.where(letter.rlike(name)).toPandas()["id"].to_numpy()


def _ranges(points: np.ndarray) -> str:
    if not len(points):
        return ""
    points = np.sort(points)
    ends = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.concatenate([[0], ends + 1])], points[np.concatenate([ends, [len(points) - 1]])]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts.tolist(), lasts.tolist()))


_patterns: dict[tuple[str, str], str] = {}
ASCII = {"L": "a-zA-Z", "N": "0-9"}  # asked first


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The split pattern with classes that match what the tokenizer library matches, whatever Java's Unicode version."""
    key = spark.sparkContext.applicationId, pattern
    if key not in _patterns:
        plus, minus = {}, {}
        for c in "LN":
            library, java = _library_class(rf"\p{{{c}}}"), _java_class(spark, rf"\p{{{c}}}")
            plus[c], minus[c] = _ranges(np.setdiff1d(library, java)), _ranges(np.setdiff1d(java, library))
        plus = {c: f"[\\x{{80}}-\\x{{10ffff}}&&[{p}]]" if p else "" for c, p in plus.items()}  # ASCII never walks the corrections
        both = r"\s" + "".join(rf"{ASCII[c]}\p{{{c}}}{plus[c]}" for c in "LN")
        gone = "".join(minus.values())
        other = f"[^{both}]" if not gone else f"(?:[^{both}]|[{gone}])"
        out = pattern.replace(r"[^\s\p{L}\p{N}]", "OTHER")
        for c in "LN":
            kind = rf"{ASCII[c]}\p{{{c}}}{plus[c]}"
            out = out.replace(rf"\p{{{c}}}", f"[{kind}&&[^{minus[c]}]]" if minus[c] else f"[{kind}]")
        _patterns[key] = "(?U)" + out.replace("OTHER", other)
    return _patterns[key]


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def using(df: DataFrame, constants: list[Column], name: str, body) -> DataFrame:
    """Add the column ``body(*constants)``; each constant is bound once, as the variable of a lambda, and never copied into rows.

    Spark takes no subquery inside a higher-order function, so the constants
    come from a projection below; each is used once, so the optimizer puts it
    back where the lambda binds it.
    """
    held = [f"__constant{i}" for i in range(len(constants))]

    def bind(left: list[str], bound: list[Column]) -> Column:
        if not left:
            return body(*bound)
        return F.element_at(F.transform(F.array(F.col(left[0])), lambda c: bind(left[1:], [*bound, c])), 1)

    def bound(rows: DataFrame) -> DataFrame:
        below = rows.select("*", *[c.alias(h) for c, h in zip(constants, held)])
        return below.select(*[F.col(f"`{c}`") for c in df.columns if c != name], bind(held, []).alias(name))

    out = bound(df)
    # Where the rows' own columns are computed just below, the optimizer may keep the projection; a written table has none.
    return bound(written(df, "rows")) if "AS __constant" in out._jdf.queryExecution().optimizedPlan().toString() else out


def let(value: Column, body, kind: str) -> Column:
    """``body`` of a value that is computed once.

    The casts to the type it has anyway go before a plan runs; without them the
    analyzer derives types of nested lambdas again at every level.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v).cast(kind)).cast(f"array<{kind}>"), 1)


def pair_table(ranks: dict[bytes, int], slots: int = PAIR_SLOTS) -> np.ndarray:
    """All pairs of tokens whose joined bytes are a token, as a cuckoo table: key * 2^20 + merged id, in one of two places of the key.

    The key is left id * 2^20 + right id; ``EMPTY`` marks a free place.
    """
    table = [EMPTY] * slots
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is None or right is None:
                continue
            item = (left << 20 | right) << 20 | rank
            place = _places(left, right, slots)[0]
            for _ in range(1000):
                item, table[place] = table[place], item
                if item == EMPTY:
                    break
                first, second = _places(item >> 40, item >> 20 & NONE, slots)
                place = second if place == first else first
            else:
                raise ValueError("the pair table is too full; use more slots")
    return np.array(table, np.int64)


def _places(left, right, slots: int) -> list:
    """The two places of a pair: bits of products that stay below 2^63.  Works on integers and on columns."""
    mixed = [left * a + right * b for a, b in MIXERS]
    return [F.shiftright(m, 16).bitwiseAND(slots - 1) if isinstance(m, Column) else m >> 16 & slots - 1 for m in mixed]


def joined_rank(pairs: Column, left: Column, right: Column, slots: int = PAIR_SLOTS) -> Column:
    """Id of the token that two neighbours make, or ``NONE``.

    XOR with the key leaves the id where a place holds the pair, and a larger number where it holds another or none.
    """
    key = F.shiftleft(left, 40).bitwiseOR(F.shiftleft(right, 20))
    return F.least(*[F.get(pairs, p.cast("int")).bitwiseXOR(key) for p in _places(left, right, slots)], F.lit(NONE).cast("bigint")).cast("bigint")


def ranked(x: Column, rank: Column) -> Column:
    return F.shiftleft(rank, 42).bitwiseOR(x)


def fold(pieces: Column, pairs: Column) -> Column:
    """The ids of one word's pieces: the pair of lowest rank is merged, step by step.

    A piece is one long: rank of the pair it makes with the next piece (20
    bits, ``NONE`` for none), its offset (22), its id (20).  The smallest is
    the leftmost pair of lowest rank, and its rank is the id of the merged
    piece.
    """
    def id_of(x: Column) -> Column:
        return x.bitwiseAND(NONE)

    def place_of(state: Column, low: Column) -> Column:
        """One-based; counts offsets, since array_position leaves its loop by an exception."""
        offset = 0x3FFFFF << 20
        return F.size(F.filter(state, lambda x: x.bitwiseAND(offset) <= low.bitwiseAND(offset)))

    def merge(state: Column, low: Column, at: Column) -> Column:
        merged = F.shiftright(low, 42)

        def here(after: Column) -> Column:
            piece = low.bitwiseAND(0x3FFFFF << 20).bitwiseOR(merged)  # its offset, its new id
            return F.when(after.isNull(), ranked(piece, F.lit(NONE).cast("bigint"))).otherwise(ranked(piece, joined_rank(pairs, merged, id_of(after))))

        def with_before(before: Column) -> Column:
            return ranked(before.bitwiseAND((1 << 42) - 1), joined_rank(pairs, id_of(before), merged))

        piece = let(F.get(state, at + 1), here, "bigint")  # get counts from zero
        return F.when(at > 1, F.concat(
            F.slice(state, F.lit(1), at - 2), F.array(let(F.get(state, at - 2), with_before, "bigint"), piece), F.slice(state, at + 2, F.size(state)),
        )).otherwise(F.concat(F.array(piece), F.slice(state, F.lit(3), F.size(state))))

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state), lambda low: F.when(low >= F.lit(NONE << 42), state).otherwise(
            let(place_of(state, low), lambda at: merge(state, low, at), LONGS)), LONGS)

    steps = F.sequence(F.lit(2), F.size(pieces) + 1)
    return F.aggregate(steps, pieces, step, lambda s: F.transform(s, lambda x: id_of(x).cast("int")).cast("array<int>")).cast("array<int>")


def fold_word(word: Column, whole: Column, pairs: Column, singles: Column) -> Column:
    """The ids of one word, from its bytes; ``whole`` is its id if it is a token."""
    def start(ids: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            after = F.get(ids, i + 1)
            rank = F.when(after.isNull(), F.lit(NONE).cast("bigint")).otherwise(joined_rank(pairs, x, after))
            return ranked(F.shiftleft(i.cast("bigint"), 20).bitwiseOR(x), rank)

        return F.transform(ids, piece)

    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    ids = F.transform(F.split(latin, F.lit("")), lambda c: F.get(singles, F.ascii(c)))
    merged = let(let(ids, start, LONGS), lambda pieces: fold(pieces, pairs), "array<int>")
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(merged).cast("array<int>")


def byte_pieces(words: pa.StringArray, singles: np.ndarray, doubles: np.ndarray) -> pa.ListArray:
    """Each word's single bytes as the fold's pieces, none for a long word; ``doubles`` has the ranks of two bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    sizes, short = np.diff(ends), pc.less_equal(pc.utf8_length(words), LONG_WORD).to_numpy(zero_copy_only=False)
    rank = np.append(doubles[data[:-1], data[1:]], NONE)
    rank[ends[1:] - ends[0] - 1] = NONE
    pieces = rank << 42 | (np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)) << 20 | singles[data]
    return _lists(np.concatenate([[0], np.cumsum(sizes * short)]), pa.array(pieces[np.repeat(short, sizes)], pa.int64()))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word in n log n steps: a heap of (rank, place) pairs over a linked list of pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts here
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n and (rank := ranks.get(word[start:ends[middle]])) is not None:
            heapq.heappush(heap, (rank, start, ends[middle]))

    for i in range(n):
        offer(i)
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = ends[start]
        if middle <= start or middle >= n or ends[middle] != end:  # either piece has changed since
            continue
        ends[start], ends[middle] = end, -1
        if end < n:
            before[end] = start
        if before[start] >= 0:
            offer(before[start])
        offer(start)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return out


def known_words(texts: DataFrame, text: str, pattern: str, most: int) -> DataFrame:
    """The commonest words that aren't long, ``most`` at most: all words from some count up.

    The count to start from is read off a histogram of counts by 32nds of a
    power of two, a table of under 2,048 rows.
    """
    words = texts.select(F.explode(words_of(F.col(text), pattern)).alias("key")).where(F.length("key") <= LONG_WORD)
    words = words.groupBy("key").count()
    words = written(words.withColumn("level", F.floor(F.log2("count") * 32).cast("int")), "words")
    total, cut = 0, None
    for level, n in sorted(((r["level"], r["n"]) for r in words.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        total += n
        if total > most:
            break
        cut = level
    return words.where(F.col("level") >= F.lit(cut)).select("key")


class Vocabulary:
    """A rank file as constants of a plan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.ranks = spark, read_ranks(path)
        if max(self.ranks.values()) >= NONE:
            raise ValueError("ids of a vocabulary take 20 bits at most")

    def pairs(self) -> Column:
        return self._constant(pair_table(self.ranks))

    def singles(self) -> Column:
        return self._constant(np.array([self.ranks[bytes([b])] for b in range(256)], np.int64))

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single bytes, and the rank of every two bytes or ``NONE``."""
        one = [bytes([b]) for b in range(256)]
        return np.array([self.ranks[b] for b in one]), np.array([[self.ranks.get(a + b, NONE) for b in one] for a in one])

    def _constant(self, values: np.ndarray) -> Column:
        row = pa.table({"value": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))})
        return written(self.spark.createDataFrame(row), "constant").select("value").scalar()

    def tokens(self) -> DataFrame:
        """(key, whole): tokens whose bytes are text, as words may be."""
        text = [(t.decode(), r) for t, r in self.ranks.items() if _is_text(t)]
        return written(self.spark.createDataFrame(pd.DataFrame(text, columns=["key", "whole"])).select("key", F.col("whole").cast("int")), "tokens")


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def _pieces(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``PIECE`` entries of a list column; a longer list is one alone."""
    for batch in batches:
        ends, at = _ends(batch.column(name))[1:], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _ends(lists: pa.ListArray) -> np.ndarray:
    """Where each row's entries begin among the flattened ones, and their number."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _look_up(known: Broadcast, singles: np.ndarray, doubles: np.ndarray):
    """``__words`` become ``__codes``: a word's place among the known ones, or -1 less its place among the row's others.

    ``__new`` has the pieces of these other words, ``__long`` those that are long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "__words"):
            words = part.column("__words")
            ends, flat = _ends(words), words.flatten()
            codes = pc.index_in(flat, value_set=known.value).fill_null(-1).to_numpy().copy()
            new = np.flatnonzero(codes < 0)
            row = np.searchsorted(ends, new, "right") - 1
            other = flat.take(pa.array(new)).dictionary_encode()
            kinds = len(other.dictionary) + 1
            pairs, place = np.unique(row * kinds + other.indices.to_numpy(), return_inverse=True)  # each word once a row
            first = np.searchsorted(pairs // kinds, np.arange(len(words) + 1))
            codes[new] = first[row] - place - 1
            distinct, kind = other.dictionary, pa.array(pairs % kinds)
            pieces = byte_pieces(distinct, singles, doubles) if len(distinct) else pa.array([], pa.list_(pa.int64()))
            long = pc.if_else(pc.greater(pc.utf8_length(distinct), LONG_WORD), distinct, None)
            columns = [_lists(ends, pa.array(codes, pa.int32())), _lists(first, pieces.take(kind)), _lists(first, long.take(kind))]
            rest = part.drop_columns(["__words"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, "__codes", "__new", "__long"])

    return run


def _assemble(known: Broadcast, ranks: dict[bytes, int], outputs_of):
    """Ids of whole texts from ``__codes`` and the ids ``__folded`` of the rows' other words; long words are merged here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "__codes"):
            codes, new, folded = part.column("__codes"), part.column("__long"), part.column("__folded").flatten()
            ends, place, words = _ends(codes), codes.flatten().to_numpy().astype(np.int64), new.flatten()
            long = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
            merged = pa.array([merge_long(words[i].as_py().encode(), ranks) for i in long.tolist()], pa.list_(pa.int32()))
            slots = np.arange(len(folded))
            slots[long] = len(folded) + np.arange(len(long))
            other = np.flatnonzero(place < 0)
            row = np.searchsorted(ends, other, "right") - 1
            place[other] = len(known.value) + slots[_ends(new)[row] - 1 - place[other]]
            tables = [known.value, _lists(_ends(folded), folded.flatten())] if len(folded) else [known.value]
            table = pa.concat_arrays([*tables, merged])
            taken = table.take(pa.array(place))
            rest, more = part.drop_columns(["__codes", "__long", "__folded"]), outputs_of(taken.flatten(), _ends(taken)[ends])
            yield pa.RecordBatch.from_arrays([*rest.columns, *more.values()], [*rest.schema.names, *more])

    return run


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str, most_known: int, keep: list[str] | None, outputs: dict, outputs_of) -> DataFrame:
    """The rows with ``outputs`` (names and types); ``outputs_of(ids, ends)`` makes these columns of the ids of a batch, row by row."""
    spark = docs.sparkSession
    book, split = Vocabulary(spark, ranks_path), java_pattern(spark, pattern)
    pairs, singles, tokens = book.pairs(), book.singles(), book.tokens()
    words = known_words(docs, text, split, most_known).join(tokens, "key", "full")  # every token is known, so no other word is one
    words = written(words, "to-fold")
    folded = using(words, [pairs, singles], "value", lambda p, s: fold_word(F.col("key"), F.col("whole"), p, s))
    found = written(folded, "known").select("key", "value").toArrow().combine_chunks()
    keys, ids = (found.column(c).combine_chunks() for c in ("key", "value"))
    keys, ids = (spark.sparkContext.broadcast(x) for x in (keys.cast(pa.string()), _lists(_ends(ids), ids.flatten())))

    kept = [f for f in docs.schema if f.name not in outputs and (keep is None or f.name in keep)]
    split_rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], words_of(F.col(text), split).alias("__words"))
    coded = StructType([*kept]).add("__codes", ArrayType(IntegerType())).add("__new", ArrayType(ArrayType(LongType()))).add("__long", ArrayType(StringType()))
    coded = split_rows.mapInArrow(_look_up(keys, *book.bytes()), coded)
    folded = using(coded, [pairs], "__folded", lambda p: F.transform("__new", lambda w: F.when(F.size(w) > 0, fold(w, p)))).drop("__new")
    out = StructType([*kept])
    for name, kind in outputs.items():
        out = out.add(name, kind)
    return folded.mapInArrow(_assemble(ids, book.ranks, outputs_of), out)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", most_known: int = KNOWN_WORDS) -> DataFrame:
    """The rows with an array of token ids of each whole text, as the column ``ids``."""
    return _encoded(docs, ranks_path, pattern, text, most_known, None, {ids: ArrayType(IntegerType())}, lambda flat, ends: {ids: _lists(ends, flat)})


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", most_known: int = KNOWN_WORDS, keep: list[str] | None = None, packed: bool = False,
) -> DataFrame:
    """The rows with ``ids`` and, from these, the bytes ``decoded``, in one pass over the documents.

    ``keep`` names the columns of the input that the result needs, if not all.
    With ``packed`` the ids of a text are one binary value, as ``little_endian`` makes it.
    """
    tokens = token_bytes(docs.sparkSession, ranks_path)

    def outputs_of(flat: pa.Array, ends: np.ndarray) -> dict[str, pa.Array]:
        ids = _binary(4 * ends, pa.py_buffer(flat.to_numpy().astype("<u4"))) if packed else _lists(ends, flat)
        return {"ids": ids, "decoded": bytes_of(flat, ends, tokens.value)}

    outputs = {"ids": BinaryType() if packed else ArrayType(IntegerType()), "decoded": BinaryType()}
    return _encoded(docs, ranks_path, pattern, text, most_known, keep, outputs, outputs_of)


def token_bytes(spark: SparkSession, ranks_path: str) -> Broadcast:
    """Every token's bytes, at its id; NULL at other places."""
    names = {rank: token for token, rank in read_ranks(ranks_path).items()}
    return spark.sparkContext.broadcast(pa.array([names.get(i) for i in range(max(names) + 1)], pa.binary()))


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def bytes_of(ids: pa.Array, ends: np.ndarray, tokens: pa.BinaryArray) -> pa.BinaryArray:
    """The tokens' bytes, concatenated row by row."""
    inside = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens))).fill_null(False)
    taken = tokens.take(pc.if_else(inside, ids, None))
    if taken.null_count:
        raise ValueError(f"no token has the id {ids[pc.index(taken.is_null(), True).as_py()].as_py()}")
    at = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(), dtype=np.int64)])
    return _binary(at[ends], taken.buffers()[2] or pa.py_buffer(b""))


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes that their ids stand for, as the binary column ``out``.

    NULL ids give NULL; an id that is NULL or no token's raises an error.
    """
    tokens = token_bytes(rows.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, "__ids"):
            lists, rest = part.column("__ids"), part.drop_columns(["__ids"])
            found = bytes_of(lists.flatten(), _ends(lists), tokens.value)
            yield pa.RecordBatch.from_arrays([*rest.columns, pc.if_else(lists.is_valid(), found, None)], [*rest.schema.names, out])

    kept = [f for f in rows.schema if f.name != out]
    with_ids = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(ids).cast("array<int>").alias("__ids"))
    return with_ids.mapInArrow(run, StructType(kept).add(out, BinaryType()))


def little_endian(ids: Column) -> Column:
    """The ids as unsigned 32-bit integers, least byte first, in one binary value."""
    def digits(i: Column) -> Column:
        n = i.cast("bigint")
        swapped = (F.shiftleft(n.bitwiseAND(255), 24).bitwiseOR(F.shiftleft(n.bitwiseAND(0xFF00), 8))
                   .bitwiseOR(F.shiftright(n, 8).bitwiseAND(0xFF00)).bitwiseOR(F.shiftright(n, 24).bitwiseAND(255)))
        return F.lpad(F.hex(swapped), 8, "0")

    return F.unhex(F.array_join(F.transform(ids, digits), ""))
