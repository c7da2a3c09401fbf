"""Packing token sequences: first-fit decreasing with a tournament tree.

Documents are encoded once, dealt to randomised groups of bounded size, and
packed group by group.  Stretches of a full sequence stand alone; what is left
of each document is packed first-fit decreasing: the leaves of a tournament
tree hold the room of every bin, inner nodes the largest room below, so the
first bin that fits is found in one descent.  Gaps that remain are filled by
cutting up the emptiest bins, and the last bin of a group is cut into
sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DOUBLE_SPACE = re.compile(r"\s\s")
#: Entries of the word cache; it is emptied when full.
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_byte_bpe(path: str) -> dict:
    """Ranks and special tokens of a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} isn't a byte-level BPE vocabulary without prefix space and normaliser")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return {"ranks": ranks, "special": special, "top": max([*ranks.values(), *special.values()])}


class Encoder:
    """Text to little-endian ids, the same as the tokenizers library gives for the vocabulary.

    A stretch between single spaces is encoded the same wherever it stands, so
    such words are looked up in a cache; texts in which two white-space
    characters meet, or with a special token, are encoded whole.
    """

    def __init__(self, vocabulary: dict):
        self.dtype = np.dtype("<u2" if vocabulary["top"] < 1 << 16 else "<u4")
        self.special = list(vocabulary["special"])
        self.encoding = tiktoken.Encoding(
            "vocabulary", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=vocabulary["ranks"], special_tokens=vocabulary["special"])
        self.words: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._bytes(self.encoding.encode(text, allowed_special="all"))
        first, *rest = text.split(" ")
        if DOUBLE_SPACE.search(text):
            return self._bytes(self.encoding.encode_ordinary(text))
        known, out = self.words, [self._bytes(self.encoding.encode_ordinary(first))]
        if len(known) > CACHE:
            known.clear()
        for w in rest:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._bytes(self.encoding.encode_ordinary(" " + w))
            out.append(ids)
        return b"".join(out)


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins as lists of item numbers; sizes are 1 to ``room``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins: list[list[int]] = []
    for i in order:
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        at = node - leaves
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins


def pack_group(lengths: list[int], room: int, least_fill: int = 16) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of the group once."""
    full, rests = [], []
    for d, n in enumerate(lengths):
        whole = n // room * room
        full += [[(d, s, room)] for s in range(0, whole, room)]
        if n > whole:
            rests.append((d, whole, n - whole))
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    held = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-held[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:  # fill the fullest bins from the emptiest
        to, take = order[lo], order[hi]
        gap = room - held[to]
        if gap < least_fill and held[take] > gap:
            lo += 1
            continue
        while gap and bins[take]:
            d, s, n = bins[take].pop()
            cut = min(n, gap)
            bins[to].append((d, s, cut))
            if n > cut:
                bins[take].append((d, s + cut, n - cut))
            gap, held[to], held[take] = gap - cut, held[to] + cut, held[take] - cut
        if not gap:
            lo += 1
        if not bins[take]:
            hi -= 1
    out = full + [bins[order[i]] for i in range(hi) if bins[order[i]]]
    if bins and bins[order[hi]]:
        out += powers_of_two(bins[order[hi]])
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts one sequence into sequences whose lengths are its binary digits."""
    total, out, queue = sum(p[2] for p in pieces), [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        need, seq = 1 << bit, []
        while need:
            d, s, n = queue.pop(0)
            cut = min(n, need)
            seq.append((d, s, cut))
            if n > cut:
                queue.insert(0, (d, s + cut, n - cut))
            need -= cut
        out.append(seq)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 1, group_docs: int = 4096, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the piece's ``ids``.

    ``ids`` are little-endian unsigned integers, 16 bits wide if the
    vocabulary fits, else 32.  Each row of ``docs`` is a document of its own,
    also where ids repeat or are null; a null or empty text has the end id as
    its only token.  Groups hold ``group_docs`` documents on average whatever
    keys or texts repeat, since the row's place in its task goes into the
    draw.  An empty table gives an empty result; other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = max(1, -(-picked.count() // group_docs))
    shared = picked.sparkSession.sparkContext.broadcast(load_byte_bpe(vocabulary))  # one vocabulary: a few MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(shared.value), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = part.column(0).to_pylist()
                drawn = [xxhash.xxh64_intdigest(f"{d} {row + i}") % groups for i, d in enumerate(ids)]
                row += len(ids)
                coded = [encoder(t.as_py() or "") + end for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int64()), part.column(0), pa.array(coded, pa.binary())], ["g", "doc_id", "coded"])

    width = 2 if load_byte_bpe(vocabulary)["top"] < 1 << 16 else 4

    def fill(group: pa.Table) -> pa.Table:
        ids, coded = group.column("doc_id").to_pylist(), group.column("coded").to_pylist()
        base = group.column("g")[0].as_py() << 32
        rows = [[] for _ in range(8)]
        lengths = [len(c) // width for c in coded]
        for q, seq in enumerate(pack_group(lengths, room)):
            offset = 0
            for d, start, n in seq:
                piece = coded[d][start * width:(start + n) * width]
                crc = zlib.crc32(np.frombuffer(piece, f"<u{width}").astype("<u4").tobytes())
                for column, v in zip(rows, (ids[d], start, n, crc, lengths[d], base + q, offset, piece if with_ids else None)):
                    column.append(v)
                offset += n
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in rows[:7]] + [pa.array(rows[7], pa.binary())], names)

    coded = picked.mapInArrow(encode, "g long, doc_id long, coded binary")
    out = coded.groupBy("g").applyInArrow(fill, PIECES)
    return out if with_ids else out.drop("ids")
