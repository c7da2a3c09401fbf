"""Language identification by cross-parsing.

For each language a suffix automaton holds every substring of a sample of its
labelled text.  A document is parsed greedily against each: from every phrase
start the longest match is taken, and where it ends the next phrase starts.
With n letters in the sample, c phrases over m letters estimate the cross
entropy c log2(n) / m; the language needing the fewest normalised phrases wins.

The automata are written as flat transition tables in which a missing
transition leads where the first letter of the next phrase leads from the
root, with the sign bit set.  Whole texts are cut into blocks, and all blocks
of a batch advance together, one letter a step, for all languages at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BLOCK = 256
SLICE = 2_000_000


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def letters_of(text: str) -> str:
    """Lower-cased letters; everything between letters becomes one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions per state of the automaton of all substrings; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return step


class Model:
    """Languages, letter codes and the joint transition table.

    Codes: 0 padding, 1 space, 2 a letter that no sample holds, then the
    letters.  Table entries are row starts; the sign bit marks a new phrase.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s} - {" "})
        code = {c: i + 3 for i, c in enumerate(letters)} | {" ": 1}
        width = len(letters) + 3
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            step = suffix_automaton([code[c] for c in samples[lang]])
            t = np.full((len(step) + 1, width), -1, np.int64)  # the last row follows a letter that the sample lacks
            for s, out in enumerate(step):
                for c, to in out.items():
                    t[s, c] = to
            restart = np.where(t[0] >= 0, t[0], len(step))
            first = restart * width + base
            t = np.where(t >= 0, t * width + base, first | (1 << 31))
            t[0] = first  # the root is left by a block's first letter, which ends no phrase
            t[:, 0] = base
            tables.append(t.astype(np.uint32).view(np.int32).ravel())
            self.roots.append(base)
            base += t.size
        if base >= 1 << 31:
            raise ValueError("the samples are too large for one table; lower sample_chars")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = np.array([math.log2(max(2, len(samples[x]))) for x in self.langs])
        self.codes = np.ones(0x110000, np.uint16)
        self.codes[[i for i in range(0x110000) if chr(i).isalpha()]] = 2
        for c, i in code.items():
            self.codes[ord(c)] = i

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text: letters, and one space for every run of others between them."""
        c = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = c == 1
        keep = ~space
        keep[1:] |= ~space[:-1]
        c = c[keep]
        return c[int(len(c) > 0 and c[0] == 1): len(c) - int(len(c) > 1 and c[-1] == 1)]

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases per document and language: (documents, languages)."""
        lens = np.array([len(d) for d in docs], np.int64)
        blocks = -(-lens // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.zeros(first[-1] * BLOCK, np.int32)
        if not len(flat):
            return np.zeros((len(docs), len(self.langs)))
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        flat[np.repeat(first[:-1] * BLOCK - starts, lens) + np.arange(lens.sum())] = np.concatenate(docs)
        lanes = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], lanes.shape[1], axis=1)
        count = np.ones_like(state)  # the phrase that the block's end cuts off
        for codes in lanes:
            state = self.table.take(state + codes)
            count -= state >> 31
            state &= 0x7FFFFFFF
        return np.add.reduceat(np.pad(count, ((0, 0), (0, 1))), first[:-1], axis=1).T * (blocks > 0)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits a letter) per text; score is how far the second language falls behind, 0 to 1."""
        codes = [self.encode(t or "") for t in texts]
        out: list[tuple[str, float, float | None]] = []
        at = 0
        while at < len(codes):
            end, size = at, 0
            while end < len(codes) and (end == at or size + len(codes[end]) <= SLICE):
                size += len(codes[end])
                end += 1
            part = codes[at:end]
            count = self.phrases(part)
            for row, c in zip(count, part):
                if not (c > 1).any() or not self.langs:
                    out.append((UNKNOWN, 0.0, None))
                    continue
                bits = row * self.bits / len(c)
                best = int(bits.argmin())
                second = np.delete(bits, best).min() if len(bits) > 1 else math.inf
                out.append((self.langs[best], float(1 - bits[best] / second) if second < math.inf else 1.0, float(bits[best])))
            at = end
        return out


def learn(labelled: DataFrame, sample_docs: int = 300, sample_chars: int = 20_000) -> Model:
    """A model from (doc_id, text, lang).

    The sample is bounded: per language ``sample_docs`` documents, those with
    the smallest hash of the id, share ``sample_chars`` letters.  Only text
    with letters and a non-null label counts.
    """
    each = 4 * max(1, sample_chars // sample_docs)
    top = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "start")
    rows = (
        labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("doc_id", "lang", F.substring("text", 1, each).alias("start"))
        .withColumn("n", F.row_number().over(top)).where(F.col("n") <= sample_docs).collect()
    )
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append((r["n"], letters_of(r["start"])))
    samples = {}
    for lang, found in parts.items():
        share = -(-sample_chars // len(found))
        text = " ".join(t[:share] for _, t in sorted(found))[:sample_chars]
        if text.strip():
            samples[lang] = text
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, with a column ``text``, and lang_pred, score and bits of every whole text.

    A null text or one without letters is ``und`` with score 0.  Equal
    languages go to the first in code point order.  Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_chars per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = shared.value.predict(part.column("text").to_pylist())
                lang, score, bits = zip(*found)
                more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]
                yield pa.RecordBatch.from_arrays(part.columns + more, [*part.schema.names, "lang_pred", "score", "bits"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, lang_pred string, score double, bits double")


def predicted(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learned from the rows that aren't held out."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(plain.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), **options)
    return identify(plain.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """Documents with a language, ``lang`` set to the predicted one; those without a letter go."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(plain.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    new = {"text": F.col("text"), "lang": F.col("lang_pred")}
    found = identify(rows, model).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
