"""Word-piece counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where a state can't be extended,
the longest pieces of what it has read are popped and the link leads to the
state of what is left.  How many tokens are popped is computed once per state,
so counting reads each character once and never builds a piece.  A character
that no piece starts with costs as many tokens as it has UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks the start of a word in the vocabulary.
START = "▁"
CACHE = 400_000


def byte_cost(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


class LongestMatch:
    """``step``: transitions per state; ``link``: failure link; ``popped``: tokens popped when it is followed."""

    def __init__(self, pieces: list[str]):
        self.step: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                to = self.step[node].get(c)
                if to is None:
                    to = self.step[node][c] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                node = to
            ends[node] = True
        self.link, self.popped = [0] * len(self.step), [0] * len(self.step)
        level = []
        for c, v in self.step[0].items():
            self.popped[v] = 1 if ends[v] else byte_cost(c)
            level.append(v)
        while level:
            below = []
            for u in level:
                for c, v in self.step[u].items():
                    below.append(v)
                    if ends[v]:
                        self.popped[v] = 1
                        continue
                    z, n = self.link[u], self.popped[u]
                    while c not in self.step[z] and z:
                        n += self.popped[z]
                        z = self.link[z]
                    to = self.step[z].get(c)
                    self.link[v], self.popped[v] = (to, n) if to is not None else (0, n + byte_cost(c))
            level = below

    def count(self, word: str) -> int:
        """Tokens of a word under greedy longest match."""
        step, link, popped, node, n = self.step, self.link, self.popped, 0, 0
        for c in word:
            to = step[node].get(c)
            while to is None and node:
                n += popped[node]
                node = link[node]
                to = step[node].get(c)
            if to is None:
                n += byte_cost(c)
            else:
                node = to
        while node:
            n += popped[node]
            node = link[node]
        return n


def greedy_count(word: str, pieces: set[str]) -> int:
    """The same number by building the pieces; for tests."""
    longest, at, n = max(map(len, pieces), default=1), 0, 0
    while at < len(word):
        size = next((s for s in range(min(longest, len(word) - at), 0, -1) if word[at:at + s] in pieces), 0)
        n += 1 if size else byte_cost(word[at])
        at += size or 1
    return n


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) per row of ``docs``.

    Words stand between white space; each is read as the start mark and its
    characters.  Null and empty texts have no words and no tokens.  Rows are
    independent; an empty table gives an empty result; other columns are
    ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = picked.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))  # one vocabulary: under a MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = LongestMatch(shared.value), {}
        for b in batches:
            words, tokens = [], []
            for text in b.column(1):
                parts = (text.as_py() or "").split()
                n = 0
                for w in parts:
                    k = known.get(w)
                    if k is None:
                        k = automaton.count(START + w)
                        if len(w) <= 64:
                            known[w] = k
                    n += k
                if len(known) > CACHE:
                    known.clear()
                words.append(len(parts))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return picked.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
