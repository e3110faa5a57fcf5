"""Token counts by a linear longest-match automaton.

Words are split greedily into the longest pieces of a vocabulary. A trie of the vocabulary has, at
every node, a failure link to the node of what is left once the greedy pieces of the node's string are
popped, and the number of popped tokens, found in advance. A word's count is one walk over its
characters that adds popped counts; no piece is ever built.

A word is a run without white space and begins with the marker of word starts. A character outside the
vocabulary counts as its UTF-8 bytes.

Defined cases: null or empty text has 0 words and 0 tokens; repeated rows and rows without id are
counted like others; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from foliant.llm.textops import text_chunks, word_bounds, word_hashes
from foliant.shipping import map_arrow

MARK = "▁"
#: Words that a worker remembers.
MEMORY = 1_000_000
_worker: dict = {}


class LongestMatch:
    """Greedy token counts over a vocabulary trie with failure links and popped-token counts."""

    def __init__(self, pieces: Iterable[str], memory: int = MEMORY):
        pieces = {p for p in pieces if p and MARK not in p[1:]}
        characters = {c for p in pieces for c in p}
        self.next: list[dict[str, int]] = [{}]
        weight = [0]  # tokens of a node that is a piece
        for piece in sorted(characters | pieces):
            node = 0
            for c in piece:
                known = self.next[node].get(c)
                if known is None:
                    known = self.next[node][c] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                node = known
            weight[node] = 1 if piece in pieces else len(piece.encode())
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for c, node in self.next[parent].items():
                    if weight[node]:
                        self.fail[node], self.pops[node] = 0, weight[node]
                    else:
                        at, popped = self.fail[parent], self.pops[parent]
                        while c not in self.next[at]:
                            popped += self.pops[at]
                            at = self.fail[at]
                        self.fail[node], self.pops[node] = self.next[at][c], popped
                    deeper.append(node)
            level = deeper
        self.memory, self.known = memory, {}

    def count(self, word: str) -> int:
        node = total = 0
        for c in word:
            while c not in self.next[node]:
                if not node:
                    total += len(c.encode("utf-8", "replace"))
                    break
                total += self.pops[node]
                node = self.fail[node]
            else:
                node = self.next[node][c]
        while node:
            total += self.pops[node]
            node = self.fail[node]
        return total

    def word(self, word: bytes) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.count(MARK + word.decode("utf-8", "replace"))
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[word] = n
        return n


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _worker:
            _worker[path] = LongestMatch(vocabulary(path))
        automaton = _worker[path]
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), 4 << 20):
                starts, ends, at = word_bounds(data, offsets)
                sums = np.zeros(len(starts) + 1, dtype=np.int64)
                if len(starts):
                    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                    raw = data.tobytes()
                    counts = np.array([automaton.word(raw[s:e]) for s, e in zip(starts[first].tolist(), ends[first].tolist())], dtype=np.int64)
                    np.cumsum(counts[which], out=sums[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(sums[at]), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, _count(path or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_words long, n_tokens long")
