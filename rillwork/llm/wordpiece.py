"""Greedy word-piece lengths by a linear longest-match automaton, without building pieces.

A word (a run without ASCII white space) is read byte by byte, with a leading space, through a trie of the vocabulary. A node's failure link leads to where the
longest match of its string, pieces popped greedily, leaves the rest; the number of pieces popped on that way is precomputed. So each byte costs
constant amortised time, whatever the word. Vocabularies hold all single bytes, so every word splits.

Null and blank texts have no words and no tokens. Rows are independent; texts and words are read whole, however long; an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

REMEMBERED = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    def __init__(self, pieces: Iterable[bytes]):
        goto: list[dict[int, int]] = [{}]
        is_piece = [False]
        for p in pieces:
            at = 0
            for c in p:
                nxt = goto[at].get(c)
                if nxt is None:
                    nxt = goto[at][c] = len(goto)
                    goto.append({})
                    is_piece.append(False)
                at = nxt
            is_piece[at] = True
        # breadth first: a node's link needs those of shorter strings
        fail, pops = [-1] * len(goto), [0] * len(goto)
        level = [0]
        while level:
            nxt_level = []
            for u in level:
                for c, v in goto[u].items():
                    nxt_level.append(v)
                    if is_piece[v]:
                        fail[v], pops[v] = 0, 1
                    else:
                        z, n = fail[u], pops[u]
                        while z >= 0 and c not in goto[z]:
                            n += pops[z]
                            z = fail[z]
                        fail[v], pops[v] = (goto[z][c], n) if z >= 0 else (-1, 0)
            level = nxt_level
        self.goto, self.fail, self.pops = goto, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of the word; ValueError if it doesn't split."""
        goto, fail, pops = self.goto, self.fail, self.pops
        at = n = 0
        for c in word:
            nxt = goto[at].get(c)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    raise ValueError(word)
                nxt = goto[at].get(c)
            at = nxt
        while at:
            n += pops[at]
            at = fail[at]
            if at < 0:
                raise ValueError(word)
        return n


_automata: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    if path not in _automata:
        _automata[path] = LongestMatch(vocabulary(path)), {}
    return _automata[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens. path: a file of base64 pieces, at that place on every executor."""
    path = path or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = automaton(path)
        for b in batches:
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, buf, off in tv.text_chunks(b.column(1)):
                starts, ends, row = tv.words(buf, off)
                # one count for each distinct word of the chunk
                _, first, at = np.unique(tv.classes(buf, starts, ends), return_index=True, return_inverse=True)
                if len(known) > REMEMBERED:
                    known.clear()
                raw, each = buf.tobytes(), np.zeros(len(first), np.int64)
                for k, (a, z) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
                    w = raw[a:z]
                    n = known.get(w)
                    if n is None:
                        n = auto.count(b" " + w)
                        if len(w) < 64:
                            known[w] = n
                    each[k] = n
                n_words.append(np.bincount(row, minlength=len(off) - 1))
                n_tokens.append(np.bincount(row, each[at], minlength=len(off) - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_tokens), pa.int64())], ["doc_id", "n_words", "n_tokens"])
        known.clear()
        tv.give_back()

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(apply, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
