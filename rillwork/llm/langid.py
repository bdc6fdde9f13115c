"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1; an n-gram is the product of its letters' vectors, each permuted (rotated) by its place; a document is the
sum of its n-grams, a language the sum of its documents' (each scaled to one). A document gets the language of the highest cosine.

Letters are lower-cased; those beyond a-z share CODES - 27 vectors by a mix of their code point and its block, so that scripts overlap by chance only. A word's edges count as a letter. Prototypes learn from at most
`most` labelled rows of at most `longest` bytes each (the first by a hash of their id), two of the parameters. Texts are read whole. Null texts and texts without a letter are `und` with score
0. Null labels are left out; with none at all, everything is `und`. Of equal cosines the first language by name wins. Repeated rows are predicted each on their own. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .held import first_by_hash, held_out

DIM, CODES, N, MOST_LABELLED, LONGEST = 512, 96, 3, 12_000, 1 << 15


@lru_cache(1)
def letters() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(17)).choice(np.array([-1, 1], np.float32), (CODES, DIM))


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """The code of each code point: 0 unless it is a letter of Unicode, which counts by its lower case."""
    out = np.zeros(0x110000, np.uint8)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[p] = low - 96 if 97 <= low <= 122 else 27 + (low + 31 * (low >> 7)) % (CODES - 27)
    return out


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, given as numbers in base CODES."""
    v, out = letters(), 1.0
    for place in range(N):
        out = out * np.roll(v, N - 1 - place, 1)[(grams // CODES ** (N - 1 - place)) % CODES]
    return out


def text_grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, row) of each n-gram within a word or at its edge; code 0 is the edge, a-z are 1 to 26, other letters 27 to CODES - 1."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
    if not len(lead):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, lead, "right") - 1
    point = buf[lead].astype(np.int64)
    nxt = np.concatenate((buf, np.zeros(3, np.uint8)))
    for first, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero(buf[lead] >= first)
        v = buf[lead[at]].astype(np.int64) & bits
        for k in range(1, more + 1):
            v = v << 6 | (nxt[lead[at] + k] & 0x3F)
        point[at] = v
    code = letter_codes()[np.minimum(point, 0x10FFFF)].astype(np.int64)
    edge_before = np.concatenate(([True], row[1:] != row[:-1]))
    # runs of what isn't a letter are one edge; a row starts and ends with one
    keep = (code > 0) | np.concatenate(([True], code[:-1] > 0)) | edge_before
    code, row, edge_before = code[keep], row[keep], edge_before[keep]
    spots = np.flatnonzero(edge_before)
    ends = spots[1:]  # the row before ends there
    at = np.concatenate((ends, spots))
    code, row = np.insert(code, at, 0), np.insert(row, at, np.concatenate((row[ends - 1], row[spots])))
    code, row = np.append(code, 0), np.append(row, row[-1] if len(row) else 0)
    gram = code[:-2] * CODES * CODES + code[1:-1] * CODES + code[2:]
    ok = (row[:-2] == row[2:]) & (code[1:-1] > 0)
    return gram[ok], row[:-2][ok]


def profiles(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct n-grams, their counts) of each text."""
    size = CODES**N
    for _, buf, off in tv.text_chunks(texts):
        gram, row = text_grams(buf, off)
        key, n = np.unique(row * size + gram, return_counts=True)
        ends = np.searchsorted(key, (np.arange(len(off) - 1) + 1) * size)
        a = 0
        for z in ends.tolist():
            yield key[a:z] % size, n[a:z]
            a = z


@dataclass
class Prototypes:
    names: list[str]
    vectors: np.ndarray  # one row a language, of length 1

    def scorer(self):
        """Of (n-grams, counts): the cosines with each language."""
        place = np.full(CODES**N, -1, np.int32)  # of an n-gram's vector in the table, which holds those met so far
        table, have = np.zeros((4096, DIM), np.int8), 0

        def score(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
            nonlocal table, have
            at = place[grams]
            new = grams[at < 0]
            if len(new):
                if have + len(new) > len(table):
                    table = np.concatenate((table, np.zeros((max(len(table), len(new)), DIM), np.int8)))
                table[have : have + len(new)] = bound(new)
                place[new] = np.arange(have, have + len(new))
                have += len(new)
                at = place[grams]
            v = np.zeros(DIM, np.float32)
            for a in range(0, len(at), 2048):
                v += counts[a : a + 2048].astype(np.float32) @ table[at[a : a + 2048]].astype(np.float32)
            return self.vectors @ (v / max(float(np.linalg.norm(v)), 1e-9))

        return score


def fit(texts: list[str], langs: list[str]) -> Prototypes:
    names = sorted(set(langs))
    sums = np.zeros((len(names), CODES**N))
    for (grams, n), lang in zip(profiles(pa.array(texts, pa.large_string())), langs, strict=True):
        if len(grams):
            sums[names.index(lang), grams] += n / np.sqrt(float((n.astype(float) ** 2).sum()))
    vectors = np.zeros((len(names), DIM))
    for a in range(0, CODES**N, 8192):
        used = a + np.flatnonzero(sums[:, a : a + 8192].any(0))
        if len(used):
            vectors += sums[:, used] @ bound(used)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Prototypes(names, vectors.astype(np.float32))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_LABELLED, longest: int = LONGEST) -> Prototypes:
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= longest))
    few = first_by_hash(usable.select("doc_id"), "doc_id", most)
    rows = usable.join(F.broadcast(few.distinct()), "doc_id", "left_semi").orderBy("doc_id", "lang", F.xxhash64("text")).limit(most).collect()  # ids may repeat
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Prototypes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (cosine, at least 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cosines = m.scorer()
        for b in batches:
            lang, score = [], []
            for grams, n in profiles(b.column(2)):
                c = cosines(grams, n) if len(grams) and m.names else None
                k = int(c.argmax()) if c is not None else -1
                lang.append(m.names[k] if k >= 0 else "und")
                score.append(round(min(1.0, max(0.0, float(c[k]))), 6) if k >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        tv.give_back()

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(apply, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
