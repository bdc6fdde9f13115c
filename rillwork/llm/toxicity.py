"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's probability is logistic in its words and their first BEGINNING bytes (hashed into BUCKETS weights); a document's is the noisy-or 1 - prod(1 - p) of its sentences'. The weights are
fitted to document labels alone, by gradient steps on the noisy-or likelihood; the sentences' own scores then locate the offending ones.

The fit uses at most `most` labelled rows of at most `longest` bytes of text each (the first by a hash of their id), two of the parameters. Scoring reads every text whole. Null, empty and wordless
texts have no sentence and score 0. Labels of a repeated id count once each; null labels are left out. With no usable label, or labels of one kind only, the
score is that of the prior. Equal texts get equal scores; repeated rows are scored each on their own. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .held import first_by_hash, held_out

BUCKETS, BEGINNING, LEAST_DOCS, MOST_LABELLED, LONGEST, THRESHOLD = 1 << 18, 5, 4, 6_000, 1 << 15, 0.3
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x0A, 0x3B]] = True


def sentence_words(buf: np.ndarray, offsets: np.ndarray):
    """(bucket of each word and of its beginning, its sentence, each sentence's row, its first and last byte); a sentence ends with . ! ? ; or a line."""
    low = tv.LOWER[buf]
    starts, ends, row = tv.runs(tv.LETTER[low], offsets)
    h = tv.run_hashes(low, starts, ends)
    stops = np.concatenate((np.zeros(1, np.int64), np.cumsum(_STOP[buf], dtype=np.int64)))
    key = stops[starts] + row  # grows with each stop and each row
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    sent = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(key)])) - 1 if len(key) else first
    beginning = tv.run_hashes(low, starts, np.minimum(ends, starts + BEGINNING)) ^ np.uint64(0x5BD1E995)
    parts = (np.concatenate((h, beginning)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return parts, np.concatenate((sent, sent)), row[first], starts[first], ends[last]


@dataclass
class NoisyOr:
    weights: np.ndarray
    bias: float

    def sentences(self, word: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(sent, self.weights[word], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def documents(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1 - np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))


def fit(texts: list[str], labels: np.ndarray, steps: int = 120, sparsity: float = 1.0) -> NoisyOr:
    """Proximal gradient steps on the document likelihood, with a penalty of `sparsity` on each weight's size (so words that few documents speak for get none).

    d(log P)/dz of a sentence is p (1 - P) / P in toxic documents and -p in others.
    """
    model = NoisyOr(np.zeros(BUCKETS), -4.0)
    if len(texts) < 2 or labels.min() == labels.max():
        return model
    parts = []
    for at, buf, off in tv.text_chunks(pa.array(texts, pa.large_string())):
        word, sent, row, _, _ = sentence_words(buf, off)
        # a word counts once a sentence
        pair = np.unique(sent * BUCKETS + word)
        parts.append((at, (pair % BUCKETS).astype(np.int32), (pair // BUCKETS).astype(np.int32), row))
    docs = [None] * len(texts)
    for at, word, sent, row in parts:
        n = int(row[-1]) + 1 if len(row) else 0
        s_ends, w_ends = np.searchsorted(row, np.arange(n), "right"), None
        w_ends = np.searchsorted(sent, s_ends, "left")
        s0 = w0 = 0
        for r in range(n):
            docs[at + r] = (word[w0 : w_ends[r]], sent[w0 : w_ends[r]] - np.int32(s0), int(s_ends[r] - s0))
            s0, w0 = int(s_ends[r]), int(w_ends[r])
    # a word of few labelled documents would only name them
    common = np.zeros(BUCKETS, np.int64)
    for d in docs:
        if d is not None:
            common[np.unique(d[0])] += 1
    docs = [None if d is None else (d[0][ok], d[1][ok], d[2]) for d in docs for ok in [d is not None and common[d[0]] >= LEAST_DOCS]]
    used = [k for k, d in enumerate(docs) if d is not None and d[2]]
    if not used:
        return model
    sizes = np.array([docs[k][2] for k in used])
    word = np.concatenate([docs[k][0] for k in used])
    sent = np.concatenate([docs[k][1] + np.int32(b) for k, b in zip(used, np.cumsum(sizes) - sizes, strict=True)])
    row, y = np.repeat(np.arange(len(used)), sizes), labels[used]
    del docs, parts
    met = np.flatnonzero(np.bincount(word, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[met] = np.arange(len(met))
    word = place[word]
    w, n = np.zeros(len(met)), np.bincount(word, minlength=len(met))
    size = 4 / (4 + n)
    for _ in range(steps):
        z = np.bincount(sent, w[word], minlength=len(row)) + model.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = np.maximum(NoisyOr.documents(p, row, len(used)), 1e-6)
        pull = np.where(y[row] == 1, p * ((1 - whole) / whole)[row], -p)
        w += size * np.bincount(word, pull[sent], minlength=len(met))
        w = np.sign(w) * np.maximum(np.abs(w) - size * sparsity, 0)
        model.bias += float(pull.sum()) / (0.25 * len(used) + 4)
    model.weights[met] = w
    return model


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, longest: int = LONGEST) -> NoisyOr:
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    few = first_by_hash(usable, "doc_id", most)  # at most `most` rows of an id and a digit
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    rows = texts.join(F.broadcast(few), "doc_id").orderBy("doc_id", "y", F.xxhash64("text")).limit(most).collect()  # ids may repeat
    return fit([r.text for r in rows], np.array([r.y for r in rows], np.int64))


def _score(model: NoisyOr, texts: pa.Array) -> Iterator[tuple]:
    for at, buf, off in tv.text_chunks(texts):
        word, sent, row, a, z = sentence_words(buf, off)
        pair = np.unique(sent * BUCKETS + word)
        p = model.sentences(pair % BUCKETS, pair // BUCKETS, len(row))
        yield at, buf, off, p, row, a, z, NoisyOr.documents(p, row, len(off) - 1)


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_offending and offending: the sentences whose own probability is the threshold or more, as start:end in code points (end exclusive), joined by commas."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, where = [np.zeros(0)], [[] for _ in range(b.num_rows)]
            for at, buf, off, p, row, a, z, s in _score(shared.value, b.column(2)):
                scores.append(s)
                bad = np.flatnonzero(p >= threshold)
                if len(bad):
                    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                    begin = points[off[row[bad]]]
                    for r, i, j in zip(row[bad].tolist(), (points[a[bad]] - begin).tolist(), (points[z[bad]] - begin).tolist(), strict=True):
                        where[at + r].append(f"{i}:{j}")
            s = np.round(np.clip(np.concatenate(scores), 0, 1), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([len(w) for w in where], pa.int64()), pa.array([",".join(w) for w in where], pa.string())], ["doc_id", "held_out", "score", "predicted", "n_offending", "offending"])
        tv.give_back()

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(apply, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_offending long, offending string")


def offending(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, sentence, score of each sentence whose own probability is the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, scores = [], [], []
            for at, buf, _, p, row, a, z, _ in _score(shared.value, b.column(1)):
                for k in np.flatnonzero(p >= threshold):
                    keys.append(at + int(row[k]))
                    texts.append(buf[a[k] : z[k]].tobytes().decode())
                    scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "sentence", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(apply, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, sentence string, score double")
