"""BPE encoding and decoding of whole texts by tree concatenation.

A text longer than a leaf is cut into halves until leaves are short; leaves are encoded in parallel (one batch call, in the library's threads) and
neighbouring encodings are joined bottom-up. At a join the characters around it are encoded again in a window that grows
until it agrees with both sides; then left part + window + right part is the encoding of the whole. Where a side's tokens lie is known from the
bytes that each token stands for, so only windows are encoded again, with white space near or without.

Why agreement is exact: a token sequence inside one pre-token is what BPE yields if and only if each two neighbours are
what BPE yields for the two together (merges happen by rank, then position). Every pair of neighbours of the joined
sequence lies within one of three valid encodings, as the window shares at least one token with either side. Pre-tokens are
found left to right without looking back, and look at most 3 characters ahead, so a shared token end of a word,
or shared tokens inside a run of letters or signs of 3 characters or more, put both on the same pre-tokens. The shared token on the
left ends at least MARGIN characters before the join.

Normalising (NFC, white space, lower case) and special tokens are done over the whole text first, as the tokenizers library does.

Null texts count as empty and give no ids and the empty text. Rows are independent; repeated rows give equal results. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

LEAF, MARGIN, WINDOW = 8192, 8, 24


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TreeEncoder:
    """ids of texts under a tokenizers file whose pre-tokens are words and runs of signs (word_bpe_49k.json)."""

    #: Characters for which lower() and the pattern below do what the file's normaliser and pre-tokeniser do; a leaf with others is left to the library.
    PLAIN = r"[\t\n\r\x20-\x7e\xa1-\u024f]*"
    PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Words whose ids are remembered, within a task; beyond, the memory starts anew, which costs time only.
    REMEMBERED = 100_000

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        import regex
        from tokenizers import Tokenizer, normalizers

        self.inner, self.leaf, self.window = Tokenizer.from_file(path), leaf, window
        self.inner.no_truncation(), self.inner.no_padding()
        self.normalizer = self.inner.normalizer
        self.inner.normalizer = normalizers.Sequence([])
        self.inner.encode_special_tokens = True  # none is left when it is used
        self.specials = {t.content: i for i, t in self.inner.get_added_tokens_decoder().items()}
        n = self.inner.get_vocab_size()
        self.tokens = [self.inner.id_to_token(i) for i in range(n)]
        self.ends_word = np.array([t.endswith("</w>") for t in self.tokens])
        #: Bytes of text that a token stands for: its characters are bytes, but for the mark of a word's end.
        self.sizes = np.array([len(t.removesuffix("</w>")) for t in self.tokens], np.int64)
        self.plain, self.pre_tokens, self.known = regex.compile(self.PLAIN).fullmatch, regex.compile(self.PRE_TOKEN).findall, {}
        self.re_encoded = 0

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        leaves = {}
        threads(False)
        for k, t in enumerate(texts):
            if len(t) > self.leaf or "<|" in t:
                out[k] = self.encode_long(t)
            else:
                leaves[k] = self._normal(t)
        for k, ids in zip(leaves, self._leaves(list(leaves.values())), strict=True):
            out[k] = ids
        return out

    def encode_long(self, text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for piece, special in self._split_specials(text):
            parts.append(np.array([special], np.uint32) if special is not None else self._tree(self._normal(piece)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _normal(self, text: str) -> str:
        return text.lower() if self.plain(text) else self.normalizer.normalize_str(text)

    def _split_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        import re

        for piece in re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text) if self.specials else [text]:
            if piece:
                yield piece, self.specials.get(piece)

    def _leaves(self, texts: list[str]) -> list[np.ndarray]:
        """ids of normalised texts; those of a pre-token are worked out once while it is remembered."""
        known, found = self.known, {}
        if len(known) > self.REMEMBERED:
            known.clear()
        for k, t in enumerate(texts):
            if self.plain(t):
                found[k] = self.pre_tokens(t)
        new = list({w for ws in found.values() for w in ws if w not in known})
        for w, e in zip(new, self.inner.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        out: list = [None] * len(texts)
        for k, ws in found.items():
            out[k] = np.frombuffer(b"".join([known[w] for w in ws]), "<u4")
        rest = [k for k in range(len(texts)) if k not in found]
        for k, e in zip(rest, self.inner.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def _tree(self, text: str) -> np.ndarray:
        cuts, todo = [], [(0, len(text))]
        while todo:
            a, b = todo.pop()
            if b - a <= self.leaf:
                cuts.append((a, b))
            else:
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        cuts.sort()
        threads(len(cuts) > 1)
        level = [(a, b, ids) for (a, b), ids in zip(cuts, self._leaves([text[a:b] for a, b in cuts]), strict=True)]
        while len(level) > 1:
            level = [self._join(text, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0][2] if level else np.zeros(0, np.uint32)

    def _spots(self, text: str, a: int, b: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends in characters) of the tokens ids of text[a:b]; a token that ends within a character counts it whole, and so does the next."""
        size, _ = self._bytes(text, a, b)
        at = np.flatnonzero(size)
        upto = np.cumsum(size[at])
        stop = np.cumsum(self.sizes[ids])
        first, last = np.searchsorted(upto, stop - self.sizes[ids], "right"), np.searchsorted(upto, stop, "left")
        return ids.astype(np.int64), a + at[first], a + at[last] + 1

    def _bytes(self, text: str, a: int, b: int) -> tuple[np.ndarray, int]:
        """Bytes of each character of text[a:b], 0 for white space, and their sum."""
        c = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), "<u4")
        size = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        size[(c == 32) | ((c >= 9) & (c <= 13))] = 0
        return size, int(size.sum())

    def _placed(self, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends in characters) of text[a:b]"""
        self.re_encoded += b - a
        return self._spots(text, a, b, np.array(self.inner.encode(text[a:b], add_special_tokens=False).ids, np.int64))

    def _tail(self, text: str, a: int, p: int, ids: np.ndarray, size: int) -> tuple[int, tuple]:
        """The last tokens of text[a:p], those of about size characters, and where they begin."""
        while True:
            q = max(a, p - size)
            if q == a:
                return a, self._spots(text, a, p, ids)
            # as many tokens as lie in there whole, from the start of a character on
            each, total = self._bytes(text, q, p)
            back = np.cumsum(self.sizes[ids[::-1][:total]])
            k = int(np.searchsorted(back, total, "right"))
            upto = total - np.cumsum(each)
            while k and not (upto == back[k - 1]).any() and back[k - 1] != total:
                k -= 1
            if k:
                q = p - len(each) if back[k - 1] == total else p - len(each) + 1 + int(np.flatnonzero(upto == back[k - 1])[-1])
                while text[q].isspace():
                    q += 1
                return q, self._spots(text, q, p, ids[len(ids) - k :])
            size *= 2

    def _head(self, text: str, p: int, b: int, ids: np.ndarray, size: int) -> tuple[int, tuple]:
        """The first tokens of text[p:b], those of about size characters, and where they end."""
        while True:
            r = min(b, p + size)
            if r == b:
                return b, self._spots(text, p, b, ids)
            each, total = self._bytes(text, p, r)
            forth = np.cumsum(self.sizes[ids[:total]])
            k = int(np.searchsorted(forth, total, "right"))
            upto = np.cumsum(each)
            while k and not (upto == forth[k - 1]).any():
                k -= 1
            if k:
                return p + int(np.flatnonzero(upto == forth[k - 1])[0]) + 1, self._spots(text, p, r, ids[:k])
            size *= 2

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        a, p, left_ids = left
        _, b, right_ids = right
        span = self.window
        while True:
            q, (li, ls, le) = self._tail(text, a, p, left_ids, 2 * span + 32)
            r, (ri, rs, re_) = self._head(text, p, b, right_ids, 2 * span + 32)
            # the window starts at the start of a token of the left side and ends at the end of one of the right side
            x = int(np.searchsorted(ls, p - span, "right")) - 1
            y = int(np.searchsorted(re_, p + span, "left"))
            w0 = int(ls[x]) if x >= 0 else q
            w1 = int(re_[y]) if y < len(ri) else r
            i = m = 0
            window = self._placed(text, w0, w1)
            got = self._agree(p, q == a and w0 <= max(a, int(ls[0]) if len(ls) else a), w1 == b, (li, ls, le), (ri, rs, re_), window)
            if got is not None:
                i, m, n, j = got
                return a, b, np.concatenate((left_ids[: len(left_ids) - len(li) + i], window[0][m:n].astype(np.uint32), right_ids[j:]))
            span *= 2

    def _agree(self, p: int, from_start: bool, to_end: bool, left: tuple, right: tuple, window: tuple) -> tuple[int, int, int, int] | None:
        """Left tokens before i, window tokens m..n and right tokens from j on make the whole; None if a side disagrees."""
        wi, ws, we = window
        if from_start:
            i = m = 0
        else:
            shared = self._shared(left, window, lambda end: end <= p - MARGIN, first=True)
            if shared is None:
                return None
            i, m = shared
        if to_end:
            return i, m, len(wi), 1 << 60
        last = int(we[-1]) if len(we) else p
        shared = self._shared(right, window, lambda end: end <= last - MARGIN, first=False, beyond=p)
        return None if shared is None else (i, m, shared[1], shared[0])

    def _shared(self, side: tuple, window: tuple, fits, first: bool, beyond: int = -1) -> tuple[int, int] | None:
        """Index in side and in window of a token that both have at the same place, by the rules above."""
        si, ss, se = side
        wi, ws, we = window
        if not len(wi) or not len(si):
            return None
        at = np.searchsorted(ss, ws)
        ok = at < len(ss)
        at = np.minimum(at, len(ss) - 1)
        ok &= (ss[at] == ws) & (se[at] == we) & (si[at] == wi) & fits(we) & (ws >= beyond)
        if not ok.any():
            return None
        if first:
            # the window starts where a left token starts, and is only right if it begins with that very token
            return (int(at[0]), 0) if ok[0] else None
        run = 0
        for k in range(len(ok)):
            if not ok[k]:
                run = 0
                continue
            if self.ends_word[wi[k]]:
                return int(at[k]) + 1, k + 1
            run += int(we[k] - ws[k])
            if run > 3:
                return int(at[k]), k
        return None

    def decode_batch(self, ids: list) -> list[str]:
        """As the library's decode(ids, skip_special_tokens=False); without a decoder in the file that is the tokens with a space between."""
        if self.inner.decoder is not None:
            return self.inner.decode_batch([list(map(int, i)) for i in ids], skip_special_tokens=False)
        return [" ".join([self.tokens[j] for j in (i.tolist() if isinstance(i, np.ndarray) else i)]) for i in ids]


def threads(on: bool) -> None:
    """Whether the library's batch calls use threads: a task has one core, but a long text's halves may have more."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


@lru_cache(1)
def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    return TreeEncoder(path, leaf)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF, digests: bool = False, batch_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, and ids (array<int>) and decoded (string), or only their SHA-256 if digests (then neither leaves the worker).

    path: the tokenizers file, at that place on every executor. batch_chars: characters handed to one batch call; a longer text is one call.
    """
    path = path or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            a = 0
            while a < b.num_rows:
                # texts become Python strings a few at a time
                texts = b.column(1).slice(a, 256).to_pylist()
                size, z = len(texts[0] or ""), 1
                while z < len(texts) and size + len(texts[z] or "") <= batch_chars:
                    size += len(texts[z] or "")
                    z += 1
                ids = enc.encode_batch([t or "" for t in texts[:z]])
                decoded = enc.decode_batch(ids)
                n = pa.array([len(i) for i in ids], pa.int64())
                if digests:
                    more = [pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
                else:
                    more = [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z), n, *more], ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])
                a += z
        enc.known.clear()
        tv.give_back()

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(apply, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))
