"""Token ids of a corpus in files compressed by a grammar: Re-Pair by shard, with expansion lengths for random access.

Writing: documents are sorted by id across partitions, encoded, each ended by END, and cut into shards of at most SHARD_IDS ids. In a shard the pairs of neighbouring symbols that occur most
are replaced by new symbols (nonterminals), round after round, until no pair occurs MIN_COUNT times, a round shortens the shard by less than LEAST_GAIN, or the symbols run out. All pairs of a round
are counted over the whole shard; where two chosen pairs overlap the more frequent one is taken.

The file format is a table that Spark writes and reads, so it works in any store that Spark reaches and a lost task leaves nothing behind. A row is a shard:

| column | |
|-|-|
| part, shard | which sorted partition, and which shard of it |
| first_id, last_id | least and greatest document id in it but null: filters on them are pushed to the scan |
| before | ids of the part before this shard |
| n_ids | ids that it expands to |
| docs | array of (doc_id, row, piece, last, start, n): pieces of documents, start within the shard; row numbers the part's documents. Only a document of more than SHARD_IDS ids has several pieces |
| rules | little-endian uint32 pairs: symbol BASE + k stands for pair k; smaller symbols are token ids |
| lengths | uint32: ids that each rule expands to |
| symbols | the shard as uint16, or uint32 where a symbol needs it |
| marks | uint32: ids before each STEP-th symbol |

and `manifest` has a row for each part: the ids before it. Reading a range of a shard looks marks up, sums lengths from there and expands only the symbols that the range touches.

Null texts count as empty: a document of END alone. Null ids come first. Rows of one id are ordered by a hash of their texts; equal rows are both kept. A text is encoded whole, however long.
An empty table gives an empty folder's table with no rows. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import threads
from .neardup import shared_checkpoints

END = 0
SHARD_IDS, MIN_COUNT, LEAST_GAIN, PER_ROUND, STEP = 1 << 20, 8, 0.1, 16384, 1024
#: Rules of a shard are at most what keeps its symbols within 16 bits, or this number where the vocabulary alone needs more.
MOST_RULES = 1 << 14
_BUCKETS = 18
#: Buckets (a power of 2) in which equal runs of bytes meet.
_RUN_BUCKETS = 20
#: Bytes of text whose chunks are found at once.
SLICE_BYTES = 3 << 21
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0
_KIND[65:91] = _KIND[97:123] = 1
#: Of eight bytes the first n.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alike(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each run of bytes other than 0, from 0 without gaps; runs of one number are equal. Up to 16 bytes are two numbers that say all: most runs meet an equal one in their bucket of a hash, those of a bucket
    that shows another run are sorted. Longer runs are compared in full."""
    length, out = ends - starts, np.empty(len(starts), np.int64)
    at = np.flatnonzero(length <= 16)
    wide = np.ndarray((len(buf) + 9,), "<u8", np.concatenate((buf, np.zeros(16, np.uint8))), strides=(1,))
    a, b = wide[starts[at]], wide[np.minimum(starts[at] + 8, len(buf))]
    n = length[at]
    a &= _MASKS[np.minimum(n, 8)]
    b &= _MASKS[np.maximum(n - 8, 0)]
    key = tv.mix(a + tv.mix(b))
    bucket = (key >> np.uint64(32) >> np.uint64(32 - _RUN_BUCKETS)).astype(np.int32)
    table = np.empty(1 << _RUN_BUCKETS, np.int32)
    table[bucket] = np.arange(len(at), dtype=np.int32)
    shown = table[bucket]
    own = (a[shown] == a) & (b[shown] == b)
    number = np.zeros(len(at), np.int32)
    number[shown[own]] = 1
    found = int(number.sum())
    number = np.cumsum(number, dtype=np.int32) - 1
    got = number[shown].astype(np.int64)
    left = np.flatnonzero(~own)
    if len(left):
        order = left[np.argsort(key[left])]
        x, y = a[order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        got[order] = found - 1 + np.cumsum(new)
        found += int(new.sum())
    rest = np.flatnonzero(length > 16)
    if not len(rest):
        return got
    out[at] = got
    out[rest] = tv.classes(buf, starts[rest], ends[rest]) + found
    return out


class ByteEncoder:
    """ids under a byte-level BPE file, as the tokenizers library gives them without truncation and padding.

    No token crosses from a character to white space after it, nor between letters and others, but that an apostrophe may take letters after it. So a text is encoded by its chunks
    (white space, then letters, or others without an apostrophe, or others and the letters after them). Chunks are found in the bytes of many texts at once; each different one is
    encoded once for them, and its ids are remembered.
    A text with control characters or characters beyond U+00A1 to U+024F, whose kinds this module doesn't know, or with the start of a special token, is left to the library whole.
    """

    #: Below U+00C0 the second bytes of three letters, and from there on those of two signs.
    _OTHER_LETTERS, _NO_LETTERS = (0xAA, 0xB5, 0xBA), (0x97, 0xB7)
    #: Chunks whose ids a worker remembers, some 80 MB; beyond, only those of the texts at hand stay, which costs time only.
    REMEMBERED = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner, self.known = Tokenizer.from_file(path), {}
        self.inner.no_truncation(), self.inner.no_padding()
        self.size = self.inner.get_vocab_size()
        #: Bytes that a token stands for: each character of its name is one.
        self.bytes = np.array([len(self.inner.id_to_token(i)) for i in range(self.size)], np.int64)
        #: What a special token begins with; its text is not cut into chunks.
        self.marks = [t.content[:2].encode() for t in self.inner.get_added_tokens_decoder().values()]
        threads(False)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number for each text), for slices of the texts in order."""
        for _, buf, offsets in tv.text_chunks(texts, SLICE_BYTES):
            yield self._slice(buf, offsets)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = self._plain(buf, offsets)
        if plain.all():
            return self._plain_ids(buf, offsets)
        keep = np.repeat(plain, np.diff(offsets))
        sizes = np.where(plain, np.diff(offsets), 0)
        ids, n = self._plain_ids(buf[keep], np.concatenate(([0], np.cumsum(sizes))))
        parts, at = [], 0
        for k, alone in enumerate((~plain).tolist()):
            if alone:
                parts.append(self._whole(buf[offsets[k] : offsets[k + 1]].tobytes()))
                n[k] = len(parts[-1])
            else:
                parts.append(ids[at : at + n[k]])
                at += n[k]
        return np.concatenate(parts), n

    def _learn(self, new: list[bytes]) -> None:
        """Remembers the ids of chunks. Those of one space and a character that isn't white are encoded as one text, as it falls into them again; tokens' sizes tell whose they are."""
        known, one = self.known, [w for w in new if w[0] == 32 and len(w) > 1 and w[1] > 32]
        ids = np.array(self.inner.encode_batch_fast([b"".join(one).decode()], add_special_tokens=False)[0].ids, "<u4") if one else np.zeros(0, "<u4")
        at = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(np.fromiter(map(len, one), np.int64, len(one))), "left") + 1
        data, begin = ids.tobytes(), 0
        for w, stop in zip(one, (4 * at).tolist(), strict=True):
            known[w] = data[begin:stop]
            begin = stop
        rest = [w for w in new if not (w[0] == 32 and len(w) > 1 and w[1] > 32)]
        for w, e in zip(rest, self.inner.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def _plain(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts have known characters only, and no special token's start."""
        lead = buf >= 0xC0
        after = np.concatenate((buf[1:], np.zeros(1, np.uint8)))
        bad = ((buf < 0x20) & (buf != 9) & (buf != 10) & (buf != 13)) | (buf == 0x7F) | (lead & ((buf < 0xC2) | (buf > 0xC9)))
        bad |= ((buf == 0xC2) & (after < 0xA1)) | ((buf == 0xC9) & (after > 0x8F))
        for m in self.marks:
            bad |= (buf == m[0]) & (after == m[1]) if len(m) > 1 else buf == m[0]
        out = np.ones(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
        return out

    def _chunks(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the chunks; they cover the buffer."""
        n = len(buf)
        kind = _KIND[buf]  # 0 white space, 1 letters, 2 others; the second byte of a character has its first one's
        two = np.flatnonzero(buf >= 0xC0)
        low = (buf[two] == 0xC2) & ~np.isin(buf[np.minimum(two + 1, n - 1)], self._OTHER_LETTERS) | (buf[two] == 0xC3) & np.isin(buf[np.minimum(two + 1, n - 1)], self._NO_LETTERS)
        kind[two] = np.where(low, 2, 1)
        kind[np.minimum(two + 1, n - 1)] = kind[two]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        was = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        start = edge[:n] | (kind != was) & (was != 0)
        # letters that follow others with an apostrophe belong to them
        touch = np.flatnonzero(start & (kind == 1) & (was == 2) & ~edge[:n])
        if len(touch):
            upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(buf == 39, dtype=np.int32)))
            begun = np.flatnonzero((kind == 2) & ((was != 2) | edge[:n]))
            first = begun[np.searchsorted(begun, touch, "left") - 1]
            start[touch[upto[touch] > upto[first]]] = False
        starts = np.flatnonzero(start)
        return starts, np.concatenate((starts[1:], [n]))

    def _plain_ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, ends = self._chunks(buf, offsets)
        same = _alike(buf, starts, ends)
        shown = np.zeros(int(same.max()) + 1, np.int64)
        shown[same] = np.arange(len(same))
        data = buf.tobytes()
        names = [data[a:z] for a, z in zip(starts[shown].tolist(), ends[shown].tolist(), strict=True)]
        known = self.known
        if len(known) > self.REMEMBERED:
            known = self.known = {w: known[w] for w in names if w in known}
        self._learn([w for w in names if w not in known])
        each = [known[w] for w in names]
        pool = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        n = size[same]
        upto = np.cumsum(n)
        ids = pool[np.repeat((np.cumsum(size) - size)[same] - (upto - n), n) + np.arange(int(upto[-1]))]
        total = np.concatenate((np.zeros(1, np.int64), upto))
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(1)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def grammar(ids: np.ndarray, base: int, most_rules: int = MOST_RULES, min_count: int = MIN_COUNT, least_gain: float = LEAST_GAIN, per_round: int = PER_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules (k, 2), lengths): symbols from base on are rules. Pairs are counted by hash buckets that each count one pair exactly, the last one seen there; another pair of the bucket waits for a later round."""
    s, rules, lengths = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)]
    n_rules, size = 0, np.ones(base + most_rules, np.uint32)
    while n_rules < most_rules and len(s) > 1:
        pair = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
        bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)).astype(np.int32)
        shown = np.zeros(1 << _BUCKETS, np.uint64)
        shown[bucket] = pair
        own = shown[bucket] == pair
        count = np.bincount(bucket[own], minlength=1 << _BUCKETS)
        often = np.flatnonzero(count >= min_count)
        often = often[np.lexsort((shown[often], -count[often]))][: min(per_round, most_rules - n_rules)]
        if not len(often):
            break
        # rank 1 is the least frequent of the chosen pairs, 0 is none; of pairs that overlap the highest rank is taken, and every other one in a run of one symbol
        rank = np.zeros(1 << _BUCKETS, np.int32)
        rank[often] = np.arange(len(often), 0, -1)
        r = np.where(own, rank[bucket], 0)
        at = np.flatnonzero(r)
        here = r[at]
        before, after = np.where(at > 0, r[at - 1], 0), np.concatenate((r, [0]))[at + 1]
        run = np.flatnonzero(here != before)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
        take = (place % 2 == 0) & ((here >= before) | (place > 0)) & (here >= after)
        at, here = at[take], here[take]
        used = np.bincount(here, minlength=len(often) + 1)
        good = used >= min_count // 2
        good[0] = False
        keep = good[here]
        at, here = at[keep], here[keep]
        if not len(at):
            break
        made = np.flatnonzero(good)[::-1]
        symbol = np.zeros(len(often) + 1, np.uint32)
        symbol[made] = base + n_rules + np.arange(len(made))
        pairs = shown[often[len(often) - made]]
        new = np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], 1)
        size[base + n_rules : base + n_rules + len(made)] = size[new[:, 0]] + size[new[:, 1]]
        lengths.append(size[base + n_rules : base + n_rules + len(made)])
        rules.append(new)
        s[at] = symbol[here]
        left = np.ones(len(s), bool)
        left[at + 1] = False
        was, s = len(s), s[left]
        n_rules += len(made)
        if was - len(s) < least_gain * was:
            break
    return s, np.concatenate(rules), np.concatenate(lengths)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: all rules are replaced at once, level by level."""
    s = symbols.astype(np.uint32)
    while (inner := s >= base).any():
        at = np.cumsum(1 + inner) - 1 - inner
        out = np.empty(len(s) + int(inner.sum()), np.uint32)
        out[at] = s
        pairs = rules[s[inner] - base]
        out[at[inner]], out[at[inner] + 1] = pairs[:, 0], pairs[:, 1]
        s = out
    return s


class Shard:
    """A written shard; ids(a, b) expands no more than the symbols that hold ids a..b."""

    def __init__(self, base: int, rules: bytes, lengths: bytes, symbols: bytes, marks: bytes, width: int):
        self.base, self.rules = base, np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.lengths, self.marks = np.frombuffer(lengths, "<u4").astype(np.int64), np.frombuffer(marks, "<u4").astype(np.int64)
        self.symbols = np.frombuffer(symbols, f"<u{width}")
        #: What each rule expands to, one after another.
        self.pool = expand(np.arange(base, base + len(self.rules)), self.rules, base)
        self.stops = np.cumsum(self.lengths)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        k = STEP * (int(np.searchsorted(self.marks, a, "right")) - 1)
        z = min(len(self.symbols), STEP * int(np.searchsorted(self.marks, b, "left")))
        some = self.symbols[k:z].astype(np.int64)
        stop = int(self.marks[k // STEP]) + np.cumsum(np.where(some >= self.base, self.lengths[np.maximum(some - self.base, 0)] if len(self.lengths) else 1, 1))
        x, y = int(np.searchsorted(stop, a, "right")), int(np.searchsorted(stop, b, "left"))
        first = int(stop[x - 1]) if x else int(self.marks[k // STEP])
        some = some[x : y + 1]
        rule = np.maximum(some - self.base, 0)
        n = np.where(some >= self.base, self.lengths[rule], 1) if len(self.lengths) else np.ones(len(some), np.int64)
        upto = np.cumsum(n)
        out = np.repeat(some.astype(np.uint32), n)
        inner = np.flatnonzero(some >= self.base)
        if len(inner):
            at = np.repeat((self.stops - self.lengths)[rule[inner]] - (upto - n)[inner], n[inner])
            place = np.flatnonzero(np.repeat(some >= self.base, n))
            out[place] = self.pool[at + place]
        return out[a - first : b - first]


_DOC = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("last", pa.bool_()), ("start", pa.int32()), ("n", pa.int32())])
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int32()), ("docs", pa.list_(_DOC)), ("base", pa.int32()), ("width", pa.int32()),
    *[(c, pa.binary()) for c in ("rules", "lengths", "symbols", "marks")]])
_SHARD_DDL = "part int, shard int, first_id long, last_id long, before long, n_ids int, docs array<struct<doc_id:long,row:long,piece:int,last:boolean,start:int,n:int>>, base int, width int, rules binary, lengths binary, symbols binary, marks binary"


def _shard_row(part: int, shard: int, before: int, ids: np.ndarray, docs: list[tuple], base: int) -> pa.RecordBatch:
    most = (1 << 16) - base
    symbols, rules, lengths = grammar(ids, base, most if most > 0 else MOST_RULES)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    each = np.where(symbols >= base, lengths[np.maximum(symbols.astype(np.int64) - base, 0)] if len(lengths) else 1, 1)
    marks = (np.cumsum(each) - each)[::STEP]
    known = [d[0] for d in docs if d[0] is not None]
    row = {
        "part": part, "shard": shard, "first_id": min(known, default=None), "last_id": max(known, default=None), "before": before, "n_ids": len(ids),
        "docs": [dict(zip(("doc_id", "row", "piece", "last", "start", "n"), d, strict=True)) for d in docs], "base": base, "width": width,
        "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes(), "marks": marks.astype("<u4").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema=_SHARD)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int | None = END, shard_ids: int = SHARD_IDS) -> None:
    """Writes folder/shards and folder/manifest. path: the tokenizers file, at that place on every executor; end: the id after each document, or none."""
    path = path or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        shard = before = row = held = 0
        buf: list[np.ndarray] = []
        listed: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, held, buf, listed
            out = _shard_row(part, shard, before, np.concatenate(buf), listed, enc.size)
            shard, before, held, buf, listed = shard + 1, before + held, 0, [], []
            return out

        for b in batches:
            names, at = b.column(0).to_pylist(), 0
            for ids, counts in enc.encode(b.column(1)):
                stop = 0
                for n in counts.tolist():
                    stop += n
                    whole = ids[stop - n : stop] if end is None else np.append(ids[stop - n : stop], np.uint32(end))
                    if held and held + len(whole) > shard_ids:
                        yield flush()
                    for piece, x in enumerate(range(0, max(len(whole), 1), shard_ids)):
                        if piece:
                            yield flush()
                        some = whole[x : x + shard_ids]
                        listed.append((names[at], row, piece, x + shard_ids >= len(whole), held, len(some)))
                        buf.append(some)
                        held += len(some)
                    row, at = row + 1, at + 1
        if listed:
            yield flush()
        tv.give_back()

    # the last key deals equal rows to several partitions; which of them is which makes no difference
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    keys = ["doc_id", "h", "tie"]
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    d.mapInArrow(apply, _SHARD_DDL).write.option("compression", "zstd").parquet(f"{folder}/shards")
    parts = docs.sparkSession.read.parquet(f"{folder}/shards").groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    # one number a part meets in one task, as in any running sum over partitions
    parts.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first")).write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, lo: int | None = None, hi: int | None = None, ids: bool = True) -> DataFrame:
    """doc_id, row (part, number), piece, last, start (ids of the corpus before the piece), n, and ids (array<int>) of the documents, or of those with ids from lo to hi; other shards are not opened.

    Without ids: crc, the unsigned checksum of a document of one piece, or else raw, the piece's ids as bytes.
    """
    d = spark.read.parquet(f"{folder}/shards")
    if lo is not None:
        d = d.filter(F.col("last_id") >= lo)
    if hi is not None:
        d = d.filter(F.col("first_id") <= hi)
    d = d.join(spark.read.parquet(f"{folder}/manifest").select("part", "first"), "part").select((F.col("first") + F.col("before")).alias("before"), "part", "docs", "base", "width", "rules", "lengths", "symbols", "marks")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("piece", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()), ("n", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [("crc", pa.int64()), ("raw", pa.binary())])])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                s = Shard(r["base"], r["rules"], r["lengths"], r["symbols"], r["marks"], r["width"])
                wanted = [x for x in r["docs"] if (lo is None or x["doc_id"] is not None and x["doc_id"] >= lo) and (hi is None or x["doc_id"] is not None and x["doc_id"] <= hi)]
                if not wanted:
                    continue
                # neighbouring documents are expanded together
                x, y = wanted[0]["start"], wanted[-1]["start"] + wanted[-1]["n"]
                got = s.ids(x, y)
                cut = [got[w["start"] - x : w["start"] - x + w["n"]] for w in wanted]
                cols = [pa.array([w[c] for w in wanted], schema.field(c).type) for c in ("doc_id", "row", "piece", "last", "n")]
                start = pa.array([r["before"] + w["start"] for w in wanted], pa.int64())
                if ids:
                    out = [pa.array([c.astype(np.int32) for c in cut], schema.field("ids").type)]
                else:
                    one = [w["last"] and not w["piece"] for w in wanted]
                    raw = [c.astype("<u4").tobytes() for c in cut]
                    out = [pa.array([zlib.crc32(x) if o else None for x, o in zip(raw, one, strict=True)], pa.int64()), pa.array([None if o else x for x, o in zip(raw, one, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([cols[0], pa.array([r["part"]] * len(wanted), pa.int32()), cols[1], cols[2], cols[3], start, cols[4], *out], schema=schema)

    ddl = "doc_id long, part int, row long, piece int, last boolean, start long, n long, " + ("ids array<int>" if ids else "crc long, raw binary")
    return d.mapInArrow(apply, ddl)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its files. Only a document of more than SHARD_IDS ids has several pieces, whose bytes meet as its text did."""
    d = read(spark, folder, ids=False).groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.max("crc").alias("crc"), F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("piece", "raw"))).alias("pieces"))
    whole = F.aggregate(F.array_sort("pieces"), F.lit(b""), lambda a, p: F.concat(a, p["raw"]))
    return d.select("doc_id", "start", "n_tokens", F.coalesce("crc", F.crc32(whole)).alias("ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token-ids-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the documents' ids and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(docs.sparkSession)
    write(docs, folder)
    return digests(docs.sparkSession, folder)
