"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of five-word shingles over all documents, hashed to DF_BUCKETS counters (a table of fixed size: the only thing broadcast besides hot keys).
   A map task sends its counters that are not zero, at most that table; the sums are gathered chunk by chunk.
2. A shingle weighs tf * idf, idf = 1 + ln((1 + N) / (1 + df)) / ln(1 + N) (from 1 to 2: common shingles count less, copies
   of one text don't lose their likeness by being many). SAMPLES consistent samples a text (Ioffe 2010) are hashed into BANDS keys of ROWS samples.
3. Texts with equal words (a 128-bit BLAKE2 digest of them) are one node. Those that share a key are compared with one centre of that key, so pairs grow with
   the members of a key and not with their square. After that, all other members of a key that are not in one class yet meet each other, cell by cell (see crossing): no
   member or candidate is dropped, and what leaves a cell is a spanning forest of its links.
4. Two texts are linked if their weighted Jaccard similarity (sum of minima over sum of maxima of the weights) is THRESHOLD or more. Classes are the connected
   components, by minimum labels with pointer jumping, checkpointed in spark.checkpoint.dir; nothing of them reaches the driver but counts.

What the method itself may miss: a pair at 0.8 shares none of the 20 keys of 6 samples in about 0.2 % of cases (one at 0.9 in fewer than one in a million), and a pair of which fewer than LIKELY of the samples agree is
not compared in full, less than one in a million at 0.8.

Texts of fewer than five words have one shingle of all their words. Null, empty and blank texts have no shingle: each row is a class of its own. Repeated rows
of an id with one text share one class; an id with unlike texts has a class for each of them. A text is read whole, however long. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES, ROWS, BANDS = 64, 6, 20
DF_BUCKETS, DF_CHUNK = 1 << 20, 1 << 12
LIKELY = 0.55
#: Members of a centre, or of a part of a key, that are compared in one stream; a larger group is split, its centre repeated for each part. A part of a key also ends at about so many shingles.
PART, PART_SHINGLES = 512, 1 << 21
#: A key that holds more than this part of the rows is hot: there are fewer of them than this number, and their row of a table is broadcast instead of dealing their rows by key.
HOT = 4096
_TABLE = 4096


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's folder spark.checkpoint.dir. Only a local session may go without: it gets one beside its warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").removeprefix("file:"), "checkpoints"))


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each k-word shingle, in rows' order; shorter texts have one of all their words."""
    starts, ends, row = tv.words(buf, offsets)
    h = tv.run_hashes(buf, starts, ends)
    out, first = tv.window_hashes(h, row, k)
    rows = row[first]
    n = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        ends_at = np.cumsum(n)
        extra = []
        for r in few:
            acc = np.uint64(n[r])
            for x in h[ends_at[r] - n[r] : ends_at[r]]:
                acc = np.uint64((int(acc) * 0x94D049BB133111EB + int(x)) & 0xFFFFFFFFFFFFFFFF)
            extra.append(acc)
        out, rows = np.concatenate((out, tv.mix(np.array(extra, np.uint64)))), np.concatenate((rows, few))
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def bags(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles ascending, their counts) for each text."""
    for _, buf, off in tv.text_chunks(texts):
        h, rows = shingles(buf, off, k)
        ends = np.cumsum(np.bincount(rows, minlength=len(off) - 1))
        a = 0
        for z in ends.tolist():
            hs = np.sort(h[a:z])
            a = z
            first = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1]))) if len(hs) else np.zeros(0, np.int64)
            yield hs[first], np.diff(np.concatenate((first, [len(hs)])))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents per bucket of shingles), over all rows of docs(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, pend, size = np.zeros(DF_BUCKETS, np.int64), 0, [], 0
        for b in batches:
            n += b.num_rows
            for h, _ in bags(b.column(0)):
                u = np.unique((h & np.uint64(DF_BUCKETS - 1)).astype(np.int64))
                pend.append(u)
                size += len(u)
                if size > DF_BUCKETS:
                    total += np.bincount(np.concatenate(pend), minlength=DF_BUCKETS)
                    pend, size = [], 0
        if pend:
            total += np.bincount(np.concatenate(pend), minlength=DF_BUCKETS)
        if n:
            chunks = total.reshape(-1, DF_CHUNK)
            some = np.flatnonzero(chunks.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([np.int64(n).tobytes(), *(packed(c) for c in chunks[some])], pa.binary())], ["chunk", "counts"])

    def packed(c: np.ndarray) -> bytes:
        """Places and counts of what is not zero, or the whole chunk if that is shorter."""
        some = np.flatnonzero(c)
        if len(some) * 10 < 8 * DF_CHUNK:
            return some.astype("<u2").tobytes() + c[some].astype("<i8").tobytes()
        return c.astype("<i8").tobytes()

    def unpacked(c: int, raw: bytes) -> np.ndarray:
        if c < 0 or len(raw) == 8 * DF_CHUNK:
            return np.frombuffer(raw, "<i8").astype(np.int64)
        out, k = np.zeros(DF_CHUNK, np.int64), len(raw) // 10
        out[np.frombuffer(raw, "<u2", k)] = np.frombuffer(raw, "<i8", k, 2 * k)
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = unpacked(c, raw)
                sums[c] = sums[c] + v if c in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    partial = docs.mapInArrow(count, "chunk int, counts binary")
    # two levels of sums, so that no task takes a table from every map task
    spread = partial.repartition(F.col("chunk"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, "chunk int, counts binary")
    n, df = 0, np.zeros(DF_BUCKETS, np.int64)
    for r in spread.repartition(F.col("chunk")).mapInArrow(add, "chunk int, counts binary").collect():
        v = np.frombuffer(r.counts, np.int64)
        if r.chunk < 0:
            n += int(v[0])
        else:
            df[r.chunk * DF_CHUNK : (r.chunk + 1) * DF_CHUNK] += v
    return n, df


def idf_table(n: int, df: np.ndarray) -> np.ndarray:
    return (1 + np.log((1 + n) / (1 + np.minimum(df, n))) / max(np.log(1 + n), 1e-9)).astype(np.float32)


@lru_cache(1)
def _randoms() -> tuple[np.ndarray, ...]:
    """Tables of 1/r, b and r by one part of a shingle's hash, and of ln c by another: r, c ~ Gamma(2, 1), b ~ U(0, 1)."""
    g = np.random.Generator(np.random.PCG64(20240607))
    r = g.gamma(2, 1, (_TABLE, SAMPLES)).astype(np.float32)
    b = g.random((_TABLE, SAMPLES), np.float32)
    lnc = np.log(g.gamma(2, 1, (_TABLE, SAMPLES))).astype(np.float32)
    salt = g.integers(1, 1 << 62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    g = np.random.Generator(np.random.PCG64(99))
    members = np.stack([g.permutation(SAMPLES)[:ROWS] for _ in range(BANDS)])
    return 1 / r, b, r, lnc, salt, members


def sample(h: np.ndarray, w: np.ndarray, step: int = 2048) -> np.ndarray:
    """SAMPLES consistent weighted samples of the shingles h with weights w: a 64-bit identifier each."""
    inv, b, r, lnc, salt, _ = _randoms()
    best = np.full(SAMPLES, np.inf, np.float32)
    got, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    k = np.arange(SAMPLES)
    for a in range(0, len(h), step):
        hs = h[a : a + step]
        i, j = (hs >> np.uint64(20)).astype(np.int64) & (_TABLE - 1), (hs >> np.uint64(40)).astype(np.int64) & (_TABLE - 1)
        x = np.log(w[a : a + step], dtype=np.float32)[:, None]
        y = inv.take(i, 0)
        y *= x
        y += b.take(i, 0)
        t = np.floor(y)
        # ln c - r (t - b + 1), as t - b = x / r less what the floor took
        y -= t
        y -= 1
        y *= r.take(i, 0)
        y += lnc.take(j, 0)
        y -= x
        m = y.argmin(0)
        v = y[m, k]
        less = v < best
        best[less] = v[less]
        got[less], level[less] = hs[m[less]], t[m[less], k[less]].astype(np.int64)
    return tv.mix(got * salt + level.astype(np.uint64))


def band_keys(samples: np.ndarray) -> np.ndarray:
    members = _randoms()[5]
    key = np.arange(BANDS).astype(np.uint64)
    for c in range(ROWS):
        key = tv.mix(key * np.uint64(0x94D049BB133111EB) + samples[members[:, c]])
    return key.astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """a, b: (distinct shingles ascending, counts)"""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = (x[1] * idf[x[0] & x[0].dtype.type(DF_BUCKETS - 1)] for x in (a, b))
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / max(float(wa.sum() + wb.sum()) - both, 1e-12)


def _pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct shingles by the low 32 bits of their hash (the bucket's 20 among them), and the counts above one."""
    h = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
    u, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, n).astype("<u4")
    many = np.flatnonzero(n > 1)
    return b"".join((np.array([len(u), len(many)], "<u4").tobytes(), u.tobytes(), many.astype("<u4").tobytes(), n[many].tobytes()))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(raw, "<u4")
    u, m = int(v[0]), int(v[1])
    n = np.ones(u, np.float32)
    n[v[2 + u : 2 + u + m]] = v[2 + u + m :]
    return v[2 : 2 + u], n


def word_digests(texts: pa.Array) -> Iterator[bytes | None]:
    """A 128-bit digest of each text's words, one space between; None without a word."""
    for _, buf, off in tv.text_chunks(texts):
        white = tv.WS[buf]
        keep = ~white
        keep[1:] |= ~white[:-1]  # a word's end keeps one
        ends = np.concatenate(([0], np.cumsum(keep)))[off]
        one = np.where(white, np.uint8(32), buf)[keep].tobytes()
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            words = one[a:z].strip(b" ")
            yield hashlib.blake2b(words, digest_size=16).digest() if words else None


def signatures(docs: DataFrame, idf) -> DataFrame:
    """docs(doc_id, text) -> doc_id, node (digest of the words), size (distinct shingles), bands, samples (two bytes each); all but doc_id are null for texts without a word."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                bands, kept, size = [], [], []
                for h, n in bags(b.column(1)):
                    got = sample(h, n * weight[(h & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]) if len(h) else None
                    bands.append(band_keys(got) if len(h) else None)
                    kept.append((got >> np.uint64(48)).astype(">u2").tobytes() if len(h) else None)
                    size.append(len(h) or None)
                node = pa.array(list(word_digests(b.column(1))), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), node, pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "node", "size", "bands", "samples"])
        tv.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(apply, f"doc_id {kind}, node binary, size long, bands array<long>, samples binary")


def attached(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table(key, n, ...) by key, where n is the number of rows of that key and total that of all rows: hot keys meet a broadcast of fewer than HOT rows, so none of them becomes one task."""
    hot = table.where(F.col("n") * HOT > total)
    names = [c for c in table.columns if c != key]
    met = rows.join(F.broadcast(hot.withColumn("hit", F.lit(True))), key, "left")
    cold = met.where("hit is null").select(*rows.columns).join(table.where(F.col("n") * HOT <= total), key)
    return met.where("hit").select(*rows.columns, *names).unionByName(cold.select(*rows.columns, *names))


def links(docs: DataFrame, signed: DataFrame, idf, threshold: float) -> DataFrame | None:
    """node, root: the connected components of all links of docs(doc_id, text), signed(doc_id, node, size, bands, samples), one row a node; only nodes with a link. None if no key is shared.

    Members of a key meet its centre; then all others of a key that are not in one class meet each other, see crossing. Keys are never refined or given up, so texts that merely share a passage meet like any others.
    The centre is the text that meets most texts over all its keys, then the first by a hash: an original meets more of its edited copies than these meet each other. Shingles are made once, of the texts
    that share a key; texts are shuffled for that and not again.
    """
    every = signed.select(F.explode("bands").alias("key"), "node", "size")
    counts = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    shared = attached(every, counts, "key", total).checkpoint()
    hubs = shared.groupBy("node").agg(F.sum("n").alias("hub")).checkpoint()
    keyed = shared.join(hubs, "node")
    packed = bagged(docs, signed.join(hubs, "node", "left_semi").select("doc_id")).checkpoint()
    order = F.struct("hub", F.xxhash64("node").alias("h"), F.col("node").alias("a"))
    centre = keyed.groupBy("key").agg(F.max(order).alias("c"), F.count(F.lit(1)).alias("n")).select("key", "n", F.col("c.a").alias("a"))
    met = attached(shared.drop("n"), centre, "key", total).where("a <> node").checkpoint()
    pairs = met.select("a", F.col("node").alias("b")).distinct().checkpoint()
    of_centres = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(signed.select(F.col("node").alias("a"), F.col("samples").alias("sa")), "a")
    with_b = pairs.join(signed.select(F.col("node").alias("b"), F.col("samples").alias("sb")), "b")
    both = attached(with_b, of_centres, "a", pairs.count())
    likely = both.where(agreeing("sa", "sb") >= LIKELY * SAMPLES).select("a", "b").checkpoint()
    roots = components(verified(packed, likely, idf, threshold).checkpoint())
    # what has met a centre has nothing left to do with it; keys of two are done
    members = met.where("n > 2").select("key", "node", "size").join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    more = crossing(members, signed, packed, idf, threshold, total).checkpoint()
    if more.isEmpty():
        return roots
    # links between classes: components of the classes
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias("root_" + end))
    among = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct()
    merged = components(among)
    known = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(merged.join(roots, "node", "left_anti").select("node", "root")).checkpoint()


def crossing(members: DataFrame, signed: DataFrame, packed: DataFrame, idf, threshold: float, total: int) -> DataFrame:
    """members(key, node, size, root) -> edges that join all members of a key that are linked and have different roots.

    Pairs under one root are one class already. All others of a key meet: members of its most frequent root (which don't meet each other) and the rest are cut into parts of about PART members or PART_SHINGLES by
    a hash, and each pair of parts is one cell. So the rows grow with a key's members if all but a few have one root, and a key's members are never held at once. Cells first get
    the samples alone, to tell which texts have a likely partner there; those come again with their shingles.
    """
    counts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    whole = counts.groupBy("key").agg(F.max(F.struct("n", "root", "shingles")).alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    parts = lambda n, shingles: F.ceil(F.greatest(n / PART, shingles / PART_SHINGLES)).cast("int")
    cut = whole.select("key", "n", F.col("most.root").alias("main"), parts(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("rest"), parts(F.col("most.n"), F.col("most.shingles")).alias("same")).checkpoint()
    h, own = F.xxhash64("node"), F.col("root") == F.col("main")
    part = F.when(own, F.col("rest") + F.pmod(h, "same")).otherwise(F.pmod(h, "rest")).cast("int")
    last = F.when(own, F.col("rest")).otherwise(F.col("rest") + F.col("same")) - 1
    dealt = attached(members, cut, "key", total).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    at = ("key", "x", "y")
    cells = dealt.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") > F.col("other")).cast("int").alias("side"), "node", F.xxhash64("root").alias("root"))
    rows = cells.join(signed.select("node", "samples"), "node").select(*at, "side", "node", "root", "samples")

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, now = [], None
        for b in batches:
            t = [np.asarray(b.column(k)) for k in range(3)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in t], axis=0)) + 1
            for s, e in zip([0, *ends], [*ends, b.num_rows], strict=True):
                if e > s:
                    cell = tuple(int(c[s]) for c in t)
                    if cell != now and held:
                        yield pa.Table.from_batches(held).combine_chunks()
                        held = []
                    now = cell
                    held.append(b.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_cell(batches):
            some = np.zeros(t.num_rows, bool)
            for i, j in likely_pairs(t):
                some[i], some[j] = True, True
            if some.any():
                yield from t.filter(pa.array(some)).to_batches()
        tv.give_back()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_cell(batches):
            a, b = cell_links(t, idf.value, threshold)
            if a:
                node = t.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])
        tv.give_back()

    sorted_by_cell = lambda d: d.repartition(*at).sortWithinPartitions(*at, "side")
    some = sorted_by_cell(rows).mapInArrow(involved, rows.schema).checkpoint()
    return sorted_by_cell(some.join(packed, "node").select(*at, "side", "node", "root", "samples", "bag")).mapInArrow(linked, "a binary, b binary")


def likely_pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs (i, j) of a cell's rows with different roots, some rows i at a time: those within side 0 if the cell has one part, else across."""
    side, root = t.column("side").to_numpy(), t.column("root").to_numpy()
    sigs = np.frombuffer(b"".join(t.column("samples").to_pylist()), ">u2").astype(np.uint16).reshape(-1, SAMPLES)
    within = t.column("x")[0].as_py() == t.column("y")[0].as_py()
    left, right = (np.arange(len(side)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, (1 << 18) // max(1, len(right)))
    columns = np.ascontiguousarray(sigs[right].T)
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        if len(rows) * len(right) < 256:
            same = (sigs[rows][:, None] == sigs[right][None]).sum(2)
        else:
            same = np.zeros((len(rows), len(right)), np.uint8)
            for c in range(SAMPLES):
                same += sigs[rows, c][:, None] == columns[c]
        ok = (same >= LIKELY * SAMPLES) & (root[rows][:, None] != root[right])
        if within:
            ok &= rows[:, None] < right
        i, j = np.nonzero(ok)
        if len(i):
            yield rows[i], right[j]


def cell_links(t: pa.Table, idf: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between a cell's roots, as rows (i, j): each likely pair that is not joined yet is compared in full."""
    _, group = np.unique(t.column("root").to_numpy(), return_inverse=True)
    bag = [_unpack(x.as_py()) for x in t.column("bag").combine_chunks()]
    ends = np.cumsum([len(u) for u, _ in bag])
    h, at = np.unique(np.concatenate([u for u, _ in bag]), return_inverse=True)
    weight = idf[h & np.uint32(DF_BUCKETS - 1)]
    value = np.concatenate([n for _, n in bag]) * weight[at]
    starts = ends - [len(u) for u, _ in bag]
    total = np.add.reduceat(value, starts)
    mine, a, b = np.zeros(len(h), np.float32), [], []
    for i_, j_ in likely_pairs(t):
        cuts = [0, *(np.flatnonzero(np.diff(i_)) + 1).tolist(), len(i_)]
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            i, partners = int(i_[p]), j_[p:q]
            partners = partners[group[partners] != group[i]]
            spot = at[starts[i] : ends[i]]
            mine[spot] = value[starts[i] : ends[i]]
            for k in range(0, len(partners), 64):
                some = partners[k : k + 64]
                some = some[group[some] != group[i]]
                if len(some):
                    lengths = ends[some] - starts[some]
                    first = np.cumsum(lengths) - lengths
                    where = np.arange(int(lengths.sum())) + np.repeat(starts[some] - first, lengths)
                    both = np.add.reduceat(np.minimum(value[where], mine[at[where]]), first, dtype=np.float64)
                    for j in some[both >= threshold * (total[i] + total[some] - both)].tolist():
                        if group[i] != group[j]:
                            a.append(i), b.append(j)
                            group[group == group[j]] = group[i]
            mine[spot] = 0
    return a, b


def bagged(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, bag of the wanted docs, one row a node."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                c = b.column(0).slice(k, 512)
                yield pa.RecordBatch.from_arrays([pa.array(list(word_digests(c)), pa.binary()), pa.array([_pack(*x) for x in bags(c)], pa.binary())], ["node", "bag"])
        tv.give_back()

    return docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(bag, "node binary, bag binary").where("node is not null").dropDuplicates(["node"])


def agreeing(a: str, b: str) -> Column:
    """The number of samples that two rows share, of two bytes each."""
    at = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    return F.aggregate(at, F.lit(0), lambda n, i: n + (F.substring(F.col(a), i * 2 + 1, F.lit(2)) == F.substring(F.col(b), i * 2 + 1, F.lit(2))).cast("int"))


def verified(packed: DataFrame, pairs: DataFrame, idf, threshold: float) -> DataFrame:
    """packed(node, bag), pairs(a, b), distinct, a the centre -> those alike. The shingles of a text are shuffled once a centre that it met; a centre's, once for each part of its members."""
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).checkpoint()
    members = attached(pairs, parts, "a", pairs.count()).select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("member"))
    centres = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    rows = packed.join(members.unionByName(centres), "node").select("a", "part", "member", "node", "bag")
    dealt = rows.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, at, centre = idf.value, None, None
        for b in batches:
            a_, b_ = [], []
            for k in range(b.num_rows):
                a, part, member, d = (b.column(i)[k].as_py() for i in range(4))
                raw = b.column(4)[k].as_py()
                if not member:
                    if at != (a, part):
                        at, centre = (a, part), _unpack(raw)
                elif weighted_jaccard(centre, _unpack(raw), weight) >= threshold:
                    a_.append(a), b_.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.binary()), pa.array(b_, pa.binary())], ["a", "b"])
        tv.give_back()

    return dealt.mapInArrow(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, root: the smallest node of each connected component; only nodes that have an edge."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).checkpoint()
    label = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).checkpoint()
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("seen"))
        step = label.join(near, "x").select("x", F.least("root", "seen").alias("lower"), F.col("root").alias("was"))
        jump = label.select(F.col("x").alias("lower"), F.col("root").alias("root2"))
        step = step.join(jump, "lower").select("x", F.least("lower", "root2").alias("root"), "was").checkpoint()
        label = step.select("x", "root")
        if step.where("root <> was").isEmpty():
            return label.withColumnRenamed("x", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its class), kept (doc_id is class_id)."""
    spark = docs.sparkSession
    shared_checkpoints(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(d.select("text"))))
    rows = signatures(d, idf).checkpoint()
    worded = rows.where("node is not null")
    texts = worded.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).checkpoint()
    # the smallest id's row speaks for the copies of a text
    own = worded.join(texts.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).checkpoint()
    roots = links(d.where(F.col("text").isNotNull()), own, idf, threshold)
    named = texts.select("node", "n", F.col("rep").alias("class_id"))
    if roots is not None:
        least = texts.join(roots, "node").groupBy("root").agg(F.min("rep").alias("least"))
        of_class = roots.join(least, "root").select("node", "least")
        named = named.join(of_class, "node", "left").select("node", "n", F.coalesce("least", "class_id").alias("class_id")).checkpoint()
    found = attached(worded.select("node", "doc_id"), named, "node", max(1, worded.count())).select("doc_id", "class_id")
    out = found.unionByName(rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that are not kept, all columns; an id with unlike texts stays if one of them is kept."""
    gone = near_duplicates(docs, id_col, text_col, threshold).groupBy(F.col("doc_id").alias("__gone")).agg(F.bool_or("kept").alias("__kept")).where("not __kept").select("__gone").checkpoint()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
