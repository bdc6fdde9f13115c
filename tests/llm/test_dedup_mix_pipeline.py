import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rillwork.llm import bpe, exactdup, mixing, neardup

from ..conftest import SF


def norm(s):
    return re.sub(r"[\x20\x09-\x0D]+", " ", s or "")


@pytest.mark.parametrize("share", [1 / 200, 0.001])
def test_exact_groups(spark, share):
    rows = [(5, None), (3, ""), (9, "a  b"), (7, "a\tb"), (7, "a\nb"), (11, "ab"), (20, "long text " * 200_000), (19, "long  text " * 200_000), (21, "long text " * 200_000 + ".")] + [(100 + k, "hot text") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("norm", F.lit(1)).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit(1).alias("norm")))
    got = exactdup.exact_duplicates(d, hot_share=share).toPandas()
    src = d.toPandas()
    src["n"] = src.text.map(norm)
    first, size = src.groupby("n").doc_id.min(), src.groupby("n").doc_id.size()
    by = dict(zip(src.doc_id, src.n, strict=True))
    assert len(got) == len(src) and got.kept.sum() == len(first)
    for r in got.itertuples():
        assert r.keep_id == first[by[r.doc_id]] and r.group_size == size[by[r.doc_id]] and (not r.kept or r.doc_id == r.keep_id)
    kept = exactdup.keep_first(d, hot_share=share).toPandas()
    assert sorted(kept.doc_id) == sorted(first) and list(kept.columns) == ["doc_id", "text", "norm"]
    assert exactdup.exact_duplicates(d.limit(0)).count() == 0


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    rows, group = [], {}
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for c in range(30 if g == 0 else 4):
            w = list(base)
            for _ in range(0 if c == 0 else rng.randint(1, 3)):
                w[rng.randrange(200)] = "edit" + str(rng.random())
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(20):
        rows.append((len(rows), " ".join(shared + [rng.choice(words) for _ in range(140)])))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "tiny text"), (1004, "tiny  text"), (1005, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit("x"))
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    want, links = brute_classes(spark, d, in_keys=True)
    assert len(links) > 150 and all(got[i].class_id == want[i] for i in want)
    assert all(got[i].kept and got[i].class_id == i for i in range(len(group), len(group) + 20))
    assert got[1005].class_id == 0 and got[1004].class_id == 1003
    assert all(got[i].class_id == i for i in (1000, 1001, 1002))
    left = {r.doc_id for r in neardup.keep_one(d).collect()}
    assert left == {i for i, r in got.items() if r.kept}
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def brute_classes(spark, d, in_keys=False):
    """Class by brute force over every pair (or every pair that shares a key), and the links."""
    idf = neardup.idf_table(*neardup.document_frequencies(d.select("text")))
    ids, texts = zip(*[(r.doc_id, r.text) for r in d.orderBy("doc_id").collect()], strict=True)
    bag = [neardup._unpack(neardup._pack(*b)) for b in neardup.bags(neardup.pa.array(texts))]
    keys = [set(neardup.band_keys(neardup.sample(h, n * idf[(h & np.uint64(neardup.DF_BUCKETS - 1)).astype(np.int64)])).tolist()) for h, n in neardup.bags(neardup.pa.array(texts))]
    root = list(range(len(ids)))
    links = []
    for i in range(len(ids)):
        for j in range(i):
            if (not in_keys or keys[i] & keys[j]) and neardup.weighted_jaccard(bag[i], bag[j], idf) >= neardup.THRESHOLD:
                links.append((ids[j], ids[i]))
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {k: ids[r] for k, r in zip(ids, root, strict=True)}, links


def templated(pairs, seed, share=150, own=13, changed=8):
    """Pairs of near copies that fill in one long template, so that unlike pairs share keys."""
    rng = random.Random(seed)
    template, rows = [f"t{k}" for k in range(share)], []
    for p in range(pairs):
        mine = [f"p{p}x{rng.random()}" for _ in range(own)]
        rows += [(2 * p, " ".join(template + mine)), (2 * p + 1, " ".join(template + mine[:-changed] + [f"q{p}y{k}" for k in range(changed)]))]
    return rows


def test_near_copies_of_a_template_are_all_found(spark):
    d = spark.createDataFrame(templated(120, 5), "doc_id long, text string")
    want, links = brute_classes(spark, d, in_keys=True)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    assert len(links) >= 100 and len(set(want.values())) > 50 and got == want


def chains(n, seed):
    """Texts a, b, c with a~b and b~c alike but a and c not, so that c hangs on b."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"c{k}x{rng.random()}" for _ in range(400)]
        b = w[:-6] + [f"b{k}y{i}" for i in range(6)]
        c = [f"z{k}y{i}" for i in range(38)] + b[38:]
        rows += [(3 * k + i, " ".join(x)) for i, x in enumerate((w, b, c))]
    return rows


def test_chains_keep_members_that_met_a_centre(spark):
    d = spark.createDataFrame(chains(120, 6), "doc_id long, text string")
    want, _ = brute_classes(spark, d, in_keys=True)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    assert sum(want[3 * k] == want[3 * k + 2] for k in range(120)) > 60 and got == want


def test_recall_on_hubs_and_a_hot_passage(spark):
    """Of all links by brute force, in a hub with copies, texts over one passage, and longer chains."""
    rng = random.Random(8)
    word = lambda: f"v{rng.random()}"
    rows = []
    hub = [word() for _ in range(300)]
    for _ in range(60):
        w = list(hub)
        for _ in range(4):
            w[rng.randrange(300)] = word()
        rows.append(w)
    passage = [word() for _ in range(220)]
    rows += [passage + [word() for _ in range(rng.randint(10, 60))] for _ in range(150)]
    for _ in range(15):
        w = [word() for _ in range(250)]
        for k in range(7):
            rows.append(list(w))
            for _ in range(3):
                w[rng.randrange(250)] = word()
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    want, links = brute_classes(spark, d)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 500 and found >= 0.99 * len(links)
    assert all(want[i] == want[got[i]] for i in got)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].class_id == 1
    long = " ".join(f"x{k}" for k in range(60_000))
    rows = [(9, long), (4, long + " end"), (4, long + " end"), (7, "the same words here"), (3, "the same  words\nhere"), (7, "other words for this id"), (None, "no id at all here"), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "class_id": F.lit(1), "kept": F.lit("y"), "key": F.lit(2)})
    got = sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in neardup.near_duplicates(d).collect())
    assert got == [(-1, -1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (7, 3, False), (7, 7, True), (9, 4, False)]
    left = neardup.keep_one(d)
    assert left.columns == d.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 2, 3, 4, 4, 7, 7]


def test_weighted_samples_estimate_the_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    w = rng.uniform(1, 3, 3000).astype(np.float32)
    a, b = np.arange(0, 2400), np.arange(600, 3000)
    true = w[600:2400].sum() / w.sum()
    hits = []
    for k in range(20):
        x = neardup.tv.mix(h + np.uint64(k * 7919))
        sa, sb = (neardup.sample(np.sort(x[i]), w[i][np.argsort(x[i])]) for i in (a, b))
        hits.append((sa == sb).mean())
    assert abs(np.mean(hits) - true) < 0.04


def test_mix_reaches_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "n_chars")
    extra = spark.createDataFrame([(-1, None, "src0", 0), (-2, "", None, 0), (-3, "only words here", None, 15), (-4, "tiny", "a", 4), (-4, "tiny", "a", 4)], d.schema)
    d = d.unionByName(extra).coalesce(3)
    got = mixing.taken(d).toPandas()
    src = d.toPandas()
    n = src.text.map(lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s or "")))
    assert sorted(zip(got.doc_id, got["size"], strict=True)) == sorted(zip(src.doc_id, n, strict=True))
    assert (got.taken <= 3 * got["size"]).all()
    names = sorted({s for s in src.source if s is not None}) + [None]
    size = [int(n[src.source.isna() if s is None else src.source == s].sum()) for s in names]
    weight, target, free, rest = [1 + k % 3 for k in range(len(names))], [0.0] * len(names), set(range(len(names))), float(sum(size))
    while free:
        u = rest / sum(weight[k] for k in free)
        full = [k for k in free if u * weight[k] > 3 * size[k]]
        for k in full or list(free):
            target[k] = 3.0 * size[k] if full else u * weight[k]
            rest -= target[k]
            free.discard(k)
    by = got.merge(src[["doc_id", "source"]].drop_duplicates(), on="doc_id")
    for s, t in zip(names, target, strict=True):
        own = by[by.source.isna() if s is None else by.source == s]
        assert own.target.iloc[0] == pytest.approx(t) and abs(own.taken.sum() - t) <= 64 + 0.01 * t
    again = mixing.taken(d).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))
    docs = mixing.mixed_documents(d).toPandas()
    w = docs.assign(w=docs.text.map(lambda s: len((s or "").split()))).groupby("doc_id").w.sum()
    t = got.groupby("doc_id").taken.sum()
    assert (w == t[w.index]).all() and (docs.text.map(len) == docs.n_chars).all()
    assert mixing.taken(d.limit(0)).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of longs (int) and of ints (given as a tuple of one)."""
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_permuted(j, n, key):
    for r in range(1, mixing.ROUNDS + 1):
        partner = (spark_hash(key, (r,), (17,)) % n - j) % n
        if spark_hash(key, (r,), max(j, partner)) & 1:
            j = partner
    return j


def test_mix_against_loops(spark):
    """Packing, draws, hand-overs, permutations and the join by blocks, each by a loop."""
    rng = random.Random(3)
    rows = [(k // 2 if k < 40 else k, " ".join(f"{k}w{i}" for i in range(rng.choice([0, 1, 5, 40, 300]))), ["a", "b", None, "c"][k % 7 % 4]) for k in range(90)]
    rows += [(500, "same row " * 60, "a")] * 5 + [(501, "q " * 3000, "b"), (502, None, "a")]
    block, shard = 16, 32
    names = ["row_id", "u", "uses", "size", "k1", "k2", "copy", "row", "spans", "as_is", "use", "bucket"]
    d = spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    known, pieces, dealt = mixing.mix(d, block=block, shard=shard)
    sizes = {}
    for r in known.collect():
        assert r["size"] == len([x for x in rows if x[0] == r.doc_id][0][1].split() if r.doc_id >= 40 and r.doc_id != 502 else [0] * r["size"])
        sizes[r.source_no] = sizes.get(r.source_no, 0) + r["size"] * r.copies
    stream = {}
    for p in pieces.collect():
        stream.setdefault(p.source_no, {}).setdefault(p.block, []).append((p.words, (p.k1, p.k2, p.copy, p.start)))
    for k, blocks in stream.items():  # whole blocks but for the last, and each document's words once
        full = [sum(w for w, _ in blocks[b]) for b in sorted(blocks)]
        assert sorted(blocks) == list(range(len(full))) and full[:-1] == [block] * (len(full) - 1) and sum(full) == sizes[k]
    target = {r.source_no: r.target for r in known.collect()}
    n_blocks = {k: -(-v // block) for k, v in sizes.items()}
    quota = {k: min(3 * n_blocks[k], round(target[k] * n_blocks[k] / sizes[k])) for k in sorted(sizes)}
    total, edges, at = sum(quota.values()), [], 0.0
    for k, q in quota.items():
        at += q / total
        edges.append((at, k))
    number, drawn = {k: 0 for k in quota}, []
    for slot in range(total):
        u = ((spark_hash(slot, (5,)) % (1 << 64)) >> 11) / float(1 << 53)
        k = edges[min(len(edges) - 1, sum(e <= u for e, _ in edges))][1]
        drawn.append((slot, k, number[k]))
        number[k] += 1
    lack = [(k, j) for k in quota for j in range(number[k], quota[k])]
    extra = sorted((k, j, slot) for slot, k, j in drawn if j >= quota[k])
    assert len(lack) == len(extra)
    fate = {slot: (k, j) for slot, k, j in drawn} | {slot: to for (_, _, slot), to in zip(extra, lack, strict=True)}
    want = {(slot // shard, slot, k, brute_permuted(j % n_blocks[k], n_blocks[k], spark_hash((k,), j // n_blocks[k]))) for slot, (k, j) in fate.items()}
    assert {tuple(r) for r in dealt.collect()} == want
    words = sorted(w for _, _, k, b in want for w in [sum(x for x, _ in stream[k][b])])
    got = mixing.taken(d, block=block).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(mixing.taken(d.repartition(2), block=block).toPandas().taken)
    assert sum(words) == sum(r.taken for r in got) if shard == mixing.SHARD else True
    mixed = mixing.mixed_documents(d, block=block)
    assert mixed.columns == d.columns
    by = {}
    for r in mixed.collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + len(r.text.split())
        assert r.u[0] == "u" and r.row_id[6:] == r.u[1:] and set(r.text.split()) <= set((rows[int(r.u[1:])][1] or "").split())
    for r in got:
        by[r.doc_id] = by.get(r.doc_id, 0) - r.taken
    assert not any(by.values())


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_pipeline_by_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    ids, docs = [{r.doc_id for r in d.collect()}], d
    for name, f in corpus_pipeline.STAGES[:4]:
        docs = f(spark, docs, SF)
        assert docs.columns == d.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema).coalesce(2)
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    from .test_filters import brute_quality

    texts = {r.doc_id: r.text for r in d.collect()}
    assert all(not brute_quality(texts[i])[-1] for i in ids[1])
    assert len({norm(texts[i]) for i in ids[1]}) == len(ids[2])
    # near copies by brute force over the pairs that share a key, and the tokens by the library
    after = spark.createDataFrame([r for r in d.collect() if r.doc_id in ids[2]], d.schema)
    want, _ = brute_classes(spark, after, in_keys=True)
    assert ids[3] == {i for i, c in want.items() if i == c}
    last = corpus_pipeline.run(spark, SF).collect()
    assert len(last) == docs.count() and all(r.n_tokens > 0 for r in last)
    whole = Tokenizer.from_file(bpe.default_path())
    whole.no_truncation(), whole.no_padding()
    count = lambda rows, f: sorted((r.doc_id, f(r)) for r in rows)
    assert count(last, lambda r: r.n_tokens) == count(docs.collect(), lambda r: len(whole.encode(r.text, add_special_tokens=False).ids))
