"""Mixing sources to target weights, in DataFrame functions only.

1. Sources, ordered by code point with null last, weigh 1, 2, 3, 1, ...; they share 100 % of all words by weight. A target stops at LIMIT times its source's
   size; the excess is shared again by weight until none is above.
2. A source's documents, in a fixed order, are one stream of words, packed into blocks of BLOCK words (the last may be shorter).
3. Output slots are dealt into shards of SHARD slots. In each shard every slot draws its source by the target weights: a multinomial count of each source. Draws
   beyond a source's whole number of blocks go to sources that got too few, in order, so that every source ends at its target to within a block.
4. A source's slots are numbered through; number j is block perm(j mod n) of pass j div n, by a swap-or-not permutation keyed by source and pass: all blocks are
   used once before one is used again, so none is used more than LIMIT times.
5. Slots and documents' pieces meet by (source, block).

All is drawn from hashes of fixed seeds, ids and texts: reruns agree, also after a lost executor. Null and wordless texts have size 0 and are taken 0 times. Rows that repeat an id
are documents of their own, in the order of their size and a hash of the text; rows that repeat id, source and text are counted before anything is sent, and stand one after the other in the stream. An empty table gives an empty table.
Extra columns are carried along, whatever their names. A source may hold most rows: running sums go over buckets and then over groups of buckets (see running), never over a source in one task. Sources
themselves are the mix's parameters, one row each on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, SHARD, LIMIT, ROUNDS, BUCKET_ROWS, FAN = 64, 16384, 3, 24, 1024, 1024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, spark: SparkSession, limit: int = LIMIT) -> list[tuple[str | None, int, float]]:
    """(source, its size, its target) by code point, null last. Sources are few: they are the mix's parameters, and one row each reaches the driver."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    got = sorted(((r.source, int(r["size"])) for r in rows), key=lambda x: (x[0] is None, x[0] or ""))
    weight, size = [1 + k % 3 for k in range(len(got))], [s for _, s in got]
    out, free, rest = [0.0] * len(got), set(range(len(got))), float(sum(size))
    while free:
        share = rest / sum(weight[k] for k in free)
        full = [k for k in free if share * weight[k] > limit * size[k]]
        if not full:
            for k in free:
                out[k] = share * weight[k]
            break
        for k in full:
            out[k] = float(limit * size[k])
            rest -= out[k]
            free.discard(k)
    return [(s, n, t) for (s, n), t in zip(got, out, strict=True)]


def permuted(j: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key (swap-or-not): in a round x and its partner swap or don't by a bit of their hash."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(17)), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), j, step)


def running(d: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """d with `before`: the sum of value over the rows of the same `by` with a smaller order (a whole number, one row each); over FAN orders and then over the groups of these, so that no task takes all."""
    d = d.withColumn("top", F.floor(F.col(order) / FAN))
    tops = d.groupBy(by, "top").agg(F.sum(value).alias("in_top"))
    base = tops.select(by, "top", (F.sum("in_top").over(Window.partitionBy(by).orderBy("top")) - F.col("in_top")).alias("base"))
    inner = F.sum(value).over(Window.partitionBy(by, "top").orderBy(order)) - F.col(value)
    return d.withColumn("inner", inner).join(base, [by, "top"]).withColumn("before", F.col("base") + F.col("inner")).drop("top", "base", "inner")


def packed(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """groups(k1, k2, doc_id, source_no, size, copies) -> the pieces of documents in blocks: k1, k2, copy, source_no, block, start (word in the document), words."""
    per = max(1, groups.count() // BUCKET_ROWS)
    d = groups.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(per))).withColumn("all", F.col("size") * F.col("copies"))
    sums = d.groupBy("source_no", "bucket").agg(F.sum("all").alias("in_bucket"))
    before = running(sums, "source_no", "bucket", "in_bucket").select("source_no", "bucket", "before")
    inner = F.sum("all").over(Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")
    placed = d.withColumn("inner", inner).join(before, ["source_no", "bucket"]).withColumn("first", F.col("before") + F.col("inner"))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("offset", F.col("first") + F.col("copy") * F.col("size"))
    blocks = F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))
    pieces = placed.select("k1", "k2", "copy", "source_no", "size", "offset", F.explode(blocks).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("offset"), F.lit(0).cast("long"))
    stop = F.least((F.col("block") + 1) * block - F.col("offset"), F.col("size"))
    return pieces.select("k1", "k2", "copy", "source_no", "block", start.alias("start"), (stop - start).alias("words"))


def slots(spark: SparkSession, sources: list[tuple[str | None, int, float]], block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, slot, source_no, block: what the mix is made of, one row a block that it takes."""
    n_blocks = [-(-size // block) for _, size, _ in sources]
    quota = [min(LIMIT * n, round(t * n / size)) if size else 0 for n, (_, size, t) in zip(n_blocks, sources, strict=True)]
    total, ids = sum(quota), list(range(len(sources)))
    table = spark.createDataFrame([(k, n_blocks[k], quota[k]) for k in ids if quota[k]], "source_no int, n_blocks long, quota long")
    if not total:
        return spark.createDataFrame([], "shard long, slot long, source_no int, block long")
    edges, at = [], 0.0
    for k in ids:
        if quota[k]:
            at += quota[k] / total
            edges.append((at, k))
    drawn = spark.range(0, total, 1, max(1, -(-total // (4 * shard)))).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard).alias("shard"))
    u = F.shiftrightunsigned(F.xxhash64("slot", F.lit(5)), 11) / F.lit(float(1 << 53))
    # the last edge is 1 but for rounding
    pick = F.element_at(F.array(*[F.lit(k) for _, k in edges]), F.least(F.lit(len(edges)), 1 + F.size(F.filter(F.array(*[F.lit(e) for e, _ in edges]), lambda e: e <= u))).cast("int"))
    drawn = drawn.withColumn("drew", pick)
    counts = drawn.groupBy("drew", "shard").agg(F.count("*").alias("n"))
    earlier = running(counts, "drew", "shard", "n").select("drew", "shard", F.col("before").alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("drew", "shard").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(earlier, ["drew", "shard"]).select("slot", "shard", "drew", (F.col("rank") + F.col("earlier")).alias("number"))
    got = {r.drew: r.n for r in counts.groupBy("drew").agg(F.sum("n").alias("n")).collect()}
    # excess draws, numbered through the sources, fill what the others lack, in order
    over, lack, shift, spot = [], [], 0, 0
    for k in ids:
        if quota[k]:
            more = got.get(k, 0) - quota[k]
            if more > 0:
                over.append((k, quota[k], shift))
                shift += more
            elif more < 0:
                lack.append((k, spot, spot - more, got.get(k, 0)))
                spot -= more
    number = F.col("number")
    if over:
        # tables by source as literals, so that the expression stays small however many sources there are
        most, begins = {k: q for k, q, _ in over}, {k: s for k, _, s in over}
        at = F.col("drew") + 1
        limit = F.element_at(F.array(*[F.lit(most.get(k, 1 << 62)) for k in ids]), at)
        begin = F.element_at(F.array(*[F.lit(begins.get(k, 0)).cast("long") for k in ids]), at)
        spots = F.array(*[F.lit(a).cast("long") for _, a, _, _ in lack])
        moved = ranked.withColumn("extra", F.when(number >= limit, number - limit + begin))
        moved = moved.withColumn("k", F.size(F.filter(spots, lambda a: a <= F.col("extra"))))
        source = F.when(F.col("extra").isNull(), F.col("drew")).otherwise(F.try_element_at(F.array(*[F.lit(k) for k, *_ in lack]), F.col("k")))
        index = F.when(F.col("extra").isNull(), number).otherwise(F.col("extra") - F.try_element_at(spots, F.col("k")) + F.try_element_at(F.array(*[F.lit(n).cast("long") for *_, n in lack]), F.col("k")))
        ranked = moved.select("slot", "shard", source.alias("source_no"), index.alias("number"))
    else:
        ranked = ranked.withColumnRenamed("drew", "source_no")
    full = ranked.join(F.broadcast(table), "source_no")  # one row a source
    key = F.xxhash64("source_no", F.floor(F.col("number") / F.col("n_blocks")))
    return full.select("shard", "slot", "source_no", permuted(F.pmod(F.col("number"), F.col("n_blocks")), F.col("n_blocks"), key).alias("block"))


def keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Two hashes of a row's id, source and text; rows with the same words, id and source that share both are taken for one another."""
    row = [F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))]
    return [F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(11), *row).alias("k2")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, pieces, slots). groups: k1, k2, doc_id, source, source_no, size, copies, source_size, target, one row for each distinct id, source and text. pieces: packed(). slots: slots()."""
    from .neardup import shared_checkpoints

    spark = docs.sparkSession
    shared_checkpoints(spark)
    sized = docs.select(*keys(id_col, text_col, source_col), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    groups = sized.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).checkpoint()
    sources = targets(groups.select("source", (F.col("size") * F.col("copies")).alias("size")), spark)
    table = spark.createDataFrame([(k, s, n, t) for k, (s, n, t) in enumerate(sources)], "source_no int, name string, source_size long, target double")
    known = groups.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return known, packed(known, block), slots(spark, sources, block, shard)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    known, pieces, dealt = mix(docs, id_col, text_col, source_col, block)
    times = dealt.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    words = pieces.join(times, ["source_no", "block"]).groupBy("k1", "k2", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.join(words, ["k1", "k2", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", block: int = BLOCK) -> DataFrame:
    """The mix as documents, with all columns: for each use k = 1, 2, ... of a document a row whose text is its words in blocks used k times or more, in their order, one space between.

    Its id stays; a document that is used whole keeps its text as it is. chars_col, if there, is set to the new text's length. Of rows that repeat id, source and text, the other columns of one are taken for all.
    """
    known, pieces, dealt = mix(docs, id_col, text_col, source_col, block)
    times = dealt.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    uses = pieces.join(times, ["source_no", "block"]).select("k1", "k2", "copy", "start", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("use"))
    spans = uses.groupBy("k1", "k2", "copy", "use").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"), F.sum("words").alias("total"))
    plan = known.select("k1", "k2", "size").join(spans, ["k1", "k2"]).select("k1", "k2", "spans", (F.col("total") == F.col("size")).alias("as_is"))
    whole = docs.select(*keys(id_col, text_col, source_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = whole.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).where("place = 1").drop("place")
    rows = one.join(plan, ["k1", "k2"])
    old = F.col("row").getField(text_col)
    split = F.filter(F.split(old, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cut(words: Column) -> Column:
        return F.array_join(F.transform(F.col("spans"), lambda s: F.array_join(F.slice(words, (s["start"] + 1).cast("int"), s["words"].cast("int")), " ")), " ")

    # a one-element transform names the words, so that a text is split once and not for each of its spans
    rows = rows.withColumn("text", F.when(F.col("as_is"), old).otherwise(F.element_at(F.transform(F.array(split), cut), 1)))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.col("text")}
    if chars_col in docs.columns:
        out[chars_col] = F.char_length("text").cast(docs.schema[chars_col].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])
