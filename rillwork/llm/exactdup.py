"""Exact deduplication by content sort, in DataFrame functions only.

Normalised texts are range-partitioned on splitters that Spark samples, by their first PREFIX characters and, among equal ones, a hash of the whole (so the sample that reaches the
driver has short rows, and texts that begin alike spread). Each partition is sorted externally; equal texts are then neighbours, compared in full, and the
row with the smallest id stays. Texts that make up HOT_SHARE or more of a bounded sample (so at most 1 / HOT_SHARE texts) get a salt in the
sort key, so that their rows spread over partitions; the runs of such a text are then put together by its SHA-256, one row a run.
The sample decides only where rows go: results are the same without it.

Null counts as empty, so null and empty texts are copies of each other. Rows that repeat an id are copies like any others, and one of them stays. Texts are
compared whole, however long. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE, HOT_SAMPLE, PREFIX = 1 / 200, 10_000, 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hot_texts(d: DataFrame, share: float = HOT_SHARE, rows: int = HOT_SAMPLE) -> list[int]:
    """Hashes of the texts that are at least that share of a sample of about that many rows; d(norm)."""
    n = d.count()
    if n < 2:
        return []
    part = min(1.0, rows / n)
    least = max(2, int(share * min(rows, n)))
    got = d.sample(part, seed=11).groupBy(F.xxhash64("norm").alias("h")).count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(int(1 / share) + 1)
    return [r.h for r in got.collect()]


def _dealt(d: DataFrame, salt: Column) -> DataFrame:
    """d(norm, ...) with begin, hash and salt, range-partitioned by these: equal texts with one salt share a partition."""
    return d.withColumns({"begin": F.substring("norm", 1, PREFIX), "hash": F.xxhash64("norm"), "salt": salt}).repartitionByRange("begin", "hash", "salt")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    from .neardup import shared_checkpoints

    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    hot = hot_texts(d, hot_share)
    salts = max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salt = F.when(F.xxhash64("norm").isin(hot), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0) if hot else F.lit(0)
    run = Window.partitionBy("begin", "hash", "salt", "norm")
    dealt = _dealt(d, salt)
    ordered = run.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = dealt.select(
        "doc_id",
        "salt",
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
        F.first("doc_id").over(ordered).alias("keep_id"),
        F.count(F.lit(1)).over(ordered).alias("group_size"),
        F.row_number().over(run.orderBy("doc_id")).alias("place"),
    )
    if not hot:
        return sorted_rows.select("doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256")
    shared_checkpoints(spark)
    rows = sorted_rows.checkpoint()  # ids and digests, no texts
    whole = rows.where("salt > 0 and place = 1").groupBy(F.col("text_sha256").alias("sha")).agg(F.min(F.struct("keep_id", "salt")).alias("least"), F.sum("group_size").alias("total"))
    joined = rows.join(F.broadcast(whole), (F.col("text_sha256") == F.col("sha")) & (F.col("salt") > 0), "left")
    first = F.coalesce((F.col("least.salt") == F.col("salt")), F.lit(True)) & (F.col("place") == 1)
    return joined.select("doc_id", F.coalesce("least.keep_id", "keep_id").alias("keep_id"), F.coalesce("total", "group_size").alias("group_size"), first.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = HOT_SHARE) -> DataFrame:
    """docs without the rows that are not kept, all columns.

    Whole rows go through one content sort, so nothing is joined back; the normalised text is made again behind the exchange rather than sent through it. Texts of a hot group don't go
    through it at all: the smallest id of each is a pre-aggregated minimum over the full text, at most 1 / hot_share + 1 rows.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    norm = normalised(F.col("whole").getField(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole.alias("whole"))
    hot = hot_texts(rows.select(norm.alias("norm")), hot_share)
    is_hot = F.xxhash64(norm).isin(hot) if hot else F.lit(False)
    keys = {"begin": F.substring(norm, 1, PREFIX), "hash": F.xxhash64(norm)}
    dealt = rows.where(~is_hot).withColumns(keys).repartitionByRange("begin", "hash").withColumn("norm", norm)
    place = F.row_number().over(Window.partitionBy("begin", "hash", "norm").orderBy("doc_id"))
    left = dealt.withColumn("place", place).where("place = 1").select("whole")
    if hot:
        many = rows.where(is_hot).withColumn("norm", norm)
        least = many.groupBy(F.col("norm").alias("same")).agg(F.min("doc_id").alias("least"))
        first = many.join(F.broadcast(least), (F.col("norm") == F.col("same")) & (F.col("doc_id") == F.col("least")), "left_semi").dropDuplicates(["norm"])
        left = left.unionByName(first.select("whole"))
    return left.select(*[F.col("whole").getField(c).alias(c) for c in names])
