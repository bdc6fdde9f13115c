"""A stored trigram index of names, for many fuzzy searches at once without reading the register.

Postings (gram, size, name), one for each different folded name and trigram, lie in folders by bucket of the gram; names with their ids lie beside them. A register grows by segments: each append adds files, and `merged`
writes all segments as one. A search reads the buckets of its queries' grams only: they are a filter on the folders, of at most `buckets` values.

Prefix filtering loses no pair: a name of similarity `least` to a query of n trigrams shares ceil(least n) of them, so it has one of the n - ceil(least n) + 1 rarest; and its size is within that ratio of n.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import names
from rillwork.operators.registers import MIN_SIMILARITY

BUCKETS = 64


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def append(register: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds register(id, folded) as a segment. Null and empty names have no trigram and are not found; a name of several ids has one set of postings in a segment."""
    segment = uuid.uuid4().hex
    r = register.select("id", F.col("folded").alias("name")).where("name <> ''")
    grams = r.select("name").distinct().select("name", names.trigrams(F.col("name")).alias("t")).select("name", F.size("t").alias("size"), F.explode("t").alias("gram"))
    grams.withColumn("bucket", _bucket(F.col("gram"), buckets)).withColumn("segment", F.lit(segment)).repartition("bucket").write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    r.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{path}/names")


def merged(spark: SparkSession, path: str, to: str, buckets: int = BUCKETS) -> None:
    """All segments as one, in another folder."""
    append(spark.read.parquet(f"{path}/names").select("id", F.col("name").alias("folded")).distinct(), to, buckets)


def search(spark: SparkSession, path: str, queries: DataFrame, least: float = MIN_SIMILARITY, buckets: int = BUCKETS) -> DataFrame:
    """queries(query_id, folded) -> query_id, id, sim of all names of that similarity or more. Equal queries are searched once."""
    asked = queries.select(F.col("folded").alias("asked")).where("asked <> ''").distinct().withColumn("t", names.trigrams(F.col("asked")))
    grams = asked.select("asked", F.size("t").alias("n"), F.explode("t").alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    used = sorted(r.bucket for r in grams.select("bucket").distinct().collect())  # at most `buckets`
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(used)).select("bucket", "gram", "size", "name")
    often = postings.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(often, ["bucket", "gram"], "left").groupBy("asked", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "bucket"))).alias("t"))
    first = ranked.select("asked", "n", F.explode(F.slice("t", 1, (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int"))).alias("p")).select("asked", "n", "p.gram", "p.bucket")
    near = (F.col("size") >= least * F.col("n") - 1e-9) & (F.col("n") >= least * F.col("size") - 1e-9)
    met = first.join(postings, ["bucket", "gram"]).where(near).select("asked", "name").distinct()
    sim = met.withColumn("sim", names.similarity(names.trigrams(F.col("asked")), names.trigrams(F.col("name")))).where(F.col("sim") >= least)
    ids = spark.read.parquet(f"{path}/names").select("id", "name").distinct()
    return queries.select("query_id", F.col("folded").alias("asked")).join(sim, "asked").join(ids, "name").select("query_id", "id", "sim")
