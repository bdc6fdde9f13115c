"""Domain tables made of the generic ones, and the same as SQL: rain series, terrain grids, registers.

The generic tables hold no rasters or rain; these views give the operators data whose every value both engines can work out exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rain_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (0: from orders, 1: from line items), observed_on, mm: a row for each day from the first to the last of both."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("observed_on")).agg(F.sum("o_orderkey").alias("k")).withColumn("series", F.lit(0))
    li = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("observed_on")).agg(F.sum(F.col("l_orderkey") + F.col("l_linenumber")).alias("k")).withColumn("series", F.lit(1))
    span = o.unionByName(li).agg(F.min("observed_on").alias("first"), F.max("observed_on").alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("observed_on"))
    spine = days.crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "series int")))  # two rows
    mm = F.coalesce(F.greatest(F.pmod("k", F.lit(1000)) - 700, F.lit(0)) / 5.0, F.lit(0.0))
    return spine.join(o.unionByName(li), ["series", "observed_on"], "left").select("series", "observed_on", mm.alias("mm"))


RAIN = """keyed AS (SELECT 0 AS series, CAST(o_orderdate AS DATE) AS observed_on, sum(o_orderkey)::BIGINT AS k FROM orders GROUP BY ALL
  UNION ALL SELECT 1, CAST(l_shipdate AS DATE), sum(l_orderkey + l_linenumber)::BIGINT FROM lineitem GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(observed_on), max(observed_on), INTERVAL 1 DAY)) AS DATE) AS observed_on FROM keyed),
rain AS (SELECT s.series::INT AS series, d.observed_on, coalesce(greatest(k.k % 1000 - 700, 0) / 5.0, 0.0)::DOUBLE AS mm
  FROM days d CROSS JOIN (SELECT unnest([0, 1]) AS series) s LEFT JOIN keyed k ON k.series = s.series AND k.observed_on = d.observed_on)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_id, row, col, z, cover: blocks of 64 vectors of 64 numbers; z in metres, cover a land-cover class by label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("col", "v"))
    code = F.element_at(F.array(*[F.lit(c) for c in (10, 20, 30, 40, 50, 60, 80, 90, 95, 100)]), F.col("label") + 1)
    return e.select((F.col("vec_id") / SIDE).cast("long").alias("grid_id"), (F.col("vec_id") % SIDE).cast("int").alias("row"), "col", (F.round(F.col("v").cast("double") * 1000) / 100 + 50).alias("z"), code.alias("cover"))


CELLS = f"""e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings),
cells AS (SELECT vec_id // {SIDE} AS grid_id, (vec_id % {SIDE})::INT AS row, col::INT AS col, round(v::DOUBLE * 1000) / 100 + 50 AS z,
  ([10, 20, 30, 40, 50, 60, 80, 90, 95, 100])[label + 1] AS cover FROM e)"""
