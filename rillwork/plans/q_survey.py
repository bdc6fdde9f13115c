"""Queries of survey helpers and remaining predicates, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import classify, geo, hydro, names
from rillwork.operators import decide, survey
from rillwork.plans.views import CELLS, cells, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("s05_mosaic", f"WITH {CELLS}, t AS (SELECT grid_id, row, col, 1 AS tile, CASE WHEN cover = 80 THEN NULL ELSE z END AS z FROM cells UNION ALL SELECT grid_id, row, col, 2, CASE WHEN col % 3 = 0 THEN NULL ELSE z + 1 END FROM cells) SELECT grid_id, row, col, round(coalesce(max(z) FILTER (WHERE tile = 1), max(z) FILTER (WHERE tile = 2), -1), 6) AS z FROM t GROUP BY ALL")
def _s05(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    a = c.select("grid_id", "row", "col", F.lit(1).alias("tile"), F.when(F.col("cover") != 80, F.col("z")).alias("z"))
    b = c.select("grid_id", "row", "col", F.lit(2).alias("tile"), F.when(F.col("col") % 3 != 0, F.col("z") + 1).alias("z"))
    return survey.mosaic(a.unionByName(b)).select("grid_id", "row", "col", F.round(F.coalesce("z", F.lit(-1.0)), 6).alias("z"))


@query("src07_bilinear", f"WITH {CELLS}, s AS (SELECT grid_id * 64 + row AS row, col, z FROM cells), t AS (SELECT grid_id, row, col, (grid_id * 64 + row) * 0.5 + 0.25 AS sr, col * 0.5 + 0.25 AS sc FROM cells), f AS (SELECT t.*, a, b, s.z, (CASE WHEN a = 1 THEN sr - floor(sr) ELSE 1 - (sr - floor(sr)) END) * (CASE WHEN b = 1 THEN sc - floor(sc) ELSE 1 - (sc - floor(sc)) END) AS w FROM t CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) LEFT JOIN s ON s.row = floor(sr)::INT + a AND s.col = floor(sc)::INT + b) SELECT grid_id, row, col, round(coalesce(CASE WHEN bool_and(z IS NOT NULL) THEN sum(w * z) END, -1), 6) AS z FROM f WHERE w > 0 GROUP BY ALL")
def _src07(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    t = c.select("grid_id", "row", "col", ((F.col("grid_id") * 64 + F.col("row")) * 0.5 + 0.25).alias("sr"), (F.col("col") * 0.5 + 0.25).alias("sc"))
    return survey.bilinear(t, c.withColumn("row", F.col("grid_id") * 64 + F.col("row"))).select("grid_id", "row", "col", F.round(F.coalesce("z", F.lit(-1.0)), 6).alias("z"))


@query("src11_nearest_cover", f"WITH {CELLS}, s AS (SELECT grid_id * 64 + row AS row, col, cover FROM cells) SELECT t.grid_id, t.row, t.col, coalesce(s.cover, -1) AS code FROM cells t LEFT JOIN s ON s.row = floor((t.grid_id * 64 + t.row) * 0.3 + 0.5)::INT AND s.col = floor(t.col * 0.3 + 0.5)::INT")
def _src11(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    t = c.select("grid_id", "row", "col", ((F.col("grid_id") * 64 + F.col("row")) * 0.3).alias("sr"), (F.col("col") * 0.3).alias("sc"))
    return survey.nearest(t, c.withColumn("row", F.col("grid_id") * 64 + F.col("row")).withColumnRenamed("cover", "code")).select("grid_id", "row", "col", F.coalesce("code", F.lit(-1)).alias("code"))


@query("src10_sample", f"WITH {CELLS}, p AS (SELECT vec_id AS point_id, vec_id // 64 AS grid_id, 500003.0 + vec_id * 14 % 400 AS x, 2499997.0 - vec_id * 13 % 330 AS y FROM embeddings) SELECT point_id, round(coalesce(c.z, -1), 6) AS z FROM p LEFT JOIN cells c ON c.grid_id = p.grid_id AND c.row = floor((p.y - 2500000) / -5)::INT AND c.col = floor((p.x - 500000) / 5)::INT AND x < 500320")
def _src10(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    g = c.groupBy("grid_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")).withColumn("transform", F.array(*[F.lit(x) for x in (5.0, 0.0, 500000.0, 0.0, -5.0, 2500000.0)]))
    v = F.col("vec_id")
    p = table(spark, d, "embeddings").select(v.alias("point_id"), (v / 64).cast("long").alias("grid_id"), (500003.0 + v * 14 % 400).alias("x"), (2499997.0 - v * 13 % 330).alias("y"))
    return survey.sampled(p, g, c).select("point_id", F.round(F.coalesce("z", F.lit(-1.0)), 6).alias("z"))


@query("j18_zonal_cover", f"WITH {CELLS}, m AS (SELECT grid_id * 10 + row // 10 AS site_id, cover FROM cells), n AS (SELECT site_id, cover, count(*) AS n FROM m GROUP BY ALL) SELECT site_id, cover, round(n / sum(n) OVER (PARTITION BY site_id), 6) AS fraction FROM n")
def _j18(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    m = c.select((F.col("grid_id") * 10 + F.floor(F.col("row") / 10)).alias("site_id"), "grid_id", "row", "col")
    return survey.zonal_fractions(m, c).select("site_id", "cover", F.round("fraction", 6).alias("fraction"))


@query("j14_gap_fill", f"WITH {CELLS}, h AS (SELECT grid_id, row, col, CASE WHEN (row + col) % 5 = 0 THEN NULL ELSE z END AS z FROM cells), p AS (SELECT grid_id, col * 5.0 + 1 AS x, row * 5.0 + 2 AS y, z, row AS pr, col AS pc FROM cells WHERE (row * 7 + col) % 6 = 0), b AS (SELECT h.grid_id, h.row, h.col, arg_min(p.z, round(sqrt((x - (h.col + 0.5) * 5) ^ 2 + (y - (h.row + 0.5) * 5) ^ 2), 9) * 1e6 + p.z) AS fill FROM h JOIN p ON p.grid_id = h.grid_id AND abs(p.pr - h.row) <= 1 AND abs(p.pc - h.col) <= 1 WHERE h.z IS NULL GROUP BY ALL) SELECT h.grid_id, h.row, h.col, round(coalesce(h.z, b.fill, -1), 6) AS z FROM h LEFT JOIN b USING (grid_id, row, col)")
def _j14(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select("grid_id", "row", "col", "z")
    p = c.where("(row * 7 + col) % 6 = 0").select("grid_id", (F.col("col") * 5.0 + 1).alias("x"), (F.col("row") * 5.0 + 2).alias("y"), "z")
    h = c.withColumn("z", F.when((F.col("row") + F.col("col")) % 5 != 0, F.col("z")))
    return survey.gap_filled(h, p, 5.0).select("grid_id", "row", "col", F.round(F.coalesce("z", F.lit(-1.0)), 6).alias("z"))


@query("w10_islands", "WITH p AS (SELECT user_id AS line_id, event_id AS seq, value > 5 AS ok FROM events), r AS (SELECT *, sum((NOT coalesce(ok, false))::INT) OVER (PARTITION BY line_id ORDER BY seq) AS g FROM p), g AS (SELECT line_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r WHERE ok GROUP BY line_id, g HAVING count(*) >= 2) SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY first)::INT AS part, first, last, n FROM g")
def _w10(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("seq"), F.coalesce(F.col("value") > 5, F.lit(False)).alias("ok"))
    return survey.islands(p)


@query("w07_index_lines", f"WITH {CELLS}, b AS (SELECT grid_id, floor(min(z)) AS lo, floor(max(z)) AS hi FROM cells GROUP BY 1), l AS (SELECT grid_id, unnest(range(lo::BIGINT, hi::BIGINT + 1)) AS level FROM b) SELECT grid_id, level::DOUBLE AS level, level % 5 = 0 AS is_index FROM l")
def _w07(spark: SparkSession, d: str) -> DataFrame:
    b = cells(spark, d).groupBy("grid_id").agg(F.floor(F.min("z")).alias("lo"), F.floor(F.max("z")).alias("hi"))
    lv = b.select("grid_id", F.explode(F.sequence("lo", "hi")).alias("level"), F.lit(1.0).alias("interval")).withColumn("level", F.col("level").cast("double"))
    return survey.index_lines(lv).select("grid_id", "level", "is_index")


@query("a27_coverage", f"WITH {CELLS}, h AS (SELECT grid_id, row, col, CASE WHEN cover = 80 THEN NULL ELSE z END AS z FROM cells) SELECT grid_id, count(*) AS cells, round(100.0 * count(z) / count(*), 4) AS hull_pct, round(max(z) - min(z), 6) AS relief FROM h GROUP BY 1")
def _a27(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("z", F.when(F.col("cover") != 80, F.col("z")))
    return survey.coverage(c).select("grid_id", "cells", F.round("hull_pct", 4).alias("hull_pct"), F.round("relief", 6).alias("relief"))


@query("a19_cadastral_totals", "SELECT c_nationkey AS layer_id, count(*) AS parcels, count(*) FILTER (WHERE c_custkey % 3 = 0) AS public_parcels, round(sum(c_custkey % 100 * 1.0), 3)::DOUBLE AS total_ha, round(coalesce(sum(c_custkey % 100 * 1.0) FILTER (WHERE c_custkey % 3 = 0), 0), 3)::DOUBLE AS public_ha FROM customer GROUP BY 1")
def _a19(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("layer_id"), (F.col("c_custkey") % 100).cast("double").alias("area_ha"), F.when(F.col("c_custkey") % 3 == 0, "Revenue land").otherwise("Ram Singh").alias("owner"))
    return survey.cadastral_totals(c)


@query("j20_chosen_sites", "WITH s AS (SELECT s_nationkey AS job_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank, s_suppkey FROM supplier), w AS (SELECT DISTINCT job_id, unnest([1, 3, 99]) AS rank FROM s) SELECT w.job_id, w.rank::INT AS rank, coalesce(s_suppkey, -1) AS site, s_suppkey IS NOT NULL AS found FROM w LEFT JOIN s USING (job_id, rank)")
def _j20(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("job_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"), "s_suppkey")
    return survey.chosen_sites(s, [1, 3, 99, 1]).select("job_id", "rank", F.coalesce("s_suppkey", F.lit(-1)).alias("site"), "found")


@query("a24_distinct_states", "SELECT DISTINCT c_mktsegment FROM customer")
def _a24(spark: SparkSession, d: str) -> DataFrame:
    return survey.distinct_values(table(spark, d, "customer"), "c_mktsegment")


@query("p04_utm_zone", "SELECT n_nationkey AS id, (floor((n_nationkey * 15.0 - 180 + 180) / 6)::INT % 60) + 1 AS zone, CASE WHEN n_nationkey % 2 = 0 THEN 32600 ELSE 32700 END + (floor((n_nationkey * 15.0) / 6)::INT % 60) + 1 AS epsg FROM nation")
def _p04(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("n_nationkey") * 15.0 - 180, F.when(F.col("n_nationkey") % 2 == 0, 10.0).otherwise(-10.0)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), geo.utm_zone(lon).alias("zone"), geo.utm_epsg(lon, lat).alias("epsg"))


@query("p07_box_checks", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'not ordered' WHEN 2 THEN 'too large' ELSE 'too small' END AS error FROM part")
def _p07(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    w = F.when(k == 0, 0.03).when(k == 1, -0.1).when(k == 2, 2.0).otherwise(0.0001)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(geo.box_error(F.lit(81.2), F.lit(21.2), 81.2 + w, 21.2 + w), F.lit("none")).alias("error"))


@query("p24_confidence", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'low' WHEN p_size / 5.0 < 5 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'full' WHEN p_size % 3 = 0 OR p_size % 2 = 0 THEN 'no_soil_lulc' ELSE 'terrain_only' END AS tier FROM part")
def _p24(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), decide.confidence(s % 3 == 0, s / 5.0).alias("confidence"), decide.tier(s % 3 == 0, s % 2 == 0).alias("tier"))


@query("p27_notes", "SELECT p_partkey AS id, CASE WHEN p_size / 100.0 < 0.05 THEN 'well defined' WHEN p_size / 100.0 < 0.15 THEN 'some flat ground' WHEN p_size / 100.0 < 0.4 THEN 'flat' ELSE 'very flat' END AS flat, CASE WHEN p_size / 100.0 < 0.05 THEN 'fills readily' WHEN p_size / 100.0 < 0.3 THEN 'well matched' ELSE 'too large' END AS fill FROM part WHERE p_size > 0")
def _p27(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("p_size") / 100.0
    return table(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), classify.flatness_note(f).alias("flat"), hydro.fill_note(f).alias("fill"))


@query("p25_screening", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'indeterminate' WHEN s_suppkey % 30 >= 5 AND s_suppkey % 7 <= 4 AND s_suppkey % 3 >= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM supplier")
def _p25(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), classify.screening((k % 30).cast("double"), F.when(k % 5 != 0, k % 7).cast("double"), (k % 3).cast("double"), 5, 4, 1).alias("verdict"))


@query("m07_kirpich", "SELECT p_partkey AS id, round(0.01947 * pow(p_size * 10.0, 0.77) * pow(p_size / 1000.0, -0.385), 6) AS tc, round(0.3 * (p_size + 5.0) * p_size / 360, 6) AS peak FROM part WHERE p_size > 0")
def _m07(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), F.round(hydro.kirpich_min(s * 10.0, s / 1000.0), 6).alias("tc"), F.round(hydro.rational_peak_m3s(s, s + 5.0, F.lit(0.3)), 6).alias("peak"))


@query("m10_inglis", "WITH p AS (SELECT p_partkey AS id, p_retailprice / 10 AS cm FROM part) SELECT id, round(CASE WHEN 0.85 * cm - 30.5 <= 0 THEN 0 ELSE (0.85 * cm - 30.5) * 10 END, 4) AS ghat, round(CASE WHEN cm <= 17.8 THEN 0 WHEN (cm - 17.8) / 254 <= 1 THEN (cm - 17.8) * cm / 25.4 ELSE -1 END, 4) AS plains FROM p")
def _m10(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(hydro.inglis_desouza_mm(p, "ghat"), 4).alias("ghat"), F.round(F.coalesce(hydro.inglis_desouza_mm(p, "plains"), F.lit(-1.0)), 4).alias("plains"))


@query("m18_ring_area", "SELECT n_nationkey AS id, round((10.0 + n_nationkey) * (20.0 + n_nationkey), 6)::DOUBLE AS area, round(2 * (10.0 + n_nationkey) + (20.0 + n_nationkey), 6)::DOUBLE AS length FROM nation")
def _m18(spark: SparkSession, d: str) -> DataFrame:
    a, b = 10.0 + F.col("n_nationkey"), 20.0 + F.col("n_nationkey")
    z = F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((z, z), (a, z), (a, b), (z, b))])
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.round(geo.ring_area_m2(ring), 6).alias("area"), F.round(geo.line_length(ring), 6).alias("length"))


@query("src09_cache_key", "SELECT n_nationkey AS id, sha256('v2|' || printf('%.5f', 81.2 + n_nationkey) || '|30') AS key FROM nation")
def _src09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), geo.cache_key(F.lit("v2"), F.format_string("%.5f", 81.2 + F.col("n_nationkey")), F.lit(30)).alias("key"))


@query("k04_top_criteria", "WITH c AS (SELECT s_suppkey AS id, unnest(['slope', 'flow_accumulation', 'plan_concavity']) AS name, unnest([s_suppkey * 7 % 11, s_suppkey * 5 % 11, s_suppkey * 3 % 11]) AS v, unnest([0, 1, 2]) AS i FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) AS k FROM c) SELECT id, string_agg(name, ',' ORDER BY k) AS top FROM r WHERE k <= 2 GROUP BY 1")
def _k04(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = F.array(*[F.struct(F.lit(n).alias("criterion"), (k * m % 11).cast("double").alias("contribution")) for n, m in (("slope", 7), ("flow_accumulation", 5), ("plan_concavity", 3))])
    return table(spark, d, "supplier").select(k.alias("id"), F.array_join(decide.top_criteria(c), ",").alias("top"))


@query("s06_layer_lists", "SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'cover' END, CASE WHEN p_size % 3 = 0 THEN 'soil' END], lambda x: x IS NOT NULL), ',') AS used, CASE WHEN p_size % 3 = 0 THEN 'B' ELSE 'C' END AS soil FROM part")
def _s06(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    lists = survey.layer_lists({"cover": s % 2 == 0, "soil": s % 3 == 0})
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(lists["used"], ",").alias("used"), survey.soil_or_assumed(F.when(s % 3 == 0, "B"))["group"].alias("soil"))


@query("f05_first_number", "SELECT n_nationkey AS id, (n_nationkey - 5.5)::DOUBLE AS n, n_nationkey % 2 = 0 AS devanagari FROM nation")
def _f05(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.concat(F.lit("Contour "), (k - 5.5).cast("string"), F.lit("m (12)"), F.when(k % 2 == 0, "गाँव").otherwise("gaon"))
    return table(spark, d, "nation").select(k.alias("id"), names.first_number(text).alias("n"), names.has_devanagari(text).alias("devanagari"))
