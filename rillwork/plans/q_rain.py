"""Queries of rainfall and runoff operators on two made series, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import hydro
from rillwork.operators import rainfall, runoff
from rillwork.plans.views import RAIN, rain_daily

Q: dict = {}
SQL: dict[str, str] = {}
CN2, AREA = 78.4, 1_802_500.0


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def day():  # noqa: ANN201
    return F.col("observed_on").cast("string").alias("observed_on")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


YEARS = f"""{RAIN},
years AS (SELECT series, year(observed_on) AS y, sum(mm) AS total, count(*) AS days FROM rain GROUP BY ALL HAVING count(*) >= 360)"""
MONTHS = f"""{YEARS},
n AS (SELECT series, count(*) AS k FROM years GROUP BY 1),
normals AS (SELECT series, month(observed_on) AS m, sum(mm) / any_value(k) AS normal FROM rain JOIN n USING (series) GROUP BY ALL)"""


@query("a01_annual_totals", f"WITH {YEARS} SELECT series, y::INT AS year, days, round(total, 6) AS total FROM years")
def _a01(spark: SparkSession, d: str) -> DataFrame:
    return rainfall.annual_totals(rain_daily(spark, d)).select("series", "year", "days", *r6("total"))


@query("a02_monthly_normals", f"WITH {MONTHS} SELECT series, m::INT AS month, round(normal, 6) AS normal FROM normals")
def _a02(spark: SparkSession, d: str) -> DataFrame:
    return rainfall.monthly_normals(rain_daily(spark, d)).select("series", "month", *r6("normal"))


@query("a03_monthly_means", f"WITH {RAIN} SELECT series, month(observed_on)::INT AS month, round(avg(CASE WHEN mm > 0 THEN mm END), 6) AS mean FROM rain GROUP BY ALL")
def _a03(spark: SparkSession, d: str) -> DataFrame:
    holes = rain_daily(spark, d).withColumn("mm", F.when(F.col("mm") > 0, F.col("mm")).otherwise(F.lit(float("nan"))))
    return rainfall.monthly_means(holes, "mm").select("series", "month", *r6("mean"))


@query(
    "a04_annual_statistics",
    f"""WITH {YEARS}, d AS (SELECT series, count(*) FILTER (WHERE mm >= 2.5) AS rainy, max(mm) AS max_1day FROM rain GROUP BY 1)
SELECT series, count(*) AS years, round(avg(total), 6) AS mean_annual, round(quantile_cont(total, 0.5), 6) AS median_annual, round(stddev_samp(total), 6) AS std_annual, round(min(total), 6) AS min_annual, round(max(total), 6) AS max_annual,
  max(max_1day) AS max_1day, round(stddev_samp(total) / avg(total), 6) AS cv, round(max(rainy) / count(*), 6) AS rainy_days_per_year FROM years JOIN d USING (series) GROUP BY series""",
)
def _a04(spark: SparkSession, d: str) -> DataFrame:
    return rainfall.annual_statistics(rain_daily(spark, d)).select("series", "years", "max_1day", *r6("mean_annual", "median_annual", "std_annual", "min_annual", "max_annual", "cv", "rainy_days_per_year"))


DEPENDABLE = """ranked AS (SELECT series, total, row_number() OVER (PARTITION BY series ORDER BY total DESC, y) / (count(*) OVER (PARTITION BY series) + 1) AS p FROM years),
pairs AS (SELECT series, total AS v, p, lead(total) OVER w AS v2, lead(p) OVER w AS p2, first_value(total) OVER w AS v_first, first_value(p) OVER w AS p_first FROM ranked WINDOW w AS (PARTITION BY series ORDER BY p)),
dep AS (SELECT series, q, max(CASE WHEN q <= p_first THEN v_first WHEN p <= q AND (p2 IS NULL OR p2 > q) THEN CASE WHEN p2 IS NULL THEN v ELSE v + (v2 - v) * (q - p) / (p2 - p) END END) AS dependable
  FROM pairs CROSS JOIN (SELECT unnest([0.5, 0.75, 0.9]::DOUBLE[]) AS q) GROUP BY ALL)"""


@query("a05_dependable_rainfall", f"WITH {YEARS}, {DEPENDABLE} SELECT series, round(max(dependable) FILTER (WHERE q = 0.5), 6) AS dependable_50, round(max(dependable) FILTER (WHERE q = 0.75), 6) AS dependable_75, round(max(dependable) FILTER (WHERE q = 0.9), 6) AS dependable_90 FROM dep GROUP BY series")
def _a05(spark: SparkSession, d: str) -> DataFrame:
    return rainfall.dependable(rainfall.annual_totals(rain_daily(spark, d))).select("series", *r6("dependable_50", "dependable_75", "dependable_90"))


@query("w03_exceedance", f"WITH {YEARS} SELECT series, y::INT AS year, row_number() OVER w AS rank, round(row_number() OVER w / (count(*) OVER (PARTITION BY series) + 1), 6) AS exceedance FROM years WINDOW w AS (PARTITION BY series ORDER BY total DESC, y)")
def _w03(spark: SparkSession, d: str) -> DataFrame:
    return rainfall.exceedance(rainfall.annual_totals(rain_daily(spark, d))).select("series", "year", F.col("rank").cast("long").alias("rank"), *r6("exceedance"))


@query(
    "a06_rainfall_ensemble",
    f"""WITH {YEARS}, m AS (SELECT series, avg(total) AS v FROM years GROUP BY 1)
SELECT 'here' AS place, count(*) AS members, round(median(v), 6) AS median, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(stddev_samp(v), 6) AS sigma, round((max(v) - min(v)) / median(v), 6) AS spread, (max(v) - min(v)) / median(v) > 0.2 AS notable FROM m""",
)
def _a06(spark: SparkSession, d: str) -> DataFrame:
    stats = rainfall.annual_statistics(rain_daily(spark, d)).withColumn("place", F.lit("here"))
    return rainfall.ensemble(stats).select("place", "members", "notable", *r6("median", "lowest", "highest", "sigma", "spread"))


@query(
    "w04_monsoon_window",
    f"""WITH {MONTHS}, s AS (SELECT a.series, a.m AS start, sum(b.normal) AS total FROM normals a JOIN normals b ON a.series = b.series AND (b.m - a.m + 12) % 12 < 4 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(total, 9) DESC, start) AS k FROM s), t AS (SELECT series, sum(normal) AS whole FROM normals GROUP BY 1)
SELECT series, start::INT AS start, round(total, 6) AS total, round(100 * total / whole, 6) AS share FROM best JOIN t USING (series) WHERE k = 1""",
)
def _w04(spark: SparkSession, d: str) -> DataFrame:
    got = rainfall.as_months(rainfall.monthly_normals(rain_daily(spark, d))).select("series", rainfall.wet_window(F.col("normals")).alias("w"))
    return got.select("series", "w.start", F.round("w.total", 6).alias("total"), F.round("w.share", 6).alias("share"))


ANTECEDENT = "ant AS (SELECT *, coalesce(sum(mm) OVER (PARTITION BY series ORDER BY observed_on ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS antecedent FROM rain)"


@query("w01_antecedent_5day", f"WITH {RAIN}, {ANTECEDENT} SELECT series, CAST(observed_on AS VARCHAR) AS observed_on, round(antecedent, 6) AS antecedent FROM ant")
def _w01(spark: SparkSession, d: str) -> DataFrame:
    return rainfall.antecedent(rain_daily(spark, d)).select("series", day(), *r6("antecedent"))


AMC = """amc AS (SELECT *, CASE WHEN antecedent < CASE WHEN month(observed_on) BETWEEN 6 AND 9 THEN 35.5 ELSE 12.7 END THEN 'I'
  WHEN antecedent > CASE WHEN month(observed_on) BETWEEN 6 AND 9 THEN 53.3 ELSE 27.9 END THEN 'III' ELSE 'II' END AS amc FROM (SELECT * REPLACE (round(antecedent, 9) AS antecedent) FROM ant))"""


@query("p20_moisture_class", f"WITH {RAIN}, {ANTECEDENT}, {AMC} SELECT series, amc, count(*) AS days FROM amc GROUP BY ALL")
def _p20(spark: SparkSession, d: str) -> DataFrame:
    a = rainfall.antecedent(rain_daily(spark, d))
    cls = hydro.moisture_class(F.round("antecedent", 9), F.month("observed_on").isin(*runoff.MONSOON))
    return a.select("series", cls.alias("amc")).groupBy("series", "amc").agg(F.count(F.lit(1)).alias("days"))


CN_SQL = f"CASE amc WHEN 'I' THEN 4.2 * {CN2} / (10 - 0.058 * {CN2}) WHEN 'III' THEN 23 * {CN2} / (10 + 0.13 * {CN2}) ELSE {CN2} END"
RUNOFF = f"""cn AS (SELECT *, ({CN_SQL})::DOUBLE AS cn FROM amc), s AS (SELECT *, 25400.0 / cn - 254.0 AS s FROM cn),
q AS (SELECT *, CASE WHEN mm > 0.3 * s THEN (mm - 0.3 * s) * (mm - 0.3 * s) / (mm - 0.3 * s + s) ELSE 0.0 END AS runoff FROM s)"""


@query("m05_daily_runoff", f"WITH {RAIN}, {ANTECEDENT}, {AMC}, {RUNOFF} SELECT series, CAST(observed_on AS VARCHAR) AS observed_on, amc, round(runoff, 6) AS runoff FROM q WHERE runoff > 0")
def _m05(spark: SparkSession, d: str) -> DataFrame:
    return runoff.daily_runoff(rain_daily(spark, d), F.lit(CN2)).where("runoff > 0").select("series", day(), "amc", *r6("runoff"))


YEARLY_RUNOFF = "years AS (SELECT series, year(observed_on) AS y, sum(runoff) AS total, sum(mm) AS rain FROM q GROUP BY ALL HAVING count(*) >= 360)"


@query("a30_annual_runoff", f"WITH {RAIN}, {ANTECEDENT}, {AMC}, {RUNOFF}, {YEARLY_RUNOFF} SELECT series, round(avg(total), 6) AS annual_mean_mm, round(avg(total) / avg(rain), 6) AS coefficient FROM years GROUP BY 1")
def _a30(spark: SparkSession, d: str) -> DataFrame:
    return runoff.runoff_estimate(rain_daily(spark, d), F.lit(CN2), F.lit(AREA)).select("series", *r6("annual_mean_mm", "coefficient"))


@query(
    "d07_scs_cn_runoff",
    f"""WITH {RAIN}, {ANTECEDENT}, {AMC}, {RUNOFF}, {YEARLY_RUNOFF}, {DEPENDABLE}
SELECT years.series, count(*) AS years, round(avg(total), 6) AS annual_mean_mm, round(avg(total) / 1000 * {AREA}, 3) AS annual_mean_m3, round(any_value(dependable), 6) AS dependable_75_mm, round(any_value(dependable) / 1000 * {AREA}, 3) AS dependable_75_m3, round(avg(total) / avg(rain), 6) AS coefficient
FROM years JOIN dep ON dep.series = years.series AND q = 0.75 GROUP BY years.series""",
)
def d07(spark: SparkSession, d: str) -> DataFrame:
    got = runoff.runoff_estimate(rain_daily(spark, d), F.lit(CN2), F.lit(AREA))
    return got.select("series", "years", *r6("annual_mean_mm", "dependable_75_mm", "coefficient"), F.round("annual_mean_m3", 3).alias("annual_mean_m3"), F.round("dependable_75_m3", 3).alias("dependable_75_m3"))


@query(
    "w09_month_filled",
    f"""WITH {RAIN}, h AS (SELECT series, observed_on, CASE WHEN mm > 0 THEN mm END AS mm FROM rain) SELECT series, CAST(observed_on AS VARCHAR) AS observed_on, round(coalesce(mm, avg(mm) OVER (PARTITION BY series, month(observed_on))), 6) AS mm FROM h""",
)
def _w09(spark: SparkSession, d: str) -> DataFrame:
    holes = rain_daily(spark, d).withColumn("mm", F.when(F.col("mm") > 0, F.col("mm")))
    return rainfall.month_filled(holes, "mm").select("series", day(), *r6("mm"))


@query(
    "snk09_cache_merge",
    f"WITH {RAIN}, a AS (SELECT observed_on, mm AS v FROM rain WHERE series = 0), b AS (SELECT observed_on, CASE WHEN mm > 0 THEN mm END AS v FROM rain WHERE series = 1) SELECT CAST(coalesce(a.observed_on, b.observed_on) AS VARCHAR) AS observed_on, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (observed_on)",
)
def _snk09(spark: SparkSession, d: str) -> DataFrame:
    r = rain_daily(spark, d)
    old = r.where("series = 0").select("observed_on", F.col("mm").alias("v"))
    new = r.where("series = 1").select("observed_on", F.when(F.col("mm") > 0, F.col("mm")).alias("v"))
    return rainfall.merge_cache(old, new, ["observed_on"], ["v"]).select(day(), "v")


@query(
    "src23_cache_coverage",
    f"WITH {RAIN}, c AS (SELECT * FROM rain WHERE series = 0 OR day(observed_on) > 5), ok AS (SELECT series FROM c WHERE observed_on BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1 HAVING count(*) / 1461.0 >= 0.95) SELECT series, count(*) AS days, round(sum(mm), 6) AS mm FROM c JOIN ok USING (series) WHERE observed_on BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1",
)
def _src23(spark: SparkSession, d: str) -> DataFrame:
    cache = rain_daily(spark, d).where("series = 0 or day(observed_on) > 5")
    got = rainfall.cached_range(cache, spark.createDataFrame([(0,), (1,)], "series int"), F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return got.groupBy("series").agg(F.count(F.lit(1)).alias("days"), F.sum("mm").alias("mm")).select("series", "days", *r6("mm"))


@query("d21_primary_source", f"WITH {YEARS} SELECT 'here' AS place, series, round(avg(total), 6) AS mean_annual FROM years WHERE series = 1 GROUP BY ALL")
def _d21(spark: SparkSession, d: str) -> DataFrame:
    stats = rainfall.annual_statistics(rain_daily(spark, d)).withColumns({"place": F.lit("here"), "source": F.concat(F.lit("s"), "series")})
    return rainfall.primary(stats, ["s1", "s0"]).select("place", "series", *r6("mean_annual"))


@query(
    "m09_hargreaves_et0",
    f"""WITH {RAIN}, d AS (SELECT series, observed_on, radians(21.25 + series) AS phi, 2 * pi() * dayofyear(observed_on) / 365.0 AS t FROM rain),
s AS (SELECT *, 1 + 0.033 * cos(t) AS near, 0.409 * sin(t - 1.39) AS decl FROM d), w AS (SELECT *, acos(greatest(-1, least(1, -tan(phi) * tan(decl)))) AS ws FROM s),
r AS (SELECT series, observed_on, 24 * 60 / pi() * 0.0820 * near * (ws * sin(phi) * sin(decl) + cos(phi) * cos(decl) * sin(ws)) AS ra FROM w)
SELECT series, CAST(observed_on AS VARCHAR) AS observed_on, round(ra, 6) AS ra, round(0.0023 * 0.408 * ra * (28 + 17.8) * sqrt(12.0), 6) AS et0 FROM r""",
)
def _m09(spark: SparkSession, d: str) -> DataFrame:
    r = rain_daily(spark, d).withColumn("ra", hydro.extraterrestrial_radiation(21.25 + F.col("series"), F.dayofyear("observed_on")))
    return r.select("series", day(), F.round("ra", 6).alias("ra"), F.round(hydro.hargreaves_et0(F.col("ra"), F.lit(28.0), F.lit(34.0), F.lit(22.0)), 6).alias("et0"))


@query(
    "d08_cross_check",
    f"""WITH {MONTHS}, s AS (SELECT series, sum(normal) AS annual, sum(normal) FILTER (WHERE m BETWEEN 6 AND 9) AS monsoon, sum(greatest(0, normal - 0.48 * 28)) AS khosla FROM normals GROUP BY 1),
x AS (SELECT series, st, annual, CASE WHEN annual / 10 <= 17.8 THEN 0 WHEN (annual / 10 - 17.8) / 254 <= 1 THEN (annual / 10 - 17.8) * (annual / 10) / 254 * 10 END AS plains, CASE WHEN khosla <= 0.75 * annual THEN khosla END AS khosla, monsoon * 0.16 AS barlow, 0.2 * annual AS scs FROM s CROSS JOIN (SELECT unnest(['Karnataka', 'Bihar', 'Chhattisgarh']) AS st)),
b AS (SELECT *, CASE st WHEN 'Karnataka' THEN 'deccan' WHEN 'Bihar' THEN 'gangetic' ELSE 'general' END AS region,
  CASE st WHEN 'Karnataka' THEN plains WHEN 'Bihar' THEN least(barlow, khosla) ELSE least(khosla, plains) END AS lowest, CASE st WHEN 'Karnataka' THEN plains WHEN 'Bihar' THEN greatest(barlow, khosla) ELSE greatest(khosla, plains) END AS highest FROM x)
SELECT series, st AS state, region, round(lowest, 6) AS lowest, round(highest, 6) AS highest, scs BETWEEN lowest * 0.75 AND highest * 1.25 AS agrees FROM b""",
)
def _d08(spark: SparkSession, d: str) -> DataFrame:
    m = rainfall.as_months(rainfall.monthly_normals(rain_daily(spark, d)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    states = spark.createDataFrame([("Karnataka",), ("Bihar",), ("Chhattisgarh",)], "state string")
    rows = m.crossJoin(F.broadcast(states)).select(  # three rows
        F.col("series").alias("site"), "state", (0.2 * total("normals")).alias("scs_mm"), total("normals").alias("annual_mm"), total(F.slice("normals", 6, 4)).alias("monsoon_mm"), F.col("normals").alias("monthly_mm"), F.array_repeat(F.lit(28.0), 12).alias("monthly_temp"), F.lit("average").alias("catchment_class")
    )
    return runoff.cross_check(rows).select(F.col("site").alias("series"), "state", "region", "agrees", *r6("lowest", "highest"))


@query(
    "a10_composite_cn",
    """WITH f AS (SELECT s_nationkey AS site, ([10, 20, 30, 40, 50, 60])[s_suppkey % 6 + 1] AS cover, (s_suppkey % 17 + 1)::DOUBLE AS fraction FROM supplier),
c AS (SELECT *, CASE cover WHEN 10 THEN 70 WHEN 20 THEN 70 WHEN 30 THEN 79 WHEN 40 THEN 85 WHEN 50 THEN 90 WHEN 60 THEN 91 END AS cn FROM f), g AS (SELECT site, sum(fraction * cn) / sum(fraction) AS cn2, count(*) AS parts FROM c GROUP BY 1)
SELECT site, parts, round(cn2, 6) AS cn2, round(greatest(1, least(100, 4.2 * cn2 / (10 - 0.058 * cn2))), 6) AS cn1, round(greatest(1, least(100, 23 * cn2 / (10 + 0.13 * cn2))), 6) AS cn3 FROM g""",
)
def _a10(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    cover = F.element_at(F.array(*[F.lit(c) for c in (10, 20, 30, 40, 50, 60)]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = s.select(F.col("s_nationkey").alias("site"), cover.alias("cover"), (F.col("s_suppkey") % 17 + 1).cast("double").alias("fraction"), F.lit("C").alias("soil"))
    return runoff.composite_curve_number(rows).select("site", F.size("breakdown").cast("long").alias("parts"), *r6("cn2", "cn1", "cn3"))


@query("a31_latency_summary", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1")
def _a31(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("value"))
    n = F.count("value").over(Window.partitionBy("event_type"))
    p95 = e.where("value is not null").withColumns({"k": rank, "n": n}).where(F.col("k") == F.ceil(F.col("n") * 0.95)).select("event_type", F.round("value", 6).alias("p95"))
    return e.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.count(F.lit(1)).alias("n")).join(p95, "event_type")


@query(
    "x05_cached_statistics",
    f"WITH {RAIN}, c AS (SELECT series, observed_on, mm FROM rain UNION ALL SELECT 2, observed_on, mm FROM rain WHERE series = 1 AND day(observed_on) > 3), s AS (SELECT unnest([0, 1, 2, 3]) AS series), "
    "r AS (SELECT * FROM c WHERE observed_on BETWEEN DATE '1995-06-01' AND DATE '1999-12-31'), ok AS (SELECT series FROM r GROUP BY 1 HAVING count(*) / (date_diff('day', DATE '1995-06-01', DATE '1999-12-31') + 1) >= 0.95), y AS (SELECT series, year(observed_on) AS y, sum(mm) AS t FROM r JOIN ok USING (series) GROUP BY ALL HAVING count(*) >= 360), "
    "g AS (SELECT series, count(*) AS years, avg(t) AS m FROM y GROUP BY 1) SELECT series, years IS NOT NULL AS hit, coalesce(years, 0) AS years, round(coalesce(m, -1), 6) AS mean_annual FROM s LEFT JOIN g USING (series)",
)
def _x05(spark: SparkSession, d: str) -> DataFrame:
    r = rain_daily(spark, d)
    cache = r.unionByName(r.where("series = 1 and day(observed_on) > 3").withColumn("series", F.lit(2)))
    got = rainfall.cached_stats(cache, spark.createDataFrame([(k,) for k in range(4)], "series int"), F.lit("1995-06-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return got.select("series", "hit", F.coalesce("years", F.lit(0).cast("long")).alias("years"), F.round(F.coalesce("mean_annual", F.lit(-1.0)), 6).alias("mean_annual"))
