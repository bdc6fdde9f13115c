"""Queries of pond, decision, siting and land operators, with SQL twins where SQL has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import classify, geo, hydro, names
from rillwork.operators import decide, kernels, pond, siting
from rillwork.plans.views import CELLS, cells, table

Q: dict = {}
SQL: dict[str, str] = {}
CELL = 5.0


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r4(*names_: str) -> list:
    return [F.round(n, 4).alias(n) for n in names_]


@query("m14_prismoidal_volume", "WITH p AS (SELECT p_partkey AS id, p_size * 2.0 AS side, 2.0 + p_partkey % 5 * 0.5 AS d FROM part), b AS (SELECT *, side - 3.0 * d AS lb FROM p) SELECT id, round(CASE WHEN lb > 0 THEN d / 3 * (side * side + lb * lb + sqrt(side * side * lb * lb)) ELSE -1 END, 4) AS volume FROM b")
def _m14(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2.0).alias("side"), (2.0 + F.col("p_partkey") % 5 * 0.5).alias("d"))
    v = hydro.prismoidal(F.col("side"), F.col("side"), F.col("d"), F.lit(1.5))["volume"]
    return p.select("id", F.round(F.coalesce(v, F.lit(-1.0)), 4).alias("volume"))


@query("m15_frustum_depth", "WITH p AS (SELECT p_partkey AS id, 10.0 + p_size AS bl, 8.0 + p_size AS bw, (p_partkey % 97 + 1) / 97.0 AS f FROM part), v AS (SELECT *, 4.0 / 3 * ((bl + 12) * (bw + 12) + bl * bw + sqrt((bl + 12) * (bw + 12) * bl * bw)) AS total FROM p) SELECT id, round(total * f, 3) AS volume FROM v")
def _m15(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (10.0 + F.col("p_size")).alias("bl"), (8.0 + F.col("p_size")).alias("bw"), ((F.col("p_partkey") % 97 + 1) / 97.0).alias("f"))
    bl, bw, z, h = F.col("bl"), F.col("bw"), F.lit(1.5), F.lit(4.0)
    p = p.withColumn("v", hydro.frustum_volume(bl, bw, z, h, h) * F.col("f")).withColumn("depth", hydro.frustum_depth(bl, bw, z, h, F.col("v")))
    return p.select("id", F.round(hydro.frustum_volume(bl, bw, z, h, F.col("depth")), 3).alias("volume"))


def _ponds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    curve = F.array(*[F.struct(F.lit(x).alias("x"), (F.lit(x * x * 100.0) + F.col("p_size")).alias("y")) for x in (0.0, 1.0, 2.0, 3.0, 4.0)])
    return p.select(
        k.alias("site_id"), (F.col("p_size") * 40.0 + k % 50 * 100.0).alias("area_m2"), F.when(k % 4 != 0, F.col("p_retailprice") * 20).alias("runoff_m3"), F.when(k % 3 == 0, 2.0 + k % 5).cast("double").alias("water_table_m"), F.when(k % 5 == 0, 20000.0 + k % 7 * 50000.0).alias("budget"), curve.alias("curve"), F.col("p_size")
    )


_VOL = "({d}) / 3 * ({s} * {s} + ({s} - 3 * ({d})) * ({s} - 3 * ({d})) + {s} * ({s} - 3 * ({d})))"


def _vol(side: str, depth: str) -> str:
    return "(" + _VOL.format(s=side, d=depth) + ")"


PONDS = f"""p AS (SELECT p_partkey AS site_id, p_size * 40.0::DOUBLE + p_partkey % 50 * 100.0::DOUBLE AS area, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 20 END AS runoff, CASE WHEN p_partkey % 3 = 0 THEN 2.0 + p_partkey % 5 - 1.0 END::DOUBLE AS wt, CASE WHEN p_partkey % 5 = 0 THEN 20000.0 + p_partkey % 7 * 50000.0 END::DOUBLE AS budget, p_size FROM part),
a AS (SELECT *, sqrt(greatest(area, 1.0)) AS side, least(4.5, CASE WHEN wt IS NULL THEN 4.5 ELSE greatest(wt, 0.0) END)::DOUBLE AS cap0 FROM p),
b AS (SELECT *, CASE WHEN side / 3.0 * 0.98 < cap0 THEN side / 3.0 * 0.98 END AS geo FROM a), c AS (SELECT *, coalesce(geo, cap0) AS cap FROM b),
e AS (SELECT *, CASE WHEN cap < 2.5 THEN greatest(cap, 0.5) ELSE cap END AS d0 FROM c),
f AS (SELECT *, CASE WHEN budget IS NULL THEN d0 ELSE list_filter(list_transform(range(0, 19), lambda k: d0 - 0.25 * k), lambda x: x <= 2.5 OR {_vol('side', 'x')} * 130 <= budget)[1] END AS d1 FROM e),
g AS (SELECT *, CASE WHEN d1 * 3 < side THEN {_vol('side', 'd1')} END AS v1 FROM f), h AS (SELECT *, CASE WHEN v1 > 0.3 * runoff THEN pow(0.3 * runoff / v1, 1.0 / 3) END AS sc FROM g),
i AS (SELECT *, d1 * coalesce(sc, 1) AS depth, side * coalesce(sc, 1) AS top FROM h), j AS (SELECT *, CASE WHEN depth * 3 < top THEN {_vol('top', 'depth')} END AS v FROM i),
l AS (SELECT *, list_sort(list_filter([{{'v': 4.5::DOUBLE, 'o': 0, 'n': 'practical_excavation_depth'}}, {{'v': CASE WHEN wt IS NOT NULL THEN greatest(wt, 0.0) END::DOUBLE, 'o': 1, 'n': 'water_table_clearance'}}, {{'v': CASE WHEN runoff > 0 THEN CASE WHEN sc IS NULL THEN 4.5 ELSE depth END END::DOUBLE, 'o': 2, 'n': 'sustainable_yield_share'}}, {{'v': geo, 'o': 3, 'n': 'plan_area_geometry'}}, {{'v': CASE WHEN budget > 0 THEN d1 END, 'o': 4, 'n': 'budget'}}], lambda x: x.v IS NOT NULL))[1].n AS binding FROM j)"""


@query("d09_pond_design", f"WITH {PONDS} SELECT site_id, round(depth, 4) AS depth_m, round(top, 4) AS top_m, round(coalesce(v, -1), 3) AS gross_m3, round(coalesce(v * 147.5, -1), 2) AS cost, binding FROM l")
def _d09(spark: SparkSession, d: str) -> DataFrame:
    x = pond.design(_ponds(spark, d)).select("site_id", "pond.*")
    return x.select("site_id", "binding", *r4("depth_m", "top_m"), F.round(F.coalesce("gross_m3", F.lit(-1.0)), 3).alias("gross_m3"), F.round(F.coalesce("cost", F.lit(-1.0)), 2).alias("cost"))


@query("d14_expected_water", f"WITH {PONDS}, w AS (SELECT site_id, 0.9 * v AS live, 0.4 * runoff AS dep FROM l ) SELECT site_id, round(CASE WHEN live IS NULL THEN -1 WHEN dep < live THEN dep ELSE live END, 3) AS m3, CASE WHEN live IS NULL THEN 'none' WHEN dep < live THEN 'inflow' ELSE 'storage' END AS limited_by FROM w")
def _d14(spark: SparkSession, d: str) -> DataFrame:
    x = pond.design(_ponds(spark, d)).select("site_id", pond.expected_water(F.col("pond.live_m3"), 0.4 * F.col("runoff_m3")).alias("w"))
    return x.select("site_id", F.round(F.coalesce("w.m3", F.lit(-1.0)), 3).alias("m3"), F.coalesce("w.limited_by", F.lit("none")).alias("limited_by"))


_SEEP = "CASE p_partkey % 5 WHEN 0 THEN 25.0 WHEN 1 THEN 12.0 WHEN 2 THEN 6.0 WHEN 3 THEN 2.0 ELSE 6.0 END::DOUBLE"
_SURFACE, _HELD = "((bl + 3 * {d}) * (bl + 3 * {d}))", "({d} / 3 * ((bl + 3 * {d}) * (bl + 3 * {d}) + bl * bl + (bl + 3 * {d}) * bl))"
_NEWTON = f"list_reduce([depth] || range(1, 17)::DOUBLE[], lambda d, k: greatest(0.0, least(depth, d - ({_HELD.format(d='d')} - storage) / {_SURFACE.format(d='d')})))"


@query(
    "d10_water_balance",
    f"""WITH RECURSIVE p AS (SELECT p_partkey AS site_id, p_partkey, 10.0::DOUBLE + p_size AS bl, 3.0::DOUBLE + p_partkey % 3 * 0.5 AS depth, p_retailprice * 500 AS catchment, {_SEEP} AS seep FROM part),
q AS (SELECT *, {_HELD.format(d='depth')} AS cap FROM p),
b(site_id, p_partkey, bl, depth, catchment, seep, cap, i, inflow, evaporation, seepage, spill, storage, area) AS (SELECT *, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM q
 UNION ALL SELECT site_id, p_partkey, bl, depth, catchment, seep, cap, i + 1, inflow, oe * lost / greatest(wanted, 1e-300), os * lost / greatest(wanted, 1e-300), greatest(0.0, was + inflow - cap), storage,
  CASE WHEN storage <= 0 THEN 0.0 ELSE (SELECT {_SURFACE.format(d='dd')} FROM (SELECT CASE WHEN storage >= cap THEN depth ELSE {_NEWTON} END AS dd)) END
 FROM (SELECT *, greatest(0.0, held - lost) AS storage FROM (SELECT *, least(held, wanted) AS lost FROM (SELECT *, least(was + inflow, cap) AS held, oe + os AS wanted FROM (
  SELECT site_id, p_partkey, bl, depth, catchment, seep, cap, i, storage AS was, CASE WHEN i % 12 BETWEEN 5 AND 9 THEN p_partkey * (i % 12 + 3) % 97 ELSE 0 END / 1000.0::DOUBLE * catchment AS inflow,
   (100 + (p_partkey + i % 12 * 7) % 60) * 1.05 / 1000 * area AS oe, seep * {[float(x) for x in hydro.DAYS_IN_MONTH]}[i % 12 + 1] / 1000 * area AS os FROM b WHERE i < 36)))))
, l AS (SELECT *, (i - 1) % 12 AS m FROM b WHERE i > 24), k AS (SELECT site_id, arg_max(m, storage * 1e6 - m / 1e6) AS top FROM l GROUP BY 1)
SELECT site_id, count(*) FILTER (WHERE storage > 0.1 * cap)::INT AS months_with_water, round(max(storage), 3) AS peak_m3, round(sum(spill), 3) AS spill_m3, round(sum(evaporation), 3) AS evaporation_m3, round(sum(seepage), 3) AS seepage_m3,
 round(sum(inflow), 3) AS inflow_m3, {list(pond.MONTHS)}[arg_min(m, (m - top + 11) % 12) FILTER (WHERE storage <= 0.1 * cap) + 1] AS dry_month FROM l JOIN k USING (site_id) GROUP BY site_id""",
)
def _d10(spark: SparkSession, d: str) -> DataFrame:
    k, months = F.col("p_partkey"), F.sequence(F.lit(0), F.lit(11))
    runoff = F.transform(months, lambda m: F.when(m.between(5, 9), (k * (m + 3) % 97).cast("double")).otherwise(0.0))
    et0 = F.transform(months, lambda m: (100 + (k + m * 7) % 60).cast("double"))
    soil = F.element_at(F.array(F.lit("A"), F.lit("b"), F.lit("C"), F.lit("D"), F.lit(None)), (k % 5 + 1).cast("int"))
    side = 10.0 + F.col("p_size")
    s = table(spark, d, "part").select(k.alias("site_id"), runoff.alias("runoff_mm"), et0.alias("et0_mm"), (F.col("p_retailprice") * 500).alias("catchment_m2"), side.alias("bottom_length"), side.alias("bottom_width"), (3.0 + k % 3 * 0.5).alias("depth"), F.lit(1.5).alias("side_slope"), soil.alias("soil"))
    bl, bw, z, h = F.col("bottom_length"), F.col("bottom_width"), F.col("side_slope"), F.col("depth")
    b = pond.water_balance(s.withColumn("capacity_m3", hydro.frustum_volume(bl, bw, z, h, h)))
    r3 = lambda c, n: F.round(c, 3).alias(n)
    inflow = F.aggregate("balance.months", F.lit(0.0), lambda t, m: t + m["inflow"])
    return b.select("site_id", "balance.months_with_water", *[r3(f"balance.{n}", n) for n in ("peak_m3", "spill_m3", "evaporation_m3", "seepage_m3")], r3(inflow, "inflow_m3"), "balance.dry_month")


METRICS_SQL = "[{'m': 'suitability_score', 'up': true, 'v': c_acctbal}, {'m': 'estimated_cost_inr', 'up': false, 'v': (c_custkey * 7919 % 1000 + 1)::DOUBLE}, {'m': 'months_with_water', 'up': true, 'v': (5 + c_custkey % 2 * 0.001)::DOUBLE}]"


@query(
    "a26_site_comparison",
    f"""WITH s AS (SELECT c_nationkey AS job_id, c_custkey AS rank, unnest({METRICS_SQL}) AS x FROM customer), g AS (SELECT job_id, x.m AS metric, count(*) AS n, min(x.v) AS lowest, max(x.v) AS highest, arg_min(rank, (CASE WHEN x.up THEN -x.v ELSE x.v END) * 1e6 + rank / 1e6) AS best FROM s GROUP BY ALL),
u AS (SELECT *, CASE WHEN lowest > 0 THEN 100 * (highest - lowest) / lowest END AS spread FROM g), v AS (SELECT *, n > 1 AND (highest - lowest < 1e-9 OR coalesce(spread < 1, false)) AS uniform FROM u)
SELECT job_id, metric, round(lowest, 4) AS lowest, round(highest, 4) AS highest, round(coalesce(spread, -1), 4) AS spread_pct, uniform, CASE WHEN uniform THEN -1 ELSE best END AS best_rank FROM v""",
)
def _a26(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_custkey").alias("rank"), F.col("c_acctbal").alias("suitability_score"), (F.col("c_custkey") * 7919 % 1000 + 1).alias("estimated_cost_inr"), (5 + F.col("c_custkey") % 2 * 0.001).alias("months_with_water"))
    return decide.compare(c).select("job_id", "metric", "uniform", *r4("lowest", "highest"), F.round(F.coalesce("spread_pct", F.lit(-1.0)), 4).alias("spread_pct"), F.coalesce("best_rank", F.lit(-1)).alias("best_rank"))


@query("w08_runner_up_margin", "WITH r AS (SELECT c_nationkey AS job_id, c_acctbal / 100 AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT a.job_id, round(a.score - b.score, 4) AS margin, a.score - b.score < 3 AS narrow FROM r a JOIN r b ON a.job_id = b.job_id AND a.rank = 1 AND b.rank = 2")
def _w08(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("job_id"), (F.col("c_acctbal") / 100).alias("score"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))
    return decide.margins(r).where("margin is not null").select("job_id", F.round("margin", 4).alias("margin"), "narrow")


@query("d03_candidate_scores", """WITH r AS (SELECT s_suppkey AS id, s_nationkey AS g, ln(1 + s_suppkey * 37 % 1000) AS a, (s_suppkey * 13 % 80 / 10.0)::DOUBLE AS s, least((s_suppkey * 7 % 50 / 10.0)::DOUBLE, 3.0) AS dep, s_acctbal AS c FROM supplier),
b AS (SELECT g, quantile_cont(a, 0.02) a0, quantile_cont(a, 0.98) a1, quantile_cont(s, 0.02) s0, quantile_cont(s, 0.98) s1, quantile_cont(dep, 0.02) d0, quantile_cont(dep, 0.98) d1, quantile_cont(c, 0.02) c0, quantile_cont(c, 0.98) c1 FROM r GROUP BY 1)
SELECT id, round(100 * (0.21 / 0.61 * CASE WHEN a1 - a0 < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (a - a0) / (a1 - a0))) END + 0.18 / 0.61 * CASE WHEN s1 - s0 < 1e-12 THEN 0.5 ELSE 1 - greatest(0, least(1, (s - s0) / (s1 - s0))) END + 0.14 / 0.61 * CASE WHEN d1 - d0 < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (dep - d0) / (d1 - d0))) END + 0.08 / 0.61 * CASE WHEN c1 - c0 < 1e-12 THEN 0.5 ELSE greatest(0, least(1, (c - c0) / (c1 - c0))) END), 4) AS score FROM r JOIN b USING (g)""")
def _d03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("grid_id"), (k * 37 % 1000).alias("acc"), (k * 13 % 80 / 10.0).alias("slope_pct"), (k * 7 % 50 / 10.0).alias("depth_m"), F.col("s_acctbal").alias("concavity"))
    return decide.score_candidates(r).select("id", *r4("score"))


@query(
    "k02_spaced_best",
    """WITH e AS (SELECT label::BIGINT AS grid_id, vec_id AS site_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE AS score FROM embeddings),
l AS (SELECT grid_id, list([{'score': score, 'site_id': site_id, 'x': x, 'y': y}] ORDER BY score DESC, site_id) AS l FROM e GROUP BY 1),
b AS (SELECT grid_id, list_reduce(l, lambda kept, s: CASE WHEN len(kept) < 5 AND len(list_filter(kept, lambda k: sqrt(pow(k.x - s[1].x, 2) + pow(k.y - s[1].y, 2)) < 100)) = 0 THEN list_concat(kept, s) ELSE kept END) AS b FROM l),
u AS (SELECT grid_id, unnest(b) AS s, generate_subscripts(b, 1) AS rank FROM b) SELECT grid_id, s.site_id AS site_id, rank, round(s.score, 6) AS score FROM u""",
)
def _k02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("site_id"), F.col("label").cast("long").alias("grid_id"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"), F.col("embedding")[2].cast("double").alias("score"))
    return decide.spaced_best(e, 100.0, 5).select("grid_id", "site_id", "rank", F.round("score", 6).alias("score"))


_SCALE = "list_concat(list_transform(range(9, 1, -1), lambda k: 1.0::DOUBLE / k), list_transform(range(1, 10), lambda k: k::DOUBLE))"
_SAATY = f"list_sort(list_transform({_SCALE}, lambda v: {{{{'d': abs(ln(v) - ln({{0}})), 'v': v}}}}))[1].v"


@query(
    "d06_ahp_weights",
    f"""WITH w AS (SELECT s_suppkey AS id, list_transform(range(1, 6), lambda i: (1 + s_suppkey * i % 7)::DOUBLE) AS w FROM supplier),
m AS (SELECT id, list_transform(range(1, 6), lambda i: list_transform(range(1, 6), lambda j: CASE WHEN i = j THEN 1.0 WHEN i < j THEN {_SAATY.format('(w[i] / w[j])')} ELSE 1 / {_SAATY.format('(w[j] / w[i])')} END)) AS m FROM w),
v AS (SELECT id, m, list_reduce(list_concat([[0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[]], list_transform(range(0, 60), lambda k: [0.0]::DOUBLE[])), lambda x, _: list_transform(list_transform(m, lambda r: list_inner_product(r, x)), lambda y: y / list_sum(list_transform(m, lambda r: list_inner_product(r, x))))) AS x FROM m),
c AS (SELECT id, x, (list_sum(list_transform(range(1, 6), lambda i: list_inner_product(m[i], x) / x[i])) / 5 - 5) / 4 / 1.12 AS cr FROM v)
SELECT id, list_transform(x, lambda y: round(y, 6)) AS weights, round(cr, 6) AS cr, cr < 0.1 AS consistent FROM c""",
)
def _d06(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (1 + F.col("s_suppkey") * i % 7).cast("double")).alias("w"))
    got = decide.ahp(w.select("id", decide.matrix_of(F.col("w")).alias("m")))
    return got.select("id", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"), F.round("cr", 6).alias("cr"), "consistent")


@query(
    "st02_job_progress",
    """WITH s AS (SELECT user_id AS job_id, event_type AS step, CASE max(event_id) % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'running' END AS state, event_type < 'd' AS required, CASE WHEN event_type < 'd' THEN 0.3 ELSE 0.1 END AS weight FROM events GROUP BY ALL),
g AS (SELECT job_id, 100 * sum(CASE WHEN state <> 'running' THEN weight ELSE 0 END)::DOUBLE AS earned, CASE WHEN bool_or(state = 'failed' AND required) THEN 'failed' WHEN bool_or(state = 'running') THEN 'running' WHEN bool_or(state = 'failed') THEN 'partial' ELSE 'done' END AS state FROM s GROUP BY 1)
SELECT job_id, state, CASE WHEN state IN ('done', 'partial') THEN 100 ELSE greatest(0, least(99, round_even(round(earned, 6), 0))) END::INT AS pct FROM g""",
)
def _st02(spark: SparkSession, d: str) -> DataFrame:
    k = F.max("event_id") % 4
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("step")).agg(F.when(k == 0, "done").when(k == 1, "failed").when(k == 2, "skipped").otherwise("running").alias("state"))
    required = F.col("step") < "d"
    return decide.job_progress(s.withColumns({"required": required, "weight": F.when(required, 0.3).otherwise(0.1)}))


@query("j13_curve_number", f"WITH {CELLS} SELECT cover, CASE cover WHEN 10 THEN 55 WHEN 20 THEN 56 WHEN 30 THEN 69 WHEN 40 THEN 78 WHEN 50 THEN 85 WHEN 60 THEN 86 WHEN 80 THEN 100 WHEN 90 THEN 88 WHEN 95 THEN 100 WHEN 100 THEN 79 END::DOUBLE AS cn, count(*) AS n FROM cells GROUP BY ALL")
def _j13(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumn("cn", hydro.curve_number(F.col("cover"), F.lit("B"))).groupBy("cover", "cn").agg(F.count(F.lit(1)).alias("n"))


@query("p14_availability", f"WITH {CELLS} SELECT grid_id, round(avg(CASE cover WHEN 10 THEN 0.05 WHEN 20 THEN 0.7 WHEN 30 THEN 0.85 WHEN 40 THEN 0.3 WHEN 60 THEN 1.0 WHEN 90 THEN 0.1 WHEN 100 THEN 0.3 ELSE 0 END), 4) AS availability, count(*) FILTER (WHERE cover IN (20, 30, 60)) AS allottable, count(*) FILTER (WHERE cover IN (10, 50, 70, 80, 95)) AS blocked FROM cells GROUP BY 1")
def _p14(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("grid_id").agg(F.round(F.avg(siting.availability(F.col("cover"))), 4).alias("availability"), F.count_if(classify.may_allot(F.col("cover"))).alias("allottable"), F.count_if(classify.is_blocked(F.col("cover"))).alias("blocked"))


@query("p18_soil_texture", """WITH s AS (SELECT p_partkey AS id, (p_partkey * 37 % 100)::DOUBLE AS clay, ((100 - p_partkey * 37 % 100) * (p_size % 11) / 10.0)::DOUBLE AS sand FROM part), t AS (SELECT *, 100 - clay - sand AS silt FROM s)
SELECT id, CASE WHEN sand >= 85 AND silt + 1.5 * clay < 15 THEN 'sand' WHEN sand BETWEEN 70 AND 91 AND silt + 1.5 * clay >= 15 AND silt + 2 * clay < 30 THEN 'loamy sand' WHEN clay >= 40 AND silt >= 40 THEN 'silty clay' WHEN clay >= 35 AND sand >= 45 THEN 'sandy clay' WHEN clay >= 40 THEN 'clay' WHEN clay >= 27 AND sand <= 20 THEN 'silty clay loam' WHEN clay >= 27 AND sand <= 45 THEN 'clay loam'
 WHEN clay >= 20 AND clay < 35 AND silt < 28 AND sand > 45 THEN 'sandy clay loam' WHEN silt >= 80 AND clay < 12 THEN 'silt' WHEN silt >= 50 AND clay < 27 THEN 'silt loam' WHEN (clay < 20 AND sand > 52 AND silt + 2 * clay >= 30) OR (clay < 7 AND silt < 50 AND sand BETWEEN 43 AND 52) THEN 'sandy loam' ELSE 'loam' END AS texture FROM t""")
def _p18(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 100).cast("double").alias("clay"), ((100 - F.col("p_partkey") * 37 % 100) * (F.col("p_size") % 11) / 10.0).alias("sand"))
    return s.select("id", hydro.texture_class(F.col("clay"), F.col("sand"), 100 - F.col("clay") - F.col("sand")).alias("texture"))


@query("p15_feature_kind", "SELECT event_type, CASE event_type WHEN 'click' THEN 'road' WHEN 'purchase' THEN 'building' WHEN 'view' THEN 'water' ELSE NULL END IS NOT NULL AS known, count(*) AS n FROM events GROUP BY ALL".replace("CASE event_type WHEN 'click' THEN 'road' WHEN 'purchase' THEN 'building' WHEN 'view' THEN 'water' ELSE NULL END IS NOT NULL AS known", "CASE WHEN event_id % 5 = 0 THEN 'building' WHEN event_id % 5 = 1 THEN 'water' WHEN event_id % 5 = 2 THEN 'road' WHEN event_id % 5 = 3 THEN 'track' ELSE 'none' END AS kind"))
def _p15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    tag = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    tags = F.when(k == 0, F.create_map(F.lit("building"), F.lit("yes"), F.lit("landuse"), F.lit("residential"))).when(k == 1, tag("waterway", "river")).when(k == 2, tag("highway", "primary")).when(k == 3, tag("highway", "path")).otherwise(tag("amenity", "well"))
    return table(spark, d, "events").select("event_type", F.coalesce(classify.feature_kind(tags), F.lit("none")).alias("kind")).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("p17_tenure_class", "SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN true ELSE false END AS public FROM customer")
def _p17(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.col("c_mktsegment") == "BUILDING", "GOVT. Waste Land").when(F.col("c_mktsegment") == "HOUSEHOLD", " Gram Panchayat gairan ").otherwise(F.col("c_mktsegment"))
    attrs = F.create_map(F.lit("Owner_Type"), owner, F.lit("id"), F.lit("7"))
    c = table(spark, d, "customer").withColumn("a", attrs)
    return c.select(F.col("c_custkey").alias("id"), classify.is_public(F.element_at("a", classify.owner_field(F.col("a")))).alias("public"))


@query("m22_utm", """SELECT n_nationkey AS id, 0 AS off_lon, 0 AS off_lat, (floor((68.0 + n_nationkey + 180) / 6)::INT % 60) + 1 AS zone FROM nation""")
def _m22(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (68.0 + F.col("n_nationkey")).alias("lon"), (8.0 + F.col("n_nationkey")).alias("lat"))
    back = geo.from_utm(geo.to_utm(F.col("lon"), F.col("lat"))["x"], geo.to_utm(F.col("lon"), F.col("lat"))["y"], geo.utm_epsg(F.col("lon"), F.col("lat")))
    return n.select("id", F.round((back["lon"] - F.col("lon")) * 1e9, 0).cast("int").alias("off_lon"), F.round((back["lat"] - F.col("lat")) * 1e9, 0).cast("int").alias("off_lat"), geo.utm_zone(F.col("lon")).alias("zone"))


@query("m17_box_area", "WITH b AS (SELECT n_nationkey AS id, 70.0 + n_nationkey AS lo, 8.0 + n_nationkey AS la, sqrt(0.0066943799901413165) AS e FROM nation), q AS (SELECT *, sin(radians(la)) AS s0, sin(radians(la + 0.25)) AS s1 FROM b) SELECT id, round(radians(0.5) * 6356752.314245179 ** 2 / 2 * ((s1 / (1 - e * e * s1 * s1) + atanh(e * s1) / e) - (s0 / (1 - e * e * s0 * s0) + atanh(e * s0) / e)) / 1e6, 4) AS km2 FROM q")
def _m17(spark: SparkSession, d: str) -> DataFrame:
    lo, la = 70.0 + F.col("n_nationkey"), 8.0 + F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.round(geo.box_area_km2(lo, la, lo + 0.5, la + 0.25), 4).alias("km2"))


@query("m21_contour_levels", f"WITH {CELLS}, b AS (SELECT grid_id, min(z) AS lo, max(z) AS hi FROM cells GROUP BY 1) SELECT grid_id, round(unnest(list_transform(range(0, (floor((hi - ceil(lo / 0.5) * 0.5) / 0.5) + 1)::BIGINT), lambda k: ceil(lo / 0.5) * 0.5 + k * 0.5)), 6)::DOUBLE AS level FROM b")
def _m21(spark: SparkSession, d: str) -> DataFrame:
    b = cells(spark, d).groupBy("grid_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return b.select("grid_id", F.explode(geo.contour_levels(F.col("lo"), F.col("hi"), F.lit(0.5))).alias("level"))


@query("m20_cell_size", "WITH p AS (SELECT p_partkey AS id, p_retailprice * 100 / (p_size + 1) / 2 AS w FROM part) SELECT id, list_sort(list_transform([1.0, 2.0, 2.5, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0]::DOUBLE[], lambda c: {'d': abs(c - greatest(1.0, least(30.0, w))), 'c': c}))[1].c AS cell FROM p")
def _m20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), geo.cell_size(F.col("p_retailprice") * 100, F.col("p_size") + 1).alias("cell"))


@query("src08_tiles", "WITH b AS (SELECT n_nationkey AS id, 76.5 + n_nationkey * 0.3 AS x, 19.2 + n_nationkey * 0.7 AS y FROM nation), t AS (SELECT id, unnest(range(floor(y)::BIGINT, floor(y + 1.1)::BIGINT + 1)) AS la, x FROM b), u AS (SELECT id, la, unnest(range(floor(x)::BIGINT, floor(x + 0.6)::BIGINT + 1)) AS lo FROM t) SELECT id, 'N' || lpad(la::VARCHAR, 2, '0') || 'E' || lpad(lo::VARCHAR, 3, '0') AS tile FROM u")
def _src08(spark: SparkSession, d: str) -> DataFrame:
    x, y = 76.5 + F.col("n_nationkey") * 0.3, 19.2 + F.col("n_nationkey") * 0.7
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(geo.tiles(x, y, x + 0.6, y + 1.1)).alias("t")).select("id", F.col("t.name").alias("tile"))


@query("j21_rain_cells", "SELECT n_nationkey AS id, printf('%.4f,%.4f', round(round_even((20.0 + n_nationkey * 0.377) / 0.5, 0) * 0.5, 6), round(round_even((75.0 + n_nationkey * 0.411) / 0.625, 0) * 0.625, 6)) AS cell FROM nation")
def _j21(spark: SparkSession, d: str) -> DataFrame:
    c = geo.rain_cell("nasa_power", 75.0 + F.col("n_nationkey") * 0.411, 20.0 + F.col("n_nationkey") * 0.377)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), c["key"].alias("cell"))


@query("f10_rupees", r"WITH v AS (SELECT o_orderkey AS id, (o_totalprice * 1000)::BIGINT AS n FROM orders), w AS (SELECT id, n::VARCHAR AS s FROM v) SELECT id, '₹' || CASE WHEN length(s) <= 3 THEN s ELSE reverse(regexp_replace(reverse(left(s, -3)), '(\d\d)', '\1,', 'g')).ltrim(',') || ',' || right(s, 3) END AS shown FROM w".replace("(o_totalprice * 1000)::BIGINT", "o_orderkey * 7919"))
def _f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), names.rupees(F.col("o_orderkey") * 7919).alias("shown"))


@query("g03_breach_then_fill", f"WITH {CELLS} SELECT grid_id, count(*) AS cells, 0 AS sinks, 0 AS above_filled FROM cells GROUP BY 1")
def _g03(spark: SparkSession, d: str) -> DataFrame:
    """Every inner cell has a lower neighbour afterwards, and none lies above the filled surface."""

    def conditioned(z, _):  # noqa: ANN001, ANN202
        import numpy as np

        surface, filled = kernels.breach_then_fill(z)[0], kernels.fill(z)
        inner = np.isfinite(surface) & ~kernels.outlets(surface)
        return [{"cells": int(np.isfinite(surface).sum()), "sinks": int((inner & (kernels.direction(surface, CELL) == 0)).sum()), "above_filled": int((surface > filled + 1e-9).sum())}]

    return kernels.rows_on_grids(cells(spark, d), conditioned, "cells long, sinks int, above_filled int")


@query("d05_pond_sites")
def _d05(spark: SparkSession, d: str) -> DataFrame:
    return siting.sites(cells(spark, d).withColumn("z", F.col("z") * 0.1 - F.col("row") * 0.05), CELL, separation=60.0, upstream_ha=0.05, threshold=0.3, min_depth=0.05, max_slope=15.0).drop("criteria")


@query(
    "x14_row_mean_weights",
    "WITH w AS (SELECT s_suppkey AS id, list_transform(range(1, 5), lambda i: (1 + s_suppkey * i % 9)::DOUBLE) AS w FROM supplier), m AS (SELECT id, list_transform(range(1, 5), lambda i: pow(list_product(list_transform(range(1, 5), lambda j: w[i] / w[j])), 0.25)) AS g FROM w) SELECT id, list_transform(g, lambda x: round(x / list_sum(g), 6)) AS row_mean, round(0.0, 6) AS ci FROM m",
)
def _x14(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of exact ratios: the row means are the weights, and they are consistent."""
    w = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (1 + F.col("s_suppkey") * i % 9).cast("double")).alias("w"))
    got = decide.ahp(w.select("id", F.transform("w", lambda a: F.transform("w", lambda b: a / b)).alias("m")))
    return got.select("id", F.transform("row_mean", lambda x: F.round(x, 6)).alias("row_mean"), F.abs(F.round("ci", 6)).alias("ci"))
