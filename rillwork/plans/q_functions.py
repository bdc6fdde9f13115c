"""Queries of Column functions over whole tables, with SQL twins: places, classes, hydrology, names and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import classify, geo, hydro, names
from rillwork.operators import decide, flow, pond, registers, runoff, siting, survey
from rillwork.plans.q_rain import r6
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


# places on a map

_GRID = "76.0 + o_orderkey % 9700 / 100.0 AS lon, o_orderkey % 171 / 2.0 - 43.0 AS lat"


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), (76.0 + k % 9700 / 100.0).alias("lon"), (k % 171 / 2.0 - 43.0).alias("lat"))


@query("p01_cell_centres", f"WITH {CELLS} SELECT grid_id, row, col, 500000.0 + grid_id * 1000 + 5 * (col + 0.5) AS x, 2200000.0 - 5 * (row + 0.5) AS y FROM cells")
def _p01(spark: SparkSession, d: str) -> DataFrame:
    t = F.array(F.lit(CELL), F.lit(0.0), 500000.0 + F.col("grid_id") * 1000, F.lit(0.0), F.lit(-CELL), F.lit(2200000.0))
    c = cells(spark, d).withColumn("p", geo.cell_centre(t, F.col("row"), F.col("col")))
    return c.select("grid_id", "row", "col", "p.x", "p.y")


@query(
    "p02_cells_of_points",
    "WITH p AS (SELECT o_orderkey AS id, o_orderkey * 37 % 5000 / 10.0 - 50 AS x, 100 - o_orderkey * 91 % 6000 / 10.0 AS y FROM orders), c AS (SELECT id, floor((y - 80.0) / -5)::INT AS r, floor((x - 20.0) / 5)::INT AS c FROM p) "
    "SELECT id, CASE WHEN r >= 0 AND r < 64 AND c >= 0 AND c < 48 THEN r ELSE -1 END AS row, CASE WHEN r >= 0 AND r < 64 AND c >= 0 AND c < 48 THEN c ELSE -1 END AS col FROM c",
)
def _p02(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.array(*[F.lit(v) for v in (5.0, 0.0, 20.0, 0.0, -5.0, 80.0)])
    rc = geo.cell_of(t, k * 37 % 5000 / 10.0 - 50, 100 - k * 91 % 6000 / 10.0, F.lit(64), F.lit(48))
    return table(spark, d, "orders").select(k.alias("id"), F.coalesce(rc["row"], F.lit(-1)).alias("row"), F.coalesce(rc["col"], F.lit(-1)).alias("col"))


@query("p05_in_india", f"SELECT o_orderkey AS id, lon BETWEEN 68 AND 97.5 AND lat BETWEEN 6 AND 37.5 AS inside FROM (SELECT o_orderkey, {_GRID} FROM orders)")
def _p05(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("id", geo.in_india(F.col("lon"), F.col("lat")).alias("inside"))


@query(
    "p06_projected_systems",
    f"WITH p AS (SELECT o_orderkey AS id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INT % 60 + 1)::INT AS epsg FROM (SELECT o_orderkey, {_GRID} FROM orders)) "
    "SELECT id, epsg, true AS projected, (epsg + id % 3 * 40) BETWEEN 32601 AND 32660 OR (epsg + id % 3 * 40) BETWEEN 32701 AND 32760 AS moved FROM p",
)
def _p06(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat")))
    return p.select("id", "epsg", geo.is_projected(F.col("epsg")).alias("projected"), geo.is_projected(F.col("epsg") + (F.col("id") % 3 * 40)).alias("moved"))


@query("x02_site_distances", f"WITH p AS (SELECT o_orderkey AS id, {_GRID} FROM orders) SELECT id, round(sqrt(pow(0.01 * 111320.0 * cos(radians((lat + lat + 0.02) / 2)), 2) + pow(0.02 * 111320.0, 2)), 3) AS m FROM p")
def _x02(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("id", F.round(geo.distance_m(F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.02), 3).alias("m"))


@query("x04_boxes_around_points", f"WITH p AS (SELECT o_orderkey AS id, {_GRID} FROM orders) SELECT id, round(lon - 500 / (111320.0 * cos(radians(lat))), 9) AS west, round(lat - 500 / 111320.0, 9) AS south, round(lon + 500 / (111320.0 * cos(radians(lat))), 9) AS east, round(lat + 500 / 111320.0, 9) AS north FROM p")
def _x04(spark: SparkSession, d: str) -> DataFrame:
    b = _places(spark, d).withColumn("b", geo.box_around(F.col("lon"), F.col("lat"), F.lit(500.0)))
    return b.select("id", *[F.round(f"b.{c}", 9).alias(n) for c, n in (("min_lon", "west"), ("min_lat", "south"), ("max_lon", "east"), ("max_lat", "north"))])


@query(
    "snk04_pond_rectangles",
    f"WITH p AS (SELECT o_orderkey AS id, {_GRID}, 20.0 + o_orderkey % 30 AS l, 10.0 + o_orderkey % 20 AS w FROM orders), q AS (SELECT id, lon, lat, l / 2 / (111320.0 * greatest(cos(radians(lat)), 1e-6)) AS dx, w / 2 / 111320.0 AS dy FROM p) "
    "SELECT id, [round(lon - dx, 9), round(lat - dy, 9), round(lon + dx, 9), round(lat - dy, 9), round(lon + dx, 9), round(lat + dy, 9), round(lon - dx, 9), round(lat + dy, 9), round(lon - dx, 9), round(lat - dy, 9)] AS ring FROM q",
)
def _snk04(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    ring = geo.pond_rectangle(F.col("lon"), F.col("lat"), 20.0 + k % 30, 10.0 + k % 20)
    return _places(spark, d).select("id", F.transform(F.flatten(ring), lambda v: F.round(v, 9)).alias("ring"))


@query("m16_water_depth_to_volume", "SELECT o_orderkey AS id, round(o_totalprice / 1000 * (o_orderkey % 977 + 1), 6) AS m3 FROM orders")
def _m16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(geo.mm_to_m3(F.col("o_totalprice"), F.col("o_orderkey") % 977 + 1), 6).alias("m3"))


@query("m25_display_intervals", "WITH p AS (SELECT p_partkey AS id, p_size * (p_partkey % 13 + 0.7) AS relief FROM part) SELECT id, coalesce(list_filter({steps}, lambda x: relief / x <= 40)[1], {last}) AS step FROM p".format(steps=str([float(x) for x in geo.DISPLAY_INTERVALS]) + "::DOUBLE[]", last=f"{float(geo.DISPLAY_INTERVALS[-1])}::DOUBLE"))
def _m25(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * (F.col("p_partkey") % 13 + 0.7)).alias("relief"))
    return p.select("id", geo.display_interval(F.col("relief")).cast("double").alias("step"))


@query("x30_content_hashes", "SELECT o_orderkey AS id, sha256(concat_ws('|', 'v3', o_orderkey::VARCHAR, o_orderstatus, (o_orderkey % 7)::VARCHAR)) AS key FROM orders")
def _x30(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), geo.cache_key(F.lit("v3"), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderkey") % 7).alias("key"))


@query(
    "x03_regional_tiles",
    """WITH s AS (SELECT s_suppkey AS id, 70.23 + s_suppkey % 50 / 10.0 AS x, 12.37 + s_suppkey % 31 / 10.0 AS y, 0.31 + s_suppkey % 7 / 5.0 AS r FROM supplier),
t AS (SELECT id, x, y, r, unnest(range(70, 78)) AS lo, la FROM (SELECT *, unnest(range(12, 18)) AS la FROM s))
SELECT id, count(*) AS tiles, sum(lo * 100 + la)::BIGINT AS names FROM t
WHERE len(list_filter([[x - r, y], [x, y - r], [x + r, y], [x, y + r]], lambda p: p[1] BETWEEN lo AND lo + 1 AND p[2] BETWEEN la AND la + 1)) > 0
   OR len(list_filter([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.5, 0.5]], lambda c: abs(lo + c[1] - x) + abs(la + c[2] - y) < r)) > 0 GROUP BY 1""",
)
def _x03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y, r = 70.23 + k % 50 / 10.0, 12.37 + k % 31 / 10.0, 0.31 + k % 7 / 5.0
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(at(x - r, y), at(x, y - r), at(x + r, y), at(x, y + r))
    t = table(spark, d, "supplier").select(k.alias("id"), F.explode(survey.regional_tiles((70.0, 12.0, 77.0, 17.0), ring)).alias("t"))
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("tiles"), F.sum(F.col("t.lon") * 100 + F.col("t.lat")).cast("long").alias("names"))


@query("p03_grid_corners", f"WITH {CELLS} SELECT grid_id, true AS holds, count(*) AS cells FROM cells GROUP BY 1")
def _p03(spark: SparkSession, d: str) -> DataFrame:
    """The four corners' box holds the middle of each grid and is as wide as the grid, by a round trip."""
    c = cells(spark, d)
    g = c.groupBy("grid_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count(F.lit(1)).alias("cells"))
    g = g.withColumns({"transform": F.array(F.lit(CELL), F.lit(0.0), 400000.0 + F.col("grid_id") * 500, F.lit(0.0), F.lit(-CELL), F.lit(2300000.0)), "epsg": F.lit(32643)})
    b = survey.corners(g).join(g, "grid_id")
    mid = geo.cell_centre(F.col("transform"), F.col("n_rows") / 2, F.col("n_cols") / 2)
    b = b.withColumn("m", geo.from_utm(mid["x"], mid["y"], F.col("epsg")))
    wide = geo.distance_m(F.col("west"), F.col("south"), F.col("east"), F.col("south"))
    holds = F.col("m.lon").between(F.col("west"), F.col("east")) & F.col("m.lat").between(F.col("south"), F.col("north")) & (F.abs(wide / (F.col("n_cols") * CELL) - 1) < 0.05)
    return b.select("grid_id", holds.alias("holds"), "cells")


# classes

@query(
    "p16_water_kinds",
    "SELECT event_id AS id, CASE WHEN event_id % 5 IN (0, 2) OR event_id % 7 IN (0, 3) THEN 'major' WHEN event_id % 5 IN (1, 3) OR event_id % 7 = 1 THEN 'minor' WHEN event_id % 5 = 4 AND event_id % 7 = 6 AND event_id % 11 >= 5 AND event_id % 13 * 3000 >= 20000 THEN 'major' ELSE 'standing' END AS kind FROM events",
)
def _p16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    way = F.element_at(F.array(*[F.lit(x) for x in ("River", "stream", "canal", "ditch", "")]), (k % 5 + 1).cast("int"))
    water = F.element_at(F.array(*[F.lit(x) for x in ("oxbow", "drain", "lake", "riverbank", "pond", "basin", "")]), (k % 7 + 1).cast("int"))
    tags = F.create_map(F.lit("waterway"), way, F.lit("water"), water)
    return table(spark, d, "events").select(k.alias("id"), classify.water_kind(tags, (k % 11).cast("double"), (k % 13 * 3000).cast("double")).alias("kind"))


@query("p26_exclusion_confidence", "SELECT event_type, CASE WHEN event_id % 4 = 3 THEN 'high' WHEN event_id % 4 = 0 THEN 'terrain-only' ELSE 'partial' END AS confidence, count(*) AS n FROM events GROUP BY ALL")
def _p26(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    sources = F.filter(F.array(F.lit("dem"), F.when(k >= 2, "osm"), F.when(k % 2 == 1, "land_cover")), lambda x: x.isNotNull())
    return table(spark, d, "events").select("event_type", classify.exclusion_confidence(sources).alias("confidence")).groupBy("event_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("p13_cropland_opt_in", f"WITH {CELLS} SELECT grid_id, count(*) FILTER (WHERE cover IN (20, 30, 60)) AS plain, count(*) FILTER (WHERE cover IN (20, 30, 40, 60)) AS with_cropland, count(*) FILTER (WHERE cover IN (10, 50, 70, 80, 95)) AS blocked FROM cells GROUP BY 1")
def _p13(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cover")
    return cells(spark, d).groupBy("grid_id").agg(F.count_if(classify.may_allot(c)).alias("plain"), F.count_if(classify.may_allot(c, True)).alias("with_cropland"), F.count_if(classify.is_blocked(c)).alias("blocked"))


@query("f13_level_labels", "SELECT c_custkey AS id, c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 AS district, true AS other FROM customer")
def _f13(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("c_mktsegment") == "BUILDING", " Dis-trict ").when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), classify.same_level("ADM2", label).alias("district"), classify.same_level("ADM9", label).alias("other"))


@query("p19_regions", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'deccan' WHEN 1 THEN 'western_ghats' WHEN 2 THEN 'gangetic' WHEN 3 THEN 'gangetic' ELSE 'general' END AS region FROM customer")
def _p19(spark: SparkSession, d: str) -> DataFrame:
    names_ = F.array(*[F.lit(x) for x in (" MAHARASHTRA ", "North Goa", "Uttar Pradesh", "delhi (NCT)", "Rajasthan", "")])
    state = F.when(F.col("c_custkey") % 6 == 5, None).otherwise(F.element_at(names_, (F.col("c_custkey") % 6 + 1).cast("int")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), runoff.region(state).alias("region"))


# hydrology

@query("m12_barlow", "SELECT p_partkey AS id, round(p_retailprice * CASE p_partkey % 5 WHEN 0 THEN 0.07 WHEN 1 THEN 0.12 WHEN 2 THEN 0.16 WHEN 3 THEN 0.36 END, 6) AS mm FROM part WHERE p_partkey % 5 < 4 UNION ALL SELECT p_partkey, -1.0 FROM part WHERE p_partkey % 5 = 4")
def _m12(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in (*hydro.BARLOW_K, "unknown")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(F.coalesce(hydro.barlow_mm(F.col("p_retailprice"), kind), F.lit(-1.0)), 6).alias("mm"))


@query("m11_khosla", "WITH m AS (SELECT p_partkey AS id, unnest(range(1, 13)) AS m, p_size FROM part) SELECT id, round(sum(greatest(0.0, (id * m % 331)::DOUBLE - 0.48 * greatest((m * 5 - 20 + p_size % 9)::DOUBLE, 0.0))), 6) AS mm FROM m GROUP BY 1")
def _m11(spark: SparkSession, d: str) -> DataFrame:
    months = F.sequence(F.lit(1), F.lit(12))
    rain = F.transform(months, lambda m: (F.col("p_partkey") * m % 331).cast("double"))
    temp = F.transform(months, lambda m: (m * 5 - 20 + F.col("p_size") % 9).cast("double"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(hydro.khosla_mm(rain, temp), 6).alias("mm"))


@query("m13_rational_peak", "SELECT p_partkey AS id, round((0.2 + p_partkey % 7 / 10.0) * p_size * p_retailprice / 360.0, 6) AS m3s FROM part")
def _m13(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(hydro.rational_peak_m3s(F.col("p_retailprice"), F.col("p_size"), 0.2 + F.col("p_partkey") % 7 / 10.0), 6).alias("m3s"))


@query("d22_capture_and_cost", "SELECT p_partkey AS id, round(CASE WHEN p_partkey % 9 > 0 THEN 100 * p_retailprice / (p_partkey % 9 * 1000) END, 6) AS capture_pct, round(CASE WHEN p_size > 5 THEN p_retailprice * 130 / p_size END, 6) AS cost_per_m3 FROM part")
def _d22(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    live = F.when(F.col("p_size") > 5, F.col("p_size"))
    return p.select(F.col("p_partkey").alias("id"), F.round(pond.capture_pct(F.col("p_retailprice"), F.col("p_partkey") % 9 * 1000), 6).alias("capture_pct"), F.round(pond.cost_per_m3(F.col("p_retailprice") * 130, live), 6).alias("cost_per_m3"))


@query("p11_least_cells", f"WITH {CELLS} SELECT grid_id, count(*) FILTER (WHERE row * 64 + col >= 400) AS feasible, count(*) FILTER (WHERE row * 64 + col >= 20) AS stream FROM cells GROUP BY 1")
def _p11(spark: SparkSession, d: str) -> DataFrame:
    acc = F.col("row") * 64 + F.col("col")
    return cells(spark, d).groupBy("grid_id").agg(F.count_if(acc >= siting.least_cells(1.0, CELL)).alias("feasible"), F.count_if(acc >= siting.least_cells(0.05, CELL)).alias("stream"))


@query("x21_fractional_cells", f"WITH {CELLS} SELECT grid_id, row, col, 1000 + 5 * (col + 0.25 + 0.5) AS x, 900 - 5 * (row + 0.75 + 0.5) AS y FROM cells")
def _x21(spark: SparkSession, d: str) -> DataFrame:
    t = F.array(*[F.lit(v) for v in (5.0, 0.0, 1000.0, 0.0, -5.0, 900.0)])
    return cells(spark, d).select("grid_id", "row", "col", geo.cell_centre(t, F.col("row") + 0.75, F.col("col") + 0.25).alias("p")).select("grid_id", "row", "col", "p.x", "p.y")


# names

@query("f11_census_codes", "SELECT c_custkey AS id, c_custkey::VARCHAR AS code, (c_custkey % 10)::VARCHAR AS bare FROM customer")
def _f11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return c.select(k.alias("id"), names.census_code(F.concat_ws("-", F.lit("11"), F.col("c_nationkey").cast("string"), k.cast("string"))).alias("code"), names.census_code((k % 10).cast("string")).alias("bare"))


@query("f12_unquoted", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _f12(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), names.unquoted(F.concat(F.lit(' "'), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, '" ').otherwise('"'))).alias("name"))


_DEVA = {"पुणे": "pune", "नागपुर": "nagpur", "रामपुर": "rampur", "कानपुर": "kanpur"}


@query("f03_folded_scripts", f"SELECT c_custkey AS id, {list(_DEVA.values())}[c_custkey % 4 + 1] AS folded, {list(_DEVA.values())}[c_custkey % 4 + 1] AS latin FROM customer")
def _f03(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("c_custkey") % 4 + 1).cast("int")
    word, latin = (F.element_at(F.array(*[F.lit(x) for x in v]), at) for v in (_DEVA, ("Puṇe", "Nāgpur", "Rāmpur", "Kānpur")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.folded(word).alias("folded"), names.folded(latin).alias("latin"))


# decisions and reports

@query("d13_tiers", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN 'full' WHEN 0 THEN 'terrain_only' ELSE 'no_soil_lulc' END AS tier, CASE WHEN p_partkey % 4 <> 3 THEN 'partial' ELSE 'done' END AS state, CASE WHEN p_partkey % 2 = 1 THEN 'D' ELSE 'C' END AS soil, p_partkey % 2 = 1 AS measured FROM part")
def _d13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tier = decide.tier(k % 4 >= 2, k % 2 == 1)
    soil = survey.soil_or_assumed(F.when(k % 2 == 1, "D"))
    return table(spark, d, "part").select(k.alias("id"), tier.alias("tier"), survey.degraded(F.lit("done"), tier).alias("state"), soil["group"].alias("soil"), soil["measured"].alias("measured"))


@query(
    "d15_site_summaries",
    "SELECT p_partkey AS id, p_partkey % 3 > 0 AS available, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 ELSE -1 END AS rank, round(CASE WHEN p_partkey % 3 > 0 THEN least(p_retailprice, p_size * 40.0) ELSE -1 END, 4) AS water_m3, CASE WHEN p_partkey % 3 = 0 THEN 'none' WHEN p_size * 40.0 < p_retailprice THEN 'inflow' ELSE 'storage' END AS limited_by FROM part",
)
def _d15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = survey.site_summary(F.when(k % 3 > 0, k % 3), F.lit(70.0), F.lit(76.1), F.lit(18.2), F.col("p_size"), pond.expected_water(F.col("p_retailprice"), F.col("p_size") * 40.0))
    x = table(spark, d, "part").select(k.alias("id"), s.alias("s"))
    return x.select("id", F.coalesce("s.available", F.lit(False)).alias("available"), F.coalesce("s.site_rank", F.lit(-1)).alias("rank"), F.round(F.coalesce("s.water_m3", F.lit(-1.0)), 4).alias("water_m3"), F.coalesce("s.limited_by", F.lit("none")).alias("limited_by"))


@query("d17_unavailable_reasons", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'no pond could be sized' WHEN p_partkey % 3 = 0 THEN 'no rainfall' WHEN p_partkey % 5 = 0 THEN 'no evapotranspiration' ELSE '' END AS reason FROM part")
def _d17(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.coalesce(survey.unavailable_reason(k % 2 > 0, k % 3 > 0, k % 5 > 0), F.lit("")).alias("reason"))


@query(
    "d19_explanations",
    """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS rank, p_size * 1.7 AS score, p_partkey % 3 AS k, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 7 * 1.0 END AS margin, CASE WHEN p_partkey % 2 = 0 THEN 'inflow' END AS lim FROM part)
SELECT id, array_to_string(list_filter(['Rank ' || rank || ', score ' || printf('%.1f', score), CASE k WHEN 0 THEN 'it stands in a natural depression' WHEN 1 THEN 'it stands on a drainage line' END, 'chiefly for plan concavity and slope',
 CASE WHEN margin < 3 THEN 'the next site is close behind' END, 'its water is limited by the ' || lim], lambda x: x IS NOT NULL), '; ') || '.' AS text FROM p""",
)
def _d19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    criteria = F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(v).alias("contribution")) for n, v in (("slope", 0.2), ("flow_accumulation", 0.1), ("plan_concavity", 0.3), ("depression_depth", 0.2))])
    kind = F.when(k % 3 == 0, "natural_depression").when(k % 3 == 1, "channel_position").otherwise("other")
    text = decide.explanation(k % 5 + 1, kind, F.col("p_size") * 1.7, decide.top_criteria(criteria), F.when(k % 4 == 0, k % 7 * 1.0), F.when(k % 2 == 0, "inflow"))
    return table(spark, d, "part").select(k.alias("id"), text.alias("text"))


@query(
    "x24_agreement_notes",
    "WITH p AS (SELECT p_partkey AS id, p_size * 10.0 AS v, 100.0 + p_partkey % 50 AS lo, 300.0 AS hi FROM part) SELECT id, CASE WHEN id % 7 = 0 THEN 'no formula to compare with' WHEN v BETWEEN lo * 0.75 AND hi * 1.25 THEN 'within' WHEN v < lo THEN 'below' ELSE 'above' END || CASE WHEN id % 7 = 0 THEN '' ELSE printf(' the formulas'' range of %.0f to %.0f mm', lo, hi) END AS note FROM p",
)
def _x24(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    known = lambda c: F.when(k % 7 > 0, c)
    v, lo, hi = F.col("p_size") * 10.0, known(100.0 + k % 50), known(F.lit(300.0))
    return table(spark, d, "part").select(k.alias("id"), survey.agreement_note(v, lo, hi, v.between(lo * 0.75, hi * 1.25)).alias("note"))


@query("x27_search_hits", "SELECT c_custkey AS id, 'Village ' || (c_custkey % 9) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Haveli, Pune' ELSE 'Pune' END AS hierarchy, c_custkey % 5 = 0 AS ambiguous FROM customer")
def _x27(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    hit = survey.hit_row(F.concat(F.lit("VILLAGE "), (k % 9).cast("string")), F.array(F.when(k % 2 == 0, "haveli").otherwise("pune"), F.lit(" PUNE ")), k % 5 == 0)
    return table(spark, d, "customer").select(k.alias("id"), hit.alias("h")).select("id", "h.name", "h.hierarchy", "h.ambiguous")


@query("m24_saaty", "WITH p AS (SELECT p_partkey AS id, p_retailprice / (p_size * 40.0) AS r FROM part), s AS (SELECT unnest(list_concat(list_transform(range(9, 1, -1), lambda k: 1.0::DOUBLE / k), list_transform(range(1, 10), lambda k: k::DOUBLE))) AS v), n AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY abs(ln(v) - ln(r)), v) AS k FROM p CROSS JOIN s) SELECT id, round(v, 9) AS v FROM n WHERE k = 1")
def _m24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(decide.saaty(F.col("p_retailprice") / (F.col("p_size") * 40.0)), 9).alias("v"))


@query("d02_cell_scores", f"WITH {CELLS} SELECT grid_id, row, col, round(CASE WHEN cover IN (20, 30, 60) THEN (0.21 * row / 64 + 0.18 * col / 64) / 0.39 ELSE 0 END, 9) AS score FROM cells")
def _d02(spark: SparkSession, d: str) -> DataFrame:
    layers = {"flow_accumulation": F.col("row") / 64, "slope": F.col("col") / 64}
    return cells(spark, d).select("grid_id", "row", "col", F.round(decide.weighted_score(layers, classify.may_allot(F.col("cover"))), 9).alias("score"))


@query("d01_weights_override", f"WITH {CELLS} SELECT grid_id, round(sum((3.0 * row / 64 + 1.0 * col / 64) / 4), 6) AS total FROM cells GROUP BY 1")
def _d01(spark: SparkSession, d: str) -> DataFrame:
    layers = {"flow_accumulation": F.col("row") / 64, "slope": F.col("col") / 64}
    return cells(spark, d).groupBy("grid_id").agg(F.round(F.sum(decide.weighted_score(layers, F.lit(True), {"flow_accumulation": 3, "slope": 1, "soil_runoff_potential": 9})), 6).alias("total"))


@query(
    "d18_site_wins",
    """WITH s AS (SELECT c_nationkey AS job_id, c_custkey AS rank, unnest([{'m': 'suitability_score', 'up': true, 'v': c_acctbal}, {'m': 'estimated_cost_inr', 'up': false, 'v': (c_custkey * 7919 % 1000 + 1)::DOUBLE}]) AS x FROM customer),
g AS (SELECT job_id, x.m AS m, count(*) AS n, min(x.v) AS lo, max(x.v) AS hi, arg_min(rank, (CASE WHEN x.up THEN -x.v ELSE x.v END) * 1e6 + rank / 1e6) AS best FROM s GROUP BY ALL)
SELECT job_id, best AS rank, count(*) AS wins FROM g WHERE NOT (n > 1 AND (hi - lo < 1e-9 OR coalesce(CASE WHEN lo > 0 THEN 100 * (hi - lo) / lo END < 1, false))) GROUP BY ALL""",
)
def _d18(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_custkey").alias("rank"), F.col("c_acctbal").alias("suitability_score"), (F.col("c_custkey") * 7919 % 1000 + 1).alias("estimated_cost_inr"))
    return decide.wins(decide.compare(c))


@query("p10_buildable", f"WITH {CELLS} SELECT grid_id, count(*) FILTER (WHERE b) AS buildable, count(*) FILTER (WHERE b AND row * col >= 400) AS feasible FROM (SELECT *, row BETWEEN 3 AND max(row) OVER (PARTITION BY grid_id) - 3 AND col BETWEEN 3 AND 60 AND z <= 52 AND cover NOT IN (50, 70, 80, 95) AS b FROM cells) GROUP BY 1")
def _p10(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumns({"slope_pct": F.col("z"), "acc": F.col("row") * F.col("col"), "availability": siting.availability(F.col("cover"))})
    m = siting.masks(c, CELL, max_slope=52.0, upstream_ha=1.0)
    return m.groupBy("grid_id").agg(F.count_if("buildable").alias("buildable"), F.count_if("feasible").alias("feasible"))


@query("x18_grid_facts", f"WITH {CELLS}, h AS (SELECT * REPLACE (CASE WHEN cover = 80 THEN NULL ELSE z END AS z) FROM cells) SELECT grid_id, count(*) AS cells, count(z) AS valid, min(z) AS lowest, max(z) AS highest, 64 AS n_rows, 64 AS n_cols, round(100.0 * count(z) / count(*), 6) AS hull_pct, round(max(z) - min(z), 6) AS relief FROM h GROUP BY 1 HAVING count(*) = 4096 UNION ALL SELECT grid_id, count(*), count(z), min(z), max(z), (max(row) + 1)::INT, (max(col) + 1)::INT, round(100.0 * count(z) / count(*), 6), round(max(z) - min(z), 6) FROM h GROUP BY 1 HAVING count(*) <> 4096")
def _x18(spark: SparkSession, d: str) -> DataFrame:
    c = survey.coverage(cells(spark, d).withColumn("z", F.when(F.col("cover") == 80, None).otherwise(F.col("z"))))
    return c.select("grid_id", "cells", "valid", "lowest", "highest", "n_rows", "n_cols", *r6("hull_pct", "relief"))


@query("g22_dilation_by_one", f"WITH {CELLS}, m AS (SELECT grid_id, row, col FROM cells WHERE z > 52), o AS (SELECT r, c FROM range(-1, 2) a(r), range(-1, 2) b(c)) SELECT DISTINCT grid_id, (row + r)::INT AS row, (col + c)::INT AS col FROM m CROSS JOIN o")
def _g22(spark: SparkSession, d: str) -> DataFrame:
    return flow.dilated(cells(spark, d).where("z > 52"), 2**0.5)


@query("a16_stream_report", "WITH r AS (SELECT p_size % 4 + 1 AS o, p_retailprice AS l FROM part), t AS (SELECT sum(l) / 1000 / 25.0 AS density FROM r) SELECT o AS \"order\", count(*) AS reaches, round(sum(l), 4) AS length_m, round(density, 6) AS density FROM r CROSS JOIN t GROUP BY o, density")
def _a16(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select((F.col("p_size") % 4 + 1).alias("order"), F.col("p_retailprice").alias("length_m"))
    return flow.stream_report(r, 25e6).select("order", "reaches", F.round("length_m", 4).alias("length_m"), *r6("density"))


@query("f09_titles", "SELECT c_custkey AS id, upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] AS title, 'Nagpur' AS marked FROM customer")
def _f09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.titled(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("title"), names.titled(F.lit("nāgpur")).alias("marked"))


@query(
    "k05_datum_operations",
    """WITH o AS (SELECT l_suppkey AS source, l_orderkey * 10 + l_linenumber AS operation, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS tier, l_quantity > 25 OR l_suppkey % 10 = 0 AS ballpark, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS acc FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, acc ASC NULLS LAST, operation) AS n FROM o WHERE NOT ballpark) SELECT s.source, coalesce(operation, -1) AS operation FROM (SELECT DISTINCT source FROM o) s LEFT JOIN k ON k.source = s.source AND n = 1""",
)
def _k05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("operation"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("tier"),
        ((F.col("l_quantity") > 25) | (F.col("l_suppkey") % 10 == 0)).alias("ballpark"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("accuracy_m"),
    )
    return registers.datum_operations(o).select("source", F.coalesce("operation", F.lit(-1)).alias("operation"))


@query(
    "x35_weights_of_requests",
    """SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 1 THEN 'unknown: colour' WHEN 2 THEN 'negative' WHEN 3 THEN 'all zero' WHEN 4 THEN 'not numbers by criterion' ELSE '' END AS problem,
round(CASE s_suppkey % 6 WHEN 0 THEN 0.21 / 0.39 WHEN 5 THEN (s_suppkey % 9 + 1) / (s_suppkey % 9 + 2.0) ELSE -1 END, 9) AS flow FROM supplier""",
)
def _x35(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = (k % 9 + 1).cast("string")
    text = F.when(k % 6 == 1, '{"flow_accumulation": 1, "colour": 2}').when(k % 6 == 2, '{"slope": -1}').when(k % 6 == 3, '{"slope": 0}').when(k % 6 == 4, "[1, 2]").when(k % 6 == 5, F.concat(F.lit('{"slope": 1, "flow_accumulation": '), n, F.lit("}")))
    w = decide.weights_from(table(spark, d, "supplier").select(k.alias("id"), text.alias("weights")), ("flow_accumulation", "slope"))
    return w.select("id", F.coalesce("problem", F.lit("")).alias("problem"), F.round(F.coalesce(F.try_element_at("weights", F.lit("flow_accumulation")), F.lit(-1.0)), 9).alias("flow"))
