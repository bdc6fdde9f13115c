"""Queries of vetoes, land, tenure and grids' kernels, with SQL twins by set operations and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import geo
from rillwork.operators import analysis, flow, kernels, land, streams, survey, terrain
from rillwork.plans.q_rain import r6
from rillwork.plans.q_terrain import _OFF, ACC, NEAR, WALK
from rillwork.plans.views import CELLS, cells, table
from rillwork.sources import sinks

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


# features of each grid: kind, corners, closed (rectangles and lines along the axes, so that distances have a plain form)
_SHAPES = (
    ("major", "[10.0, 250.0, 250.0]", "[60.0 + grid_id % 5 * 20, 60.0 + grid_id % 5 * 20, 300.0]", False),
    ("building", "[100.0 + grid_id % 3 * 7, 122.0 + grid_id % 3 * 7, 122.0 + grid_id % 3 * 7, 100.0 + grid_id % 3 * 7]", "[200.0, 200.0, 213.0, 213.0]", True),
    ("road", "[0.0, 320.0]", "[33.0, 33.0]", False),
    ("standing", "[40.0, 70.0, 70.0, 40.0]", "[120.0, 120.0, 150.0, 150.0]", True),
    ("track", "[5.0, 300.0]", "[280.0, 280.0]", False),
)


def _features(c: DataFrame) -> DataFrame:
    g = c.select("grid_id").distinct()
    arr = lambda s: F.array(*[F.expr(f"CAST({x.strip()} AS DOUBLE)") for x in s.strip("[]").split(",")])
    shapes = F.array(*[F.struct(F.lit(k).alias("kind"), arr(x).alias("x"), arr(y).alias("y"), F.lit(closed).alias("closed")) for k, x, y, closed in _SHAPES])
    return g.select("grid_id", F.explode(shapes).alias("f")).select("grid_id", "f.*")


# the same as boxes: a line's segments, and a rectangle as a whole
BOXES = """g AS (SELECT DISTINCT grid_id FROM cells), boxes AS (
SELECT grid_id, 'major' AS kind, 50.0 AS reach, 10.0 AS x0, 60.0 + grid_id % 5 * 20 AS y0, 250.0 AS x1, 60.0 + grid_id % 5 * 20 AS y1 FROM g
UNION ALL SELECT grid_id, 'major', 50.0, 250.0, 60.0 + grid_id % 5 * 20, 250.0, 300.0 FROM g
UNION ALL SELECT grid_id, 'building', 50.0, 100.0 + grid_id % 3 * 7, 200.0, 122.0 + grid_id % 3 * 7, 213.0 FROM g
UNION ALL SELECT grid_id, 'road', 20.0, 0.0, 33.0, 320.0, 33.0 FROM g
UNION ALL SELECT grid_id, 'standing', 0.0, 40.0, 120.0, 70.0, 150.0 FROM g),
grown AS (SELECT DISTINCT b.grid_id, r::INT AS row, c::INT AS col, kind FROM boxes b, range(0, 90) q(r), range(0, 90) w(c)
 WHERE sqrt(pow(greatest(x0 - (c + 1) * 5, c * 5 - x1, 0), 2) + pow(greatest(y0 - (r + 1) * 5, r * 5 - y1, 0), 2)) <= reach + 1e-9)"""


@query("j19_burned_features", f"WITH {CELLS}, {BOXES} SELECT grid_id, row, col, kind FROM grown")
def _j19(spark: SparkSession, d: str) -> DataFrame:
    return land.burned(_features(cells(spark, d)).where("kind <> 'track'"), CELL, land.SITE_BUFFERS)


VETOES = f"""{CELLS}, {BOXES}, a AS (SELECT *, row * col * 500 AS acc FROM cells),
wet AS (SELECT DISTINCT grid_id, row + r AS row, col + c AS col, 'land_cover_water' AS kind FROM (SELECT * FROM a WHERE cover IN (80, 90, 95)) x, range(-4, 5) q(r), range(-4, 5) w(c) WHERE r * r + c * c <= 16),
why AS (SELECT grid_id, row, col, kind FROM grown UNION SELECT grid_id, row::INT, col::INT, kind FROM wet
 UNION SELECT grid_id, row, col, 'built_up' FROM a WHERE cover = 50 UNION SELECT grid_id, row, col, 'large_river' FROM a WHERE acc * 25 / 10000 > 2000),
v AS (SELECT a.grid_id, a.row, a.col, list(kind ORDER BY kind) FILTER (WHERE kind IS NOT NULL) AS reasons FROM a LEFT JOIN why USING (grid_id, row, col) GROUP BY ALL)"""


def _vetoed(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("acc", F.col("row") * F.col("col") * 500)
    return land.vetoes(c, _features(c), CELL)


@query("d12_siting_vetoes", f"WITH {VETOES} SELECT grid_id, row, col, coalesce(array_to_string(reasons, ','), '') AS reasons, reasons IS NOT NULL AS excluded FROM v")
def _d12(spark: SparkSession, d: str) -> DataFrame:
    return _vetoed(spark, d).select("grid_id", "row", "col", F.array_join("reasons", ",").alias("reasons"), "excluded")


@query("a18_exclusion_audit", f"WITH {VETOES}, u AS (SELECT grid_id, unnest(reasons) AS reason FROM v) SELECT grid_id, reason, count(*) AS cells FROM u GROUP BY ALL")
def _a18(spark: SparkSession, d: str) -> DataFrame:
    return land.removed_by(_vetoed(spark, d))


@query(
    "s02_drawn_area_veto",
    f"WITH {VETOES}, i AS (SELECT v.*, (row + 0.5) * 5 BETWEEN 41 AND 233 AND (col + 0.5) * 5 BETWEEN 60.5 AND 251 AS inside FROM v) SELECT grid_id, count(*) FILTER (WHERE inside) AS inside, count(*) FILTER (WHERE reasons IS NOT NULL OR NOT inside) AS excluded FROM i GROUP BY 1",
)
def _s02(spark: SparkSession, d: str) -> DataFrame:
    area = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((60.4, 41.0), (251.3, 41.0), (251.3, 233.7), (60.4, 233.7))])
    v = land.outside_veto(_vetoed(spark, d).crossJoin(F.broadcast(spark.range(1).select(area.alias("ring")))), CELL)  # one row
    return v.groupBy("grid_id").agg(F.count_if("inside").alias("inside"), F.count_if("excluded").alias("excluded"))


@query(
    "j12_site_tenure",
    """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 1009 / 100.0 + 0.003 AS x, o_orderkey % 997 / 100.0 + 0.003 AS y FROM orders),
p AS (SELECT s_suppkey AS pid, s_suppkey % 10 * 1.0 AS x, s_suppkey // 10 % 10 * 1.0 AS y, s_suppkey % 4 IN (0, 2) AS public FROM supplier),
j AS (SELECT id, min(pid) AS pid FROM s JOIN p ON s.x > p.x AND s.x < p.x + 1.5 AND s.y > p.y AND s.y < p.y + 1.5 GROUP BY 1)
SELECT id AS site_id, coalesce(j.pid, -1) AS parcel_id, CASE WHEN j.pid IS NULL THEN 'unknown' WHEN p.public THEN 'allottable' ELSE 'privately held' END AS tenure FROM s LEFT JOIN j USING (id) LEFT JOIN p ON p.pid = j.pid""",
)
def _j12(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    sites = table(spark, d, "orders").select(k.alias("site_id"), (k % 1009 / 100.0 + 0.003).alias("x"), (k % 997 / 100.0 + 0.003).alias("y"))
    at = lambda a, b: F.struct((s % 10 + a).cast("double").alias("x"), (F.floor(s / 10) % 10 + b).cast("double").alias("y"))
    owner = F.element_at(F.array(*[F.lit(x) for x in ("Gram Panchayat", "R. Patil", "GOVT waste", "")]), (s % 4 + 1).cast("int"))
    layer = table(spark, d, "supplier").select(s.alias("parcel_id"), F.array(at(0, 0), at(1.5, 0), at(1.5, 1.5), at(0, 1.5)).alias("ring"), owner.alias("owner"))
    return land.tenure(sites, layer, 0.5).select("site_id", F.coalesce("parcel_id", F.lit(-1)).alias("parcel_id"), "tenure")


@query("j15_distance_to_water", f"WITH {CELLS}, w AS (SELECT grid_id, row, col FROM cells WHERE cover = 80 AND row % 8 = 1 AND col % 8 = 1) SELECT c.grid_id, c.row, c.col, round(coalesce(min(5.0 * sqrt((c.row - w.row) ** 2 + (c.col - w.col) ** 2)), -1), 6) AS metres FROM cells c LEFT JOIN w ON w.grid_id = c.grid_id GROUP BY ALL")
def _j15(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    c = cells(spark, d).withColumn("water", ((F.col("cover") == 80) & (F.col("row") % 8 == 1) & (F.col("col") % 8 == 1)).cast("double"))
    far = lambda a: np.where(np.isfinite(a), a, -1.0)
    return kernels.on_grids(c, lambda m, _: {"metres": far(kernels.distance(m > 0, CELL))}, "metres double", "water").select("grid_id", "row", "col", *r6("metres"))


COMPONENTS = """t AS (SELECT grid_id, row, col, row AS r, col AS c FROM m UNION SELECT t.grid_id, t.row, t.col, m.row, m.col FROM t JOIN m ON m.grid_id = t.grid_id AND abs(m.row - t.r) <= 1 AND abs(m.col - t.c) <= 1),
lab AS (SELECT grid_id, row, col, min(r * 64 + c) AS label FROM t GROUP BY ALL)"""
PARCELS = f"""{COMPONENTS}, j AS (SELECT * FROM lab JOIN m USING (grid_id, row, col)),
p AS (SELECT grid_id, label, count(*) AS cells, round_even(avg(row), 0)::INT AS row, round_even(avg(col), 0)::INT AS col, round(max(z), 6) AS max_slope_pct, round(avg(z), 6) AS mean_slope_pct, round(avg(row + col), 6) AS mean_acc FROM j GROUP BY ALL HAVING count(*) >= 4),
k AS (SELECT grid_id, label, cover, row_number() OVER (PARTITION BY grid_id, label ORDER BY count(*) DESC, cover) AS n FROM j WHERE cover > 0 GROUP BY grid_id, label, cover)
SELECT p.grid_id, cells, row, col, max_slope_pct, mean_slope_pct, mean_acc, cells * 25.0::DOUBLE AS area_m2, cover, row_number() OVER (PARTITION BY p.grid_id ORDER BY cells DESC, p.label) AS parcel_id FROM p JOIN k ON k.grid_id = p.grid_id AND k.label = p.label AND n = 1"""


@query("a17_parcels", f"WITH RECURSIVE {CELLS}, m AS (SELECT grid_id, row, col, z, cover FROM cells WHERE z > 51.2), {PARCELS}")
def _a17(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumns({"available": F.col("z") > 51.2, "slope_pct": F.col("z"), "acc": F.col("row") + F.col("col")})
    return land.parcels(c, CELL, 100.0).select("grid_id", "cells", "row", "col", "area_m2", "cover", "parcel_id", *r6("max_slope_pct", "mean_slope_pct", "mean_acc"))


_DISC = "(SELECT r, c FROM range(-2, 3) q(r), range(-2, 3) w(c) WHERE abs(c) <= CASE abs(r) WHEN 2 THEN 0 ELSE 2 END)"


def _opened(mask: str) -> str:
    """Opening and closing of mask(grid_id, row, col, v) as CTEs; beyond the grid shrinking sees True and growing False."""
    step = lambda new, old, op: f"{new} AS (SELECT a.grid_id, a.row, a.col, coalesce({op}(b.v), a.v) AS v FROM {old} a CROSS JOIN {_DISC} o LEFT JOIN {old} b ON b.grid_id = a.grid_id AND b.row = a.row + o.r AND b.col = a.col + o.c GROUP BY a.grid_id, a.row, a.col, a.v)"
    return ", ".join((step("e1", mask, "bool_and"), step("e2", "e1", "bool_or"), step("e3", "e2", "bool_or"), step("clean", "e3", "bool_and")))


@query("g20_open_close", f"WITH {CELLS}, m0 AS (SELECT grid_id, row, col, z > 49.5 AS v FROM cells), {_opened('m0')} SELECT grid_id, row, col, v AS clean FROM clean")
def _g20(spark: SparkSession, d: str) -> DataFrame:
    return kernels.on_grids(cells(spark, d), lambda z, _: {"clean": kernels.opened_closed(z > 49.5)}, "clean boolean")


@query(
    "d11_available_land",
    f"""WITH RECURSIVE {CELLS}, wet AS (SELECT DISTINCT grid_id, row, col FROM cells WHERE cover = 80 AND col < 20), m0 AS (SELECT c.grid_id, c.row, c.col, c.z <= 51.6 AND c.cover IN (20, 30, 40, 60) AND w.row IS NULL AS v FROM cells c LEFT JOIN wet w USING (grid_id, row, col)), {_opened('m0')},
n AS (SELECT grid_id, row, col FROM clean WHERE v), g0 AS (SELECT grid_id, count(*) AS available FROM n GROUP BY 1), g1 AS (SELECT grid_id, count(*) AS cells FROM cells GROUP BY 1)
SELECT grid_id, cells, coalesce(available, 0) AS available FROM g1 LEFT JOIN g0 USING (grid_id)""",
)
def _d11(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("slope_pct", F.col("z"))
    a = land.available(c, c.where("cover = 80 and col < 20").select("grid_id", "row", "col"), 51.6, cropland=True)
    return a.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("available").alias("available"))


@query("g17_clusters", f"""WITH RECURSIVE {CELLS}, m AS (SELECT grid_id, row, col FROM cells WHERE z > 51.1), o AS (SELECT r, c FROM range(-2, 3) q(r), range(-2, 3) w(c) WHERE r * r + c * c <= 6),
n AS (SELECT m.grid_id, m.row, m.col, x.row AS r, x.col AS c FROM m CROSS JOIN o JOIN m x ON x.grid_id = m.grid_id AND x.row = m.row + o.r AND x.col = m.col + o.c),
core AS (SELECT grid_id, row, col FROM n GROUP BY ALL HAVING count(*) >= 4),
edge AS (SELECT n.* FROM n JOIN core USING (grid_id, row, col) JOIN core k ON k.grid_id = n.grid_id AND k.row = n.r AND k.col = n.c),
t AS (SELECT grid_id, row, col, row AS r, col AS c FROM core UNION SELECT t.grid_id, t.row, t.col, edge.r, edge.c FROM t JOIN edge ON edge.grid_id = t.grid_id AND edge.row = t.r AND edge.col = t.c),
lab AS (SELECT grid_id, row, col, min(r * 64 + c) AS label FROM t GROUP BY ALL),
own AS (SELECT m.grid_id, m.row, m.col, min(l.label) AS label FROM m LEFT JOIN n ON n.grid_id = m.grid_id AND n.row = m.row AND n.col = m.col LEFT JOIN lab l ON l.grid_id = n.grid_id AND l.row = n.r AND l.col = n.c GROUP BY ALL),
k AS (SELECT grid_id, row, col, CASE WHEN label IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY grid_id ORDER BY label NULLS LAST) - 1 END AS cluster FROM own)
SELECT grid_id, row, col, coalesce(cluster, -1)::INT AS cluster FROM cells LEFT JOIN k USING (grid_id, row, col)""")
def _g17(spark: SparkSession, d: str) -> DataFrame:
    return kernels.on_grids(cells(spark, d), lambda z, _: {"cluster": kernels.clusters(z > 51.1).astype("int32")}, "cluster int")


@query("g18_stage_storage", f"""WITH RECURSIVE {CELLS}, h AS (SELECT grid_id, max(row) + 1 AS n FROM cells GROUP BY 1), s AS (SELECT c.grid_id, c.row, c.col, c.z AS base FROM cells c JOIN h USING (grid_id) WHERE c.row = n // 2 AND c.col = 32),
l AS (SELECT *, unnest(range(1, 19)) AS k FROM s), o AS (SELECT r, c FROM range(-1, 2) q(r), range(-1, 2) w(c)),
t AS (SELECT grid_id, k, row, col, base + k * 0.25 AS level FROM l UNION SELECT t.grid_id, t.k, c.row, c.col, t.level FROM t CROSS JOIN o JOIN cells c ON c.grid_id = t.grid_id AND c.row = t.row + o.r AND c.col = t.col + o.c WHERE c.z < t.level),
a AS (SELECT grid_id, k, level, count(*) AS n, sum(level - z) * 25 AS v FROM t JOIN cells USING (grid_id, row, col) GROUP BY ALL),
f AS (SELECT grid_id, min(k) FILTER (WHERE n > 800) AS full_at FROM a GROUP BY 1)
SELECT grid_id, 0.0::DOUBLE AS depth_m, base AS level_m, 0.0::DOUBLE AS area_m2, 0.0::DOUBLE AS volume_m3, false AS unbounded FROM s
UNION ALL SELECT grid_id, k * 0.25, level, least(n, 800) * 25.0, round(CASE WHEN n > 800 THEN -1 ELSE v END, 4), n > 800 FROM a JOIN f USING (grid_id) WHERE full_at IS NULL OR k <= full_at""")
def _g18(spark: SparkSession, d: str) -> DataFrame:
    c = kernels.rows_on_grids(cells(spark, d), lambda z, _: kernels.stage_curve(z, z.shape[0] // 2, 32, CELL), "depth_m double, level_m double, area_m2 double, volume_m3 double, unbounded boolean")
    return c.withColumn("volume_m3", F.round(F.when(F.col("unbounded"), -1.0).otherwise(F.col("volume_m3")), 4))


@query("g19_footprints", f"WITH RECURSIVE {CELLS}, m AS (SELECT grid_id, row, col FROM cells WHERE z < 50.4), o AS (SELECT r, c FROM range(-1, 2) q(r), range(-1, 2) w(c)), t AS (SELECT grid_id, row, col FROM m WHERE row = 20 AND col = 30 UNION SELECT m.grid_id, m.row, m.col FROM t CROSS JOIN o JOIN m ON m.grid_id = t.grid_id AND m.row = t.row + o.r AND m.col = t.col + o.c), n0 AS (SELECT grid_id, count(*) AS n FROM t GROUP BY 1), n AS (SELECT grid_id, coalesce(n, 1) AS n FROM (SELECT grid_id FROM cells WHERE row = 20 AND col = 30) LEFT JOIN n0 USING (grid_id)) SELECT grid_id, least(n, 400) * 25.0::DOUBLE AS area_m2, n > 400 AS capped FROM n")
def _g19(spark: SparkSession, d: str) -> DataFrame:
    def around(z, _):  # noqa: ANN001, ANN202
        if z.shape[0] <= 20:
            return []
        area, capped = kernels.footprint(z < 50.4, 20, 30, CELL, 10_000.0)
        return [{"area_m2": area, "capped": bool(capped)}]

    return kernels.rows_on_grids(cells(spark, d), around, "area_m2 double, capped boolean")


@query("g01_fill_depressions", f"""WITH RECURSIVE {CELLS}, h AS (SELECT grid_id, max(row) AS last FROM cells GROUP BY 1),
z0 AS (SELECT grid_id, row, col, z, row = 0 OR col = 0 OR row = last OR col = 63 AS edge FROM cells JOIN h USING (grid_id)), o AS (SELECT r, c FROM range(-1, 2) q(r), range(-1, 2) w(c) WHERE r <> 0 OR c <> 0),
w AS (SELECT 0 AS k, grid_id, row, col, z, edge, CASE WHEN edge THEN z ELSE 1e9 END AS w, true AS moved FROM z0
 UNION ALL SELECT k, grid_id, row, col, z, edge, v, bool_or(v <> w) OVER () FROM (SELECT a.k + 1 AS k, a.grid_id, a.row, a.col, a.z, a.edge, a.w, CASE WHEN a.edge THEN a.z ELSE least(a.w, greatest(a.z, min(b.w) + 1e-6)) END AS v
  FROM w a CROSS JOIN o LEFT JOIN w b ON b.grid_id = a.grid_id AND b.row = a.row + o.r AND b.col = a.col + o.c WHERE a.moved GROUP BY a.k, a.grid_id, a.row, a.col, a.z, a.edge, a.w))
SELECT grid_id, row, col, round(min(w), 7) AS filled FROM w GROUP BY ALL""")
def _g01(spark: SparkSession, d: str) -> DataFrame:
    f = kernels.on_grids(cells(spark, d), lambda z, _: {"filled": kernels.fill(z)}, "filled double")
    return f.select("grid_id", "row", "col", F.round("filled", 7).alias("filled"))


@query("j01_aligned_layers", f"WITH {CELLS} SELECT grid_id, count(*) AS cells, round(sum(z), 4) AS z, count(*) FILTER (WHERE cover IN (20, 30, 60)) AS free, round(sum(row * 2.0), 4) AS layer FROM cells GROUP BY 1")
def _j01(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    a = survey.aligned(c.select("grid_id", "row", "col", "z"), c.select("grid_id", "row", "col", "cover"), c.select("grid_id", "row", "col", (F.col("row") * 2.0).alias("layer")))
    return a.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("z"), 4).alias("z"), F.count_if(F.col("cover").isin(20, 30, 60)).alias("free"), F.round(F.sum("layer"), 4).alias("layer"))


@query("j05_parameter_row", f"WITH {CELLS} SELECT grid_id, count(*) FILTER (WHERE z > 50.5 AND col < 48) AS n FROM cells GROUP BY 1")
def _j05(spark: SparkSession, d: str) -> DataFrame:
    c = survey.with_parameters(cells(spark, d), {"least_z": 50.5, "most_col": 48})
    return c.groupBy("grid_id").agg(F.count_if((F.col("z") > F.col("least_z")) & (F.col("col") < F.col("most_col"))).alias("n"))


@query("p08_cells_in_rectangle", f"WITH {CELLS} SELECT grid_id, count(*) AS cells, count(*) FILTER (WHERE row BETWEEN 10 AND 40 AND col BETWEEN 5 AND 50) AS inside FROM cells GROUP BY 1")
def _p08(spark: SparkSession, d: str) -> DataFrame:
    """The rectangle is that of two cells' centres, so that it takes in whole rows and columns but for the grid's slant, which is below a tenth of a cell here."""
    c = cells(spark, d)
    grids = c.select("grid_id").distinct().withColumns({"transform": F.array(*[F.lit(v) for v in (5.0, 0.0, 500000.0 - 140.0, 0.0, -5.0, 2300000.0)]), "epsg": F.lit(32643)})
    corner = lambda r, q: geo.from_utm(F.lit(500000.0 - 140.0 + 5 * (q + 0.5)), F.lit(2300000.0 - 5 * (r + 0.5)), F.lit(32643))
    at = spark.range(1).select(corner(40.3, 4.7).alias("a"), corner(9.7, 50.3).alias("b")).first()
    inside = survey.inside_box(c, grids, (at.a.lon, at.a.lat, at.b.lon, at.b.lat))
    return inside.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("inside").alias("inside"))


@query("x13_deepest_cells", f"WITH {CELLS}, k AS (SELECT grid_id, row // 16 AS part, row, col, z, row_number() OVER (PARTITION BY grid_id, row // 16 ORDER BY z, row, col) AS n FROM cells) SELECT grid_id, part, row, col, z FROM k WHERE n = 1")
def _x13(spark: SparkSession, d: str) -> DataFrame:
    return terrain.deepest(cells(spark, d).withColumn("part", F.floor(F.col("row") / 16)), ["grid_id", "part"])


@query("x29_bands", f"WITH {CELLS} SELECT grid_id, round(sum(CASE WHEN cover = 80 THEN -9999.0 ELSE z::FLOAT::DOUBLE END), 3) AS dem, sum(CASE WHEN cover = 80 THEN 255 ELSE greatest(0, least(255, round_even(z, 0))) END)::BIGINT AS shade FROM cells GROUP BY 1")
def _x29(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("z", F.when(F.col("cover") != 80, F.col("z")))
    both = terrain.band_values(terrain.band_values(c, "dem").withColumnRenamed("band", "dem"), "hillshade")
    return both.groupBy("grid_id").agg(F.round(F.sum("dem"), 3).alias("dem"), F.sum("band").cast("long").alias("shade"))


@query("x20_display_contours", f"""WITH {CELLS}, b AS (SELECT grid_id, max(z) - min(z) AS relief, min(z) AS lo, max(z) AS hi FROM cells GROUP BY 1), s AS (SELECT *, coalesce(list_filter({[float(x) for x in geo.DISPLAY_INTERVALS]}::DOUBLE[], lambda x: relief / x <= 40)[1], {float(geo.DISPLAY_INTERVALS[-1])}) AS step FROM b),
v AS (SELECT grid_id, unnest(list_transform(range(ceil(lo / step)::BIGINT, floor(hi / step)::BIGINT + 1), lambda k: round(k * step, 6)))::DOUBLE AS level, lo, hi FROM s) SELECT grid_id, level FROM v WHERE level < hi - 1e-9 AND level > lo + 1e-9""")
def _x20(spark: SparkSession, d: str) -> DataFrame:
    return analysis.display_contours(cells(spark, d)).select("grid_id", F.round("level", 6).alias("level")).distinct()


@query(
    "g23_tin_surface",
    f"WITH {CELLS}, h AS (SELECT grid_id, max(row) // 4 * 4 AS last FROM cells GROUP BY 1) SELECT grid_id, row, col, round(CASE WHEN row <= last AND col <= 60 THEN grid_id + 0.5 * col + 0.25 * row ELSE -1 END, 6) AS tin FROM cells JOIN h USING (grid_id)",
)
def _g23(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth row and column of a plane: the triangles give the plane back within the hull, whatever way they lie."""

    def surface(z, _):  # noqa: ANN001, ANN202
        import numpy as np

        r, c = np.indices(z.shape)
        use = (r % 4 == 0) & (c % 4 == 0)
        pts = np.stack(((c[use] + 0.5) * CELL, (r[use] + 0.5) * CELL), 1)
        return {"tin": kernels.interpolate(pts, z[use], z.shape, CELL)}

    plane = cells(spark, d).withColumn("z", F.col("grid_id") + 0.5 * F.col("col") + 0.25 * F.col("row"))
    got = kernels.on_grids(plane, surface, "tin double")
    return got.select("grid_id", "row", "col", F.round(F.coalesce(F.nanvl("tin", F.lit(None).cast("double")), F.lit(-1.0)), 6).alias("tin"))


@query(
    "g25_contours",
    f"""WITH {CELLS}, l AS (SELECT unnest([49.003, 50.003, 51.003]) AS level), n AS (SELECT a.grid_id, level FROM cells a JOIN cells b ON b.grid_id = a.grid_id AND b.row = a.row AND b.col = a.col + 1 CROSS JOIN l WHERE (a.z > level) <> (b.z > level)
UNION ALL SELECT a.grid_id, level FROM cells a JOIN cells b ON b.grid_id = a.grid_id AND b.row = a.row + 1 AND b.col = a.col CROSS JOIN l WHERE (a.z > level) <> (b.z > level)) SELECT grid_id, level::DOUBLE AS level, count(*) AS vertices FROM n GROUP BY ALL""",
)
def _g25(spark: SparkSession, d: str) -> DataFrame:
    """Lines cross each pair of neighbouring cells that lie on either side of the level, once."""

    def lines(z, _):  # noqa: ANN001, ANN202
        return [{"level": v, "rows": [p[0] for p in line], "cols": [p[1] for p in line]} for v in (49.003, 50.003, 51.003) for line in kernels.contour_lines(z, v)]

    got = kernels.rows_on_grids(cells(spark, d), lines, "level double, rows array<double>, cols array<double>")
    return got.select("grid_id", "level", F.explode(F.arrays_zip("rows", "cols")).alias("p")).distinct().groupBy("grid_id", "level").agg(F.count(F.lit(1)).alias("vertices"))


@query(
    "g26_outlines",
    f"""WITH {CELLS}, m AS (SELECT grid_id, row, col FROM cells WHERE z > 51.5), o AS (SELECT unnest([0, 1, 0, -1]) AS dr, unnest([1, 0, -1, 0]) AS dc),
rim AS (SELECT m.grid_id, count(*) AS edges FROM m CROSS JOIN o LEFT JOIN m x ON x.grid_id = m.grid_id AND x.row = m.row + dr AND x.col = m.col + dc WHERE x.row IS NULL GROUP BY 1), n AS (SELECT grid_id, count(*) AS cells FROM m GROUP BY 1) SELECT grid_id, cells, edges FROM n JOIN rim USING (grid_id)""",
)
def _g26(spark: SparkSession, d: str) -> DataFrame:
    """S-04: the rings around a mask, holes among them, hold its cells and are as long as its rim."""
    got = kernels.rows_on_grids(cells(spark, d), lambda z, _: [{"rows": [p[0] for p in r], "cols": [p[1] for p in r]} for r in kernels.outlines(z > 51.5)], "rows array<int>, cols array<int>")
    at = F.sequence(F.lit(1), F.size("rows"))
    here, there = lambda c, i: F.element_at(c, i), lambda c, i: F.element_at(c, i % F.size("rows") + 1)
    twice = F.aggregate(at, F.lit(0), lambda s, i: s + here("cols", i) * there("rows", i) - there("cols", i) * here("rows", i))
    rim = F.aggregate(at, F.lit(0), lambda s, i: s + F.abs(there("rows", i) - here("rows", i)) + F.abs(there("cols", i) - here("cols", i)))
    g = got.select("grid_id", twice.alias("twice"), rim.alias("rim")).groupBy("grid_id").agg(F.abs(F.sum("twice") / 2).cast("long").alias("cells"), F.sum("rim").alias("edges"))
    return g


STREAMS = f"""{WALK}, {ACC}, st AS (SELECT d.grid_id, d.row, d.col, d.down_row, d.down_col FROM dirs d JOIN acc USING (grid_id, row, col) WHERE acc >= 5),
up AS (SELECT p.grid_id, p.row, p.col, c.row AS r, c.col AS c FROM st p JOIN st c ON c.grid_id = p.grid_id AND c.down_row = p.row AND c.down_col = p.col),
ords AS (SELECT 0 AS k, grid_id, row, col, 1 AS ord FROM st UNION ALL SELECT k + 1, grid_id, row, col, CASE WHEN len(l) = 0 THEN 1 WHEN len(l) > 1 AND l[1] = l[2] THEN l[1] + 1 ELSE l[1] END FROM (
 SELECT o.k, o.grid_id, o.row, o.col, list_reverse_sort(coalesce(list(x.ord) FILTER (WHERE x.ord IS NOT NULL), [])) AS l FROM ords o LEFT JOIN up u ON u.grid_id = o.grid_id AND u.row = o.row AND u.col = o.col LEFT JOIN ords x ON x.grid_id = u.grid_id AND x.row = u.r AND x.col = u.c WHERE o.k < 40 GROUP BY o.k, o.grid_id, o.row, o.col)),
strahler AS (SELECT grid_id, row, col, max(ord) FILTER (WHERE k = 40) AS ord FROM ords GROUP BY ALL)"""


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their flow, unfilled as in the twin."""
    f = terrain.flow_direction(cells(spark, d), CELL)
    return f.select("grid_id", "row", "col", "fdir").join(flow.accumulation(f), ["grid_id", "row", "col"])


@query("g13_strahler_orders", f"WITH RECURSIVE {STREAMS} SELECT c.grid_id, c.row, c.col, coalesce(ord, 0)::INT AS ord FROM cells c LEFT JOIN strahler USING (grid_id, row, col)")
def _g13(spark: SparkSession, d: str) -> DataFrame:
    got = streams.orders(_channels(spark, d), 5)
    return cells(spark, d).select("grid_id", "row", "col").join(got, ["grid_id", "row", "col"], "left").select("grid_id", "row", "col", F.coalesce("order", F.lit(0)).alias("ord"))


@query(
    "g14_stream_reaches",
    f"""WITH RECURSIVE {STREAMS}, links AS (SELECT st.grid_id, s.ord, CASE WHEN st.row <> st.down_row AND st.col <> st.down_col THEN 5.0 * sqrt(2) ELSE 5.0 END AS l FROM st JOIN strahler s USING (grid_id, row, col) JOIN st q ON q.grid_id = st.grid_id AND q.row = st.down_row AND q.col = st.down_col)
SELECT grid_id, ord::INT AS "order", round(sum(l), 4) AS length_m FROM links GROUP BY ALL""",
)
def _g14(spark: SparkSession, d: str) -> DataFrame:
    """Reaches take each step from one channel cell to the next once, under the order of the upper one."""
    got = streams.reaches(_channels(spark, d), 5, CELL)
    return got.groupBy("grid_id", "order").agg(F.round(F.sum("length_m"), 4).alias("length_m"))


@query(
    "g24_smoothed",
    f"""WITH {CELLS}, h AS (SELECT grid_id, max(row) + 1 AS n FROM cells GROUP BY 1), g AS (SELECT unnest(range(-3, 4)) AS i), w AS (SELECT i, exp(-0.5 * (i / 0.75) ** 2) AS w FROM g),
p AS (SELECT c.grid_id, c.row, c.col, a.w * b.w AS w, CASE WHEN c.row + a.i < 0 THEN -(c.row + a.i) - 1 WHEN c.row + a.i >= n THEN 2 * n - 1 - c.row - a.i ELSE c.row + a.i END AS r, CASE WHEN c.col + b.i < 0 THEN -(c.col + b.i) - 1 WHEN c.col + b.i >= 64 THEN 127 - c.col - b.i ELSE c.col + b.i END AS q
 FROM cells c JOIN h USING (grid_id) CROSS JOIN w a CROSS JOIN w b WHERE c.cover <> 80)
SELECT p.grid_id, p.row, p.col, round(sum(w * x.z) / sum(w), 6) AS z FROM p JOIN cells x ON x.grid_id = p.grid_id AND x.row = p.r AND x.col = p.q WHERE x.cover <> 80 GROUP BY ALL""",
)
def _g24(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("z", F.when(F.col("cover") != 80, F.col("z")))
    got = kernels.on_grids(c, lambda z, _: {"s": kernels.gaussian(z)}, "s double")
    return got.where("s is not null and not isnan(s)").select("grid_id", "row", "col", F.round("s", 6).alias("z"))


_FLAT = f"""{NEAR}, s AS (SELECT grid_id, greatest({', '.join(f'coalesce(abs(z - n_{k}) * f / {CELL * (2**0.5 if r and c else 1.0)!r}, 0)' for k, (r, c) in _OFF.items())}) AS g FROM (SELECT *, CASE WHEN grid_id % 2 = 0 THEN 1.0 ELSE 0.001 END AS f FROM near))"""


@query("g02_conditioning_choice", f"WITH {_FLAT} SELECT grid_id, CASE WHEN avg((g < 0.001)::INT) > 0.15 THEN 'breach' ELSE 'fill' END AS method, 0 AS sinks FROM s GROUP BY 1")
def _g02(spark: SparkSession, d: str) -> DataFrame:
    """Odd grids are nearly flat. Whatever is chosen, no inner cell is left without a lower neighbour."""

    def choose(z, _):  # noqa: ANN001, ANN202
        import numpy as np

        surface, method = kernels.condition(z, CELL)
        inner = np.isfinite(surface) & ~kernels.outlets(surface)
        return [{"method": method, "sinks": int((inner & (kernels.direction(surface, CELL) == 0)).sum())}]

    c = cells(spark, d).withColumn("z", F.when(F.col("grid_id") % 2 == 0, F.col("z")).otherwise(F.col("z") * 0.001))
    return kernels.rows_on_grids(c, choose, "method string, sinks int")


@query("x11_layer_extents", "WITH f AS (SELECT s_nationkey AS layer_id, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT layer_id, min(id % 17 * 1.0) AS west, min(id % 13 * 1.0) AS south, max(id % 17 + 1.5) AS east, max(id % 13 + 2.0) AS north FROM f WHERE k <= 3 GROUP BY 1")
def _x11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = lambda a, b: F.struct((k % 17 + a).cast("double").alias("x"), (k % 13 + b).cast("double").alias("y"))
    f = table(spark, d, "supplier").select(F.col("s_nationkey").alias("layer_id"), k.alias("feature_id"), F.array(at(0, 0), at(1.5, 0), at(0, 2.0)).alias("ring"))
    return survey.layer_extent(f, 3)


@query("x22_line_report", "SELECT s_nationkey AS grid_id, count(*) AS lines, count(*) FILTER (WHERE s_suppkey % 10 = 0) AS index_lines, sum(s_suppkey % 30 + 2)::BIGINT AS vertices, round(100.0 * (1 - sum(s_suppkey % 30 + 2) / sum(s_suppkey % 30 * 3.0 + 9)), 6) AS reduction_pct FROM supplier GROUP BY 1")
def _x22(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lines = survey.index_lines(table(spark, d, "supplier").select(F.col("s_nationkey").alias("grid_id"), (k * 0.5).alias("level"), F.lit(0.5).alias("interval"), (k % 30 + 2).alias("vertices"), (k % 30 * 3 + 9).alias("vertices_before")), 10)
    return survey.line_report(lines).select("grid_id", "lines", "index_lines", "vertices", *r6("reduction_pct"))


@query("snk02_layers", f"WITH {CELLS} SELECT grid_id, count(*) AS cells, round(min(z), 6) AS low, round(min(z) + 1, 6) AS low_of_changed, 2 AS folders FROM cells GROUP BY 1")
def _snk02(spark: SparkSession, d: str) -> DataFrame:
    """A layer under the hash of its parameters and rows, in the shared folder: written again from other partitions it is the same folder, with other heights another one."""
    flow.shared_checkpoints(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/layers"
    c = cells(spark, d).select("grid_id", "row", "col", "z")
    paths = [sinks.write_layer(x, root, "dem", CELL) for x in (c, c.repartition(3), c.withColumn("z", F.col("z") + 1))]
    low = lambda p, n: spark.read.parquet(p).groupBy(F.col("grid_id").cast("long").alias("grid_id")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.min("z"), 6).alias(n))
    return low(paths[1], "low").join(low(paths[2], "low_of_changed").drop("cells"), "grid_id").withColumn("folders", F.lit(len(set(paths))))
