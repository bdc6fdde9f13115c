"""Queries of terrain and flow operators on grids made of vectors, with SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import flow, terrain
from rillwork.plans.q_rain import r6
from rillwork.plans.views import CELLS, cells
from rillwork.sources import sinks

Q: dict = {}
SQL: dict[str, str] = {}
CELL = 5.0


#: Neighbours, beyond the grid null (n_) or clamped (k_).
_OFF = {"e": (0, 1), "se": (1, 1), "s": (1, 0), "sw": (1, -1), "w": (0, -1), "nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1)}
NEAR = f"""{CELLS},
near AS (SELECT c.*, {", ".join(f"{k}.z AS n_{k}" for k in _OFF)} FROM cells c {" ".join(f"LEFT JOIN cells {k} ON {k}.grid_id = c.grid_id AND {k}.row = c.row + ({r}) AND {k}.col = c.col + ({c})" for k, (r, c) in _OFF.items())}),
clamped AS (SELECT *, {", ".join(f"coalesce(n_{k}, {', '.join('n_' + x for x in k) + ', ' if len(k) == 2 else ''}z) AS k_{k}" for k in _OFF)} FROM near),
horn AS (SELECT *, (k_ne + 2 * k_e + k_se - k_nw - 2 * k_w - k_sw) / (8 * {CELL}) AS dx, (k_sw + 2 * k_s + k_se - k_nw - 2 * k_n - k_ne) / (8 * {CELL}) AS dy FROM clamped)"""
_DROPS = ", ".join(f"{{'d': (z - n_{k}) / {CELL * (2**0.5 if r and c else 1.0)!r}, 'i': {-i}, 'code': {1 << i}, 'r': {r}, 'c': {c}}}" for i, (k, (r, c)) in enumerate(_OFF.items()))
DIRS = f"""{NEAR},
lower AS (SELECT grid_id, row, col, z, list_filter([{_DROPS}], lambda x: x.d > 0) AS l FROM near),
best AS (SELECT grid_id, row, col, z, CASE WHEN len(l) > 0 THEN list_reverse_sort(l)[1] END AS b FROM lower),
dirs AS (SELECT grid_id, row, col, z, coalesce(b.code, 0)::INT AS fdir, row + b.r AS down_row, col + b.c AS down_col FROM best)"""
# the recursive walk names every cell below each cell
WALK = DIRS.replace("e AS (SELECT vec_id", "e AS (SELECT vec_id", 1) + """,
walk AS (SELECT grid_id, row AS r0, col AS c0, row, col, 0.0::DOUBLE AS dist FROM dirs
  UNION ALL SELECT w.grid_id, w.r0, w.c0, d.down_row, d.down_col, w.dist + CASE WHEN d.down_row <> d.row AND d.down_col <> d.col THEN 5.0 * sqrt(2) ELSE 5.0 END FROM walk w JOIN dirs d ON d.grid_id = w.grid_id AND d.row = w.row AND d.col = w.col WHERE d.down_row IS NOT NULL)"""


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("m01_slope", f"WITH {NEAR} SELECT grid_id, row, col, round(100 * sqrt(dx * dx + dy * dy), 6) AS slope_pct FROM horn")
def _m01(spark: SparkSession, d: str) -> DataFrame:
    return terrain.slope(cells(spark, d), CELL).select("grid_id", "row", "col", *r6("slope_pct"))


@query(
    "m02_hillshade",
    f"WITH {NEAR} SELECT grid_id, row, col, round_even(254 * greatest(0, least(1, (sin(radians(45)) - cos(radians(45)) * (dx * sin(radians(315)) - dy * cos(radians(315)))) / sqrt(1 + dx * dx + dy * dy))), 0)::INT AS shade FROM horn",
)
def _m02(spark: SparkSession, d: str) -> DataFrame:
    return terrain.hillshade(cells(spark, d), CELL).select("grid_id", "row", "col", "shade")


@query("m03_concavity", f"WITH {NEAR} SELECT grid_id, row, col, round(k_n + k_s + k_e + k_w - 4 * z, 6) AS concavity FROM clamped")
def _m03(spark: SparkSession, d: str) -> DataFrame:
    return terrain.concavity(cells(spark, d)).select("grid_id", "row", "col", *r6("concavity"))


@query("g05_flow_direction", f"WITH {DIRS} SELECT grid_id, row, col, fdir, coalesce(down_row, -1) AS down_row, coalesce(down_col, -1) AS down_col FROM dirs")
def _g05(spark: SparkSession, d: str) -> DataFrame:
    return terrain.flow_direction(cells(spark, d), CELL).select("grid_id", "row", "col", "fdir", F.coalesce("down_row", F.lit(-1)).alias("down_row"), F.coalesce("down_col", F.lit(-1)).alias("down_col"))


@query("g07_flow_accumulation", f"WITH RECURSIVE {WALK} SELECT grid_id, row, col, count(*) AS acc FROM walk GROUP BY ALL")
def _g07(spark: SparkSession, d: str) -> DataFrame:
    return flow.accumulation(terrain.flow_direction(cells(spark, d), CELL))


@query("g10_flow_distance", f"WITH RECURSIVE {WALK} SELECT grid_id, r0 AS row, c0 AS col, max_by(row, dist) AS end_row, max_by(col, dist) AS end_col, round(max(dist), 6) AS dist FROM walk GROUP BY ALL")
def _g10(spark: SparkSession, d: str) -> DataFrame:
    return flow.terminal(terrain.flow_direction(cells(spark, d), CELL), CELL).select("grid_id", "row", "col", "end_row", "end_col", *r6("dist"))



ACC = "acc AS (SELECT grid_id, row, col, count(*) AS acc FROM walk GROUP BY ALL)"


def _sites(f: DataFrame) -> DataFrame:
    return flow.accumulation(f).where("acc >= 6").select("grid_id", (F.col("grid_id") * 4096 + F.col("row") * 64 + F.col("col")).alias("site_id"), "row", "col")


@query(
    "g09_catchments",
    f"WITH RECURSIVE {WALK}, {ACC}, s AS (SELECT grid_id, grid_id * 4096 + row * 64 + col AS site_id, row, col FROM acc WHERE acc >= 6) SELECT site_id, w.grid_id, r0 AS row, c0 AS col, round(dist, 6) AS dist FROM walk w JOIN s ON s.grid_id = w.grid_id AND s.row = w.row AND s.col = w.col",
)
def _g09(spark: SparkSession, d: str) -> DataFrame:
    flow.shared_checkpoints(spark)
    f = terrain.flow_direction(cells(spark, d), CELL).checkpoint()
    return flow.catchments(f, _sites(f), CELL).select("site_id", "grid_id", "row", "col", *r6("dist"))


@query(
    "a07_catchment_metrics",
    f"""WITH RECURSIVE {WALK}, {ACC}, s AS (SELECT grid_id, grid_id * 4096 + row * 64 + col AS site_id, row, col FROM acc WHERE acc >= 6),
m AS (SELECT site_id, w.grid_id, r0 AS row, c0 AS col, dist FROM walk w JOIN s ON s.grid_id = w.grid_id AND s.row = w.row AND s.col = w.col),
a AS (SELECT site_id, count(*) AS cells, max(h.z) - min(h.z) AS relief, avg(100 * sqrt(dx * dx + dy * dy)) AS ms, max(dist) AS len FROM m JOIN horn h USING (grid_id, row, col) GROUP BY 1),
o AS (SELECT unnest([0, 1, 0, -1]) AS dr, unnest([1, 0, -1, 0]) AS dc),
p AS (SELECT m.site_id, count(*) * 5.0 AS perimeter FROM m CROSS JOIN o LEFT JOIN m x ON x.site_id = m.site_id AND x.grid_id = m.grid_id AND x.row = m.row + dr AND x.col = m.col + dc WHERE x.row IS NULL GROUP BY 1)
SELECT site_id, cells, round(relief, 6) AS relief_m, round(ms, 6) AS mean_slope_pct, round(len, 6) AS longest_path_m, perimeter::DOUBLE AS perimeter_m, round(cells * 25.0 / (len * len), 6) AS form_factor, round(perimeter / (2 * sqrt(pi() * cells * 25.0)), 6) AS compactness, round(0.01947 * pow(len, 0.77) * pow(relief / len, -0.385), 6) AS tc_min FROM a JOIN p USING (site_id)""",
)
def _a07(spark: SparkSession, d: str) -> DataFrame:
    flow.shared_checkpoints(spark)
    c = cells(spark, d)
    f = terrain.flow_direction(c, CELL).checkpoint()
    m = flow.catchment_metrics(flow.catchments(f, _sites(f), CELL), terrain.slope(c, CELL), CELL)
    return m.select("site_id", "cells", "perimeter_m", *r6("relief_m", "mean_slope_pct", "longest_path_m", "form_factor", "compactness", "tc_min"))


@query(
    "k10_snap_to_drainage",
    f"""WITH RECURSIVE {WALK}, {ACC}, s AS (SELECT grid_id * 4096 + row * 64 + col AS site_id, grid_id, row, col FROM cells WHERE row % 16 = 8 AND col % 16 = 8),
n AS (SELECT s.site_id, s.grid_id, a.row, a.col, a.acc, row_number() OVER (PARTITION BY s.site_id ORDER BY a.acc DESC, a.row, a.col) AS k FROM s JOIN acc a ON a.grid_id = s.grid_id AND (a.row - s.row) * (a.row - s.row) + (a.col - s.col) * (a.col - s.col) <= 9)
SELECT site_id, grid_id, row, col, acc FROM n WHERE k = 1""",
)
def _k10(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    sites = c.where("row % 16 = 8 and col % 16 = 8").select((F.col("grid_id") * 4096 + F.col("row") * 64 + F.col("col")).alias("site_id"), "grid_id", "row", "col")
    return flow.snapped(sites, flow.accumulation(terrain.flow_direction(c, CELL)), 3)


@query("g11_sinks", f"WITH {DIRS} SELECT grid_id, row, col, z FROM dirs WHERE fdir = 0")
def _g11(spark: SparkSession, d: str) -> DataFrame:
    return terrain.sinks(cells(spark, d)).select("grid_id", "row", "col", "z")


@query("p09_outlets", f"WITH {CELLS}, h AS (SELECT * REPLACE (CASE WHEN cover = 80 AND col % 7 = 3 THEN NULL ELSE z END AS z) FROM cells), o AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dr, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dc), n AS (SELECT h.grid_id, h.row, h.col, count(x.z) AS k FROM h CROSS JOIN o LEFT JOIN h x ON x.grid_id = h.grid_id AND x.row = h.row + dr AND x.col = h.col + dc WHERE h.z IS NOT NULL GROUP BY ALL) SELECT grid_id, count(*) FILTER (WHERE k < 8) AS outlets, count(*) AS valid FROM n GROUP BY 1")
def _p09(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("z", F.when((F.col("cover") == 80) & (F.col("col") % 7 == 3), None).otherwise(F.col("z")))
    return terrain.outlets(c).groupBy("grid_id").agg(F.count_if("outlet").alias("outlets"), F.count("z").alias("valid"))


@query("a15_flatness", f"WITH {NEAR}, s AS (SELECT grid_id, greatest({', '.join(f'abs(z - n_{k}) / {CELL * (2**0.5 if r and c else 1.0)!r}' for k, (r, c) in _OFF.items())}) AS g FROM near) SELECT grid_id, round(avg((g < 0.5)::INT), 6) AS flat_fraction FROM s GROUP BY 1")
def _a15(spark: SparkSession, d: str) -> DataFrame:
    return terrain.flatness(cells(spark, d), CELL, 0.5).select("grid_id", *r6("flat_fraction"))


@query("a13_robust_bounds", f"WITH {CELLS} SELECT grid_id, round(quantile_cont(z, 0.02), 6) AS lo, round(quantile_cont(z, 0.98), 6) AS hi FROM cells WHERE cover IN (20, 30, 60) GROUP BY 1")
def _a13(spark: SparkSession, d: str) -> DataFrame:
    return terrain.robust_bounds(cells(spark, d), "z", F.col("cover").isin(20, 30, 60)).select("grid_id", *r6("lo", "hi"))


@query("m04_normalised", f"WITH {CELLS}, b AS (SELECT grid_id, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM cells GROUP BY 1) SELECT grid_id, row, col, round(CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE 1 - greatest(0, least(1, (z - lo) / (hi - lo))) END, 6) AS score FROM cells JOIN b USING (grid_id)")
def _m04(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    b = terrain.robust_bounds(c, "z", F.lit(True))
    return c.join(b, "grid_id").select("grid_id", "row", "col", F.round(terrain.normalised(F.col("z"), F.col("lo"), F.col("hi"), True), 6).alias("score"))


@query("a14_band_stats", f"WITH {CELLS} SELECT grid_id, min(z) AS min, max(z) AS max, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.02), 6) AS p2, round(quantile_cont(z, 0.98), 6) AS p98, count(z) AS valid, count(*) - count(z) AS nodata FROM cells GROUP BY 1")
def _a14(spark: SparkSession, d: str) -> DataFrame:
    return terrain.band_stats(cells(spark, d)).select("grid_id", "min", "max", "valid", "nodata", *r6("mean", "p2", "p98"))


@query("a09_cover_fractions", f"WITH {CELLS}, n AS (SELECT grid_id, cover, count(*) AS n FROM cells GROUP BY ALL) SELECT grid_id, cover, round(n / sum(n) OVER (PARTITION BY grid_id), 6) AS fraction FROM n")
def _a09(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = cells(spark, d).groupBy("grid_id", "cover").agg(F.count(F.lit(1)).alias("n"))
    return n.select("grid_id", "cover", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("grid_id")), 6).alias("fraction"))


@query("snk01_overviews", f"WITH {CELLS}, l1 AS (SELECT grid_id, row // 2 AS row, col // 2 AS col, avg(z) AS v FROM cells GROUP BY ALL), l2 AS (SELECT grid_id, row // 2 AS row, col // 2 AS col, avg(v) AS v FROM l1 GROUP BY ALL) SELECT grid_id, 1 AS level, row, col, round(v, 6) AS v FROM l1 UNION ALL SELECT grid_id, 2, row, col, round(v, 6) FROM l2")
def _snk01(spark: SparkSession, d: str) -> DataFrame:
    return terrain.overviews(cells(spark, d), levels=2).select("grid_id", "level", "row", "col", *r6("v"))


@query("g16_components", f"""WITH RECURSIVE {CELLS}, m AS (SELECT grid_id, row, col FROM cells WHERE z > 51.2),
t AS (SELECT grid_id, row, col, row AS r, col AS c FROM m UNION SELECT t.grid_id, t.row, t.col, m.row, m.col FROM t JOIN m ON m.grid_id = t.grid_id AND abs(m.row - t.r) <= 1 AND abs(m.col - t.c) <= 1)
SELECT grid_id, row, col, min(r::BIGINT * 1048576 + c) AS label FROM t GROUP BY ALL""")
def _g16(spark: SparkSession, d: str) -> DataFrame:
    return flow.components(cells(spark, d).where("z > 51.2"))


@query("g21_dilation", f"WITH {CELLS}, m AS (SELECT grid_id, row, col FROM cells WHERE z > 52), o AS (SELECT r, c FROM range(-2, 3) a(r), range(-2, 3) b(c) WHERE r * r + c * c <= 5) SELECT DISTINCT grid_id, (row + r)::INT AS row, (col + c)::INT AS col FROM m CROSS JOIN o")
def _g21(spark: SparkSession, d: str) -> DataFrame:
    return flow.dilated(cells(spark, d).where("z > 52"), 5**0.5)


@query("x01_elevation_agreement", f"WITH {CELLS}, f AS (SELECT * FROM cells WHERE row % 10 = 0 AND col % 10 = 0), c AS (SELECT grid_id, row, col, round(z) + 1 AS z2 FROM cells) SELECT grid_id, round(avg(z2 - z), 6) AS bias, round(stddev_pop(z2 - z), 6) AS spread, round(avg(abs(z2 - z)), 6) AS mae, round(corr(z, z2), 6) AS r, count(*) AS n FROM f JOIN c USING (grid_id, row, col) GROUP BY 1")
def _x01(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return terrain.agreement(c, c.withColumn("z", F.round("z") + 1)).select("grid_id", "n", *r6("bias", "spread", "mae", "r"))


@query(
    "snk05_hillshade_pictures",
    f"WITH {NEAR} SELECT grid_id, row, col, round_even(255 * round_even(254 * greatest(0, least(1, (sin(radians(45)) - 4 * cos(radians(45)) * (dx * sin(radians(315)) - dy * cos(radians(315)))) / sqrt(1 + 16 * dx * dx + 16 * dy * dy))), 0) / 254, 0)::INT AS grey, 255 AS alpha FROM horn",
)
def _snk05_hillshade(spark: SparkSession, d: str) -> DataFrame:
    """Relief of each grid, four times as steep, as pictures; their pixels again."""
    import pandas as pd

    def unpacked(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for grid, data in zip(b["grid_id"], b["png"], strict=True):
                p = sinks.pixels(bytes(data))
                r, c = (x.ravel() for x in np.indices(p.shape[:2]))
                yield pd.DataFrame({"grid_id": grid, "row": r, "col": c, "grey": p[r, c, 0].astype("int32"), "alpha": p[r, c, 3].astype("int32")})

    shade = terrain.hillshade(cells(spark, d), CELL, z_factor=4.0).withColumn("shade", F.nullif("shade", F.lit(255)))
    return sinks.pictures(shade, "shade", 0.0, 254.0, grey=True).mapInPandas(unpacked, "grid_id long, row int, col int, grey int, alpha int")
