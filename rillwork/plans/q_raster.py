"""Queries over raster files that are written from the grids made of vectors, with SQL twins over the same cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import flow
from rillwork.plans.q_rain import r6
from rillwork.plans.views import CELLS, SIDE, cells
from rillwork.sources import raster

Q: dict = {}
SQL: dict[str, str] = {}
#: Grids lie side by side, 16 to a row of them, cells of a 1024th of a degree.
_STEP, _ROW = 1024.0, 16

PLACED = f"""{CELLS},
placed AS (SELECT *, 77 + (grid_id % {_ROW}) / 16.0::DOUBLE AS x0, 21 - (grid_id // {_ROW}) / 16.0::DOUBLE AS y0, (grid_id % {_ROW}) * {SIDE} + col AS gc, (grid_id // {_ROW}) * {SIDE} + row AS gr, z::FLOAT::DOUBLE AS v FROM cells)"""


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def grids(d: DataFrame) -> DataFrame:
    across, down = F.col("grid_id") % _ROW, F.floor(F.col("grid_id") / _ROW)
    t = F.array(F.lit(1 / _STEP), F.lit(0.0), 77 + across / 16.0, F.lit(0.0), F.lit(-1 / _STEP), 21 - down / 16.0)
    return d.groupBy("grid_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")).select("grid_id", "n_rows", "n_cols", t.alias("transform"), F.lit(4326).alias("epsg"))


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the cluster's shared one."""
    flow.shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def written(spark: SparkSession, sf_dir: str, kind: str = "dem", value: str = "z", **more: object) -> tuple[str, DataFrame, DataFrame]:
    """(folder, the catalogue of its files, the cells that they hold)"""
    d, path = cells(spark, sf_dir), folder(spark, kind)
    return path, raster.write(d, grids(d), path, kind, value, tile=16, **more), d


@query("src07_raster_cells", f"WITH {PLACED} SELECT grid_id::VARCHAR AS file, row, col, x0 + (col + 0.5) / {_STEP} AS x, y0 - (row + 0.5) / {_STEP} AS y, v AS value FROM placed")
def _cells(spark: SparkSession, d: str) -> DataFrame:
    path, _, _ = written(spark, d)
    return raster.read(spark, path).select("file", "row", "col", "x", "y", "value")


@query(
    "src07_raster_bilinear",
    f"""WITH {PLACED}, f AS (SELECT grid_id AS file, min(y0) - (max(row) + 1) / {_STEP} AS south, min(x0) AS west FROM placed GROUP BY 1),
n AS (SELECT t.grid_id, t.row, t.col, c.grid_id AS file, avg(c.v) AS v FROM placed t JOIN placed c ON c.gr IN (t.gr - 1, t.gr) AND c.gc IN (t.gc - 1, t.gc) GROUP BY ALL)
SELECT grid_id, row, col, round(arg_min(v, struct_pack(south := south, west := west)), 6) AS value FROM n JOIN f USING (file) GROUP BY ALL""",
)
def _bilinear(spark: SparkSession, d: str) -> DataFrame:
    path, _, c = written(spark, d)
    at = c.join(grids(c), "grid_id").select("grid_id", "row", "col", (F.col("transform")[2] + F.col("col") / _STEP).alias("x"), (F.col("transform")[5] - F.col("row") / _STEP).alias("y"))
    return raster.bilinear(at, raster.files(spark, path), raster.read(spark, path), ["grid_id", "row", "col"]).select("grid_id", "row", "col", *r6("value"))


@query("src11_raster_cover", f"WITH {CELLS} SELECT grid_id, row, col, cover::INT AS cover, round(count(*) OVER (PARTITION BY grid_id, cover) / count(*) OVER (PARTITION BY grid_id)::DOUBLE, 6) AS fraction FROM cells")
def _cover(spark: SparkSession, d: str) -> DataFrame:
    path, _, c = written(spark, d, "land_cover", "cover", band=("uint8", 0.0, "nearest"))
    at = c.join(grids(c), "grid_id").select("grid_id", "row", "col", (F.col("transform")[2] + (F.col("col") + 0.25) / _STEP).alias("x"), (F.col("transform")[5] - (F.col("row") + 0.75) / _STEP).alias("y"))
    got = raster.nearest(at, raster.files(spark, path), raster.read(spark, path), ["grid_id", "row", "col"]).withColumn("cover", F.col("value").cast("int")).checkpoint()
    share = got.groupBy("grid_id", "cover").agg(F.count("cover").alias("n")).join(got.groupBy("grid_id").agg(F.count("cover").alias("all")), "grid_id").select("grid_id", "cover", F.round(F.col("n") / F.col("all"), 6).alias("fraction"))
    return got.join(share, ["grid_id", "cover"]).select("grid_id", "row", "col", "cover", "fraction")


@query(
    "snk01_raster_files",
    f"""WITH {PLACED} SELECT grid_id::VARCHAR AS file, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, min(x0) AS west, min(y0) AS north, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 4) AS mean,
round(quantile_cont(v, 0.02), 4) AS p2, round(quantile_cont(v, 0.98), 4) AS p98, count(v) AS valid, 2 AS overviews FROM placed GROUP BY grid_id""",
)
def _files(spark: SparkSession, d: str) -> DataFrame:
    _, c, _ = written(spark, d)
    return c.select("file", "n_rows", "n_cols", "west", "north", *r6("min", "max"), *[F.round(x, 4).alias(x) for x in ("mean", "p2", "p98")], "valid", "overviews")


@query("snk01_raster_overviews", f"WITH {CELLS} SELECT grid_id::VARCHAR AS file, row // 2 AS row, col // 2 AS col, round(avg(z), 4) AS value FROM cells GROUP BY ALL")
def _overviews(spark: SparkSession, d: str) -> DataFrame:
    path, _, _ = written(spark, d)
    return raster.read(spark, path, cell=2 / _STEP).select("file", "row", "col", F.round("value", 4).alias("value"))
