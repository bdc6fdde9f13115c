"""End-to-end queries: contour maps, or areas with heights, to ranked, vetoed, sized and balanced sites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import analysis, kernels
from rillwork.plans.q_land import CELL, _features
from rillwork.plans.views import cells, rain_daily, table
from rillwork.sources import kml

Q: dict = {}
SQL: dict[str, str] = {}
ET0 = [110, 120, 170, 190, 210, 170, 120, 110, 115, 120, 105, 100]
LOOSE = {"separation": 60.0, "upstream_ha": 0.05, "threshold": 0.3, "min_depth": 0.05, "max_slope": 15.0}


def query(name: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        return f

    return add


def valley(shape: tuple[int, int], tilt: float):  # noqa: ANN201
    """Heights of a valley that falls to the east, with a hollow in its floor."""
    import numpy as np

    r, c = np.indices(shape)
    mid = shape[0] / 2
    return 100 - tilt * c + 0.12 * np.abs(r - mid) - 1.6 * np.exp(-((r - mid) ** 2 + (c - 0.6 * shape[1]) ** 2) / 40.0)


def valley_kml(tilt: float, lon: float, lat: float, cell: float = 5.0, shape: tuple[int, int] = (64, 64), interval: float = 0.5) -> str:
    """The valley's contour lines as a KML text with the heights in the placemarks' names."""
    import math

    import numpy as np

    z = valley(shape, tilt)
    parts = []
    for level in np.arange(math.ceil(z.min() / interval) * interval, z.max(), interval):
        for line in kernels.contour_lines(z, float(level)):
            if len(line) >= 3:
                at = " ".join(f"{lon + q * cell / (111320 * math.cos(math.radians(lat))):.9f},{lat - p * cell / 111320:.9f}" for p, q in line)
                parts.append(f"<Placemark><name>{level:.1f} m</name><LineString><coordinates>{at}</coordinates></LineString></Placemark>")
    return "<kml><Document>" + "".join(parts) + "</Document></kml>"


def contour_maps(spark: SparkSession, d: str) -> DataFrame:
    """map_id, content: a map for each region."""

    def draw(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pd.DataFrame({"map_id": [f"map{k}" for k in b["k"]], "content": [valley_kml(0.03 + 0.01 * k, 77.0 + 0.1 * k, 20.0).encode() for k in b["k"]]})

    return table(spark, d, "region").select(F.col("r_regionkey").alias("k")).mapInPandas(draw, "map_id string, content binary")


def yearly_rain(spark: SparkSession, d: str) -> DataFrame:
    """The mean of both series."""
    return rain_daily(spark, d).groupBy("observed_on").agg(F.avg("mm").alias("mm"))


@query("e01_contour_analysis")
def _e01(spark: SparkSession, d: str) -> DataFrame:
    lines = kml.contour_lines(kml.parsed(contour_maps(spark, d)))
    out = analysis.analyse_maps(lines, lambda c: c.withColumn("cover", F.when(F.col("col") % 16 == 0, 40).otherwise(30)), yearly_rain(spark, d), ET0, **LOOSE)
    return out.select("map_id", "rank", "kind", "row", "col", F.round("score", 3).alias("score"), F.round("catchment_m2", 1).alias("catchment_m2"), F.round("gross_m3", 2).alias("gross_m3"), F.round("terrain_m3", 2).alias("terrain_m3"), F.round("usable_m2", 1).alias("usable_m2"), F.round("snapped_m", 1).alias("snapped_m"), "months_with_water", "limited_by", "confidence", "explanation")


@query("e02_area_analysis")
def _e02(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("z", F.col("z") * 0.1 - F.col("row") * 0.05)
    out = analysis.analyse(c, CELL, yearly_rain(spark, d), ET0, "B", _features(c), **LOOSE)
    return out.select("grid_id", "rank", "kind", "row", "col", F.round("score", 3).alias("score"), F.round("catchment_m2", 1).alias("catchment_m2"), F.round("gross_m3", 2).alias("gross_m3"), F.round("terrain_m3", 2).alias("terrain_m3"), F.round("usable_m2", 1).alias("usable_m2"), F.round("snapped_m", 1).alias("snapped_m"), "months_with_water", "limited_by", "confidence", "explanation")


@query("g23_contour_surface")
def _g23(spark: SparkSession, d: str) -> DataFrame:
    """Contour maps to heights, and how far they are from the valley that was drawn."""
    lines = kml.contour_lines(kml.parsed(contour_maps(spark, d)))
    grid, frames = analysis.gridded(lines)
    return grid.join(frames.select("grid_id", "map_id", "cell_m"), "grid_id").groupBy("map_id", "cell_m").agg(F.count(F.lit(1)).alias("cells"), F.count("z").alias("valid"), F.round(F.min("z"), 2).alias("lowest"), F.round(F.max("z"), 2).alias("highest"))
