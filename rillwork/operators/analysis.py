"""The whole analysis as one plan: contour maps to heights, heights to vetoed and ranked sites, and each site to its catchment, water, pond, balance and words. Many maps at once."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions import geo, hydro
from rillwork.operators import decide, flow, kernels, pond, rainfall, runoff, siting, survey, terrain


@dataclass(frozen=True)
class Options:
    """U-05: what a run may be told; the names are those of siting.sites and analyse."""

    most: int = 5
    separation: float = siting.SEPARATION
    max_slope: float = siting.MAX_SLOPE
    upstream_ha: float = siting.MIN_UPSTREAM_HA
    threshold: float = siting.THRESHOLD
    min_depth: float = siting.MIN_DEPTH
    snap_m: float = 150.0

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


def display_contours(cells: DataFrame, most: int = 40) -> DataFrame:
    """X-20, M-25: contour lines of each area to draw, at the first interval that gives few enough levels: grid_id, level, rows, cols. An area is a task, as in the other kernels."""
    span = cells.groupBy("grid_id").agg(geo.display_interval(F.max("z") - F.min("z"), most).alias("step"))

    def lines(z: np.ndarray, x: dict[str, np.ndarray]) -> list[dict]:
        step = float(np.nanmax(x["step"]))
        levels = np.arange(np.ceil(np.nanmin(z) / step), np.floor(np.nanmax(z) / step) + 1) * step
        levels = levels[(levels > np.nanmin(z) + 1e-9) & (levels < np.nanmax(z) - 1e-9)]  # the ends have no line
        return [{"level": float(v), "rows": [p[0] for p in line], "cols": [p[1] for p in line]} for v in levels for line in kernels.contour_lines(z, float(v))]

    return kernels.rows_on_grids(cells.join(span, "grid_id"), lines, "level double, rows array<double>, cols array<double>", extra=("step",))


def map_frames(lines: DataFrame) -> DataFrame:
    """lines(map_id, elevation_m, coords array<struct<lon, lat>>) -> map_id, grid_id, epsg, west, north, cell_m, n_rows, n_cols: each map's zone, its box in metres, and the cell size that its contour spacing bears."""
    flat = lambda c: F.transform("coords", lambda p: p[c])
    g = lines.groupBy("map_id").agg(F.min(F.array_min(flat("lon"))).alias("w"), F.max(F.array_max(flat("lon"))).alias("e"), F.min(F.array_min(flat("lat"))).alias("s"), F.max(F.array_max(flat("lat"))).alias("n"))
    g = g.select("map_id", geo.utm_epsg((F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2).alias("epsg"))
    p = projected(lines, g)
    along = lambda c: F.transform("points", lambda q: q[c])
    b = p.groupBy("map_id", "epsg").agg(F.min(F.array_min(along("x"))).alias("west"), F.max(F.array_max(along("x"))).alias("east"), F.min(F.array_min(along("y"))).alias("south"), F.max(F.array_max(along("y"))).alias("north"), F.sum(geo.line_length(F.col("points"))).alias("length"))
    b = b.withColumn("cell_m", geo.cell_size((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")), F.col("length")))
    n = lambda a, z: F.greatest(F.lit(1), F.ceil((F.col(z) - F.col(a)) / F.col("cell_m"))).cast("int")
    return b.select("map_id", F.xxhash64("map_id").alias("grid_id"), "epsg", "west", "north", "cell_m", n("south", "north").alias("n_rows"), n("west", "east").alias("n_cols"))


def projected(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """lines with points array<struct<x, y>> in the metres of their map's zone."""
    zone, south = F.col("epsg") % 100, F.col("epsg") >= 32700
    j = lines.join(frames, "map_id")
    return j.withColumn("points", F.transform("coords", lambda p: geo.to_utm(p["lon"], p["lat"], zone, south)))


def gridded(lines: DataFrame, spacing_cells: float = 1.0, smooth: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(cells(grid_id, row, col, z), frames) of contour lines(map_id, elevation_m, coords): points at even steps along the lines, triangulated, gaps at the rim from the nearest point, smoothed. A map is a task: it is
    bounded by the survey's cap."""
    frames = map_frames(lines.where("elevation_m is not null"))
    p = projected(lines.where("elevation_m is not null"), frames)
    rows = p.select("map_id", "grid_id", "cell_m", "n_rows", "n_cols", F.col("elevation_m").alias("level"), F.transform("points", lambda q: q["x"] - F.col("west")).alias("x"), F.transform("points", lambda q: F.col("north") - q["y"]).alias("y"))

    def surface(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        cell, shape = float(pdf["cell_m"].iloc[0]), (int(pdf["n_rows"].iloc[0]), int(pdf["n_cols"].iloc[0]))
        pts, z = [], []
        for x, y, level in zip(pdf["x"], pdf["y"], pdf["level"], strict=True):
            line = np.stack((np.asarray(x, float), np.asarray(y, float)), 1)
            line = survey.respaced(line, spacing_cells * cell)
            pts.append(line)
            z.append(np.full(len(line), float(level)))
        pts, first = np.unique(np.round(np.concatenate(pts), 3), axis=0, return_index=True)
        got = kernels.interpolate(pts, np.concatenate(z)[first], shape, cell)
        got = kernels.gaussian(got, smooth)
        r, c = np.indices(shape)
        return pd.DataFrame({"grid_id": int(pdf["grid_id"].iloc[0]), "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "z": np.where(np.isfinite(got), got, np.nan).ravel()})

    cells = rows.groupBy("map_id").applyInPandas(surface, "grid_id long, row int, col int, z double")
    return cells.withColumn("z", F.nanvl("z", F.lit(None).cast("double"))), frames


def pour_points(sites: DataFrame, flow_of: DataFrame, cell_m: float, snap_m: float) -> DataFrame:
    """G-08, K-10: sites whose outlet_row and outlet_col are the cell of most flow within snap_m, with snapped_m, how far that is."""
    at = sites.select("site_id", "grid_id", F.col("outlet_row").alias("row"), F.col("outlet_col").alias("col"))
    to = flow.snapped(at, flow_of, max(0, round(snap_m / cell_m))).select("site_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    moved = F.hypot((F.col("to_row") - F.col("outlet_row")).cast("double"), (F.col("to_col") - F.col("outlet_col")).cast("double")) * cell_m
    return sites.join(to, "site_id").withColumn("snapped_m", moved).withColumns({"outlet_row": F.col("to_row"), "outlet_col": F.col("to_col")}).drop("to_row", "to_col")


def site_catchments(cells: DataFrame, sites: DataFrame, cell_m: float, flow_of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members(site_id, grid_id, row, col, dist), metrics by site_id) of the sites' outlets over each grid's filled surface (flow_of, as of routed with trees, if it is there already)."""
    if flow_of is None:
        flow_of = siting.routed(cells, cell_m, tree=True).checkpoint()
    at = sites.select("site_id", "grid_id", F.col("outlet_row").alias("row"), F.col("outlet_col").alias("col"))
    members = flow.upstream(flow_of, at, cell_m).checkpoint()
    edge = members.join(terrain.outlets(cells).where("outlet").select(*survey.KEY), survey.KEY, "left_semi").select("site_id").distinct().withColumn("touches_edge", F.lit(True))
    metrics = flow.catchment_metrics(members, terrain.slope(cells, cell_m), cell_m).join(edge, "site_id", "left")
    return members, metrics.withColumn("touches_edge", F.coalesce("touches_edge", F.lit(False)))


def site_water(members: DataFrame, cells: DataFrame, metrics: DataFrame, daily: DataFrame, soil: Column) -> DataFrame:
    """site_id, cn2, annual_m3, dependable_m3, monthly_mm of each catchment under the daily rain(observed_on, mm) of the area; soil is its hydrologic group."""
    fractions = survey.zonal_fractions(members, cells).select(F.col("site_id").alias("site"), "cover", "fraction", soil.alias("soil"))
    cn = runoff.composite_curve_number(fractions).select(F.col("site").alias("series"), "cn2")
    # the days before a day are the same for all sites: they are summed once, and then the rain is repeated for each site
    wet = rainfall.antecedent(daily.select(F.lit(0).alias("series"), "observed_on", "mm")).drop("series")
    # sites are small rows that Spark would put in one task, where each becomes a row a day; the rain has a row a day only
    spark = cells.sparkSession
    rain = cn.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "series").crossJoin(F.broadcast(wet))
    mm = runoff.runoff_estimate(rain, F.col("cn2"), F.lit(1.0)).join(cn, "series")
    area = metrics.select(F.col("site_id").alias("series"), "area_m2")
    return mm.join(area, "series").select(F.col("series").alias("site_id"), "cn2", (F.col("annual_mean_mm") / 1000 * F.col("area_m2")).alias("annual_m3"), (F.col("dependable_75_mm") / 1000 * F.col("area_m2")).alias("dependable_m3"), "monthly_mm")


def analyse(cells: DataFrame, cell_m: float, daily: DataFrame, et0_mm: list[float], soil: str | None = None, features: DataFrame | None = None, snap_m: float = Options.snap_m, **options: float) -> DataFrame:
    """cells(grid_id, row, col, z, cover) -> one row a site: its rank, place and score, its snapped pour point and catchment, curve number, water, a pond on the buildable land around it and what the ground itself
    would hold, balance, confidence, comparison and a sentence with what speaks for it. features (see land.burned) veto cells."""
    group = F.coalesce(F.lit(soil), F.lit(survey.ASSUMED_SOIL))
    flow.shared_checkpoints(cells.sparkSession)
    flow_of = siting.routed(cells, cell_m, tree=True).checkpoint()
    survey_of = siting.surveyed(cells, cell_m, features, flow_of, **options)
    best = siting.sites(cells, cell_m, survey_of=survey_of, **options).withColumn("site_id", F.xxhash64("grid_id", "rank")).checkpoint()
    sites = pour_points(best, flow_of, cell_m, snap_m).join(siting.storage(survey_of, best, cell_m), ["grid_id", "rank"]).checkpoint()
    members, metrics = site_catchments(cells, sites, cell_m, flow_of)
    metrics = metrics.checkpoint()
    water = site_water(members, cells, metrics, daily, group)
    s = sites.join(metrics.select("site_id", "area_m2", "relief_m", "tc_min", "touches_edge").withColumnRenamed("area_m2", "catchment_m2"), "site_id").join(water, "site_id", "left")
    s = s.withColumns({"area_m2": F.col("usable_m2"), "runoff_m3": F.col("annual_m3"), "water_table_m": F.lit(None).cast("double"), "budget": F.lit(None).cast("double")})
    s = pond.design(s)
    s = s.withColumns({
        "runoff_mm": F.col("monthly_mm"), "et0_mm": F.array(*[F.lit(float(x)) for x in et0_mm]), "soil": group, "bottom_length": F.col("pond.bottom_m"), "bottom_width": F.col("pond.bottom_m"),
        "depth": F.col("pond.depth_m"), "side_slope": F.lit(hydro.SIDE_SLOPE), "capacity_m3": F.col("pond.gross_m3"),
    })
    s = pond.water_balance(s).withColumn("expected", pond.expected_water(F.col("pond.live_m3"), F.col("dependable_m3")))
    margin = F.col("score") - F.lead("score").over(Window.partitionBy("grid_id").orderBy("rank"))
    s = s.withColumn("margin", F.when(F.col("rank") == 1, margin))
    words = decide.explanation(F.col("rank"), F.col("kind"), F.col("score"), decide.top_criteria(F.col("criteria")), F.col("margin"), F.col("expected.limited_by"))
    reason = survey.unavailable_reason(F.col("pond.gross_m3").isNotNull(), F.col("monthly_mm").isNotNull(), F.lit(len(et0_mm) == 12))
    return s.select(
        "grid_id", "rank", "kind", "row", "col", "outlet_row", "outlet_col", "snapped_m", "score", "catchment_m2", "usable_m2", F.col("pond.terrain_m3").alias("terrain_m3"), "relief_m", "tc_min", "cn2", "annual_m3", "dependable_m3",
        F.col("pond.depth_m").alias("depth_m"), F.col("pond.gross_m3").alias("gross_m3"), F.col("pond.live_m3").alias("live_m3"), F.col("pond.cost").alias("cost"), F.col("pond.binding").alias("binding"),
        F.col("balance.months_with_water").alias("months_with_water"), F.col("balance.spill_m3").alias("spill_m3"), F.col("expected.m3").alias("expected_m3"), F.col("expected.limited_by").alias("limited_by"),
        pond.capture_pct(F.col("pond.gross_m3"), F.col("annual_m3")).alias("capture_pct"), decide.confidence(F.col("touches_edge"), F.col("relief_m")).alias("confidence"), reason.alias("unavailable"), words.alias("explanation"),
    )



def analyse_maps(lines: DataFrame, with_cover, daily: DataFrame, et0_mm: list[float], **options) -> DataFrame:  # noqa: ANN001, ANN003
    """Contour lines(map_id, elevation_m, coords) -> analyse's rows with map_id. with_cover puts a land-cover column to cells. Maps of one cell size go together; there are no more sizes than steps of the ladder."""
    flow.shared_checkpoints(lines.sparkSession)
    cells, frames = gridded(lines)
    cells, frames = with_cover(cells).checkpoint(), frames.checkpoint()
    out = None
    for size in sorted(r.cell_m for r in frames.select("cell_m").distinct().collect()):
        of_size = cells.join(frames.where(F.col("cell_m") == size).select("grid_id"), "grid_id", "left_semi")
        got = analyse(of_size, size, daily, et0_mm, **options)
        out = got if out is None else out.unionByName(got)
    return out.join(frames.select("grid_id", "map_id"), "grid_id")


def reports(rows: DataFrame) -> DataFrame:
    """D-15..D-17, SNK-06: analyse's rows -> grid_id, report: a JSON text with the headline (the best site), the sites in order with their catchment, water, pond (or why there is none) and words, and how many have water all year."""
    water = F.struct(F.col("expected_m3").alias("m3"), F.col("limited_by").alias("limited_by"))
    site = F.struct(
        "rank", "kind", F.round("score", 1).alias("score"), F.struct("row", "col").alias("cell"),
        F.struct(F.round(F.col("catchment_m2") / 10_000, 2).alias("ha"), F.round("relief_m", 2).alias("relief_m"), "confidence").alias("catchment"),
        F.struct(F.round("annual_m3", 1).alias("annual_m3"), F.round("dependable_m3", 1).alias("dependable_m3"), F.round("cn2", 1).alias("curve_number")).alias("runoff"),
        F.when(F.col("unavailable").isNull(), F.struct(F.round("depth_m", 2).alias("depth_m"), F.round("gross_m3", 1).alias("gross_m3"), F.round("cost", 0).alias("cost"), "binding", "months_with_water")).alias("pond"),
        "unavailable", "explanation",
    )
    head = survey.site_summary(F.col("rank"), F.round("score", 1), F.col("col").cast("double"), F.col("row").cast("double"), F.col("catchment_m2") / 10_000, water)
    g = rows.groupBy("grid_id").agg(F.min_by(head, "rank").alias("headline"), F.array_sort(F.collect_list(site)).alias("sites"), F.count_if(F.col("months_with_water") == 12).alias("all_year"))
    return g.select("grid_id", F.to_json(F.struct("headline", "sites", "all_year")).alias("report"))
