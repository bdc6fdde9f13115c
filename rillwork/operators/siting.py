"""Pond siting on grids: masks, scores, candidate regions and the best sites, for many grids at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.operators import decide, flow, kernels, land, terrain, tiled
from rillwork.operators import streams as network

MAX_SLOPE, MIN_UPSTREAM_HA, THRESHOLD, SEPARATION, SATURATION, MIN_DEPTH, MIN_REGION_M2, EDGE = 8.0, 1.0, 0.55, 300.0, 3.0, 0.3, 100.0, 3
# Land-cover classes and how far they may be used for ponds.
AVAILABILITY = {10: 0.05, 20: 0.7, 30: 0.85, 40: 0.3, 50: 0.0, 60: 1.0, 70: 0.0, 80: 0.0, 90: 0.1, 95: 0.0, 100: 0.3}


def availability(cover: Column) -> Column:
    """P-14: unknown classes count 0; null without land cover."""
    table = F.create_map(*[F.lit(x) for kv in AVAILABILITY.items() for x in kv])
    return F.when(cover.isNotNull(), F.coalesce(F.try_element_at(table, cover), F.lit(0.0)))


def least_cells(hectares: float, cell_m: float) -> int:
    """P-11, P-12: cells that make an area, 1 at least."""
    return max(1, round(hectares * 10_000 / cell_m**2))


def masks(cells: DataFrame, cell_m: float, max_slope: float = MAX_SLOPE, upstream_ha: float = MIN_UPSTREAM_HA) -> DataFrame:
    """P-10, P-11: cells(z, slope_pct, acc, availability?, excluded?) with buildable and feasible. Grids of up to twice the edge buffer have no buildable cell."""
    sizes = cells.groupBy("grid_id").agg(F.max("row").alias("__r"), F.max("col").alias("__c"))
    inner = (F.col("row") >= EDGE) & (F.col("col") >= EDGE) & (F.col("row") <= F.col("__r") - EDGE) & (F.col("col") <= F.col("__c") - EDGE)
    ok = F.col("z").isNotNull() & (F.col("slope_pct") <= max_slope) & inner
    if "availability" in cells.columns:
        ok = ok & (F.col("availability").isNull() | (F.col("availability") > 0))
    if "excluded" in cells.columns:
        ok = ok & ~F.coalesce("excluded", F.lit(False))
    built = F.coalesce(ok, F.lit(False))
    return cells.join(sizes, "grid_id").withColumn("buildable", built).withColumn("feasible", built & (F.col("acc") >= least_cells(upstream_ha, cell_m))).drop("__r", "__c")


def scored(cells: DataFrame, override: dict[str, float] | None = None) -> DataFrame:
    """D-02: cells(feasible, acc, slope_pct, fill_depth, concavity, availability?) with score 0..1; criteria are scaled over the feasible cells of each grid."""
    made = cells.withColumns({"__a": F.log1p(F.col("acc").cast("double")), "__d": F.least(F.coalesce("fill_depth", F.lit(0.0)), F.lit(SATURATION))})
    p = lambda c: F.percentile(F.when(F.col("feasible"), F.col(c)), F.array(F.lit(0.02), F.lit(0.98)))
    bounds = made.groupBy("grid_id").agg(p("__a").alias("__ba"), p("slope_pct").alias("__bs"), p("__d").alias("__bd"), p("concavity").alias("__bc"))
    j = made.join(bounds, "grid_id")
    n = lambda c, b, inv=False: terrain.normalised(F.col(c).cast("double"), F.col(b)[0], F.col(b)[1], inv)
    layers = {"flow_accumulation": n("__a", "__ba"), "slope": n("slope_pct", "__bs", True), "depression_depth": n("__d", "__bd"), "plan_concavity": n("concavity", "__bc")}
    if "availability" in cells.columns:
        layers["land_availability"] = F.coalesce("availability", F.lit(0.0))
    return j.withColumn("score", F.coalesce(decide.weighted_score(layers, F.col("feasible"), override), F.lit(0.0))).drop("__a", "__d", "__ba", "__bs", "__bd", "__bc")


def regions(cells: DataFrame, cell_m: float, threshold: float = THRESHOLD, min_depth: float = MIN_DEPTH) -> DataFrame:
    """A-11, A-12, D-04: candidate regions of each grid: natural depressions (the pond goes to the deepest feasible, or else buildable, cell; its outlet is the cell of most flow) and clusters of
    high scores along channels (both at the cell of most flow). Means go over the region's allowed cells."""

    def find(z: np.ndarray, x: dict[str, np.ndarray]) -> list[dict]:
        feasible, out = x["feasible"] > 0, []
        flat = {k: v.ravel() for k, v in x.items()}
        place = lambda at: divmod(int(at), z.shape[1])

        def add(kind: str, own: np.ndarray, allowed: np.ndarray, site: int) -> None:
            """own, allowed: flat indices of cells."""
            top = own[flat["acc"][own].argmax()]
            mean = lambda v: float(np.nanmean(v)) if np.isfinite(v).any() else None
            (row, col), (outlet_row, outlet_col) = place(site), place(top)
            means = {k: mean(flat[k][allowed]) for k in ("slope_pct", "concavity", "availability")}
            out.append({"kind": kind, "cells": len(own), "row": row, "col": col, "outlet_row": outlet_row, "outlet_col": outlet_col, "depth_m": float(np.nanmax(np.append(flat["fill_depth"][own], 0))), "acc": int(flat["acc"][top])} | means)

        least = max(4, int(MIN_REGION_M2 / cell_m**2))
        for own in kernels.by_label(kernels.label(np.nan_to_num(x["fill_depth"]) >= min_depth)):
            if len(own) >= least:
                allowed = own[flat["feasible"][own] > 0]
                allowed = allowed if len(allowed) else own[flat["buildable"][own] > 0]
                if len(allowed):
                    add("natural_depression", own, allowed, allowed[np.nan_to_num(flat["fill_depth"][allowed], nan=-1).argmax()])
        for own in kernels.by_label(kernels.clusters(feasible & (x["score"] >= threshold)) + 1):
            add("channel_position", own, own, own[flat["acc"][own].argmax()])
        return out

    d = cells.withColumns({c: F.col(c).cast("double") for c in ("feasible", "buildable", "acc", "fill_depth", "slope_pct", "concavity", "score")})
    d = d.withColumn("availability", F.col("availability").cast("double") if "availability" in cells.columns else F.lit(None).cast("double"))
    schema = "kind string, cells long, row int, col int, outlet_row int, outlet_col int, depth_m double, acc long, slope_pct double, concavity double, availability double"
    return kernels.rows_on_grids(d, find, schema, extra=("feasible", "buildable", "acc", "fill_depth", "slope_pct", "concavity", "availability", "score"))


def routed(cells: DataFrame, cell_m: float, tree: bool = False) -> DataFrame:
    """grid_id, row, col, filled, fdir, acc: the filled surface and its flow, by tiles; with places in the trees of ends if asked for."""
    return tiled.routed(cells, cell_m, tree=tree)


def surveyed(cells: DataFrame, cell_m: float, features: DataFrame | None = None, flow_of: DataFrame | None = None, max_slope: float = MAX_SLOPE, upstream_ha: float = MIN_UPSTREAM_HA, **_: float) -> DataFrame:
    """P-10, P-11, D-02: cells(grid_id, row, col, z, cover?) with slope, flow, masks and score; checkpointed. Routing is on the filled surface (flow_of, as of routed, if it is there already), slope and concavity on the ground."""
    flow.shared_checkpoints(cells.sparkSession)
    ground = terrain.concavity(terrain.slope(cells, cell_m))
    d = ground.join((routed(cells, cell_m) if flow_of is None else flow_of).select("grid_id", "row", "col", "filled", "fdir", "acc"), ["grid_id", "row", "col"]).withColumn("fill_depth", F.col("filled") - F.col("z"))
    if "cover" in cells.columns:
        d = d.withColumn("availability", availability(F.col("cover")))
    if features is not None:
        # masks and scores read the cells three times; vetoes are worked out once
        d = land.vetoes(d, features, cell_m).checkpoint()
    return scored(masks(d, cell_m, max_slope, upstream_ha)).checkpoint()


def sites(cells: DataFrame, cell_m: float, most: int = 5, separation: float = SEPARATION, features: DataFrame | None = None, flow_of: DataFrame | None = None, survey_of: DataFrame | None = None, **options: float) -> DataFrame:
    """D-05: cells(grid_id, row, col, z, cover?) -> the best sites of each grid: grid_id, rank, kind, row, col, outlet, score (0..100), the region's figures and its criteria. Cells that are excluded, or that features veto, have none.

    survey_of: the cells as surveyed gives them, if they are there already.
    """
    s = surveyed(cells, cell_m, features, flow_of, **options) if survey_of is None else survey_of
    r = regions(s, cell_m, options.get("threshold", THRESHOLD), options.get("min_depth", MIN_DEPTH))
    r = decide.score_candidates(r.withColumn("site_id", F.col("row").cast("long") * 1_000_000 + F.col("col")).checkpoint())
    best = decide.spaced_best(r.select("grid_id", "site_id", (F.col("col") * cell_m).alias("x"), (F.col("row") * cell_m).alias("y"), "score"), separation, most)
    names = ("kind", "row", "col", "outlet_row", "outlet_col", "cells", "depth_m", "acc", "slope_pct")
    one = r.groupBy("grid_id", "site_id").agg(F.max(F.struct("score", *names, "criteria")).alias("r"))
    return best.join(one, ["grid_id", "site_id"]).select("grid_id", "rank", "score", *[f"r.{c}" for c in (*names, "criteria")])


def storage(survey_of: DataFrame, sites: DataFrame, cell_m: float) -> DataFrame:
    """G-18, G-19: grid_id, rank, usable_m2 (buildable land around the site, at most 2 ha), capped, and curve array<struct<x: depth, y: volume>> of the ground there, up to where the water would spread too far. One kernel a grid."""

    def around(z: np.ndarray, x: dict[str, np.ndarray]) -> list[dict]:
        out, buildable = [], x["buildable"] > 0
        for r, c in np.argwhere(np.isfinite(x["rank"])).tolist():
            usable, capped = kernels.footprint(buildable, r, c, cell_m)
            curve = kernels.stage_curve(z, r, c, cell_m) if np.isfinite(z[r, c]) else []
            kept = [p for p in curve if not p["unbounded"]]
            out.append({"rank": int(x["rank"][r, c]), "usable_m2": usable, "capped": capped, "depths": [p["depth_m"] for p in kept], "volumes": [p["volume_m3"] for p in kept]})
        return out

    at = sites.select("grid_id", "row", "col", F.col("rank").cast("double").alias("rank"))
    marked = survey_of.select("grid_id", "row", "col", "z", F.col("buildable").cast("double").alias("buildable")).join(at, ["grid_id", "row", "col"], "left")
    got = kernels.rows_on_grids(marked, around, "rank int, usable_m2 double, capped boolean, depths array<double>, volumes array<double>", extra=("buildable", "rank"))
    return got.withColumn("curve", F.when(F.size("depths") > 1, F.transform(F.arrays_zip("depths", "volumes"), lambda p: F.struct(p["depths"].alias("x"), p["volumes"].alias("y"))))).drop("depths", "volumes")


def streams(cells: DataFrame, cell_m: float, threshold_ha: float = 1.0, within: DataFrame | None = None) -> DataFrame:
    """G-15: the reaches (see streams.reaches) of each grid's filled surface, or of the cells of a catchment."""
    return network.reaches(routed(cells, cell_m), least_cells(threshold_ha, cell_m), cell_m, within)
