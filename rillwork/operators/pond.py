"""Pond design, monthly water balance and their reports, as Column expressions and one Arrow kernel: each row is a site."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import hydro

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
NEWTON = 16


def interpolate(x: Column, points: Column) -> Column:
    """points: array<struct<x, y>> by ascending x; linear between, the end values beyond."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    lo = F.element_at(F.filter(points, lambda p: p["x"] <= x), -1)
    hi = F.element_at(F.filter(points, lambda p: p["x"] > x), 1)
    return F.when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (x - lo["x"]) / (hi["x"] - lo["x"]))


def design(sites: DataFrame, side_slope: float = hydro.SIDE_SLOPE, depths: tuple[float, float] = hydro.POND_DEPTHS, rate: float = hydro.EXCAVATION_RATE) -> DataFrame:
    """D-09: sites(area_m2, runoff_m3, water_table_m, budget, curve array<struct<x, y>>) -> sites with `pond`.

    Depth is the smallest limit by name: practical depth, water table, plan geometry; the budget takes off quarter metres down to the least depth; a pond of more than its share of
    a year's runoff shrinks in all dimensions. The binding limit is the smallest, of equals the first named. Null runoff, water table, budget or curve mean: not given.
    """
    least, most = depths
    z = F.lit(side_slope)
    area, runoff = F.col("area_m2").cast("double"), F.when(F.col("runoff_m3") > 0, F.col("runoff_m3").cast("double"))
    d = sites.withColumn("__side", F.sqrt(F.greatest(area, F.lit(1.0))))
    table = F.when(F.col("water_table_m").isNotNull(), F.greatest(F.lit(0.0), F.col("water_table_m") - 1.0))
    cap0 = F.least(F.lit(most), F.coalesce(table, F.lit(most)))
    geometry = F.col("__side") / (2 * z) * 0.98
    d = d.withColumns({"__cap0": cap0, "__table": table}).withColumn("__geo", F.when(geometry < F.col("__cap0"), geometry))
    d = d.withColumn("__cap", F.coalesce("__geo", "__cap0")).withColumn("__d0", F.when(F.col("__cap") < least, F.greatest(F.col("__cap"), F.lit(0.5))).otherwise(F.col("__cap")))
    volume = lambda side, depth: hydro.prismoidal(side, side, depth, z)["volume"]
    # the first depth, going down by quarter metres, that the budget pays for or that isn't above the least
    steps = F.transform(F.sequence(F.lit(0), F.lit(int((most - 0.5) / 0.25) + 2)), lambda k: F.col("__d0") - 0.25 * k)
    pays = F.filter(steps, lambda x: (x <= least) | (volume(F.col("__side"), x) * rate <= F.col("budget")))
    d = d.withColumn("__d1", F.when(F.col("budget") > 0, F.element_at(pays, 1)).otherwise(F.col("__d0")))
    d = d.withColumn("__v1", volume(F.col("__side"), F.col("__d1")))
    scale = F.when(F.col("__v1") > hydro.YIELD_SHARE * runoff, F.pow(hydro.YIELD_SHARE * runoff / F.col("__v1"), 1.0 / 3.0))
    d = d.withColumn("__scale", scale).withColumns({"__depth": F.col("__d1") * F.coalesce("__scale", F.lit(1.0)), "__top": F.col("__side") * F.coalesce("__scale", F.lit(1.0))})
    d = d.withColumn("__p", hydro.prismoidal(F.col("__top"), F.col("__top"), F.col("__depth"), z))
    limit = lambda name, value, order: F.struct(value.cast("double").alias("value"), F.lit(order).alias("order"), F.lit(name).alias("name"))
    share = F.when(runoff.isNotNull(), F.when(F.col("__scale").isNotNull(), F.col("__depth")).otherwise(F.lit(most)))
    limits = F.filter(
        F.array(
            limit("practical_excavation_depth", F.lit(most), 0),
            limit("water_table_clearance", F.col("__table"), 1),
            limit("sustainable_yield_share", share, 2),
            limit("plan_area_geometry", F.col("__geo"), 3),
            limit("budget", F.when(F.col("budget") > 0, F.col("__d1")), 4),
        ),
        lambda x: x["value"].isNotNull(),
    )
    v = F.col("__p.volume")
    bank = hydro.EMBANKMENT_SHARE * v
    pond = F.struct(
        F.col("__depth").alias("depth_m"),
        F.col("__top").alias("top_m"),
        F.col("__p.bottom_length").alias("bottom_m"),
        v.alias("gross_m3"),
        (hydro.SILT * v).alias("dead_m3"),
        ((1 - hydro.SILT) * v).alias("live_m3"),
        bank.alias("embankment_m3"),
        (v * rate + bank * hydro.EMBANKMENT_RATE).alias("cost"),
        F.try_divide(v, runoff).alias("fill_ratio"),
        interpolate(F.col("__depth"), F.col("curve")).alias("terrain_m3"),
        F.array_min(limits)["name"].alias("binding"),
        F.map_from_entries(F.transform(limits, lambda x: F.struct(x["name"], F.round(x["value"], 3)))).alias("limits"),
        (F.col("__cap") < least).alias("too_shallow"),
    )
    return d.withColumn("pond", pond).drop("__side", "__cap0", "__table", "__geo", "__cap", "__d0", "__d1", "__v1", "__scale", "__depth", "__top", "__p")


def water_balance(sites: DataFrame) -> DataFrame:
    """D-10, A-32: sites(runoff_mm (12), et0_mm (12), catchment_m2, bottom_length, bottom_width, depth, side_slope, capacity_m3, soil) -> sites with `balance`.

    Three years of months from an empty pond, as 36 array steps over all sites of a batch; the last year is reported. Losses follow the surface at the month's start and never exceed what is there. Sites without
    twelve months, depth or capacity have no balance.
    """
    numbers = ("catchment_m2", "bottom_length", "bottom_width", "side_slope", "depth", "capacity_m3")
    seepage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hydro.SEEPAGE_MM_PER_DAY.items() for x in kv]), F.upper("soil")), F.lit(hydro.DEFAULT_SEEPAGE))
    ok = (F.col("depth") > 0) & (F.col("capacity_m3") > 0)
    for c in ("runoff_mm", "et0_mm"):
        ok = ok & (F.size(c) == 12) & F.forall(c, lambda x: x.isNotNull())
    for c in numbers[:4]:
        ok = ok & F.col(c).isNotNull()
    months = lambda c: F.when(ok, F.col(c).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), 12))
    balance = _balances()(months("runoff_mm"), months("et0_mm"), *[F.coalesce(F.when(ok, F.col(c)).cast("double"), F.lit(1.0)) for c in numbers], seepage)
    return sites.withColumn("balance", F.when(ok, balance))


def _balances():  # noqa: ANN202
    """water_balance's kernel as a Column function; made when used, as that needs a session."""
    month = (("month", pa.int32()), *[(n, pa.float64()) for n in ("inflow", "evaporation", "seepage", "spill", "storage", "depth", "area")])

    def kernel(runoff: pa.Array, et0: pa.Array, catchment: pa.Array, bl: pa.Array, bw: pa.Array, z: pa.Array, depth: pa.Array, capacity: pa.Array, seepage: pa.Array) -> pa.Array:
        rain, evap = (x.flatten().to_numpy(zero_copy_only=False).reshape(-1, 12) for x in (runoff, et0))
        catchment, bl, bw, z, depth, capacity, seepage = (x.to_numpy(zero_copy_only=False) for x in (catchment, bl, bw, z, depth, capacity, seepage))
        n = len(rain)
        surface = lambda d: (bl + 2 * z * d) * (bw + 2 * z * d)
        volume = lambda d: d / 3 * (surface(d) + bl * bw + np.sqrt(surface(d) * bl * bw))
        whole, storage, area, rows = volume(depth), np.zeros(n), np.zeros(n), []
        for i in range(12 * hydro.SPIN_UP_YEARS):
            m = i % 12
            inflow = rain[:, m] / 1000 * catchment
            out, leak = evap[:, m] * hydro.OPEN_WATER / 1000 * area, seepage * hydro.DAYS_IN_MONTH[m] / 1000 * area
            full, wanted = storage + inflow, out + leak
            held = np.minimum(full, capacity)
            lost = np.minimum(held, wanted)
            share = np.divide(lost, wanted, out=np.zeros(n), where=wanted > 0)
            storage = np.maximum(0.0, held - lost)
            # Newton's steps down from the full depth, as volume is convex in depth
            d = depth.copy()
            for _ in range(NEWTON):
                d = np.clip(d - (volume(d) - storage) / surface(d), 0.0, depth)
            d = np.where(storage <= 0, 0.0, np.where(storage >= whole, depth, d))
            area = np.where(storage > 0, surface(d), 0.0)
            rows.append((np.full(n, m, np.int32), inflow, out * share, leak * share, np.maximum(0.0, full - capacity), storage, d, area))
        year = rows[-12:]
        cube = {name: np.stack([r[k] for r in year], 1) for k, (name, _) in enumerate(month)}
        wet = cube["storage"] > hydro.USABLE_FRACTION * capacity[:, None]
        peak = cube["storage"].argmax(1)
        after = (peak[:, None] + 1 + np.arange(12)) % 12
        dry = ~np.take_along_axis(wet, after, 1)
        first = after[np.arange(n), dry.argmax(1)]
        total = lambda name: pa.array(cube[name].sum(1))
        parts = pa.StructArray.from_arrays([pa.array(cube[name].ravel(), kind) for name, kind in month], [name for name, _ in month])
        count = wet.sum(1)
        columns = {
            "months": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 12, pa.int32()), parts),
            "months_with_water": pa.array(count, pa.int32()),
            "reliability_pct": pa.array(100.0 * count / 12),
            "peak_m3": pa.array(cube["storage"].max(1)),
            "spill_m3": total("spill"),
            "evaporation_m3": total("evaporation"),
            "seepage_m3": total("seepage"),
            "dry_month": pa.array(np.array([*MONTHS, None], object)[np.where(dry.any(1), first, 12)], pa.string()),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    each = "month int, inflow double, evaporation double, seepage double, spill double, storage double, depth double, area double"
    return F.arrow_udf(kernel, f"months array<struct<{each.replace(' ', ':').replace(',:', ', ')}>>, months_with_water int, reliability_pct double, peak_m3 double, spill_m3 double, evaporation_m3 double, seepage_m3 double, dry_month string")


def expected_water(live: Column, dependable: Column) -> Column:
    """D-14: struct(m3, limited_by): the smaller of what the pond holds and what a dependable year brings; without the latter, what it holds; null without a pond."""
    by = F.when(dependable < live, "inflow").otherwise("storage")
    return F.when(live.isNotNull(), F.struct(F.least(live, dependable).alias("m3"), by.alias("limited_by")))


def capture_pct(capacity: Column, runoff: Column) -> Column:
    """D-22 (of mean runoff), X-34 (of dependable runoff): null without runoff."""
    return F.when(runoff > 0, 100 * capacity / runoff)


def cost_per_m3(cost: Column, live: Column) -> Column:
    return F.when(live > 0, cost / live)
