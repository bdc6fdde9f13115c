"""Available land, siting vetoes, parcels and tenure."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions import classify
from rillwork.operators import flow, kernels, registers

# Metres kept clear, and land rules.
LAND_BUFFERS = {"building": 50.0, "road": 20.0, "track": 5.0, "water": 100.0, "landuse": 0.0}
SITE_BUFFERS = {"standing": 0.0, "major": 50.0, "building": 50.0, "road": 20.0}
COVER_WATER, COVER_WATER_BUFFER, MAX_UPSTREAM_HA = (80, 90, 95), 20.0, 2000.0
MAX_SLOPE, MIN_AREA_M2, KERNEL = 5.0, 400.0, 5
#: Cells that one task makes at burning, on average.
MOST_BURNED = 1 << 18


def burned(features: DataFrame, cell_m: float, buffers: dict[str, float]) -> DataFrame:
    """J-19: features(grid_id, kind, x array<double>, y array<double>, closed; in metres from the grid's corner, y downwards) -> grid_id, row, col, kind of cells that the shape, widened by its kind's
    buffer, touches. A feature is cut into its segments first, so a long line is many short rows; the inside of closed shapes is added from their box.

    A cell is touched if its square is within the buffer of the shape; tangent squares count. A few shapes can touch very many cells, so rows of cells are dealt over as many tasks as there are cells to look at
    before they are made; all shapes meet the row in the same task, which drops repeats.
    """
    reach = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in buffers.items() for x in kv]), F.col("kind")), F.lit(0.0))
    f = features.withColumn("reach", reach)
    n = F.size("x")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.element_at("x", i).alias("x0"), F.element_at("y", i).alias("y0"), F.element_at("x", i % n + 1).alias("x1"), F.element_at("y", i % n + 1).alias("y1"), (i == n).alias("last")))
    seg = f.where("size(x) > 0").select("grid_id", "kind", "reach", "closed", F.explode(ends).alias("s")).select("grid_id", "kind", "reach", "closed", "s.*").where("closed or not last")
    lo = lambda a, b: F.greatest(F.lit(0), F.ceil((F.least(a, b) - F.col("reach")) / cell_m - 1e-9).cast("int") - 1)
    hi = lambda a, b: F.floor((F.greatest(a, b) + F.col("reach")) / cell_m + 1e-9).cast("int")
    near = seg.withColumns({"c0": lo("x0", "x1"), "c1": hi("x0", "x1"), "r0": lo("y0", "y1"), "r1": hi("y0", "y1")}).where("c1 >= c0 and r1 >= r0")
    lines = near.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("beyond", F.lit(None).cast("array<double>"))
    solid = f.where("closed and size(x) > 2").withColumn("ring", F.arrays_zip("x", "y"))
    box = solid.withColumns({"c0": F.greatest(F.lit(0), F.floor(F.array_min("x") / cell_m).cast("int")), "c1": F.floor(F.array_max("x") / cell_m).cast("int"), "r0": F.greatest(F.lit(0), F.floor(F.array_min("y") / cell_m).cast("int")), "r1": F.floor(F.array_max("y") / cell_m).cast("int")}).where("c1 >= c0 and r1 >= r0")
    inner = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("beyond", registers.crossings((F.col("row") + 0.5) * cell_m, F.col("ring")))
    size = lambda d: d.select(((F.col("c1") - F.col("c0") + 1).cast("long") * (F.col("r1") - F.col("r0") + 1)).alias("n"))
    n = size(near).unionByName(size(box)).agg(F.sum("n")).first()[0] or 0
    rows = lines.select("grid_id", "kind", "reach", "row", "c0", "c1", "beyond", "x0", "y0", "x1", "y1").unionByName(inner.select("grid_id", "kind", "reach", "row", "c0", "c1", "beyond"), allowMissingColumns=True)
    cells = rows.repartition(1 + n // MOST_BURNED, "grid_id", "row").withColumn("col", F.explode(F.sequence("c0", "c1")))
    hit = F.when(F.col("beyond").isNull(), _square_to_segment(cell_m) <= F.col("reach") + 1e-9).otherwise(registers.odd_before(F.col("beyond"), (F.col("col") + 0.5) * cell_m))
    return cells.where(hit).select("grid_id", "row", "col", "kind").distinct()


def _square_to_segment(cell_m: float) -> Column:
    """Distance between a cell's square and a segment: 0 if they cross, else the least of corner to segment and end to square."""
    cx, cy, h = (F.col("col") + 0.5) * cell_m, (F.col("row") + 0.5) * cell_m, cell_m / 2
    x0, y0, dx, dy = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy

    def to_segment(px: Column, py: Column) -> Column:
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.nullif(square, F.lit(0.0)))), F.lit(0.0))
        return F.hypot(px - x0 - t * dx, py - y0 - t * dy)

    def to_square(px: Column, py: Column) -> Column:
        return F.hypot(F.greatest(F.abs(px - cx) - h, F.lit(0.0)), F.greatest(F.abs(py - cy) - h, F.lit(0.0)))

    corners = [to_segment(cx + sx * h, cy + sy * h) for sx in (-1, 1) for sy in (-1, 1)]
    # the line separates no pair of corners, or the boxes don't meet: then there is no crossing
    sides = [dx * (cy + sy * h - y0) - dy * (cx + sx * h - x0) for sx in (-1, 1) for sy in (-1, 1)]
    meets = (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0) & (F.least(x0, F.col("x1")) <= cx + h) & (F.greatest(x0, F.col("x1")) >= cx - h) & (F.least(y0, F.col("y1")) <= cy + h) & (F.greatest(y0, F.col("y1")) >= cy - h)
    return F.when(meets, F.lit(0.0)).otherwise(F.least(*corners, to_square(x0, y0), to_square(F.col("x1"), F.col("y1"))))


def vetoes(cells: DataFrame, features: DataFrame, cell_m: float, max_upstream_ha: float = MAX_UPSTREAM_HA) -> DataFrame:
    """D-12: cells(cover, acc) with the reasons against a pond (array) and excluded; features have kinds standing, major, building, road."""
    hits = burned(features.where(F.col("kind").isin(*SITE_BUFFERS)), cell_m, SITE_BUFFERS)
    wet = flow.dilated(cells.where(F.col("cover").isin(*COVER_WATER)), COVER_WATER_BUFFER / cell_m).withColumn("kind", F.lit("land_cover_water"))
    # a bit a kind: sets of names would be put together by sorting all cells
    kinds = (*SITE_BUFFERS, "land_cover_water")
    bit = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, 1 << k)]), F.col("kind"))
    why = hits.unionByName(wet).groupBy("grid_id", "row", "col").agg(F.bit_or(bit).alias("why"))
    d = cells.join(why, ["grid_id", "row", "col"], "left")
    named = [F.when(F.col("why").bitwiseAND(F.lit(1 << k)) != 0, kind) for k, kind in enumerate(kinds)]
    more = [F.when(F.col("cover") == 50, "built_up"), F.when(F.col("acc") * cell_m**2 / 10_000 > max_upstream_ha, "large_river")]
    all_ = F.array_sort(F.filter(F.array(*named, *more), lambda x: x.isNotNull()))
    return d.withColumn("reasons", all_).withColumn("excluded", F.size("reasons") > 0).drop("why")


def outside_veto(cells: DataFrame, cell_m: float) -> DataFrame:
    """S-02: cells(excluded, ring: the drawn area in metres from the grid's corner, y downwards) with inside, by the cell's centre, and excluded also outside of it."""
    inside = registers.inside((F.col("col") + 0.5) * cell_m, (F.col("row") + 0.5) * cell_m, F.col("ring"))
    return cells.withColumn("inside", inside).withColumn("excluded", F.col("excluded") | ~inside).drop("ring")


def removed_by(cells: DataFrame) -> DataFrame:
    """A-18: grid_id, reason, cells; a cell counts under each of its reasons."""
    return cells.select("grid_id", F.explode("reasons").alias("reason")).groupBy("grid_id", "reason").agg(F.count(F.lit(1)).alias("cells"))


def available(cells: DataFrame, blocked: DataFrame, max_slope: float = MAX_SLOPE, cropland: bool = False) -> DataFrame:
    """D-11, S-01: cells(z, slope_pct, cover) with `available` after cleaning: gentle, allottable and not in blocked(grid_id, row, col)."""
    b = blocked.select("grid_id", "row", "col").distinct().withColumn("__b", F.lit(True))
    ok = F.col("z").isNotNull() & (F.col("slope_pct") <= max_slope) & classify.may_allot(F.col("cover"), cropland) & F.col("__b").isNull()
    d = cells.join(b, ["grid_id", "row", "col"], "left").withColumn("raw", F.coalesce(ok, F.lit(False)).cast("double")).drop("__b")
    clean = kernels.on_grids(d, lambda m, x: {"available": kernels.opened_closed(m > 0, KERNEL) & np.isfinite(x["z"])}, "available boolean", "raw", ("z",))
    return d.drop("raw").join(clean, ["grid_id", "row", "col"])


def parcels(cells: DataFrame, cell_m: float, min_area: float = MIN_AREA_M2) -> DataFrame:
    """A-17, W-07: components of available cells of min_area or more: grid_id, parcel_id (1 is the largest), cells, area_m2, centre, slopes, the commonest cover (smallest code of equals), mean flow."""
    on = cells.where("available")
    lab = flow.components(on)
    j = on.join(lab, ["grid_id", "row", "col"])
    g = j.groupBy("grid_id", "label").agg(
        F.count(F.lit(1)).alias("cells"),
        F.rint(F.avg("row")).cast("int").alias("row"),
        F.rint(F.avg("col")).cast("int").alias("col"),
        F.avg("slope_pct").alias("mean_slope_pct"),
        F.max("slope_pct").alias("max_slope_pct"),
        F.avg("acc").alias("mean_acc"),
    )
    g = g.where(F.col("cells") >= max(1, round(min_area / cell_m**2))).withColumn("area_m2", F.col("cells") * cell_m**2)
    common = j.where("cover > 0").groupBy("grid_id", "label", "cover").agg(F.count(F.lit(1)).alias("n")).groupBy("grid_id", "label").agg(F.max_by("cover", F.struct("n", -F.col("cover"))).alias("cover"))
    rank = F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("cells"), "label"))
    return g.join(common, ["grid_id", "label"], "left").withColumn("parcel_id", rank).drop("label")


def tenure(sites: DataFrame, layer: DataFrame, bucket: float = 0.01) -> DataFrame:
    """J-12: sites(site_id, x, y), layer(parcel_id, ring, owner; parcel_id in the layer's order) -> site_id, parcel_id, tenure by the first parcel around a site."""
    # later parcels of the same ring are never an answer, and their owners don't matter
    once = layer.groupBy("ring").agg(F.min_by(F.struct("parcel_id", "owner"), "parcel_id").alias("m")).select("ring", F.col("m.parcel_id").alias("area_id"), F.col("m.owner").alias("owner"))
    got = registers.containing(sites.select(F.col("site_id").alias("point_id"), "x", "y"), once.select("area_id", "ring", F.col("area_id").alias("size")), bucket)
    owners = once.select("area_id", classify.is_public(F.col("owner")).alias("public"))
    j = got.join(owners, "area_id", "left")
    return j.select(F.col("point_id").alias("site_id"), F.col("area_id").alias("parcel_id"), F.when(F.col("area_id").isNull(), "unknown").when(F.col("public"), "allottable").otherwise("privately held").alias("tenure"))


