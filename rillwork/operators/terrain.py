"""Terrain derivatives of many grids at once, as Column expressions over neighbours.

cells: grid_id, row, col, z and more; a grid is dense and nodata is null. Neighbours come from windows along rows and columns, which need one exchange by
grid_id for all of them; nothing is exploded or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbour order, offsets and pointer codes of D8.
D8 = (("e", 0, 1, 1), ("se", 1, 1, 2), ("s", 1, 0, 4), ("sw", 1, -1, 8), ("w", 0, -1, 16), ("nw", -1, -1, 32), ("n", -1, 0, 64), ("ne", -1, 1, 128))
FLAT_GRADIENT = 0.001


def with_neighbours(cells: DataFrame, value: str = "z", prefix: str = "z_", clamp: bool = False) -> DataFrame:
    """J-02: cells with <prefix>e, _se, ... of value. Beyond the grid they are null, or with clamp the nearest cell's of the grid."""
    across, down = Window.partitionBy("grid_id", "row").orderBy("col"), Window.partitionBy("grid_id", "col").orderBy("row")

    def shift(name: str, w, step: int) -> Column:  # noqa: ANN001
        moved = F.lag(name).over(w) if step < 0 else F.lead(name).over(w)
        place = "row" if w is down else "col"
        edge = (F.lag(place).over(w) if step < 0 else F.lead(place).over(w)).isNull()
        return F.when(edge, F.col(name)).otherwise(moved) if clamp else moved

    p = prefix
    out = cells.repartition("grid_id").withColumns({p + "w": shift(value, across, -1), p + "e": shift(value, across, 1)})
    rows = {p + "n": shift(value, down, -1), p + "s": shift(value, down, 1)}
    for side in "we":
        rows |= {p + "n" + side: shift(p + side, down, -1), p + "s" + side: shift(p + side, down, 1)}
    return out.withColumns(rows)


def gradients(p: str, cell: Column) -> tuple[Column, Column]:
    """Horn's (dz/dx, dz/dy), x to the east and y to the south."""
    z = {k: F.col(p + k) for k in ("e", "se", "s", "sw", "w", "nw", "n", "ne")}
    return (z["ne"] + 2 * z["e"] + z["se"] - z["nw"] - 2 * z["w"] - z["sw"]) / (8 * cell), (z["sw"] + 2 * z["s"] + z["se"] - z["nw"] - 2 * z["n"] - z["ne"]) / (8 * cell)


def slope(cells: DataFrame, cell_m: float, name: str = "slope_pct") -> DataFrame:
    """M-01: percent; null where a neighbour is nodata."""
    c = with_neighbours(cells, prefix="__k_", clamp=True)
    dx, dy = gradients("__k_", F.lit(cell_m))
    made = F.when(F.col("z").isNotNull(), 100 * F.sqrt(dx * dx + dy * dy))
    return c.withColumn(name, made).drop(*["__k_" + k for k, *_ in D8])


def hillshade(cells: DataFrame, cell_m: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, name: str = "shade") -> DataFrame:
    """M-02: 0 to 254, rounded half to even; 255 where there is no slope."""
    c = with_neighbours(cells, prefix="__k_", clamp=True)
    dx, dy = gradients("__k_", F.lit(cell_m / z_factor))
    az, al = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    # light from the azimuth: east is sin, north is cos, and y runs south
    light = (F.sin(al) - F.cos(al) * (dx * F.sin(az) - dy * F.cos(az))) / F.sqrt(1 + dx * dx + dy * dy)
    shade = F.rint(254 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))).cast("int")
    return c.withColumn(name, F.coalesce(F.when(F.col("z").isNotNull(), shade), F.lit(255))).drop(*["__k_" + k for k, *_ in D8])


def concavity(cells: DataFrame, name: str = "concavity") -> DataFrame:
    """M-03: sum of the four side neighbours minus four times the cell; nodata counts as 0 among the neighbours, and has none itself."""
    filled = cells.withColumn("__f", F.coalesce("z", F.lit(0.0)))
    c = with_neighbours(filled, "__f", "__k_", clamp=True)
    lap = F.col("__k_n") + F.col("__k_s") + F.col("__k_e") + F.col("__k_w") - 4 * F.col("__f")
    return c.withColumn(name, F.when(F.col("z").isNotNull(), lap)).drop("__f", *["__k_" + k for k, *_ in D8])


def drops(p: str, z: str, cell_m: float) -> Column:
    """array<struct<drop, place, code>> to lower neighbours, by distance; place is -0, -1, ... in D8's order, so the largest struct is the steepest, first of equals."""
    parts = [F.struct(((F.col(z) - F.col(p + k)) / (cell_m * (2**0.5 if dr and dc else 1.0))).alias("drop"), F.lit(-i).alias("place"), F.lit(code).alias("code")) for i, (k, dr, dc, code) in enumerate(D8)]
    return F.filter(F.array(*parts), lambda x: x["drop"] > 0)


def flow_direction(cells: DataFrame, cell_m: float = 1.0, z: str = "z") -> DataFrame:
    """G-05, G-06: fdir (D8 code, 0 where nothing is lower) and down_row, down_col (null then)."""
    c = with_neighbours(cells, z, "__k_")
    code = F.coalesce(F.array_max(drops("__k_", z, cell_m))["code"], F.lit(0))
    c = c.withColumn("fdir", F.when(F.col(z).isNotNull(), code).otherwise(0)).drop(*["__k_" + k for k, *_ in D8])
    return with_pointer(c)


def with_pointer(cells: DataFrame) -> DataFrame:
    step = F.create_map(*[x for _, dr, dc, code in D8 for x in (F.lit(code), F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")))])
    to = F.try_element_at(step, F.col("fdir"))
    return cells.withColumns({"down_row": F.col("row") + to["dr"], "down_col": F.col("col") + to["dc"]})


def sinks(cells: DataFrame) -> DataFrame:
    """G-11: cells with data and no lower neighbour."""
    c = with_neighbours(cells, prefix="__k_")
    none = F.size(drops("__k_", "z", 1.0)) == 0
    return c.where(F.col("z").isNotNull() & none).drop(*["__k_" + k for k, *_ in D8])


def outlets(cells: DataFrame, name: str = "outlet") -> DataFrame:
    """P-09: data on the grid's edge or beside nodata."""
    c = with_neighbours(cells, prefix="__k_")
    open_ = F.lit(False)
    for k, *_ in D8:
        open_ = open_ | F.col("__k_" + k).isNull()
    return c.withColumn(name, F.col("z").isNotNull() & open_).drop(*["__k_" + k for k, *_ in D8])


def flatness(cells: DataFrame, cell_m: float, limit: float = FLAT_GRADIENT) -> DataFrame:
    """A-15: grid_id, flat_fraction: of the cells with data, those whose steepest gradient to a neighbour with data, up or down, is below the limit."""
    c = with_neighbours(cells, prefix="__k_")
    steep = F.array_max(F.array(*[F.abs(F.col("z") - F.col("__k_" + k)) / (cell_m * (2**0.5 if dr and dc else 1.0)) for k, dr, dc, _ in D8]))
    return c.where("z is not null").groupBy("grid_id").agg(F.avg((F.coalesce(steep, F.lit(0.0)) < limit).cast("double")).alias("flat_fraction"))


def robust_bounds(cells: DataFrame, value: str, mask: Column, by: str = "grid_id") -> DataFrame:
    """A-13: 2nd and 98th percentiles (linear) over a mask: one row a grid."""
    return cells.where(mask & F.col(value).isNotNull()).groupBy(by).agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98))).alias("b")).select(by, F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))


def normalised(value: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    """M-04: to 0..1 between the bounds; 0.5 where they don't differ."""
    # greatest and least skip nulls, so the cases without a range come first
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - lo, hi - lo)))
    return F.when(value.isNull() | lo.isNull(), F.lit(None).cast("double")).when(hi - lo < 1e-12, F.lit(0.5)).otherwise(1 - x if invert else x)


def band_stats(cells: DataFrame, value: str = "z") -> DataFrame:
    """A-14."""
    v = F.col(value)
    p = F.percentile(value, F.array(F.lit(0.02), F.lit(0.98)))
    return cells.groupBy("grid_id").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), p[0].alias("p2"), p[1].alias("p98"), F.count(v).alias("valid"), F.count_if(v.isNull()).alias("nodata"))


def overviews(cells: DataFrame, value: str = "z", levels: int = 3, categorical: bool = False) -> DataFrame:
    """SNK-01: the pyramid of a layer: level k holds cells of 2^k by 2^k, by mean, or by the top left cell for classes; each level from the one below."""
    out, last = None, cells.select("grid_id", "row", "col", F.col(value).alias("v"))
    for k in range(1, levels + 1):
        keys = ["grid_id", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")]
        v = F.min_by("v", F.struct("row", "col")) if categorical else F.avg("v")
        last = last.groupBy(*keys).agg(v.alias("v"))
        part = last.select("grid_id", F.lit(k).alias("level"), "row", "col", "v")
        out = part if out is None else out.unionByName(part)
    return out


def agreement(fine: DataFrame, coarse: DataFrame, stride: int = 10) -> DataFrame:
    """X-01: every stride-th cell of fine against coarse at the same place (grid_id, row, col, z): bias, spread (population), mae, r, n."""
    a = fine.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    d = a.join(coarse.select("grid_id", "row", "col", F.col("z").alias("z2")), ["grid_id", "row", "col"]).withColumn("d", F.col("z2") - F.col("z")).where("d is not null")
    return d.groupBy("grid_id").agg(F.avg("d").alias("bias"), F.stddev_pop("d").alias("spread"), F.avg(F.abs("d")).alias("mae"), F.corr("z", "z2").alias("r"), F.count(F.lit(1)).alias("n"))


def deepest(cells: DataFrame, by: list[str]) -> DataFrame:
    """X-13: cells(z, row, col, by) -> by, row, col, z of the lowest cell of each region, the first in row order of equals."""
    return cells.where("z is not null").groupBy(*by).agg(F.min(F.struct("z", "row", "col")).alias("m")).select(*by, "m.row", "m.col", "m.z")


#: X-29, what a product is written as: type, nodata, how it is resampled.
BANDS = {"dem": ("float32", -9999.0, "bilinear"), "slope": ("float32", -9999.0, "bilinear"), "hillshade": ("uint8", 255.0, "bilinear"), "flow_accumulation": ("float32", -9999.0, "nearest"), "flow_direction": ("uint8", 255.0, "nearest")}


def band_values(cells: DataFrame, product: str, value: str = "z") -> DataFrame:
    """X-29: cells with `band`: the product's value as it is written, nodata for null."""
    kind, nodata, _ = BANDS[product]
    made = F.coalesce(F.col(value).cast("double"), F.lit(nodata))
    return cells.withColumn("band", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(made))) if kind == "uint8" else made.cast("float").cast("double"))
