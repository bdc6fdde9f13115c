"""Flow over pointer grids, for all grids and outlets at once: accumulation, ends and catchments by tiles (see tiled), components by pointer jumping.

flow: grid_id, row, col, down_row, down_col (null at ends), as terrain.flow_direction gives. Steps are cut by checkpoints in spark.checkpoint.dir.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import hydro
from rillwork.operators import tiled
from rillwork.operators.terrain import D8

KEY = ["grid_id", "row", "col"]
#: Numbers that one row makes at once.
_STRETCH = 4096


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's folder spark.checkpoint.dir. Only a local session may go without: it gets one beside its warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").removeprefix("file:"), "checkpoints"))


def accumulation(flow: DataFrame) -> DataFrame:
    """G-07: acc: cells that drain through each cell, itself included."""
    return tiled.accumulation(flow)


def _steps(straight: Column, diagonal: Column, cell_m: float) -> Column:
    return straight * F.lit(cell_m) + diagonal * F.lit(cell_m * 2**0.5)


def terminal(flow: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """The end that each cell drains to (end_row, end_col) and the distance to it along the flow (diagonal steps count root 2)."""
    end = [F.shiftright("root", 32).cast("int").alias("end_row"), F.col("root").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end_col")]
    return tiled.trees(flow).select(*KEY, *end, _steps(F.col("straight"), F.col("diagonal"), cell_m).alias("dist"))


def upstream(trees: DataFrame, sites: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """G-09, G-10: trees as tiled.trees or tiled.routed give them, sites(site_id, grid_id, row, col) -> site_id, grid_id, row, col, dist for every cell that drains through the site's cell, dist along the flow.

    The cells upstream of a site are the numbers from its own place on, so each site meets just its own cells, however catchments are nested; a site's numbers are made in stretches.
    """
    at = sites.select("site_id", *KEY).join(trees.select(*KEY, "root", F.col("place").alias("first"), F.col("acc").alias("n"), F.col("straight").alias("s0"), F.col("diagonal").alias("d0")), KEY).drop("row", "col")
    stretch = at.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_STRETCH).cast("long"))))
    mine = stretch.withColumn("place", F.explode(F.sequence(F.col("first") + F.col("a"), F.col("first") + F.least(F.col("a") + _STRETCH, F.col("n")) - 1))).drop("a", "first", "n")
    j = mine.join(trees.select(*KEY, "root", "place", "straight", "diagonal"), ["grid_id", "root", "place"])
    return j.select("site_id", *KEY, _steps(F.col("straight") - F.col("s0"), F.col("diagonal") - F.col("d0"), cell_m).alias("dist"))


def catchments(flow: DataFrame, sites: DataFrame, cell_m: float = 1.0) -> DataFrame:
    """G-09, G-10: see upstream; flow has the pointers."""
    return upstream(tiled.trees(flow).checkpoint(), sites, cell_m)


def perimeter(members: DataFrame, cell_m: float) -> DataFrame:
    """A-08: site_id, perimeter_m: sides of member cells that no member shares."""
    sides = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    faced = members.select("site_id", "grid_id", "row", "col", F.explode(sides).alias("d")).select("site_id", "grid_id", (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"))
    return faced.join(members.select("site_id", *KEY), ["site_id", *KEY], "left_anti").groupBy("site_id").agg((F.count(F.lit(1)) * cell_m).alias("perimeter_m"))


def catchment_metrics(members: DataFrame, cells: DataFrame, cell_m: float) -> DataFrame:
    """A-07, M-07, M-08: members(site_id, grid_id, row, col, dist), cells(z, slope_pct) -> one row a site."""
    j = members.join(cells.select(*KEY, "z", "slope_pct"), KEY)
    a = j.groupBy("site_id").agg(F.count(F.lit(1)).alias("cells"), (F.max("z") - F.min("z")).alias("relief_m"), F.avg("slope_pct").alias("mean_slope_pct"), F.max("slope_pct").alias("max_slope_pct"), F.max("dist").alias("longest_path_m"))
    a = a.join(perimeter(members, cell_m), "site_id").withColumn("area_m2", F.col("cells") * cell_m * cell_m)
    fall = F.try_divide(F.col("relief_m"), F.col("longest_path_m"))
    return a.withColumns({"form_factor": hydro.form_factor(F.col("area_m2"), F.col("longest_path_m")), "compactness": hydro.compactness(F.col("perimeter_m"), F.col("area_m2")), "tc_min": hydro.kirpich_min(F.col("longest_path_m"), fall)})


def snapped(sites: DataFrame, acc: DataFrame, radius: int) -> DataFrame:
    """G-08, K-10: each site moves to the cell of most accumulation within the circle, the first in row order of equals."""
    disc = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    near = sites.select("site_id", "grid_id", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in disc])).alias("d"))
    near = near.select("site_id", "grid_id", "r0", "c0", (F.col("r0") + F.col("d.r")).alias("row"), (F.col("c0") + F.col("d.c")).alias("col"))
    best = near.join(acc.select(*KEY, "acc"), KEY).groupBy("site_id", "grid_id").agg(F.max(F.struct("acc", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m"))
    return best.select("site_id", "grid_id", (-F.col("m.r")).alias("row"), (-F.col("m.c")).alias("col"), F.col("m.acc").alias("acc"))


def components(mask: DataFrame, neighbours: int = 8) -> DataFrame:
    """G-16: mask(grid_id, row, col) -> label: the smallest cell number of the component; smallest labels with pointer jumping."""
    shared_checkpoints(mask.sparkSession)
    offsets = [(dr, dc) for _, dr, dc, _ in D8 if neighbours == 8 or not (dr and dc)]
    n = F.lit(1 << 20).cast("long")
    m = mask.select(*KEY, (F.col("row") * n + F.col("col")).alias("id")).checkpoint()
    out = m.select("grid_id", "id", F.explode(F.array(*[F.lit((dr << 20) + dc).cast("long") for dr, dc in offsets])).alias("o")).select("grid_id", F.col("id").alias("x"), (F.col("id") + F.col("o")).alias("y"))
    edges = out.join(m.select("grid_id", F.col("id").alias("y")), ["grid_id", "y"]).checkpoint()
    label = m.select("grid_id", F.col("id").alias("x"), F.col("id").alias("label")).checkpoint()
    while True:
        low = edges.join(label.select("grid_id", F.col("x").alias("y"), F.col("label").alias("l")), ["grid_id", "y"]).groupBy("grid_id", "x").agg(F.min("l").alias("seen"))
        step = label.join(low, ["grid_id", "x"], "left").select("grid_id", "x", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("mid"))
        jumped = step.join(label.select("grid_id", F.col("x").alias("mid"), F.col("label").alias("l2")), ["grid_id", "mid"]).select("grid_id", "x", "was", F.least("mid", "l2").alias("label")).checkpoint()
        label = jumped.select("grid_id", "x", "label")
        if jumped.where("label <> was").isEmpty():
            return m.join(label.withColumnRenamed("x", "id"), ["grid_id", "id"]).select(*KEY, "label")


def dilated(mask: DataFrame, radius: float) -> DataFrame:
    """G-21, G-22: cells within the radius (in cells; 2 ** 0.5 gives the eight neighbours) of a member.

    Cells go as the bits of numbers, 64 of a row in each: those are moved and put together, so no task holds the cells of the widened mask one by one.
    """
    k = int(radius)
    disc = [(r, c) for r in range(-k, k + 1) for c in range(-k, k + 1) if r * r + c * c <= radius * radius + 1e-9]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("col").bitwiseAND(F.lit(63)).cast("int"))
    words = mask.groupBy("grid_id", "row", F.floor(F.col("col") / 64).alias("block")).agg(F.bit_or(bit).alias("bits"))
    # a step of c columns leaves c % 64 bits in the block after
    steps = [(r, c // 64 + n, c % 64, n) for r, c in disc for n in ((0, 1) if c % 64 else (0,))]
    moved = words.withColumn("d", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(b).alias("b"), F.lit(e).alias("e"), F.lit(n).alias("n")) for r, b, e, n in steps])))
    left, right = F.call_function("shiftleft", F.col("bits"), F.col("d.e")), F.call_function("shiftrightunsigned", F.col("bits"), 64 - F.col("d.e"))
    moved = moved.select("grid_id", (F.col("row") + F.col("d.r")).alias("row"), (F.col("block") + F.col("d.b")).alias("block"), F.when(F.col("d.n") == 0, left).otherwise(right).alias("bits")).where("bits <> 0")
    grown = moved.groupBy("grid_id", "row", "block").agg(F.bit_or("bits").alias("bits")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(63))))
    on = F.call_function("shiftrightunsigned", F.col("bits"), F.col("at")).bitwiseAND(F.lit(1).cast("long")) == 1
    return grown.where(on).select("grid_id", "row", (F.col("block") * 64 + F.col("at")).cast(mask.schema["col"].dataType).alias("col"))


def stream_report(reaches: DataFrame, area_m2: float) -> DataFrame:
    """A-16: reaches(order, length_m) -> order, reaches, length_m, and the whole's drainage density in km per km2."""
    by = reaches.groupBy("order").agg(F.count(F.lit(1)).alias("reaches"), F.sum("length_m").alias("length_m"))
    total = reaches.agg((F.sum("length_m") / 1000 / (area_m2 / 1e6)).alias("density"))
    return by.crossJoin(F.broadcast(total))  # one row
