"""Stream networks of grids of any size: orders and reaches, by tiles.

Stream cells are few of a grid's. Each knows how many stream cells drain into it (one aggregation); those with none or several, and those that are entered from another tile, begin a piece. A tile walks its pieces down to
where the next one begins, so a piece is a row with its cells. Pieces with their successors are a small forest, ordered and joined to reaches by one task for each grid without the pieces' cells; these meet their
reach's number in a join and are put together in order.

A reach is a run of one order; it ends with the cell where the order changes, which starts the next one, and has at least two cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators import kernels, tiled
from rillwork.operators.tiled import SIDE, _col, _id, _row

KEY = ["grid_id", "row", "col"]
# Fixed value: a network of more cells is refused.
MOST_CELLS = 400_000
NONE = -1
_PIECE = "grid_id long, id long, fed int, next long, ids array<long>, straight long, diagonal long"


def network(cells: DataFrame, least: int, within: DataFrame | None = None) -> DataFrame:
    """G-12, G-15: cells(grid_id, row, col, fdir, acc) with at least that many cells upstream, of those in within(grid_id, row, col) if it is given -> grid_id, id, next (the stream cell below, or NONE), fed (stream cells that drain into it)."""
    from rillwork.operators import terrain

    s = cells.where(F.col("acc") >= least)
    if within is not None:
        s = s.join(within.select(*KEY).distinct(), KEY, "left_semi")
    s = terrain.with_pointer(s.select(*KEY, "fdir")).select("grid_id", _id(F.col("row"), F.col("col")).alias("id"), F.when((F.col("down_row") >= 0) & (F.col("down_col") >= 0), _id(F.col("down_row"), F.col("down_col"))).alias("down"))
    on = s.select("grid_id", F.col("id").alias("down"), F.lit(True).alias("on"))
    s = s.join(on, ["grid_id", "down"], "left").select("grid_id", "id", F.when(F.col("on"), F.col("down")).otherwise(NONE).alias("next"))
    fed = s.where(F.col("next") != NONE).groupBy("grid_id", F.col("next").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("fed"))
    return s.join(fed, ["grid_id", "id"], "left").select("grid_id", "id", "next", F.coalesce("fed", F.lit(0)).alias("fed"))


def _pieces(net: DataFrame, side: int) -> DataFrame:
    """Runs of cells down to where the next one begins: id of the first, fed of it, next (the first of the next run, or NONE), ids, and straight and diagonal steps, the one to the next included."""
    at = lambda c: F.floor(c / side).cast("int")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, down, fed = pdf["id"].to_numpy(), pdf["next"].to_numpy(), pdf["fed"].to_numpy()
        order = np.argsort(ids)
        ids, down, fed = ids[order], down[order], fed[order]
        k = np.minimum(np.searchsorted(ids, down), len(ids) - 1)
        to = np.where(ids[k] == down, k, NONE)
        inner = np.bincount(to[to >= 0], minlength=len(ids))
        starts = (fed != 1) | (inner == 0)  # a head, a junction, or entered from another tile
        step = (np.abs((down >> 32) - (ids >> 32)) + np.abs((down & 0xFFFFFFFF) - (ids & 0xFFFFFFFF)) == 2).astype(int)
        to_l, starts_l, out = to.tolist(), starts.tolist(), []
        for s in np.flatnonzero(starts).tolist():
            run = [s]
            while (t := to_l[run[-1]]) >= 0 and not starts_l[t]:
                run.append(t)
            last = run[-1]
            n = len(run) - (down[last] == NONE)
            slanted = int(step[run[:n]].sum())
            out.append((pdf["grid_id"].iloc[0], ids[s], fed[s], down[last], ids[run].tolist(), n - slanted, slanted))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    d = net.withColumns({"tr": at(_row(F.col("id"))), "tc": at(_col(F.col("id")))})
    return d.groupBy("grid_id", "tr", "tc").applyInPandas(walk, _PIECE)


def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    """pieces(grid_id, id, fed, next) of one grid -> order, reach (id of its first piece), place in the reach, and last: the cell that ends the reach after its last piece, if there is one."""
    pdf = pdf.sort_values("id")
    ids, after = pdf["id"].to_numpy(), pdf["next"].to_numpy()
    k = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
    to = np.where(ids[k] == after, k, NONE)
    n = len(ids)
    top, twice, order = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    waves = list(kernels.waves(to))
    for wave in waves:
        order[wave] = np.where(top[wave] == 0, 1, top[wave] + (twice[wave] >= 2))
        wave = wave[to[wave] >= 0]
        t, o = to[wave], order[wave]
        best = top.copy()
        np.maximum.at(best, t, o)
        twice[best > top] = 0
        np.add.at(twice, t, (o == best[t]).astype(int))
        top = best
    reach, place = ids.copy(), np.zeros(n, int)
    for wave in waves:
        wave = wave[to[wave] >= 0]
        wave = wave[order[to[wave]] == order[wave]]
        reach[to[wave]], place[to[wave]] = reach[wave], place[wave] + 1
    ends = (to < 0) | (order[np.maximum(to, 0)] != order)
    last = np.where(ends & (to >= 0), after, NONE)
    return pd.DataFrame({"grid_id": pdf["grid_id"].to_numpy(), "id": ids, "order": order.astype("int32"), "reach": reach, "place": place.astype("int32"), "last": last})


def _labels(pieces: DataFrame) -> DataFrame:
    return pieces.select("grid_id", "id", "fed", "next").groupBy("grid_id").applyInPandas(numbered, "grid_id long, id long, order int, reach long, place int, last long")


def orders(cells: DataFrame, least: int, within: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """G-13: grid_id, row, col, order of each stream cell: 1 at heads; one more where two or more of the highest order meet."""
    tiled.shared(cells)
    p = _pieces(network(cells, least, within), side).checkpoint()
    d = p.join(_labels(p), ["grid_id", "id"]).select("grid_id", F.explode("ids").alias("cell"), "order")
    return d.select("grid_id", _row(F.col("cell")).alias("row"), _col(F.col("cell")).alias("col"), "order")


def reaches(cells: DataFrame, least: int, cell_m: float, within: DataFrame | None = None, side: int = SIDE, most: int = MOST_CELLS) -> DataFrame:
    """G-14, G-15: cells(grid_id, row, col, fdir, acc) -> grid_id, reach (row << 32 | col of its first cell), order, rows and cols of its cells from the top, length_m, problem.

    within(grid_id, row, col) restricts the network to a catchment. A grid whose network has more than most cells has one row with why it is refused.
    """
    tiled.shared(cells)
    net = network(cells, least, within).checkpoint()
    sizes = net.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"))
    large = sizes.where(F.col("cells") > most)
    p = _pieces(net.join(large, "grid_id", "left_anti"), side).checkpoint()
    j = p.join(_labels(p), ["grid_id", "id"]).where((F.size("ids") > 1) | (F.col("next") != NONE) | (F.col("place") > 0))
    whole = F.array_sort(F.collect_list(F.struct("place", "ids", "last")))
    ids = F.concat(F.flatten(F.transform("x", lambda s: s["ids"])), F.filter(F.array(F.element_at("x", -1)["last"]), lambda c: c != NONE))
    g = j.groupBy("grid_id", "reach").agg(F.first("order").alias("order"), whole.alias("x"), F.sum("straight").alias("s"), F.sum("diagonal").alias("d")).select("grid_id", "reach", "order", "s", "d", ids.alias("ids"))
    length = F.col("s") * F.lit(cell_m) + F.col("d") * F.lit(cell_m * 2**0.5)
    cut = lambda f: F.transform("ids", lambda c: f(c))
    out = g.where(F.size("ids") > 1).select("grid_id", "reach", "order", cut(_row).alias("rows"), cut(_col).alias("cols"), length.alias("length_m"), F.lit(None).cast("string").alias("problem"))
    why = F.concat(F.col("cells").cast("string"), F.lit(" cells are in the network, more than "), F.lit(str(most)), F.lit("; use a larger threshold"))
    none = lambda t: F.lit(None).cast(t)
    refused = large.select("grid_id", none("long").alias("reach"), none("int").alias("order"), none("array<int>").alias("rows"), none("array<int>").alias("cols"), none("double").alias("length_m"), why.alias("problem"))
    return out.unionByName(refused)

