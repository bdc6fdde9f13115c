"""Flooding and drainage of grids of any size, tile by tile.

A grid is cut into square tiles; no task holds more than one tile and its rim. What crosses tiles is told by small tables of their border cells: a graph of passes for flooding, a forest of exits for drainage. Such a
table has some four rows for each row of a tile (1 in 256 of the cells at SIDE 1024), and is solved by one task for each grid.

Flooding (G-01): W = max(z, lowest neighbour's W + eps) with W = z at outlets has one solution.
1. Each tile floods from its outlets and border cells without eps; a cell belongs to the border cell that reached it. Of the passes between neighbouring basins a minimum spanning forest goes into the grid's graph,
   with the steps between border cells of two tiles. Minimax paths to the outlets give each border cell's level, and so the level of each cell.
2. Border cells that stand above a neighbour's level have W = z; those of lakes and flats are unknown. Tiles flood again with eps from outlets and known cells around them and tell each other their border cells, until
   none changes: as many rounds as a lake crosses tiles, and only by tiles around changed cells. Since the solution is unique, what no longer changes is it.

Drainage (G-07, G-09, G-10): accumulation within tiles, then along the forest of cells where the flow leaves a tile, then down each tile once with what enters. Cells get numbers by a walk from each end up its tree,
so that the cells upstream of any cell are an interval: (root, place) from its own place on, as many as its accumulation.

Cells without data count as cells of their own, as in a table of pointers without one. Pointers to cells that are not in the table are ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.operators import kernels
from rillwork.operators.terrain import D8

SIDE = 1024
TILE = ["grid_id", "tr", "tc"]
SEA = -1
_MOVES = {(dr, dc): code for _, dr, dc, code in D8}


def shared(cells: DataFrame) -> None:
    """The cluster's folder for checkpoints."""
    from rillwork.operators.flow import shared_checkpoints

    shared_checkpoints(cells.sparkSession)


def _id(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("long"), 32).bitwiseOR(col.cast("long"))


def _row(id_: Column) -> Column:
    return F.shiftright(id_, 32).cast("int")


def _col(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _tiles_near(row: Column, col: Column, side: int, own: bool) -> Column:
    """The tiles that a cell is in, or in the rim of; rows and columns count from 0, so no tile is before the first."""
    at = lambda x: F.floor(x / side).cast("int")
    tile = lambda r, c: F.struct(at(r).alias("tr"), at(c).alias("tc"))
    inner = lambda x: F.pmod(x, F.lit(side)).between(1, side - 2)
    all_ = F.filter(F.array_distinct(F.array(*[tile(row + a, col + b) for a in (0, -1, 1) for b in (0, -1, 1)])), lambda t: (t["tr"] >= 0) & (t["tc"] >= 0))
    if not own:
        return F.filter(all_, lambda t: (t["tr"] != at(row)) | (t["tc"] != at(col)))
    return F.when(inner(row) & inner(col), F.array(tile(row, col))).otherwise(all_) if side > 2 else all_


def _packed(cells: DataFrame, value: Column, side: int, rim: bool, gap: float) -> DataFrame:
    """A row a tile: grid_id, tr, tc, h, w (of its own cells) and data, float64 of (h + 2) x (w + 2) cells with the rim, or h x w without; gap stands for cells that are not there."""
    d = cells.select("grid_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value.cast("double").alias("v")).where("row is not null and col is not null")
    near = _tiles_near(F.col("row"), F.col("col"), side, True) if rim else F.array(F.struct(F.floor(F.col("row") / side).cast("int").alias("tr"), F.floor(F.col("col") / side).cast("int").alias("tc")))
    d = d.select("grid_id", "row", "col", F.coalesce("v", F.lit(float("nan"))).alias("v"), F.explode(near).alias("t")).select("grid_id", F.col("t.tr").alias("tr"), F.col("t.tc").alias("tc"), "row", "col", "v")
    edge = 1 if rim else 0

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, tr, tc = pdf["grid_id"].iloc[0], int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        r, c = pdf["row"].to_numpy() - tr * side, pdf["col"].to_numpy() - tc * side
        own = (r >= 0) & (c >= 0) & (r < side) & (c < side)
        if not own.any():
            return pd.DataFrame(columns=["grid_id", "tr", "tc", "h", "w", "data"])
        h, w = int(r[own].max()) + 1, int(c[own].max()) + 1
        a = np.full((h + 2 * edge, w + 2 * edge), gap)
        keep = (r < h + edge) & (c < w + edge)
        a[r[keep] + edge, c[keep] + edge] = pdf["v"].to_numpy()[keep]
        return pd.DataFrame({"grid_id": [grid], "tr": [tr], "tc": [tc], "h": [h], "w": [w], "data": [a.tobytes()]})

    packed = d.groupBy(*TILE).applyInPandas(pack, "grid_id long, tr int, tc int, h int, w int, data binary")
    # a tile is a second of work, but few bytes: without a number of partitions Spark would put many in one
    spark = cells.sparkSession
    return packed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *TILE)


def _each(tiles: DataFrame, work: Callable[[dict], dict[str, np.ndarray] | None], schema: pa.Schema) -> DataFrame:
    """work(tile's row) -> columns, after grid_id, of the rows that a tile gives."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                got = work(row)
                if got is not None and (n := len(next(iter(got.values())))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["grid_id"])), *[pa.array(got[f.name], f.type, from_pandas=True) for f in list(schema)[1:]]], schema=schema)

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}
    return tiles.mapInArrow(apply, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _schema(**columns: pa.DataType) -> pa.Schema:
    return pa.schema([("grid_id", pa.int64()), *columns.items()])


def _by_tile(rows: DataFrame, tile: Column | None, *values: str) -> DataFrame:
    """rows(grid_id, id, values) gathered by the tile (struct tr, tc) that they are for: arrays in one order. A tile has no more of them than its rim and border."""
    d = rows.select("grid_id", tile.alias("t"), "id", *values)
    return d.groupBy("grid_id", F.col("t.tr").alias("tr"), F.col("t.tc").alias("tc")).agg(F.collect_list(F.struct("id", *values)).alias("x")).select(*TILE, *[F.col(f"x.{v}").alias(v) for v in ("id", *values)])


def _own_tile(side: int) -> Column:
    return F.struct(F.floor(_row(F.col("id")) / side).cast("int").alias("tr"), F.floor(_col(F.col("id")) / side).cast("int").alias("tc"))


# --- flooding


class _Ground:
    """A tile's heights with its rim, and which of its cells are outlets and border cells."""

    def __init__(self, row: dict, side: int):
        self.h, self.w = row["h"], row["w"]
        self.z = np.frombuffer(row["data"], float).reshape(self.h + 2, self.w + 2)
        self.r0, self.c0 = row["tr"] * side - 1, row["tc"] * side - 1  # of the rim's corner
        ok = np.isfinite(self.z)
        self.core = np.zeros(self.z.shape, bool)
        self.core[1:-1, 1:-1] = ok[1:-1, 1:-1]
        self.outlet = self.core & kernels.dilate(~ok)
        #: Border cells: those with a neighbour with data in another tile.
        self.border = self.core & kernels.dilate(ok & ~self.core)

    def ids(self, at: np.ndarray) -> np.ndarray:
        r, c = np.divmod(at, self.w + 2)
        return (r + self.r0) << 32 | (c + self.c0)

    def places(self, ids: list[int]) -> np.ndarray:
        i = np.asarray(ids, np.int64)
        return ((i >> 32) - self.r0) * (self.w + 2) + ((i & (1 << 32) - 1) - self.c0)

    def flooded(self, starts: list[tuple[float, int]], eps: float, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(levels of the tile's cells, infinite where nothing comes; labels, which spread from starts if given) from starts (level, place) inward, places being flat ones with the rim."""
        # one more rim that is done, so that a neighbour's place is a sum
        wide = self.w + 4
        pad = lambda x, v: np.pad(x.reshape(self.z.shape), 1, constant_values=v).ravel()
        moved = lambda k: (k // (self.w + 2) + 1) * wide + k % (self.w + 2) + 1
        out, seen = pad(np.where(self.core, self.z, np.inf), np.inf).tolist(), bytearray(pad(~self.core, True).astype(np.uint8).tobytes())
        marks = None if label is None else pad(label, 0).tolist()
        heap = [(v, moved(at)) for v, at in starts]
        for v, at in heap:
            out[at], seen[at] = v, 1
        around = [dr * wide + dc for dr, dc in kernels.STEPS]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            least, at = pop(heap)
            least += eps
            for o in around:
                q = at + o
                if not seen[q]:
                    seen[q] = 1
                    v = out[q]
                    if v < least:
                        v = out[q] = least
                    if marks is not None:
                        marks[q] = marks[at]
                    push(heap, (v, q))
        crop = lambda x: np.array(x).reshape(self.h + 4, wide)[1:-1, 1:-1]
        reached = crop(np.frombuffer(bytes(seen), np.uint8)) > 0
        return np.where(self.core & reached, crop(out), np.inf), None if marks is None else crop(marks)


def spanning_forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """Which edges, cheapest first, join nodes 0..n-1 that nothing cheaper joins."""
    up, keep = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in np.argsort(cost, kind="stable").tolist():
        x, y = top(int(a[k])), top(int(b[k]))
        if x != y:
            up[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _basins(g: _Ground) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, label, places of the border cells that labels 1, 2, ... stand for); label 0 is the tile's own outlets'."""
    border, outlet = np.flatnonzero(g.border), np.flatnonzero(g.outlet & ~g.border)
    flat, label = g.z.ravel(), np.zeros(g.z.size, np.int64)
    label[border] = np.arange(1, len(border) + 1)
    level, label = g.flooded([(float(flat[k]), k) for k in np.concatenate((border, outlet)).tolist()], 0.0, label)
    return level, label, border


_PASSES = pa.schema([("grid_id", pa.int64()), ("tr", pa.int32()), ("tc", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("cost", pa.list_(pa.float64())), ("level", pa.binary()), ("label", pa.binary())])


def _passes(tiles: DataFrame, side: int) -> DataFrame:
    """grid_id, tr, tc, the tile's passes (a, b, cost), and its cells' levels and labels. Tiles without border cells have nothing to tell and no row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                g = _Ground(row, side)
                if g.border.any():
                    level, label, border = _basins(g)
                    ends_a, ends_b, cost = _tile_passes(g, level, label, border)
                    cols = [[row["grid_id"]], [row["tr"]], [row["tc"]], [ends_a], [ends_b], [cost], [level.tobytes()], [label.astype(np.int32).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PASSES, strict=True)], schema=_PASSES)

    return tiles.mapInArrow(apply, "grid_id long, tr int, tc int, a array<long>, b array<long>, cost array<double>, level binary, label binary")


def _tile_passes(g: _Ground, level: np.ndarray, label: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = g.w + 2
    sea = g.outlet.ravel()[border]
    # border cells that are outlets, and neighbours of unlike basins
    a_all, b_all, c_all = [np.zeros(len(border), np.int64)], [np.arange(1, len(border) + 1)], [np.where(sea, g.z.ravel()[border], np.inf)]
    for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1)):
        near, ok = kernels.shifted(label, dr, dc, 0), g.core & kernels.shifted(g.core, dr, dc, False)
        differ = ok & (near != label)
        a_all.append(label[differ])
        b_all.append(near[differ])
        c_all.append(np.maximum(level, kernels.shifted(level, dr, dc))[differ])
    a, b, cost = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(c_all)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((cost, b, a))
    order = order[np.isfinite(cost[order])]
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    a, b, cost = a[order][new], b[order][new], cost[order][new]
    keep = spanning_forest(a, b, cost, len(border) + 1)
    ids = np.concatenate(([SEA], g.ids(border)))
    from_, to, costs = [ids[a[keep]]], [ids[b[keep]]], [cost[keep]]
    # steps to border cells of other tiles, told by the lower number
    flat, core = g.z.ravel(), g.core.ravel()
    for dr, dc in kernels.STEPS:
        q = border + dr * n + dc
        there = np.isfinite(flat[q]) & ~core[q]
        x, y = g.ids(border[there]), g.ids(q[there])
        first = x < y
        from_.append(x[first])
        to.append(y[first])
        costs.append(np.maximum(flat[border[there]], flat[q[there]])[first])
    return np.concatenate(from_), np.concatenate(to), np.concatenate(costs)


def minimax(pdf: pd.DataFrame) -> pd.DataFrame:
    """passes(grid_id, a, b, cost) of one grid -> id, spill: the least height over which a node is joined to the sea."""
    ids, ends = np.unique(np.concatenate((pdf["a"].to_numpy(), pdf["b"].to_numpy(), [SEA])), return_inverse=True)
    n = len(pdf)
    x, y, cost = np.concatenate((ends[:n], ends[n : 2 * n])), np.concatenate((ends[n : 2 * n], ends[:n])), np.tile(pdf["cost"].to_numpy(), 2)
    order = np.argsort(x, kind="stable")
    to, cost, first = y[order].tolist(), cost[order].tolist(), np.searchsorted(x[order], np.arange(len(ids) + 1)).tolist()
    level, done = [np.inf] * len(ids), bytearray(len(ids))
    sea = int(ends[-1])
    level[sea] = -np.inf
    heap = [(-np.inf, sea)]
    while heap:
        v, k = heapq.heappop(heap)
        if done[k]:
            continue
        done[k] = 1
        for j in range(first[k], first[k + 1]):
            t, c = to[j], max(v, cost[j])
            if c < level[t]:
                level[t] = c
                heapq.heappush(heap, (c, t))
    keep = np.arange(len(ids)) != sea
    return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0] if n else 0, "id": ids[keep], "spill": np.array(level)[keep]})


_TOLD = _schema(id=pa.int64(), v=pa.float64())


def _first_guess(side: int) -> Callable[[dict], dict[str, np.ndarray]]:
    """What is known of a tile's border cells once levels are: those that stand above a neighbour's level, and outlets, keep their height; others are unknown (infinite)."""

    def work(row: dict) -> dict[str, np.ndarray]:
        g = _Ground(row, side)
        border = np.flatnonzero(g.border)
        level, label = np.frombuffer(row["level"], float).reshape(g.z.shape), np.frombuffer(row["label"], np.int32).reshape(g.z.shape)
        spill = np.full(len(border) + 1, -np.inf)
        if row["id"]:
            number = np.zeros(g.z.size, np.int64)
            number[border] = np.arange(1, len(border) + 1)
            spill[number[g.places(row["id"])]] = row["spill"]
        level = np.where(g.core, np.maximum(level, spill[label]), np.nan)
        lower = np.zeros(g.z.shape, bool)
        for dr, dc in kernels.STEPS:
            lower |= kernels.shifted(level, dr, dc) < level
        known = g.outlet | ((level == g.z) & lower)
        return {"id": g.ids(border), "v": np.where(known.ravel()[border], g.z.ravel()[border], np.inf)}

    return work


def _rim(g: _Ground, row: dict) -> np.ndarray:
    rim = np.full(g.z.size, np.nan)
    if row["id"]:
        rim[g.places(row["id"])] = row["v"]
    return rim.reshape(g.z.shape)


_STATE = pa.schema([("grid_id", pa.int64()), ("tr", pa.int32()), ("tc", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary()), ("filled", pa.binary()), ("told_id", pa.list_(pa.int64())), ("told_v", pa.list_(pa.float64()))])


def _raised(tiles: DataFrame, side: int, eps: float) -> DataFrame:
    """Tiles with their cells flooded with eps from their outlets and what is known of the rim, infinite where neither reaches; and what they tell of their border cells."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                g = _Ground(row, side)
                starts = [(float(g.z.ravel()[at]), at) for at in np.flatnonzero(g.outlet).tolist()]
                if row["id"]:
                    starts += [(v, at) for at, v in zip(g.places(row["id"]).tolist(), row["v"], strict=True) if v < np.inf]
                level, _ = g.flooded(starts, eps)
                border = np.flatnonzero(g.border)
                made = row | {"filled": np.where(g.core, level, np.nan)[1:-1, 1:-1].tobytes(), "told_id": g.ids(border), "told_v": level.ravel()[border]}
                yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in _STATE], schema=_STATE)

    return tiles.mapInArrow(apply, "grid_id long, tr int, tc int, h int, w int, data binary, filled binary, told_id array<long>, told_v array<double>")


_FLOODED = _schema(row=pa.int32(), col=pa.int32(), filled=pa.float64(), fdir=pa.int32())
_POINTED = pa.schema([("grid_id", pa.int64()), ("tr", pa.int32()), ("tc", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary()), ("filled", pa.binary())])


def _pointed(tiles: DataFrame, side: int, cell_m: float) -> DataFrame:
    """Tiles with their flow directions as data, -1 for a cell that is not there, and their flooded surface."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                g = _Ground(row, side)
                w = _rim(g, row)
                w[1:-1, 1:-1] = np.frombuffer(row["filled"], float).reshape(g.h, g.w)
                code = np.where(np.isneginf(g.z), -1.0, kernels.direction(w, cell_m))[1:-1, 1:-1]
                made = row | {"data": code.tobytes()}
                yield pa.RecordBatch.from_pylist([{f.name: made[f.name] for f in _POINTED}], schema=_POINTED)

    return tiles.mapInArrow(apply, "grid_id long, tr int, tc int, h int, w int, data binary, filled binary")


def _flooded(cells: DataFrame, cell_m: float, side: int, eps: float) -> DataFrame:
    shared(cells)
    # a gap is a cell that is not there; it is nodata to its neighbours, and gives no row
    tiles = _packed(cells, F.col("z"), side, True, float("-inf")).checkpoint()
    passes = _passes(tiles, side).checkpoint()
    each = passes.select("grid_id", F.explode(F.arrays_zip("a", "b", "cost")).alias("p")).select("grid_id", "p.a", "p.b", "p.cost")
    levels = each.groupBy("grid_id").applyInPandas(minimax, "grid_id long, id long, spill double")
    bordered = tiles.join(passes.select(*TILE, "level", "label"), TILE).join(_by_tile(levels, _own_tile(side), "spill"), TILE, "left")
    known = _each(bordered, _first_guess(side), _TOLD).checkpoint()
    near = _tiles_near(_row(F.col("id")), _col(F.col("id")), side, False)
    around = lambda told: _by_tile(told.withColumn("n", F.explode(near)), F.col("n"), "v")
    state, active = None, tiles
    while True:
        new = _raised(active.join(around(known), TILE, "left"), side, eps).checkpoint()
        state = new if state is None else state.join(new.select(*TILE), TILE, "left_anti").unionByName(new)
        told = new.select("grid_id", F.explode(F.arrays_zip("told_id", "told_v")).alias("p")).select("grid_id", F.col("p.told_id").alias("id"), F.col("p.told_v").alias("new"))
        both = known.join(told, ["grid_id", "id"], "left")
        both = both.select("grid_id", "id", F.coalesce("new", "v").alias("v"), (F.coalesce("new", "v") != F.col("v")).alias("changed")).checkpoint()
        known, changed = both.drop("changed"), both.where("changed")
        if changed.isEmpty():
            break
        heard = changed.select("grid_id", F.explode(near).alias("n")).select("grid_id", "n.tr", "n.tc").distinct()
        active = tiles.join(heard, TILE, "left_semi")
    return _pointed(state.drop("told_id", "told_v").join(around(known), TILE, "left"), side, cell_m)


def filled(cells: DataFrame, cell_m: float = 1.0, side: int = SIDE, eps: float = kernels.EPSILON) -> DataFrame:
    """G-01, G-05: cells(grid_id, row, col, z) -> grid_id, row, col, filled, fdir: the flooded surface (null for nodata) and its flow directions. Cells must be unique by grid, row and col."""

    def work(row: dict) -> dict[str, np.ndarray]:
        code = np.frombuffer(row["data"], float).reshape(row["h"], row["w"])
        r, c = np.nonzero(code >= 0)
        w = np.frombuffer(row["filled"], float).reshape(code.shape)
        return {"row": (r + row["tr"] * side).astype(np.int32), "col": (c + row["tc"] * side).astype(np.int32), "filled": w[r, c], "fdir": code[r, c].astype(np.int32)}

    return _each(_flooded(cells, cell_m, side, eps), work, _FLOODED)


# --- drainage


class _Drains:
    """A tile's pointers: flat places of the cell below, -1 at ends and where the flow leaves the tile; target is the cell's number there, SEA at ends."""

    def __init__(self, row: dict, side: int):
        self.h, self.w = row["h"], row["w"]
        code = np.frombuffer(row["data"], float).reshape(self.h, self.w)
        self.there = (code >= 0).ravel()
        code = np.where(code > 0, code, 0).astype(np.int64)
        self.r0, self.c0 = row["tr"] * side, row["tc"] * side
        r, c = np.indices(code.shape)
        dr, dc = np.zeros(code.shape, np.int64), np.zeros(code.shape, np.int64)
        for (a, b), k in _MOVES.items():
            dr[code == k], dc[code == k] = a, b
        tr, tc = r + dr, c + dc
        inside = (tr >= 0) & (tc >= 0) & (tr < self.h) & (tc < self.w) & (code > 0)
        to = np.where(inside, tr * self.w + tc, -1).ravel()
        # a pointer to a gap is an end
        gap = (to >= 0) & ~self.there[np.maximum(to, 0)]
        self.to = np.where(gap, -1, to)
        far_r, far_c = tr + self.r0, tc + self.c0
        leaves = (code > 0) & ((tr < 0) | (tc < 0) | (tr >= side) | (tc >= side)) & (far_r >= 0) & (far_c >= 0)
        self.target = np.where(leaves, far_r << 32 | np.maximum(far_c, 0), SEA).ravel()
        self.diagonal = ((dr != 0) & (dc != 0)).ravel()
        self.waves = list(kernels.waves(self.to))
        rim = np.zeros(code.shape, bool)
        rim[[0, -1], :] = rim[:, [0, -1]] = True
        self.border = np.flatnonzero(rim.ravel() & self.there)

    def ids(self, at: np.ndarray) -> np.ndarray:
        r, c = np.divmod(at, self.w)
        return (r + self.r0) << 32 | (c + self.c0)

    def places(self, ids: list[int]) -> np.ndarray:
        i = np.asarray(ids, np.int64)
        return ((i >> 32) - self.r0) * self.w + ((i & (1 << 32) - 1) - self.c0)

    def down(self, own: np.ndarray) -> np.ndarray:
        """Sums of own over the cells that drain through each."""
        out = own.copy()
        for wave in self.waves:
            wave = wave[self.to[wave] >= 0]
            np.add.at(out, self.to[wave], out[wave])
        return out

    def up(self, acc: np.ndarray, entering: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each cell: the end of its path in the tile, its place in that end's walk, straight and diagonal steps to the end. A cell's walk has what enters it first, then the cells that drain into it, in order."""
        n = len(self.to)
        end, place, straight, diagonal = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        # where a cell begins among those that drain into the same one
        child = np.flatnonzero(self.to >= 0)
        child = child[np.argsort(self.to[child], kind="stable")]
        before = np.cumsum(acc[child]) - acc[child]
        first = np.ones(len(child), bool)
        first[1:] = self.to[child][1:] != self.to[child][:-1]
        shift = np.zeros(n, np.int64)
        if len(child):
            shift[child] = before - np.repeat(before[first], np.diff(np.concatenate((np.flatnonzero(first), [len(child)]))))
        for wave in reversed(self.waves):
            wave = wave[self.to[wave] >= 0]
            t = self.to[wave]
            end[wave], place[wave] = end[t], place[t] + 1 + entering[t] + shift[wave]
            straight[wave], diagonal[wave] = straight[t] + ~self.diagonal[wave], diagonal[t] + self.diagonal[wave]
        return end, place, straight, diagonal


_LINK = _schema(id=pa.int64(), end=pa.int64(), target=pa.int64(), acc=pa.int64())


def _links(side: int) -> Callable[[dict], dict[str, np.ndarray]]:
    """For each border cell the end of its path in the tile; for that end, where the flow goes on and what it gathers in the tile."""

    def work(row: dict) -> dict[str, np.ndarray]:
        d = _Drains(row, side)
        acc = d.down(d.there.astype(np.int64))
        end, *_ = d.up(acc, np.zeros(len(acc), np.int64))
        at = np.unique(np.concatenate((d.border, np.flatnonzero((d.target != SEA) & d.there))))
        return {"id": d.ids(at), "end": d.ids(end[at]), "target": d.target[end[at]], "acc": acc[end[at]]}

    return work


class _Exits:
    """One grid's forest of exits: cells where the flow leaves a tile for a cell of another."""

    def __init__(self, pdf: pd.DataFrame):
        border, end = pdf["id"].to_numpy(), pdf["end"].to_numpy()
        by_id = np.argsort(border)
        self.border, self.end_of = border[by_id], end[by_id]
        out = pdf[pdf["target"] != SEA].drop_duplicates("end").sort_values("end")
        known = np.isin(out["target"].to_numpy(), self.border)
        out = out[known]
        self.id, self.target, self.acc = out["end"].to_numpy(), out["target"].to_numpy(), out["acc"].to_numpy().astype(np.int64)
        # the next exit: the end of the path from the target on, if that is one
        ends = self.end_of[np.searchsorted(self.border, self.target)] if len(self.id) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.id, ends), max(0, len(self.id) - 1))
        self.next = np.where(self.id[at] == ends, at, -1) if len(self.id) else np.zeros(0, np.int64)
        self.last = ends  # an end that is not an exit
        self.waves = list(kernels.waves(self.next)) if len(self.id) else []
        for wave in self.waves:
            wave = wave[self.next[wave] >= 0]
            np.add.at(self.acc, self.next[wave], self.acc[wave])


def entering(pdf: pd.DataFrame) -> pd.DataFrame:
    """links of one grid -> id, n: cells from other tiles that drain into a border cell."""
    x = _Exits(pdf)
    ids, at = np.unique(x.target, return_inverse=True)
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, at, x.acc)
    return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "id": ids, "n": n})


_WALK = _schema(id=pa.int64(), end=pa.int64(), target=pa.int64(), acc=pa.int64(), place=pa.int64(), straight=pa.int64(), diagonal=pa.int64(), out_diagonal=pa.bool_())


def _entered(d: _Drains, row: dict) -> np.ndarray:
    n = np.zeros(len(d.to), np.int64)
    if row["id"]:
        n[d.places(row["id"])] = row["n"]
    return n


def _walks(side: int) -> Callable[[dict], dict[str, np.ndarray]]:
    """links again, with border cells' places in their end's walk and the steps to it, now that what enters is known."""

    def work(row: dict) -> dict[str, np.ndarray]:
        d = _Drains(row, side)
        own, more = d.down(d.there.astype(np.int64)), _entered(d, row)
        end, place, straight, diagonal = d.up(d.down(d.there + more), more)
        at = np.unique(np.concatenate((d.border, np.flatnonzero((d.target != SEA) & d.there))))
        e = end[at]
        return {"id": d.ids(at), "end": d.ids(e), "target": d.target[e], "acc": own[e], "place": place[at], "straight": straight[at], "diagonal": diagonal[at], "out_diagonal": d.diagonal[e]}

    return work


def numbered_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """walks of one grid -> id of each exit, the root of its tree, its place in the root's walk, and its steps to the root."""
    x = _Exits(pdf)
    n = len(x.id)
    w = pdf.sort_values("id")
    place, straight, diagonal = (w[c].to_numpy().astype(np.int64) for c in ("place", "straight", "diagonal"))
    out_diagonal = pdf.drop_duplicates("end").set_index("end")["out_diagonal"].reindex(x.id).to_numpy(bool) if n else np.zeros(0, bool)
    into = np.searchsorted(x.border, x.target)
    # exits into one cell follow each other, by number
    order = np.lexsort((x.id, x.target))
    before = np.cumsum(x.acc[order]) - x.acc[order]
    first = np.ones(n, bool)
    first[1:] = x.target[order][1:] != x.target[order][:-1]
    shift = np.zeros(n, np.int64)
    if n:
        shift[order] = before - np.repeat(before[first], np.diff(np.concatenate((np.flatnonzero(first), [n]))))
    step = (place[into] + 1 + shift, straight[into] + ~out_diagonal, diagonal[into] + out_diagonal) if n else (np.zeros(0, np.int64),) * 3
    root, sums = x.last.copy(), [s.copy() for s in step]
    for wave in reversed(x.waves):
        wave = wave[x.next[wave] >= 0]
        t = x.next[wave]
        root[wave] = root[t]
        for s, own in zip(sums, step, strict=True):
            s[wave] = s[t] + own[wave]
    return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "id": x.id, "root": root, "place": sums[0], "straight": sums[1], "diagonal": sums[2]})


def _cells(d: _Drains, **columns: np.ndarray) -> dict[str, np.ndarray]:
    at = np.flatnonzero(d.there)
    r, c = np.divmod(at, d.w)
    return {"row": (r + d.r0).astype(np.int32), "col": (c + d.c0).astype(np.int32)} | {k: v[at] for k, v in columns.items()}


def _pointer_tiles(flow: DataFrame, side: int) -> DataFrame:
    shared(flow)
    move = F.create_map(*[x for (dr, dc), code in _MOVES.items() for x in (F.lit(3 * dr + dc), F.lit(code))])
    code = F.coalesce(F.try_element_at(move, (3 * (F.col("down_row") - F.col("row")) + F.col("down_col") - F.col("col")).cast("int")), F.lit(0))
    return _packed(flow, code, side, False, -1.0).checkpoint()


def _with_entering(tiles: DataFrame, side: int) -> DataFrame:
    more = _each(tiles, _links(side), _LINK).groupBy("grid_id").applyInPandas(entering, "grid_id long, id long, n long")
    return tiles.join(_by_tile(more, _own_tile(side), "n"), TILE, "left")


def _with_exits(tiles: DataFrame, side: int) -> DataFrame:
    exits = _each(tiles, _walks(side), _WALK).groupBy("grid_id").applyInPandas(numbered_exits, "grid_id long, id long, root long, place long, straight long, diagonal long")
    at = _by_tile(exits, _own_tile(side), "root", "place", "straight", "diagonal")
    return tiles.join(at.select(*TILE, *[F.col(c).alias(f"x_{c}") for c in ("id", "root", "place", "straight", "diagonal")]), TILE, "left")


def _gathered(side: int, surface: bool, tree: bool) -> tuple[Callable[[dict], dict[str, np.ndarray]], pa.Schema]:
    """A tile's cells with acc, with filled and fdir if there is a surface, and with their place in the tree of their end if asked for."""
    schema = _schema(row=pa.int32(), col=pa.int32(), **({"filled": pa.float64(), "fdir": pa.int32()} if surface else {}), acc=pa.int64(), **(dict.fromkeys(("root", "place", "straight", "diagonal"), pa.int64()) if tree else {}))

    def work(row: dict) -> dict[str, np.ndarray]:
        d = _Drains(row, side)
        more = _entered(d, row)
        acc = d.down(d.there + more)
        out = {"acc": acc}
        if surface:
            out |= {"filled": np.frombuffer(row["filled"], float), "fdir": np.frombuffer(row["data"], float).astype(np.int32)}
        if tree:
            end, place, straight, diagonal = d.up(acc, more)
            root = d.ids(np.arange(len(acc)))
            base = {c: np.zeros(len(acc), np.int64) for c in ("place", "straight", "diagonal")}
            if row["x_id"]:
                k = d.places(row["x_id"])
                root[k] = row["x_root"]
                for c, v in base.items():
                    v[k] = row[f"x_{c}"]
            out |= {"root": root[end], "place": place + base["place"][end], "straight": straight + base["straight"][end], "diagonal": diagonal + base["diagonal"][end]}
        return _cells(d, **out)

    return work, schema


def accumulation(flow: DataFrame, side: int = SIDE) -> DataFrame:
    """G-07: flow(grid_id, row, col, down_row, down_col) -> grid_id, row, col, acc: cells that drain through each, itself included."""
    return _each(_with_entering(_pointer_tiles(flow, side), side), *_gathered(side, False, False))


def trees(flow: DataFrame, side: int = SIDE) -> DataFrame:
    """G-07, G-09, G-10: grid_id, row, col, acc, root (row << 32 | col of the end of the flow), place (the cells upstream of a cell have its root and places from its own on, acc of them), and straight and diagonal steps to the end."""
    return _each(_with_exits(_with_entering(_pointer_tiles(flow, side), side).checkpoint(), side), *_gathered(side, False, True))


def routed(cells: DataFrame, cell_m: float = 1.0, side: int = SIDE, tree: bool = False, eps: float = kernels.EPSILON) -> DataFrame:
    """G-01, G-05, G-07: cells(grid_id, row, col, z) -> filled, fdir and acc of each, and its place in the tree of its end (see trees) if asked for; the tiles are dealt once."""
    tiles = _flooded(cells, cell_m, side, eps).checkpoint()
    tiles = _with_entering(tiles, side)
    return _each(_with_exits(tiles.checkpoint(), side) if tree else tiles, *_gathered(side, True, tree))
