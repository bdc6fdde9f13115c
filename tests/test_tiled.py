import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import kernels, streams, terrain, tiled

DDL = "grid_id long, row int, col int, z double"


def landscapes():
    """Grids by number: noise, steps of whole metres (flats), bowls, valleys with nodata, single cells, strips."""
    rng = np.random.default_rng(11)
    out = {}
    for k in range(6):
        out[k] = rng.random((int(rng.integers(5, 40)), int(rng.integers(5, 40)))) * 10
    for k in range(6, 12):
        out[k] = np.rint(rng.random((23, 31)) * 3)
    r, c = np.indices((37, 29))
    out[12] = np.hypot(r - 18, c - 14)  # a bowl: one lake over many tiles
    out[13] = np.where(np.hypot(r - 18, c - 14) < 12, 0.0, 5 + 0.01 * r)  # a flat lake
    out[14] = 10 - 0.1 * r + np.abs(c - 14) * 0.05 + rng.random(r.shape) * 0.3
    out[15] = np.zeros((19, 19))
    for k in range(16, 19):
        z = np.rint(rng.random((33, 26)) * 20) / 4
        z[rng.random(z.shape) < 0.08] = np.nan
        out[k] = z
    out[19], out[20], out[21] = np.array([[3.0]]), np.arange(12.0)[None, :] % 5, np.full((6, 6), np.nan)
    spiral = np.full((25, 25), 9.0)
    at, step = [12, 12], 0
    for n in range(1, 23):
        for _ in range(n):
            if 0 <= at[0] < 25 and 0 <= at[1] < 25:
                spiral[at[0], at[1]] = 1.0
            at[step % 2] += 1 if step % 4 < 2 else -1
        step += 1
    out[22] = spiral  # a long winding lake
    return out


GRIDS = landscapes()


def frame(spark, gaps=False):
    rows = []
    for k, z in GRIDS.items():
        for (r, c), v in np.ndenumerate(z):
            if not (gaps and (r * 7 + c * 3 + k) % 29 == 0):
                rows.append((k, r, c, None if np.isnan(v) else float(v)))
    return spark.createDataFrame(rows, DDL).repartition(5)


def arrays(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r.grid_id, {})[r.row, r.col] = tuple(r[n] for n in names)
    return out


@pytest.mark.parametrize(("side", "gaps"), [(3, False), (8, False), (8, True), (512, False)])
def test_flooding_by_tiles_is_flooding_at_once(spark, side, gaps):
    d = frame(spark, gaps)
    got = arrays(tiled.filled(d, 5.0, side=side), "filled", "fdir")
    there = arrays(d, "z")
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in there.items()}
    for k, z in GRIDS.items():
        z = np.array(z)
        for at in np.ndindex(z.shape):
            if at not in there.get(k, {}):
                z[at] = np.nan
        want = kernels.fill(z)
        code = kernels.direction(want, 5.0)
        for at, (w, f) in got.get(k, {}).items():
            assert (w is None and np.isnan(want[at])) or w == want[at], (k, at, w, want[at])
            assert f == code[at], (k, at)


@pytest.fixture(scope="module")
def pointed(spark):
    d = tiled.filled(frame(spark), 5.0, side=16)
    return terrain.with_pointer(d).checkpoint()


@pytest.mark.parametrize("side", [3, 8, 512])
def test_drainage_by_tiles(spark, pointed, side):
    codes = {k: np.zeros(z.shape, np.uint8) for k, z in GRIDS.items()}
    for r in pointed.collect():
        codes[r.grid_id][r.row, r.col] = r.fdir
    acc = arrays(tiled.accumulation(pointed, side), "acc")
    tree = arrays(tiled.trees(pointed, side), "acc", "root", "place", "straight", "diagonal")
    for k, code in codes.items():
        want = kernels.accumulation(code)
        to = kernels.pointers(code)
        assert all(acc[k][at] == (want[at],) for at in np.ndindex(code.shape))
        places: dict = {}
        for at in np.ndindex(code.shape):
            a, root, place, straight, diagonal = tree[k][at]
            assert a == want[at]
            r, c, s, d = *at, 0, 0
            while to[r, c] >= 0:
                r2, c2 = divmod(int(to[r, c]), code.shape[1])
                s, d = s + (r2 == r or c2 == c), d + (r2 != r and c2 != c)
                r, c = r2, c2
            assert (root, straight, diagonal) == (r << 32 | c, s, d)
            places.setdefault(root, {})[place] = at
        for root, p in places.items():
            assert sorted(p) == list(range(len(p)))  # a walk names each cell once
        for at in [(0, 0), *[tuple(x) for x in np.argwhere(want > 6)[:4].tolist()]]:
            mine = {c for p, c in places[tree[k][at][1]].items() if tree[k][at][2] <= p < tree[k][at][2] + tree[k][at][0]}
            assert mine == {tuple(x) for x in np.argwhere(kernels.catchment(code, *at)).tolist()}


def test_pointers_out_of_the_table_are_ends(spark):
    rows = [(1, 0, 0, 0, 1), (1, 0, 1, 0, 2), (1, 5, 5, 4, 4), (1, 4, 4, None, None), (1, 4, 3, -1, 3), (2, 0, 0, -1, 0)]
    d = spark.createDataFrame(rows, "grid_id long, row int, col int, down_row int, down_col int")
    got = {(r.grid_id, r.row, r.col): r.acc for r in tiled.accumulation(d, 2).collect()}
    assert got == {(1, 0, 0): 1, (1, 0, 1): 2, (1, 5, 5): 1, (1, 4, 4): 2, (1, 4, 3): 1, (2, 0, 0): 1}


def test_empty_tables(spark):
    assert tiled.filled(spark.createDataFrame([], DDL)).count() == 0
    f = spark.createDataFrame([], "grid_id long, row int, col int, down_row int, down_col int")
    assert tiled.accumulation(f).count() == 0 and tiled.trees(f).count() == 0


def test_forest_keeps_the_cheapest_joins():
    a, b, cost = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([5.0, 1.0, 2.0, 9.0])
    assert sorted(tiled.spanning_forest(a, b, cost, 4).tolist()) == [1, 2, 3]


@pytest.mark.parametrize("side", [4, 512])
def test_reaches_by_tiles(spark, pointed, side):
    """Orders and reaches of all grids against the walk over one grid, whole and within a catchment."""
    acc = tiled.accumulation(pointed, 8)
    cells = pointed.select("grid_id", "row", "col", "fdir").join(acc, ["grid_id", "row", "col"]).checkpoint()
    codes = {k: np.zeros(z.shape, np.uint8) for k, z in GRIDS.items()}
    for r in pointed.collect():
        codes[r.grid_id][r.row, r.col] = r.fdir
    masks = {}
    for k, code in codes.items():
        a = kernels.accumulation(code)
        masks[k] = kernels.catchment(code, *np.unravel_index(a.argmax(), a.shape))
    inside = spark.createDataFrame([(k, int(r), int(c)) for k, m in masks.items() for r, c in np.argwhere(m)], "grid_id long, row int, col int")
    for within in (None, inside):
        got = {}
        for r in streams.reaches(cells, 3, 5.0, within, side=side).collect():
            got.setdefault(r.grid_id, []).append((r.order, list(zip(r.rows, r.cols, strict=True)), round(r.length_m, 6)))
            assert r.reach == r.rows[0] << 32 | r.cols[0] and r.problem is None
        orders = {(r.grid_id, r.row, r.col): r.order for r in streams.orders(cells, 3, within, side=side).collect()}
        for k, code in codes.items():
            on = kernels.accumulation(code) >= 3
            on = on & masks[k] if within is not None else on
            assert sorted(got.get(k, [])) == sorted((r["order"], r["cells"], round(r["length_m"], 6)) for r in kernels.reaches(on, code, 5.0))
            want = kernels.strahler(on, code)
            assert {at: int(want[at]) for at in zip(*np.nonzero(want), strict=True)} == {(r, c): o for (g, r, c), o in orders.items() if g == k}


def test_networks_beyond_the_limit_are_refused(spark, pointed):
    acc = tiled.accumulation(pointed, 8)
    cells = pointed.select("grid_id", "row", "col", "fdir").join(acc, ["grid_id", "row", "col"])
    got = streams.reaches(cells, 1, 5.0, most=400).collect()
    large = {k for k, z in GRIDS.items() if z.size > 400}
    assert {r.grid_id for r in got if r.problem} == large and all(r.reach is None for r in got if r.problem)
    assert {r.grid_id for r in got if not r.problem} <= set(GRIDS) - large
