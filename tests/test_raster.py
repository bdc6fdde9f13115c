import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.sources import raster, tiff


def read_at(data):
    return lambda offset, n: data[offset : offset + n]


def packed_lzw(data):
    """The straightforward encoder of the TIFF specification."""
    bits, table, width, w = [], {bytes([k]): k for k in range(256)}, 9, b""
    put = lambda code: bits.append(f"{code:0{width}b}")
    put(256)
    n = 258
    for byte in data:
        c = bytes([byte])
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c] = n
        n += 1
        width = next(x for x in (9, 10, 11, 12) if n < (1 << x))
        if n == 4094:
            put(256)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = c
    if w:
        put(table[w])
        n += 1
        width = min(12, next(x for x in (9, 10, 11, 12, 13) if n < (1 << x)))
    put(257)
    s = "".join(bits)
    s += "0" * (-len(s) % 8)
    return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8))


def plain_file(a, order="<", big=False, strip=3, compression=1, predictor=1, planar=False, centre=False):
    """A file with strips of an array (rows, cols) or (rows, cols, samples)."""
    a3 = a if a.ndim == 3 else a[:, :, None]
    rows, cols, samples = a3.shape
    layers = [a3[:, :, [k]] for k in range(samples)] if planar else [a3]
    pieces = []
    for layer in layers:
        for r in range(0, rows, strip):
            part = layer[r : r + strip].astype(a.dtype.newbyteorder(order))
            if predictor == 2:
                native = layer[r : r + strip]
                part = np.concatenate((native[:, :1], np.diff(native, axis=1)), 1).astype(a.dtype.newbyteorder(order))
            raw = part.tobytes()
            if predictor == 3:
                planes = layer[r : r + strip].astype(a.dtype.newbyteorder(">")).reshape(part.shape[0], -1, 1).view(np.uint8).transpose(0, 2, 1).reshape(part.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
            pieces.append({1: lambda x: x, 5: packed_lzw, 8: zlib.compress}[compression](raw))
    word, kind = ("Q", 16) if big else ("I", 4)
    fmt = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 3, (cols,)), (257, 3, (rows,)), (258, 3, (a.dtype.itemsize * 8,) * samples), (259, 3, (compression,)), (273, kind, None), (277, 3, (samples,)), (278, 3, (strip,)), (279, kind, tuple(map(len, pieces))), (284, 3, (2 if planar else 1,)),
        (317, 3, (predictor,)), (339, 3, (fmt,) * samples), (33550, 12, (0.5, 0.25, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 77.0, 21.0, 0.0)), (34735, 3, (1, 1, 0, 2, 1025, 0, 1, 2 if centre else 1, 2048, 0, 1, 4326)), (42113, 2, b"-1\0")]
    head = struct.pack(order + "2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    entry, inside = (20, 8) if big else (12, 4)
    room = len(head) + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    starts, at = [], room
    for p in pieces:
        starts.append(at)
        at += len(p)
    table, extra = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    for tag, k, v in tags:
        v = tuple(starts) if v is None else v
        raw = v if k == 2 else struct.pack(f"{order}{len(v)}{tiff.KINDS[k]}", *v)
        table += struct.pack(f"{order}HH{word}", tag, k, len(v))
        if len(raw) <= inside:
            table += raw.ljust(inside, b"\0")
        else:
            table += struct.pack(order + word, at + len(extra))
            extra += raw
    return head + table + struct.pack(order + word, 0) + b"".join(pieces) + extra


def cells_of(header, level, data, band=0):
    i = header.images[level]
    out = np.zeros((i.height, i.width), np.dtype(i.dtype).newbyteorder("="))
    for n, (offset, size) in i.places.items():
        if n // (i.across * i.down) != (band if i.planar else 0):
            continue
        k = n % (i.across * i.down)
        a = tiff.tile_array(i, k, data[offset : offset + size], band)
        r, c = i.tile_height * (k // i.across), i.tile_width * (k % i.across)
        out[r : r + a.shape[0], c : c + a.shape[1]] = a
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(("dtype", "predictor"), [("u1", 1), ("u1", 2), ("i2", 2), ("u4", 1), ("f4", 1), ("f4", 3), ("f8", 3)])
def test_strips_of_all_kinds(order, big, compression, dtype, predictor):
    rng = np.random.default_rng(5)
    for shape, planar in (((7, 5), False), ((40, 31), False), ((6, 4, 3), False), ((6, 4, 3), True)):
        a = (rng.random(shape) * 200).astype(dtype)
        data = plain_file(a, order, big, compression=compression, predictor=predictor, planar=planar)
        h = tiff.read_header(read_at(data))
        assert h.transform == (0.5, 0.0, 77.0, 0.0, -0.25, 21.0) and h.epsg == 4326 and h.nodata == -1
        for band in range(shape[2] if len(shape) == 3 else 1):
            assert (cells_of(h, 0, data, band) == (a[:, :, band] if a.ndim == 3 else a)).all()


def test_tie_points_at_centres():
    assert tiff.read_header(read_at(plain_file(np.zeros((3, 3), "f4"), centre=True))).transform == (0.5, 0.0, 76.75, 0.0, -0.25, 21.125)


@pytest.mark.parametrize("data", [b"", b"II*\0", b"no tiff at all..", b"II*\0\x08\0\0\0\0\0\0\0\0\0"])
def test_other_files_are_refused(data):
    with pytest.raises((ValueError, struct.error)):
        tiff.read_header(read_at(data))


def test_other_compressions_and_short_tiles_are_refused():
    data = bytearray(plain_file(np.ones((3, 3), "f4")))
    at = data.find(struct.pack("<HHI", 259, 3, 1))
    data[at + 8] = 7
    with pytest.raises(ValueError, match="compression 7"):
        tiff.read_header(read_at(bytes(data)))
    h = tiff.read_header(read_at(plain_file(np.ones((3, 3), "f4"))))
    with pytest.raises(ValueError, match="cut short"):
        tiff.tile_array(h.images[0], 0, b"1234")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000) | st.integers(1, 9000).map(lambda n: bytes(range(256)) * (n // 256)) | st.integers(0, 20000).map(lambda n: b"ab" * n))
def test_lzw(data):
    assert tiff.unpacked_lzw(packed_lzw(data)) == data


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 70), st.integers(1, 70), st.sampled_from(["float32", "uint8", "int16"]), st.booleans())
def test_written_files_read_back(rows, cols, dtype, average):
    rng = np.random.default_rng(rows * 100 + cols)
    a = np.rint(rng.random((rows, cols)) * 200)
    a[rng.random((rows, cols)) < 0.2] = np.nan
    nodata = 255.0 if dtype == "uint8" else -9999.0
    data, stats = tiff.encoded(a, (30.0, 0.0, 500000.0, 0.0, -30.0, 2350000.0), 32644, dtype, nodata, average, side=16)
    assert data == tiff.encoded(a, (30.0, 0.0, 500000.0, 0.0, -30.0, 2350000.0), 32644, dtype, nodata, average, side=16)[0]
    h = tiff.read_header(read_at(data))
    assert h.epsg == 32644 and h.nodata == nodata and len(h.images) == stats["overviews"] + 1 and max(h.images[-1].width, h.images[-1].height) <= 16
    assert stats["valid"] == np.isfinite(a).sum() and (not stats["valid"] or stats["min"] == np.nanmin(a))
    level = a
    for k in range(len(h.images)):
        want = np.where(np.isfinite(level), level, nodata)
        assert (cells_of(h, k, data) == (want if dtype == "float32" else np.rint(want)).astype(dtype)).all()
        up = np.full((-(-level.shape[0] // 2), -(-level.shape[1] // 2)), np.nan)
        for r in range(up.shape[0]):
            for c in range(up.shape[1]):
                four = level[2 * r : 2 * r + 2, 2 * c : 2 * c + 2]
                up[r, c] = (np.nan if np.isnan(four).all() else np.nansum(four) / np.isfinite(four).sum()) if average else four[0, 0]
        level = up


def grid(spark, n_rows, n_cols, grid_id=1, x0=0.0, y0=0.0, cell=1.0):
    d = spark.range(n_rows * n_cols).select(F.lit(grid_id).cast("long").alias("grid_id"), F.floor(F.col("id") / n_cols).cast("int").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"))
    z = F.when((F.col("row") + F.col("col")) % 7 == 0, None).otherwise(F.col("row") * 10.0 + F.col("col"))
    g = spark.createDataFrame([(grid_id, n_rows, n_cols, [cell, 0.0, x0, 0.0, -cell, y0], 4326)], "grid_id long, n_rows int, n_cols int, transform array<double>, epsg int")
    return d.withColumn("z", z), g


def test_large_grids_are_cut_into_files_and_read_back(spark, tmp_path):
    d, g = grid(spark, 50, 37)
    cat = raster.write(d, g, str(tmp_path / "r"), file_side=16, tile=8)
    assert cat.count() == 4 * 3 and {r.overviews for r in cat.collect()} == {1, 0}
    got = {(r.x, r.y): r.value for r in raster.read(spark, str(tmp_path / "r")).collect()}
    assert got == {(r.col + 0.5, -r.row - 0.5): r.z for r in d.collect()}
    for r in cat.collect():
        data = (tmp_path / "r" / f"{r.file}.tif").read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.size_bytes, r.sha256)
    # the same cells give the same bytes, from any partitions
    again = raster.write(d.repartition(7), g, str(tmp_path / "s"), file_side=16, tile=8)
    assert sorted(again.select("file", "sha256").collect()) == sorted(cat.select("file", "sha256").collect())
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.name.startswith(".staging")) == []
    kept = raster.files(spark, f"file:{tmp_path}/r").collect()
    assert len(kept) == 12 and sum(f.n_rows * f.n_cols for f in kept) == 50 * 37


def test_a_box_opens_only_its_tiles(spark, tmp_path):
    from pyspark.sql import datasource as ds

    d, g = grid(spark, 64, 64)
    raster.write(d, g, str(tmp_path / "r"), tile=16)
    path = str(tmp_path / "r")
    reader = raster.CellReader({"path": path})
    filters = [ds.GreaterThanOrEqual(("x",), 17.0), ds.LessThan(("x",), 30.0), ds.GreaterThan(("y",), -15.6), ds.LessThanOrEqual(("y",), -3.0)]
    assert reader.pushFilters(filters) == filters
    assert [[list(p.image.places) for p in x.parts] for x in reader.partitions()] == [[[1]]]
    # tiles of many files go together, and those of a large one are divided
    assert [len(x.parts) for x in raster.CellReader({"path": path, "cells": 4 * 256}).partitions()] == [1] * 4
    # the other tiles may even be broken
    file = tmp_path / "r" / "1.tif"
    h = tiff.read_header(read_at(file.read_bytes()))
    data = bytearray(file.read_bytes())
    for k, (offset, size) in h.images[0].places.items():
        if k != 1:
            data[offset : offset + size] = b"\xff" * size
    file.write_bytes(bytes(data))
    got = raster.read(spark, path, box=(17.0, -15.6, 30.0, -3.0))
    assert sorted((r.row, r.col, r.value) for r in got.collect()) == sorted((r.row, r.col, r.z) for r in d.collect() if 17 <= r.col + 0.5 <= 30 and 3 <= r.row + 0.5 <= 15.6)
    assert raster.read(spark, path).where("file = 'other'").count() == 0


def test_overviews_by_cell_size(spark, tmp_path):
    d, g = grid(spark, 64, 48, cell=2.0)
    raster.write(d, g, str(tmp_path / "r"), tile=16)
    for cell, level in ((1, 0), (3.9, 0), (4, 1), (9, 2), (100, 2)):
        got = raster.read(spark, str(tmp_path / "r"), cell=cell).agg(F.min("level"), F.max("level"), F.count("*")).first()
        assert tuple(got) == (level, level, (64 >> level) * (48 >> level))
    assert raster.read(spark, str(tmp_path / "r"), level=7).count() == 0


def test_a_failed_job_leaves_the_old_files(spark, tmp_path):
    d, g = grid(spark, 20, 20)
    folder = tmp_path / "r"
    raster.write(d, g, str(folder))
    before = {p.name: p.read_bytes() for p in folder.iterdir()}
    bad = raster.strips(d, g).withColumn("row", F.when(F.col("row") == 19, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("row")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format(raster.NAME).mode("overwrite").save(str(folder))
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == before


def test_appending_keeps_other_files(spark, tmp_path):
    for k in (1, 2):
        d, g = grid(spark, 5, 5, grid_id=k)
        cat = raster.write(d, g, str(tmp_path / "r"), mode="append")
    assert [r.file for r in cat.orderBy("file").collect()] == ["1", "2"]
    d, g = grid(spark, 4, 4, grid_id=3)
    assert [r.file for r in raster.write(d, g, str(tmp_path / "r")).collect()] == ["3"]


def test_empty_folders_and_grids_without_values(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert raster.read(spark, str(tmp_path / "e")).count() == 0 and raster.files(spark, str(tmp_path / "e")).count() == 0
    d, g = grid(spark, 3, 3)
    cat = raster.write(d.withColumn("z", F.lit(None).cast("double")), g, str(tmp_path / "n")).first()
    assert (cat.valid, cat.min, cat["nodata"]) == (0, None, 9)
    assert raster.read(spark, str(tmp_path / "n")).where("value is not null").count() == 0


def test_resampling_over_files(spark, tmp_path):
    """Two files side by side, the eastern one lower, against a loop."""
    rng = np.random.default_rng(3)
    arrays = {1: np.rint(rng.random((6, 5)) * 50), 2: np.rint(rng.random((6, 5)) * 50)}
    arrays[1][2, 4], arrays[2][0, 0] = np.nan, np.nan
    origin = {1: (0.0, 6.0), 2: (5.0, 5.0)}
    rows = [(k, r, c, None if np.isnan(v) else float(v)) for k, a in arrays.items() for (r, c), v in np.ndenumerate(a)]
    d = spark.createDataFrame(rows, "grid_id long, row int, col int, z double")
    g = spark.createDataFrame([(k, 6, 5, [1.0, 0.0, x, 0.0, -1.0, y], 4326) for k, (x, y) in origin.items()], "grid_id long, n_rows int, n_cols int, transform array<double>, epsg int")
    raster.write(d, g, str(tmp_path / "r"))
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((80, 2)) * [14, 9] - [2, 1])]
    p = spark.createDataFrame(points, "id long, x double, y double")
    args = (p, raster.files(spark, str(tmp_path / "r")), raster.read(spark, str(tmp_path / "r")), ["id"])
    smooth = {r.id: r.value for r in raster.bilinear(*args).collect()}
    near = {r.id: r.value for r in raster.nearest(*args).collect()}
    for i, x, y in points:
        want = {"smooth": None, "near": None}
        for k in (2, 1):  # from the south
            sr, sc = origin[k][1] - y - 0.5, x - origin[k][0] - 0.5
            inside = lambda r, c: 0 <= r < 6 and 0 <= c < 5 and not np.isnan(arrays[k][r, c])
            if want["near"] is None and inside(int(np.floor(sr + 0.5)), int(np.floor(sc + 0.5))):
                want["near"] = arrays[k][int(np.floor(sr + 0.5)), int(np.floor(sc + 0.5))]
            r0, c0 = int(np.floor(sr)), int(np.floor(sc))
            four = [((1 - abs(sr - r)) * (1 - abs(sc - c)), arrays[k][r, c]) for r in (r0, r0 + 1) for c in (c0, c0 + 1) if inside(r, c)]
            if want["smooth"] is None and four:
                want["smooth"] = sum(w * v for w, v in four) / sum(w for w, _ in four)
        assert near[i] == want["near"] and smooth[i] == pytest.approx(want["smooth"]), (i, x, y)


def test_window_of_degree_tiles_on_a_metric_grid(spark, tmp_path):
    """A plane in degrees over two tiles: any point between centres is the plane's value; beyond the tiles there is no terrain."""
    from rillwork.functions import geo

    d = spark.range(2 * 100 * 100).select((F.col("id") / 10_000).cast("long").alias("grid_id"), (F.floor(F.col("id") / 100) % 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    z = F.lit(300.0) + (F.col("grid_id") * 100 + F.col("col")) * 2 + F.col("row") * 3
    g = spark.createDataFrame([(k, 100, 100, [0.001, 0.0, 77.0 + 0.1 * k, 0.0, -0.001, 21.0], 4326) for k in (0, 1)], "grid_id long, n_rows int, n_cols int, transform array<double>, epsg int")
    raster.write(d.withColumn("z", z), g, str(tmp_path / "r"), tile=32)
    grids, cells = raster.dem_window(spark, str(tmp_path / "r"), (77.08, 20.94, 77.12, 20.96), cell_m=90.0)
    about = grids.first()
    assert about.terrain == "data" and about.tiles == 2 and about.epsg == 32643 and about.valid == about.n_rows * about.n_cols
    at = geo.cell_centre(F.array(*map(F.lit, about.transform)), F.col("row"), F.col("col"))
    p = geo.from_utm(at["x"], at["y"], F.lit(about.epsg))
    off = cells.withColumn("p", p).withColumns({"lon": F.col("p.lon"), "lat": F.col("p.lat")})
    plane = 300 + ((F.col("lon") - 77.0) / 0.001 - 0.5) * 2 + ((21.0 - F.col("lat")) / 0.001 - 0.5) * 3
    # between the two tiles the western one's rim stands for what is beyond it, by less than a cell
    far = off.withColumn("off", F.abs(F.col("z") - plane)).agg(F.max(F.when(F.abs(F.col("lon") - 77.1) > 0.0006, F.col("off"))).alias("inside"), F.max("off").alias("seam")).first()
    assert far.inside < 1e-3 and far.seam <= 2.0
    empty, _ = raster.dem_window(spark, str(tmp_path / "r"), (80.0, 20.94, 80.01, 20.95), cell_m=90.0)
    assert empty.first().terrain == "no tiles"
    with pytest.raises(ValueError, match="more than"):
        raster.dem_window(spark, str(tmp_path / "r"), (77.0, 20.0, 79.0, 21.0), cell_m=1.0)


def test_points_and_cells_meet_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raster, "MOST_MET", 16)
    cells = spark.range(64).select(F.lit(7).cast("long").alias("grid_id"), (F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").cast("double").alias("z"))
    grids = spark.sql("SELECT 7L AS grid_id, 8 AS n_rows, 8 AS n_cols, array(1D, 0D, 0D, 0D, -1D, 8D) AS transform, 4326 AS epsg")
    raster.write(cells, grids, str(tmp_path / "t"))
    points = spark.range(16).select("id", (F.col("id") / 2.0 + 0.25).alias("x"), F.lit(4.0).alias("y"))
    for how, each in ((raster.bilinear, 4), (raster.nearest, 1)):
        got = how(points, raster.files(spark, str(tmp_path / "t")), raster.read(spark, str(tmp_path / "t")), ["id"])
        assert got.rdd.getNumPartitions() == 1 + (each * 16 + 64) // 16 and got.where("value is not null").count() == 16
