"""Rasters as a Spark data source: cells of GeoTIFF files read by tile, and files with overviews written by tasks.

    raster.register(spark)
    spark.read.format("raster").load(folder)                        # file, level, row, col, x, y, value
    spark.read.format("raster").option("cell", 30).load(folder)     # from the coarsest overview whose cells are no larger than that
    spark.read.format("raster").option("what", "files").load(folder)  # a row a file: its size, transform, EPSG code and overviews

Reading: only headers are read on the driver. Filters on x, y and file reach the source: tiles beyond them are never opened, and partitions hold tiles of about `cells` cells.
Writing (SNK-01): a file is made by one task from rows of its cells, in a staging folder; the commit moves files to their names and writes the catalogue (catalogue.json, a line a file with statistics
and the file's SHA-256) last. A failed job or attempt leaves nothing but the staging folder, which the next commit or the abort removes. Grids beyond file_side cells a side become several files, so a task holds
file_side squared cells at most.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from rillwork.functions import geo
from rillwork.operators import terrain
from rillwork.sources import tiff

CELLS, FILE_SIDE, TILE_SIDE, MOST_CELLS, NAME = 1 << 20, 4096, 512, 20_000_000, "raster"
#: Rows that a task holds where points meet cells, on average.
MOST_MET = 1 << 19
_CELL = pa.schema([("file", pa.string()), ("level", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("value", pa.float64())])
_CELL_DDL = "file string, level int, row int, col int, x double, y double, value double"
_FILE_DDL = "file string, n_rows int, n_cols int, transform array<double>, epsg int, nodata double, type string, tile_rows int, tile_cols int, overviews int, west double, south double, east double, north double"
_STRIP_DDL = "file string, n_rows int, n_cols int, transform array<double>, epsg int, row int, cols array<int>, values array<double>"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it; paths without a scheme are local, as those of file:."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = path.rstrip("/")
    return sorted(f"{root}/{i.path.removeprefix(at.rstrip('/')).lstrip('/')}" for i in system.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))


def _header(path: str) -> tiff.Header:
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        size = f.size()
        return tiff.read_header(lambda offset, n: f.read_at(min(n, max(0, size - offset)), offset))


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _bounds(t: tuple[float, ...], rows: tuple[int, int], cols: tuple[int, int]) -> tuple[float, float, float, float]:
    """(least x, least y, greatest x, greatest y) of cells' corners."""
    xs, ys = zip(*((t[2] + t[0] * c + t[1] * r, t[5] + t[3] * c + t[4] * r) for r in rows for c in cols), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


class RasterSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _FILE_DDL if self.options.get("what") == "files" else _CELL_DDL

    def reader(self, schema) -> ds.DataSourceReader:  # noqa: ANN001
        return FileReader(self.options) if self.options.get("what") == "files" else CellReader(self.options)

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:  # noqa: ANN001
        return RasterWriter(self.options, overwrite)


@dataclass
class TilePart(ds.InputPartition):
    path: str
    level: int
    transform: tuple[float, ...]
    nodata: float | None
    image: tiff.Image

    def __init__(self, path: str, level: int, transform: tuple[float, ...], nodata: float | None, image: tiff.Image):
        super().__init__(None)
        self.path, self.level, self.transform, self.nodata, self.image = path, level, transform, nodata, image


@dataclass
class TileParts(ds.InputPartition):
    """Parts of small files that one task reads after each other."""

    parts: list[TilePart]

    def __init__(self, parts: list[TilePart]):
        super().__init__(None)
        self.parts = parts


@dataclass
class NamePart(ds.InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class FileReader(ds.DataSourceReader):
    """A row a file, headers read by tasks."""

    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("files", 64))

    def partitions(self) -> list[NamePart]:
        paths = _files(self.path)
        return [NamePart(paths[k : k + self.each]) for k in range(0, len(paths), self.each)] or [NamePart([])]

    def read(self, partition: NamePart) -> Iterator[tuple]:
        for path in partition.paths:
            h = _header(path)
            i = h.images[0]
            yield (_stem(path), i.height, i.width, list(h.transform), h.epsg, h.nodata, np.dtype(i.dtype).name, i.tile_height, i.tile_width, len(h.images) - 1, *_bounds(h.transform, (0, i.height), (0, i.width)))


class CellReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.cell = options["path"], float(options["cell"]) if "cell" in options else None
        self.level, self.band, self.cells = int(options.get("level", 0)), int(options.get("band", 1)) - 1, int(options.get("cells", CELLS))
        self.box, self.names = [-math.inf, -math.inf, math.inf, math.inf], None

    def pushFilters(self, filters: list[ds.Filter]) -> list[ds.Filter]:  # noqa: N802
        """Ranges of x and y, and names of files, choose tiles; all filters are left to Spark too, as a tile holds more than what is asked for."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("x", "y"):
                k = "xy".index(column)
                if isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual | ds.EqualTo):
                    self.box[k] = max(self.box[k], f.value)
                if isinstance(f, ds.LessThan | ds.LessThanOrEqual | ds.EqualTo):
                    self.box[k + 2] = min(self.box[k + 2], f.value)
            elif column == "file" and isinstance(f, ds.EqualTo | ds.In):
                named = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.names = named if self.names is None else self.names & named
        return filters

    def partitions(self) -> list[ds.InputPartition]:
        paths = [p for p in _files(self.path) if self.names is None or _stem(p) in self.names]
        with ThreadPoolExecutor(16) as pool:
            each = [p for parts in pool.map(self._parts, paths) for p in parts]
        out, held = [[]], 0
        for p in each:
            size = len(p.image.places) * p.image.tile_width * p.image.tile_height
            if out[-1] and held + size > self.cells:
                out.append([])
                held = 0
            out[-1].append(p)
            held += size
        return [TileParts(x) for x in out]

    def _level(self, h: tiff.Header) -> int:
        if self.cell is None:
            return self.level
        fits = [k for k in range(len(h.images)) if abs(h.level_transform(k)[0]) <= self.cell * (1 + 1e-9)]
        return fits[-1] if fits else 0

    def _parts(self, path: str) -> list[TilePart]:
        h = _header(path)
        level = self._level(h)
        if level >= len(h.images):
            return []
        image, t = h.images[level], h.level_transform(level)
        wanted = [k for k in range(image.across * image.down) if self._meets(image, t, k)]
        each = max(1, self.cells // (image.tile_width * image.tile_height))
        skip = image.across * image.down * self.band if image.planar else 0
        return [TilePart(path, level, t, h.nodata, image.only([skip + n for n in wanted[k : k + each]])) for k in range(0, len(wanted), each)]

    def _meets(self, image: tiff.Image, t: tuple[float, ...], number: int) -> bool:
        r, c = image.tile_height * (number // image.across), image.tile_width * (number % image.across)
        # of centres, so half a cell inside the corners
        x0, y0, x1, y1 = _bounds(t, (r + 0.5, min(r + image.tile_height, image.height) - 0.5), (c + 0.5, min(c + image.tile_width, image.width) - 0.5))
        return x0 <= self.box[2] and x1 >= self.box[0] and y0 <= self.box[3] and y1 >= self.box[1]

    def read(self, partition: TileParts) -> Iterator[pa.RecordBatch]:
        for p in partition.parts:
            yield from self._read(p)

    def _read(self, p: TilePart) -> Iterator[pa.RecordBatch]:
        image, t = p.image, p.transform
        system, at = _opened(p.path)
        name = _stem(p.path)
        with system.open_input_file(at) as f:
            for number, (offset, size) in image.places.items():
                k = number % (image.across * image.down)
                r0, c0 = image.tile_height * (k // image.across), image.tile_width * (k % image.across)
                if not size:
                    rows, cols = min(image.tile_height, image.height - r0), min(image.tile_width, image.width - c0)
                    a = np.full((rows, cols), 0 if p.nodata is None else p.nodata)
                else:
                    a = tiff.tile_array(image, k, f.read_at(size, offset), self.band)
                # rows of at most 64K cells at a time
                step = max(1, (1 << 16) // max(1, a.shape[1]))
                for r in range(0, a.shape[0], step):
                    part = a[r : r + step]
                    row, col = (x.ravel() for x in np.meshgrid(np.arange(part.shape[0]) + r0 + r, np.arange(part.shape[1]) + c0, indexing="ij"))
                    v = part.ravel().astype(float)
                    gone = ~np.isfinite(v) if p.nodata is None else ~np.isfinite(v) | (part.ravel() == np.array(p.nodata).astype(part.dtype))
                    x, y = t[2] + t[0] * (col + 0.5) + t[1] * (row + 0.5), t[5] + t[3] * (col + 0.5) + t[4] * (row + 0.5)
                    n = len(v)
                    cols = [pa.array([name]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, p.level, np.int32)), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(x), pa.array(y), pa.array(v, mask=gone)]
                    yield pa.RecordBatch.from_arrays(cols, schema=_CELL)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class RasterWriter(ds.DataSourceArrowWriter):
    """Rows as in _STRIP_DDL, those of a file in one partition and together."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.dtype, self.nodata, self.product = options.get("type", "float32"), float(options.get("nodata", -9999.0)), options.get("product", "")
        self.average, self.side = options.get("resampling", "average") == "average", int(options.get("tile", TILE_SIDE))
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        attempt, made, name, array, about = TaskContext.get().taskAttemptId(), [], None, None, None

        def close() -> None:
            if name is not None:
                made.append(self._file(name, array, *about, attempt))

        for b in iterator:
            for k in range(b.num_rows):
                file, n_rows, n_cols = (b.column(c)[k].as_py() for c in range(3))
                if file != name:
                    close()
                    name, array, about = file, np.full((n_rows, n_cols), np.nan), (tuple(b.column(3)[k].as_py()), b.column(4)[k].as_py())
                cols, values = b.column(6)[k].values, b.column(7)[k].values
                array[b.column(5)[k].as_py(), cols.to_numpy()] = values.to_numpy(zero_copy_only=False)
        close()
        return Written(made)

    def _file(self, name: str, array: np.ndarray, transform: tuple[float, ...], epsg: int, attempt: int) -> dict:
        data, stats = tiff.encoded(array, transform, epsg, self.dtype, self.nodata, self.average, self.side, self.product)
        system, staging = _opened(self.staging)
        system.create_dir(staging)
        temporary = f"{name}.{attempt}.part"
        with system.open_output_stream(f"{staging}/{temporary}") as f:
            f.write(data)
        west, south, east, north = _bounds(transform, (0, array.shape[0]), (0, array.shape[1]))
        place = {"n_rows": array.shape[0], "n_cols": array.shape[1], "epsg": epsg, "west": west, "south": south, "east": east, "north": north}
        return {"file": name, "temporary": temporary, "product": self.product, "type": self.dtype, "nodata_value": self.nodata, "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), **place, **stats}

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        _, staging = _opened(self.staging)
        system.create_dir(root)
        if self.overwrite:
            for i in system.get_file_info(pafs.FileSelector(root)):
                if i.type == pafs.FileType.File and (i.path.endswith(".tif") or i.path.endswith("/catalogue.json")):
                    system.delete_file(i.path)
        lines = {}
        if not self.overwrite and system.get_file_info(f"{root}/catalogue.json").type == pafs.FileType.File:
            with system.open_input_stream(f"{root}/catalogue.json") as f:
                lines = {json.loads(x)["file"]: x for x in f.read().decode().splitlines()}
        for about in sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"]):
            temporary = about.pop("temporary")
            system.move(f"{staging}/{temporary}", f"{root}/{about['file']}.tif")
            lines[about["file"]] = json.dumps(about)
        if system.get_file_info(staging).type != pafs.FileType.NotFound:
            system.delete_dir(staging)
        with system.open_output_stream(f"{root}/catalogue.json") as f:
            f.write("".join(f"{x}\n" for x in lines.values()).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, staging = _opened(self.staging)
        if system.get_file_info(staging).type != pafs.FileType.NotFound:
            system.delete_dir(staging)


# --- DataFrames in and out


def strips(cells: DataFrame, grids: DataFrame, value: str = "z", file_side: int = FILE_SIDE) -> DataFrame:
    """cells(grid_id, row, col, value), grids(grid_id, n_rows, n_cols, transform, epsg) -> rows of files as the writer takes them: grid_id, or grid_id-i-j for the parts of a grid that is larger than a file. Null cells and cells that are not there are nodata."""
    side = F.lit(file_side)
    part = lambda c: F.floor(F.col(c) / side).cast("int")
    d = cells.where(F.col("row").isNotNull() & F.col("col").isNotNull()).select("grid_id", part("row").alias("i"), part("col").alias("j"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("v"))
    rows = d.groupBy("grid_id", "i", "j", "row").agg(F.collect_list(F.struct((F.col("col") - F.col("j") * side).alias("col"), F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("x"))
    g = grids.select("grid_id", F.col("n_rows").alias("nr"), F.col("n_cols").alias("nc"), F.col("transform").alias("t"), "epsg")
    j = rows.join(g, "grid_id")
    name = F.when((F.col("nr") <= side) & (F.col("nc") <= side), F.col("grid_id").cast("string")).otherwise(F.concat_ws("-", "grid_id", "i", "j"))
    t, r0, c0 = F.col("t"), F.col("i") * side, F.col("j") * side
    moved = F.array(t[0], t[1], t[2] + t[0] * c0 + t[1] * r0, t[3], t[4], t[5] + t[3] * c0 + t[4] * r0)
    return j.select(
        name.alias("file"), F.least(side, F.col("nr") - r0).cast("int").alias("n_rows"), F.least(side, F.col("nc") - c0).cast("int").alias("n_cols"), moved.alias("transform"), F.col("epsg").cast("int").alias("epsg"),
        (F.col("row") - r0).cast("int").alias("row"), F.transform("x", lambda s: s["col"].cast("int")).alias("cols"), F.transform("x", lambda s: s["v"]).alias("values"),
    )


def write(cells: DataFrame, grids: DataFrame, folder: str, product: str = "dem", value: str = "z", mode: str = "overwrite", file_side: int = FILE_SIDE, tile: int = TILE_SIDE, band: tuple[str, float, str] | None = None) -> DataFrame:
    """SNK-01: a file a grid (or part of one) with overviews, and the catalogue of what was written: file, sizes, statistics, checksum. band: (type, nodata, resampling), if not those of the product."""
    spark = cells.sparkSession
    register(spark)
    kind, nodata, resampling = band or terrain.BANDS[product]
    rows = strips(cells, grids, value, file_side).repartition("file").sortWithinPartitions("file")
    resampling = "nearest" if resampling == "nearest" else "average"
    rows.write.format(NAME).mode(mode).option("type", kind).option("nodata", nodata).option("resampling", resampling).option("product", product).option("tile", tile).save(folder)
    return catalogue(spark, folder)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    ddl = "file string, product string, type string, nodata_value double, size_bytes long, sha256 string, n_rows int, n_cols int, epsg int, west double, south double, east double, north double, min double, max double, mean double, p2 double, p98 double, valid long, nodata long, overviews int"
    return spark.read.schema(ddl).json(f"{folder}/catalogue.json")


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, cell: float | None = None, level: int = 0) -> DataFrame:
    """Cells of a file or of a folder's files; of those in a box (least x, least y, greatest x, greatest y), edges included."""
    register(spark)
    r = spark.read.format(NAME).option("level", level)
    d = (r.option("cell", cell) if cell is not None else r).load(path)
    return d if box is None else d.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def files(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("what", "files").load(path)


def _places(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points(x, y) beside each file that reaches to within a cell of them, with sr and sc, the place in rows and columns from cells' centres. Files and points meet in squares of the largest file's side; north-up files only."""
    side = tiles.agg(F.max(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))).alias("side"))
    t = tiles.crossJoin(F.broadcast(side))  # one row
    at = lambda c: F.floor(c / F.col("side")).cast("long")
    dx, dy = F.col("transform")[0], -F.col("transform")[4]
    near = t.withColumn("bx", F.explode(F.sequence(at(F.col("west") - dx), at(F.col("east") + dx)))).withColumn("by", F.explode(F.sequence(at(F.col("south") - dy), at(F.col("north") + dy)))).drop("side")
    p = points.crossJoin(F.broadcast(side)).withColumns({"bx": at(F.col("x")), "by": at(F.col("y"))}).drop("side")
    j = p.join(near.select("bx", "by", "file", "transform", "west", "south", "n_rows", "n_cols"), ["bx", "by"]).drop("bx", "by")
    tr = F.col("transform")
    j = j.withColumns({"sr": (F.col("y") - tr[5]) / tr[4] - 0.5, "sc": (F.col("x") - tr[2]) / tr[0] - 0.5})
    return j.where((F.col("sr") > -1) & (F.col("sc") > -1) & (F.col("sr") < F.col("n_rows")) & (F.col("sc") < F.col("n_cols"))).drop("transform", "n_rows", "n_cols")


def _source(cells: DataFrame) -> DataFrame:
    return cells.where("value is not null").select("file", F.col("row").alias("s_row"), F.col("col").alias("s_col"), "value")


def _tasks(points: DataFrame, tiles: DataFrame, each: int) -> int:
    """Tasks for points, each of which asks for some cells, and the files' cells; without a number Spark would put as many rows in one as its compressed bytes allow."""
    held = tiles.agg(F.sum(F.col("n_rows").cast("long") * F.col("n_cols"))).first()[0] or 0
    return 1 + (each * points.count() + held) // MOST_MET


def _first_tile(found: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Of a point's values by file the one of the file that comes first from south-west to north-east."""
    return found.where(value.isNotNull()).groupBy(*keys).agg(F.min(F.struct("south", "west", "file", value.alias("v"))).alias("m")).select(*keys, F.col("m.v").alias("value"))


def bilinear(points: DataFrame, tiles: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-07: points(keys, x, y), tiles as of `files`, cells as of `read` -> keys, value: between the four cells around in each file, by those that have a value; the first file in order wins. Null where no file has any."""
    n, place = _tasks(points, tiles, 4), ["file", "s_row", "s_col"]
    j = _places(points.select(*keys, "x", "y"), tiles)
    r0, c0 = F.floor("sr").cast("int"), F.floor("sc").cast("int")
    fr, fc = F.col("sr") - r0, F.col("sc") - c0
    four = F.array(*[F.struct((r0 + a).alias("s_row"), (c0 + b).alias("s_col"), ((fr if a else 1 - fr) * (fc if b else 1 - fc)).alias("w")) for a in (0, 1) for b in (0, 1)])
    j = j.select(*keys, "file", "south", "west", F.explode(four).alias("k")).select(*keys, "file", "south", "west", "k.s_row", "k.s_col", "k.w").where("w > 0")
    v = j.repartition(n, *place).join(_source(cells).repartition(n, *place), place)
    v = v.repartition(n, *keys).groupBy(*keys, "file", "south", "west").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("v"))
    return points.select(*keys).repartition(n, *keys).join(_first_tile(v, keys, F.col("v")), keys, "left")


def dem_window(spark: SparkSession, folder: str, box: tuple[float, float, float, float], cell_m: float = 30.0, buffer_m: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """SRC-07: (grids, cells) of a box of degrees (west, south, east, north), widened by a buffer, on a grid of metres in the UTM zone of its middle, from a folder of geographic tiles.

    grids: grid_id 0, n_rows, n_cols, transform, epsg and `terrain`: data, none (tiles hold nothing here) or no tiles. Only tiles of the box and of a few cells around it are opened. Grids of more than MOST_CELLS cells are refused.
    """
    if cell_m <= 0:
        raise ValueError("cell size must be positive")
    west, south, east, north = box
    lon, lat = (west + east) / 2, (south + north) / 2
    # Metres of a degree of latitude, and of longitude at the equator.
    up, right = 1 / 110_540.0, 1 / (111_320.0 * max(0.05, math.cos(math.radians(lat))))
    w, s, e, n = west - buffer_m * right, south - buffer_m * up, east + buffer_m * right, north + buffer_m * up
    zone, down = geo.utm_zone(F.lit(lon)), F.lit(lat < 0)
    at = [geo.to_utm(F.lit(x), F.lit(y), zone, down) for x in (w, e) for y in (s, n)]
    r = spark.range(1).select(geo.utm_epsg(F.lit(lon), F.lit(lat)).alias("epsg"), *[F.array(*[p[c] for p in at]).alias(c) for c in ("x", "y")]).first()
    x0, x1, y0, y1 = min(r.x), max(r.x), min(r.y), max(r.y)
    n_cols, n_rows = math.ceil((x1 - x0) / cell_m) + 1, math.ceil((y1 - y0) / cell_m) + 1
    if n_rows * n_cols > MOST_CELLS:
        raise ValueError(f"a grid of {n_rows * n_cols} cells, more than {MOST_CELLS}")
    t = [cell_m, 0.0, x0 - cell_m / 2, 0.0, -cell_m, y1 + cell_m / 2]
    # the grid overhangs the box by up to a cell and a half, and a point needs the tiles' cells around it
    found = files(spark, folder)
    own = found.agg(F.max(F.abs(F.col("transform")[0])).alias("x"), F.max(F.abs(F.col("transform")[4])).alias("y")).first()
    more_x, more_y = 2 * cell_m * right + (own.x or 0), 2 * cell_m * up + (own.y or 0)
    wide = (w - more_x, s - more_y, e + more_x, n + more_y)
    tiles = found.where((F.col("west") <= wide[2]) & (F.col("east") >= wide[0]) & (F.col("south") <= wide[3]) & (F.col("north") >= wide[1]))
    k = F.col("id")
    cells = spark.range(n_rows * n_cols).select(F.lit(0).cast("long").alias("grid_id"), F.floor(k / n_cols).cast("int").alias("row"), (k % n_cols).cast("int").alias("col"))
    xy = geo.cell_centre(F.array(*map(F.lit, t)), F.col("row"), F.col("col"))
    points = cells.withColumn("p", geo.from_utm(xy["x"], xy["y"], F.lit(r.epsg))).select("grid_id", "row", "col", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
    z = bilinear(points, tiles, read(spark, folder, wide), ["grid_id", "row", "col"]).withColumnRenamed("value", "z")
    about = z.agg(F.count("z").alias("valid")).crossJoin(tiles.agg(F.count("file").alias("tiles")))  # one row each
    state = F.when(F.col("tiles") == 0, "no tiles").when(F.col("valid") == 0, "none").otherwise("data")
    grid = [F.lit(0).cast("long").alias("grid_id"), F.lit(n_rows).alias("n_rows"), F.lit(n_cols).alias("n_cols"), F.array(*map(F.lit, t)).alias("transform"), F.lit(r.epsg).alias("epsg")]
    return about.select(*grid, "valid", "tiles", state.alias("terrain")), z


def nearest(points: DataFrame, tiles: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-11: the value of the cell that a point lies in; nodata of one file leaves the point to the next."""
    n, place = _tasks(points, tiles, 1), ["file", "s_row", "s_col"]
    j = _places(points.select(*keys, "x", "y"), tiles).withColumns({"s_row": F.floor(F.col("sr") + 0.5).cast("int"), "s_col": F.floor(F.col("sc") + 0.5).cast("int")})
    v = j.repartition(n, *place).join(_source(cells).repartition(n, *place), place).repartition(n, *keys)
    return points.select(*keys).repartition(n, *keys).join(_first_tile(v, keys, F.col("value")), keys, "left")
