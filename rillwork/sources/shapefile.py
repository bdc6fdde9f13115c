"""Shapefiles as a Spark data source: polygons, lines and points of .shp with attributes of .dbf, loose or in a zip archive.

    shapefile.register(spark)
    spark.read.format("shapefile").load("parcels.shp")   # or a folder of them, or a .zip that holds one
    -> source, record, kind, polygons (array of polygons, each an outer ring and its holes, of [x, y]), parts (of lines and points), attributes (map), crs (the .prj's text)

A loose file is split by its index: a task reads its records' bytes of .shp and .dbf only. An archive is one task: it is inflated in memory under a budget that counts what comes out, not what the archive claims.
Refused with a reason: an archive with too many members, unsafe paths, links or more bytes than MOST_BYTES, without .shp, .shx, .dbf, or without .prj (its coordinates could be anything).
A record whose bytes are no shape has kind null and counts as skipped, as a null shape does. Deleted attribute rows keep their shape and have no attributes.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from rillwork.functions import classify, datum, geo
from rillwork.operators import registers
from rillwork.sources.raster import _opened

# What an archive may hold.
MOST_BYTES, MOST_MEMBERS = 200 * 1024 * 1024, 200
SUFFIXES = (".shp", ".shx", ".dbf", ".prj", ".cpg", ".sbn", ".sbx")
NAME, RECORDS = "shapefile", 20_000
KINDS = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint", 11: "Point", 13: "LineString", 15: "Polygon", 18: "MultiPoint", 21: "Point", 23: "LineString", 25: "Polygon", 28: "MultiPoint"}
#: Code pages of a table's language byte.
PAGES = {0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x57: "cp1252", 0x58: "cp1252", 0x59: "cp1252"}
#: What well-known text calls the datum of WGS 84.
WGS84 = ("WGS_1984", "D_WGS_1984", "World Geodetic System 1984")
_DDL = "source string, record long, kind string, polygons array<array<array<array<double>>>>, parts array<array<array<double>>>, attributes map<string,string>, crs string"


class LayerError(ValueError):
    """Why a layer can't be read."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapefileSource)


def inflated(data: bytes, most: int = MOST_BYTES) -> dict[str, bytes]:
    """X-12: the shapefile's members of a zip archive by suffix, or LayerError. Bytes are counted as they come out."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise LayerError(f"not a readable zip archive: {e}") from e
    members = archive.infolist()
    if len(members) > MOST_MEMBERS:
        raise LayerError(f"the archive has {len(members)} members, more than {MOST_MEMBERS}")
    if sum(m.file_size for m in members) > most:
        raise LayerError(f"the archive holds more than {most} bytes")
    keep: dict[str, zipfile.ZipInfo] = {}
    for m in members:
        path = PurePosixPath(m.filename.replace("\\", "/"))
        if path.is_absolute() or ".." in path.parts or ":" in path.parts[0:1]:
            raise LayerError(f"an unsafe path in the archive: {m.filename!r}")
        if (m.external_attr >> 16) & 0o170000 == 0o120000:
            raise LayerError(f"a link in the archive: {m.filename!r}")
        if not m.is_dir() and path.suffix.lower() in SUFFIXES:
            keep.setdefault(path.suffix.lower(), m)
    lacking = [s for s in (".shp", ".shx", ".dbf", ".prj") if s not in keep]
    if lacking:
        raise LayerError(f"the archive has no {', '.join(lacking)}" + ("; without .prj its coordinates could be of any datum" if lacking == [".prj"] else ""))
    out, total = {}, 0
    for suffix, m in keep.items():
        piece = bytearray()
        try:
            with archive.open(m) as f:
                while chunk := f.read(1 << 16):
                    total += len(chunk)
                    if total > most:
                        raise LayerError(f"the archive holds more than {most} bytes")
                    piece += chunk
        except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError) as e:
            raise LayerError(f"a broken member: {m.filename!r}") from e
        out[suffix] = bytes(piece)
    return out


def _signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _within(ring: np.ndarray, outer: np.ndarray) -> bool:
    """Whether most of a ring's corners lie in another, by crossings to the right."""
    x0, y0, x1, y1 = outer[:, 0], outer[:, 1], np.roll(outer[:, 0], -1), np.roll(outer[:, 1], -1)
    n = 0
    for x, y in ring:
        cross = (y0 > y) != (y1 > y)
        n += int((x < x0[cross] + (y - y0[cross]) * (x1[cross] - x0[cross]) / (y1[cross] - y0[cross])).sum()) % 2
    return 2 * n > len(ring)


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings go clockwise, and each hole belongs to the smallest outer ring around it; a hole without one is an outer ring that was drawn the wrong way. Rings of no area are left out."""
    sized = [(r, _signed_area(r)) for r in rings if len(r) >= 4]
    outer = [(r, a) for r, a in sized if a < 0]
    out = [[r] for r, _ in outer]
    for hole, _ in [(r, a) for r, a in sized if a > 0]:
        around = [k for k, (r, a) in enumerate(outer) if _within(hole, r)]
        if around:
            out[min(around, key=lambda k: -outer[k][1])].append(hole)
        else:
            out.append([hole])
    return out


def shape(content: bytes) -> tuple[str | None, list | None, list | None]:
    """(kind, polygons, parts) of a record; all null for a null shape or for bytes that are none."""
    try:
        code = struct.unpack_from("<i", content)[0]
        kind = KINDS.get(code)
        if kind is None:
            return None, None, None
        if kind == "Point":
            return kind, None, [[list(struct.unpack_from("<2d", content, 4))]]
        if kind == "MultiPoint":
            n = struct.unpack_from("<i", content, 36)[0]
            return kind, None, [np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2).tolist()]
        n_parts, n = struct.unpack_from("<2i", content, 36)
        starts = [*np.frombuffer(content, "<i4", n_parts, 44).tolist(), n]
        xy = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * n_parts).reshape(-1, 2)
        if any(not 0 <= a <= b <= n for a, b in zip(starts[:-1], starts[1:], strict=True)):
            return None, None, None
        parts = [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        if kind == "Polygon":
            made = [[r.tolist() for r in p] for p in polygons(parts)]
            return (kind, made, None) if made else (None, None, None)
        return kind, None, [p.tolist() for p in parts]
    except (struct.error, ValueError):
        return None, None, None


@dataclass(frozen=True)
class Table:
    """A .dbf's columns: (name, kind, size) after the flag byte of each row."""

    header: int
    width: int
    rows: int
    columns: tuple[tuple[str, str, int], ...]
    page: str

    @staticmethod
    def of(head: bytes, page: str | None) -> Table:
        rows, header, width = struct.unpack_from("<IHH", head, 4)
        columns, at = [], 32
        page = page or PAGES.get(head[29], "utf-8")
        while at + 32 <= min(header, len(head)) and head[at] != 0x0D:
            columns.append((head[at : at + 11].split(b"\0")[0].decode(page, "replace").strip(), chr(head[at + 11]), head[at + 16]))
            at += 32
        return Table(header, width, rows, tuple(columns), page)

    def attributes(self, row: bytes) -> dict[str, str | None]:
        """Text of each column; blanks and undefined values are null."""
        if not row or row[:1] == b"*":
            return {}
        out, at = {}, 1
        for name, kind, size in self.columns:
            raw = row[at : at + size]
            at += size
            try:
                text = raw.decode(self.page).strip("\0 ")
            except UnicodeDecodeError:
                text = raw.decode("cp1252", "replace").strip("\0 ")
            undefined = not text or (kind in "NF" and set(text) == {"*"}) or (kind == "L" and text == "?") or (kind == "D" and text == "00000000")
            out[name] = None if undefined else text
        return out


@dataclass
class Records(ds.InputPartition):
    path: str
    first: int = 0
    last: int = 0
    table: Table | None = None
    crs: str | None = None
    zipped: bool = False
    paths: dict = field(default_factory=dict)

    def __init__(self, path: str, first: int = 0, last: int = 0, table: Table | None = None, crs: str | None = None, zipped: bool = False, paths: dict | None = None):
        super().__init__(None)
        self.path, self.first, self.last, self.table, self.crs, self.zipped, self.paths = path, first, last, table, crs, zipped, paths or {}


class ShapefileSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> ds.DataSourceReader:  # noqa: ANN001
        return ShapefileReader(self.options)


class ShapefileReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each, self.most = options["path"], int(options.get("records", RECORDS)), int(options.get("bytes", MOST_BYTES))

    def partitions(self) -> list[Records]:
        system, at = _opened(self.path)
        info = system.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [at] if info.type == pafs.FileType.File else sorted(i.path for i in system.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        out = []
        for n in names:
            if n.lower().endswith(".zip"):
                out.append(Records(scheme + n, zipped=True))
            elif n.lower().endswith(".shp"):
                out += self._split(system, scheme, n)
        return out or [Records("")]

    def _split(self, system: pafs.FileSystem, scheme: str, shp: str) -> list[Records]:
        stem = shp[:-4]
        found = {}
        for s in SUFFIXES:
            for name in (stem + s, stem + s.upper()):
                if system.get_file_info(name).type == pafs.FileType.File:
                    found[s] = name
                    break
        lacking = [s for s in (".shx", ".dbf", ".prj") if s not in found]
        if lacking:
            raise LayerError(f"{shp} has no {', '.join(lacking)} beside it")
        read = lambda s, n=None: system.open_input_stream(found[s]).read(n) if n else system.open_input_stream(found[s]).read()
        head = read(".dbf", 1 << 16)
        table = Table.of(head, read(".cpg").decode("ascii", "ignore").strip() or None if ".cpg" in found else None)
        count = max(0, (system.get_file_info(found[".shx"]).size - 100) // 8)
        crs = read(".prj").decode("utf-8", "replace").strip()
        paths = {s: scheme + n for s, n in found.items()}
        return [Records(scheme + shp, a, min(a + self.each, count), table, crs, paths=paths) for a in range(0, count, self.each)]

    def read(self, partition: Records) -> Iterator[tuple]:
        p = partition
        if not p.path:
            return
        system, at = _opened(p.path)
        name = p.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if p.zipped:
            with system.open_input_stream(at) as f:
                files = inflated(f.read(), self.most)
            table = Table.of(files[".dbf"][: 1 << 16], files[".cpg"].decode("ascii", "ignore").strip() or None if ".cpg" in files else None)
            n, crs = max(0, (len(files[".shx"]) - 100) // 8), files[".prj"].decode("utf-8", "replace").strip()
            index = files[".shx"][100 : 100 + 8 * n]
            yield from self._rows(name, 0, index, lambda a, z: files[".shp"][a:z], files[".dbf"][table.header : table.header + n * table.width], table, crs)
            return
        inner = {s: _opened(x)[1] for s, x in p.paths.items()}
        with system.open_input_file(inner[".shx"]) as x, system.open_input_file(inner[".dbf"]) as d, system.open_input_file(inner[".shp"]) as s:
            index = x.read_at(8 * (p.last - p.first), 100 + 8 * p.first)
            rows = d.read_at(p.table.width * (p.last - p.first), p.table.header + p.table.width * p.first)
            yield from self._rows(name, p.first, index, lambda a, z: s.read_at(z - a, a), rows, p.table, p.crs)

    def _rows(self, name: str, first: int, index: bytes, content, rows: bytes, table: Table, crs: str) -> Iterator[tuple]:  # noqa: ANN001
        for k, (offset, length) in enumerate(np.frombuffer(index, ">i4").reshape(-1, 2).tolist()):
            kind, polys, parts = shape(content(2 * offset + 8, 2 * offset + 8 + 2 * length)) if offset > 0 and length > 0 else (None, None, None)
            yield name, first + k, kind, polys, parts, table.attributes(rows[k * table.width : (k + 1) * table.width]), crs


def read(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("records", records).load(path)


def parcel_features(layer: DataFrame, point: Column | None = None) -> DataFrame:
    """SRC-21: rows of `read` as services.parcel_features gives them: parcel_id (the record), own_id, ring (all boundaries joined), attributes, owner, public, skipped. point maps a corner's struct(x, y), as for a datum's shift."""
    from rillwork.sources.services import joined_rings

    parts = F.transform(F.flatten(F.coalesce("polygons", F.array().cast("array<array<array<array<double>>>>"))), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    p = F.col("attributes")
    owner = F.try_element_at(p, classify.owner_field(p))
    own = F.coalesce(*[F.try_element_at(p, F.lit(k)) for k in ("id", "ID", "parcel_id")])
    # the shapefile closes its rings; one that goes along several closes them itself
    open_ = F.transform(parts, lambda r: F.slice(r, 1, F.size(r) - 1))
    return layer.select(F.col("record").alias("parcel_id"), own.alias("own_id"), joined_rings(open_).alias("ring"), p.alias("attributes"), F.trim(owner).alias("owner"), classify.is_public(owner).alias("public"), (F.size(parts) == 0).alias("skipped"))


def from_archives(archives: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The rows of `read` from archives(source, content) that are already rows, as of spark.read.format("binaryFile"), with `problem`: why an archive is refused, in one row of its own."""

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = ShapefileReader({"path": ""})
        point = pa.list_(pa.float64())
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(point))), pa.list_(pa.list_(point)), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
        names = ["source", "record", "kind", "polygons", "parts", "attributes", "crs", "problem"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [[None if v is None else list(v.items()) for v in c] if k == 5 else list(c) for k, c in enumerate(zip(*rows, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for k in range(b.num_rows):
                source, content = (b.column(c)[k].as_py() for c in (0, 1))
                rows = []
                try:
                    files = inflated(content or b"", most)
                    table = Table.of(files[".dbf"][: 1 << 16], files[".cpg"].decode("ascii", "ignore").strip() or None if ".cpg" in files else None)
                    n = max(0, (len(files[".shx"]) - 100) // 8)
                    for row in reader._rows(source, 0, files[".shx"][100 : 100 + 8 * n], lambda a, z, s=files[".shp"]: s[a:z], files[".dbf"][table.header : table.header + n * table.width], table, files[".prj"].decode("utf-8", "replace").strip()):
                        rows.append((*row, None))
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
                except (LayerError, struct.error, IndexError) as e:
                    rows.append((source, None, None, None, None, None, None, str(e) or "a broken layer"))
                if rows:
                    yield batch(rows)

    return archives.select("source", "content").mapInArrow(apply, f"{_DDL}, problem string")


def archive_of(shapes: list[list[list[tuple[float, float]]]], attributes: list[dict[str, str]], prj: str, lacking: tuple[str, ...] = ()) -> bytes:
    """A zipped polygon shapefile: the rings of each shape as they are (none: a null shape), and text attributes."""
    records, index, at = bytearray(), bytearray(), 50
    for k, rings in enumerate(shapes):
        body = struct.pack("<i", 0)
        if rings:
            flat = [p for r in rings for p in r]
            xs, ys = zip(*flat, strict=True)
            starts = np.cumsum([0, *map(len, rings[:-1])]).tolist()
            body = struct.pack(f"<i4d2i{len(rings)}i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat), *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        records += struct.pack(">2i", k + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    columns = sorted({c for a in attributes for c in a})
    sizes = [max([1, *(len(a.get(c, "").encode()) for a in attributes)]) for c in columns]
    dbf = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(shapes), 33 + 32 * len(columns), 1 + sum(sizes))
    dbf += b"".join(struct.pack("<11sc4xBB14x", c.encode()[:10], b"C", n, 0) for c, n in zip(columns, sizes, strict=True)) + b"\r"
    dbf += b"".join(b" " + b"".join(a.get(c, "").encode().ljust(n) for c, n in zip(columns, sizes, strict=True)) for a in attributes)
    files = {".shp": head(len(records)) + bytes(records), ".shx": head(len(index)) + bytes(index), ".dbf": dbf, ".prj": prj.encode(), ".cpg": b"UTF-8"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for suffix, data in files.items():
            if suffix not in lacking:
                z.writestr(zipfile.ZipInfo(f"layer{suffix}", (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def to_wgs84(layer: DataFrame, operations: DataFrame) -> DataFrame:
    """X-10: rows of `read` with polygons in degrees of WGS 84, and operation, accuracy_m and refused: why a layer's coordinates can't be used (its polygons are then null, never taken as they are).

    operations(source: a datum's name, operation, tier, ballpark, accuracy_m, shift: struct(dx, dy, dz, rx, ry, rz, ppm)): what is known; of each datum's the best is used (see registers.datum_operations).
    A layer has one text of its system, so there are few.
    """
    systems = layer.select("crs").distinct().withColumn("system", datum.parsed(F.col("crs")))
    best = registers.datum_operations(operations).where("operation is not null").join(operations.select("source", "operation", "accuracy_m", "shift"), ["source", "operation"]).dropDuplicates(["source"])
    s = systems.withColumn("source", F.col("system.datum")).join(best, "source", "left")
    same = F.col("source").isin(*WGS84)
    refused = F.when(F.col("system").isNull(), "the coordinate reference system is not understood").when(~same & F.col("shift").isNull(), F.concat(F.lit("no shift is known from "), "source", F.lit(" to WGS 84")))
    s = s.select("crs", "system", "shift", same.alias("same"), F.when(same, "none").otherwise(F.col("operation")).alias("operation"), F.when(same, 0.0).otherwise(F.col("accuracy_m")).alias("accuracy_m"), refused.alias("refused"))
    j = layer.join(s, "crs", "left")

    def moved(p: Column) -> Column:
        def shifted(q: Column) -> Column:
            r = F.when(F.col("same"), F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"), F.lit(0.0).alias("height"))).otherwise(datum.to_wgs84(q["lon"], q["lat"], F.col("system.a"), F.col("system.f"), F.col("shift")))
            return geo.let(r, lambda w: F.array(w["lon"], w["lat"]))

        return geo.let(datum.unprojected(F.col("system"), p[0], p[1]), shifted)

    made = F.transform("polygons", lambda poly: F.transform(poly, lambda ring: F.transform(ring, moved)))
    return j.withColumn("polygons", F.when(F.col("refused").isNull(), made)).drop("system", "shift", "same")
