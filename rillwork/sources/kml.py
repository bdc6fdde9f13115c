"""Contour maps in KML or KMZ: safe unpacking, placemarks as rows, and where a map keeps its heights."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import names

MAX_UPLOAD, MAX_EXPANDED, MAX_MEMBERS, MAX_UNRESOLVED = 50 << 20, 250 << 20, 100, 0.10
#: Attribute names that hold a height.
FIELDS = ("elev", "elevation", "level", "contour", "contour_value", "height", "alt", "altitude", "z", "value", "isovalue")
SCHEMA = "map_id string, pm_id long, coords array<struct<lon:double,lat:double>>, z_values array<double>, name_text string, extended map<string,string>, folder_path array<string>, boundary boolean, error string"
STRATEGIES = ("coordinate_z", "extended_data", "placemark_name", "folder_name")


def unpacked(data: bytes, name: str = "") -> bytes:
    """SRC-01: the KML of a file or of a zip (by its first bytes); doc.kml is preferred. ValueError says what is wrong."""
    if len(data) > MAX_UPLOAD:
        raise ValueError("the file is too large")
    if data[:2] != b"PK":
        if name.lower().endswith(".kmz"):
            raise ValueError("a .kmz that isn't a zip")
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        inner = z.infolist()
        if len(inner) > MAX_MEMBERS or sum(i.file_size for i in inner) > MAX_EXPANDED:
            raise ValueError("the archive is too large")
        kmls = [i for i in inner if i.filename.lower().endswith(".kml")]
        if not kmls:
            raise ValueError("no KML in the archive")
        best = min(kmls, key=lambda i: (i.filename.lower().rsplit("/", 1)[-1] != "doc.kml", i.filename))
        with z.open(best) as f:
            out = f.read(MAX_EXPANDED + 1)
        if len(out) > MAX_EXPANDED:
            raise ValueError("the archive is too large")
        return out


def coordinates(text: str | None) -> list[tuple[float, float, float | None]]:
    """SRC-03: lon,lat[,z] tokens; malformed ones are skipped."""
    out = []
    for token in (text or "").split():
        parts = token.split(",")
        try:
            lon, lat = float(parts[0]), float(parts[1])
            z = float(parts[2]) if len(parts) > 2 and parts[2] else None
        except (ValueError, IndexError):
            continue
        out.append((lon, lat, z))
    return out


def _tag(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2]


def placemarks(data: bytes, name: str = "") -> Iterator[dict]:
    """SRC-02: lines with their name, attributes and folders, and the first polygon of 4 points or more as boundary; points are ignored. Documents that declare entities are refused."""
    text = unpacked(data, name)
    if b"<!DOCTYPE" in text or b"<!ENTITY" in text:
        raise ValueError("document types and entities are refused")
    found_boundary = False
    todo: list[tuple[ET.Element, tuple[str, ...]]] = [(ET.fromstring(text), ())]
    while todo:
        el, folders = todo.pop()
        kind = _tag(el)
        if kind in ("Folder", "Document"):
            own = next((c.text or "" for c in el if _tag(c) == "name"), "")
            folders = (*folders, own) if own else folders
        if kind != "Placemark":
            todo += [(c, folders) for c in reversed(list(el))]
            continue
        title = next((c.text or "" for c in el if _tag(c) == "name"), "")
        more = {}
        for d in el.iter():
            if _tag(d) == "SimpleData":
                more[d.get("name", "")] = d.text or ""
            elif _tag(d) == "Data":
                more[d.get("name", "")] = next((v.text or "" for v in d if _tag(v) == "value"), "")
        for g in el.iter():
            if _tag(g) == "LineString":
                pts = coordinates(next((c.text for c in g if _tag(c) == "coordinates"), None))
                if len(pts) > 1:
                    yield {"coords": [{"lon": p[0], "lat": p[1]} for p in pts], "z_values": [p[2] for p in pts], "name_text": title, "extended": more, "folder_path": list(folders), "boundary": False}
            elif _tag(g) == "Polygon" and not found_boundary:
                pts = coordinates(next((c.text for c in g.iter() if _tag(c) == "coordinates"), None))
                if len(pts) >= 4:
                    found_boundary = True
                    yield {"coords": [{"lon": p[0], "lat": p[1]} for p in pts], "z_values": [p[2] for p in pts], "name_text": title, "extended": more, "folder_path": list(folders), "boundary": True}


def read(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01, SRC-02: files -> placemark rows; a file that can't be read gives one row with the error, so that one bad map doesn't stop the rest."""
    return parsed(spark.read.format("binaryFile").load(path).select(F.col("path").alias("map_id"), "content"))


def parsed(files: DataFrame) -> DataFrame:
    """files(map_id, content)"""
    kind = pa.schema(
        [
            ("map_id", pa.string()),
            ("pm_id", pa.int64()),
            ("coords", pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))),
            ("z_values", pa.list_(pa.float64())),
            ("name_text", pa.string()),
            ("extended", pa.map_(pa.string(), pa.string())),
            ("folder_path", pa.list_(pa.string())),
            ("boundary", pa.bool_()),
            ("error", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for map_id, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [r | {"map_id": map_id, "pm_id": k, "extended": list(r["extended"].items())} for k, r in enumerate(placemarks(content, map_id))]
                except (ValueError, ET.ParseError, zipfile.BadZipFile) as e:
                    rows = [{"map_id": map_id, "pm_id": -1, "boundary": False, "error": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select("map_id", "content").mapInArrow(run, SCHEMA)


def heights(pm: DataFrame) -> DataFrame:
    """SRC-04: pm with four nullable columns, one a strategy: constant z of at least half the points, a height field, the name's first number, the deepest folder's."""
    zs = F.filter("z_values", lambda z: z.isNotNull())
    by_z = F.when((F.size(zs) >= F.greatest(F.lit(1), F.floor(F.size("z_values") / 2))) & (F.array_max(zs) - F.array_min(zs) <= 1e-6), F.try_element_at(zs, F.lit(1)))
    pairs = F.filter(F.map_entries(F.coalesce("extended", F.create_map().cast("map<string,string>"))), lambda e: F.lower(F.trim(e["key"])).isin(*FIELDS))
    numbers = lambda a: F.filter(F.transform(a, lambda v: names.first_number(v)), lambda v: v.isNotNull())
    by_field = F.try_element_at(numbers(F.transform(pairs, lambda e: e["value"])), F.lit(1))
    by_folder = F.try_element_at(numbers(F.reverse("folder_path")), F.lit(1))
    return pm.withColumns(dict(zip(STRATEGIES, (by_z, by_field, names.first_number(F.col("name_text")), by_folder), strict=True)))


def contour_lines(pm: DataFrame) -> DataFrame:
    """SRC-05: lines with elevation_m by the strategy that resolves most lines of the map to two levels or more, the earlier of equals; maps without one have none (see problems)."""
    h = heights(pm.where("not boundary and error is null"))
    stacked = h.select("map_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).alias("v")) for k, s in enumerate(STRATEGIES)])).alias("x")).select("map_id", "x.k", "x.v")
    n = stacked.groupBy("map_id", "k").agg(F.count("v").alias("n"), F.count_distinct("v").alias("levels")).where("levels >= 2")
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("n"), "k"))).where("r = 1").select("map_id", "k")
    value = F.element_at(F.array(*[F.col(s) for s in STRATEGIES]), F.col("k") + 1)
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("k") + 1)
    return h.join(best, "map_id").select("map_id", F.col("pm_id").alias("line_id"), value.alias("elevation_m"), strategy.alias("strategy"), "coords")


def problems(pm: DataFrame) -> DataFrame:
    """SRC-06: map_id, problem for each map that can't be used: unreadable, no strategy, too many lines without a height, too few lines, bad coordinates, no extent."""
    lines = contour_lines(pm)
    ok = F.forall("coords", lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
    flat = lambda c: F.transform("coords", lambda p: p[c])
    g = lines.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("elevation_m").alias("known"), F.bool_and(ok).alias("ok"),
        (F.max(F.array_max(flat("lon"))) - F.min(F.array_min(flat("lon")))).alias("w"), (F.max(F.array_max(flat("lat"))) - F.min(F.array_min(flat("lat")))).alias("h"),
    )
    bad = pm.groupBy("map_id").agg(F.max("error").alias("error"))
    j = bad.join(g, "map_id", "left")
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("n").isNull(), "no heights of two levels or more").when(F.col("known") < 2, "too few lines").when(F.col("known") < (1 - MAX_UNRESOLVED) * F.col("n"), "too many lines without a height").when(~F.col("ok"), "coordinates out of range").when((F.col("w") <= 0) | (F.col("h") <= 0), "no extent")
    return j.select("map_id", why.alias("problem")).where("problem is not null")


def summary(lines: DataFrame) -> DataFrame:
    """S-03, A-20, W-05, X-36: per map its levels, their modal interval (the smaller of equals), lines and points."""
    lv = lines.where("elevation_m is not null").select("map_id", "elevation_m").distinct()
    step = lv.withColumn("d", F.round(F.col("elevation_m") - F.lag("elevation_m").over(Window.partitionBy("map_id").orderBy("elevation_m")), 6)).where("d > 0")
    modal = step.groupBy("map_id", "d").agg(F.count(F.lit(1)).alias("n")).groupBy("map_id").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("interval_m"))
    g = lines.groupBy("map_id").agg(F.sort_array(F.collect_set("elevation_m")).alias("levels"), F.count(F.lit(1)).alias("lines"), F.sum(F.size("coords")).alias("points"))
    return g.join(modal, "map_id", "left")


def parse_coordinates(text: Column) -> Column:
    """SRC-03 as a Column: array<struct<lon, lat, z>>."""
    parts = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: F.split(t, ","))
    got = F.transform(parts, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat"), F.try_element_at(p, F.lit(3)).try_cast("double").alias("z")))
    return F.filter(got, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
