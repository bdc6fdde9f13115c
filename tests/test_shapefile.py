import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators.registers import inside
from rillwork.sources import services, shapefile

PRJ = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]]]'


def square(x, y, w, hole=False):
    r = [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]  # clockwise
    return r[::-1] if hole else r


SHAPES = [
    [square(0, 0, 4)],
    [square(0, 0, 4), square(1, 1, 2, hole=True)],
    [square(0, 0, 4), square(10, 0, 4), square(11, 1, 1, hole=True), square(1, 1, 1, hole=True)],
    [],
    [square(0, 0, 9), square(1, 1, 6, hole=True), square(2, 2, 3), square(3, 3, 1, hole=True)],
    [square(5, 5, 1, hole=True)],
]
ATTRIBUTES = [{"ID": f"P{k}", "Owner": "Govt waste" if k % 2 else "A. Shinde", "ग्राम": "दुर्ग"} for k in range(len(SHAPES))]
ATTRIBUTES = [{k if k.isascii() else "village": v for k, v in a.items()} for a in ATTRIBUTES]


def unzipped(tmp_path, data, name="layer"):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.namelist():
            (tmp_path / m.replace("layer", name)).write_bytes(z.read(m))
    return str(tmp_path / f"{name}.shp")


def test_zip_and_loose_files_give_the_same_rows(spark, tmp_path):
    data = shapefile.archive_of(SHAPES, ATTRIBUTES, PRJ)
    (tmp_path / "layer.zip").write_bytes(data)
    loose = tmp_path / "loose"
    loose.mkdir()
    path = unzipped(loose, data)
    rows = lambda d: sorted(map(str, d.collect()))
    a = shapefile.read(spark, str(tmp_path / "layer.zip"))
    b = shapefile.read(spark, f"file:{path}", records=2)
    assert b.rdd.getNumPartitions() == 3 and rows(a) == rows(b) == rows(shapefile.read(spark, str(loose)))
    got = {r.record: r for r in a.collect()}
    assert [len(p) for p in got[2].polygons] == [2, 2] and [len(p) for p in got[4].polygons] == [2, 2] and got[3].kind is None
    assert got[5].polygons == [[[list(map(float, p)) for p in square(5, 5, 1, hole=True)]]]
    assert got[1].attributes == {"ID": "P1", "Owner": "Govt waste", "village": "दुर्ग"} and got[1].crs == PRJ


def test_parcels_equal_the_same_geojson(spark, tmp_path):
    (tmp_path / "layer.zip").write_bytes(shapefile.archive_of(SHAPES, ATTRIBUTES, PRJ))
    features = []
    for rings, a in zip(SHAPES, ATTRIBUTES, strict=True):
        polys = shapefile.polygons([np.array(r, float) for r in rings]) if rings else []
        geometry = {"type": "MultiPolygon", "coordinates": [[r.tolist() for r in p] for p in polys]} if polys else None
        features.append({"type": "Feature", "properties": a, "geometry": geometry})
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    a = shapefile.parcel_features(shapefile.read(spark, str(tmp_path / "layer.zip")))
    b = services.parcels(spark, str(tmp_path / "g.geojson"))
    points = spark.createDataFrame([(x + 0.35, y + 0.21) for x in range(0, 16) for y in range(0, 10)], "x double, y double")
    covered = lambda d: sorted(map(tuple, d.where("not skipped").crossJoin(points).select("parcel_id", "own_id", "owner", "public", "x", "y", inside(F.col("x"), F.col("y"), F.col("ring")).alias("in")).collect()))
    assert covered(a) == covered(b)
    assert sorted(map(tuple, a.select("parcel_id", "skipped").collect())) == sorted(map(tuple, b.select("parcel_id", "skipped").collect()))


def zipped(files, link=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            info = zipfile.ZipInfo(name)
            if name == link:
                info.external_attr = 0o120777 << 16
            z.writestr(info, data)
    return out.getvalue()


FOUR = {f"a{s}": b"x" * 200 for s in (".shp", ".shx", ".dbf", ".prj")}
HOSTILE = {
    "no zip": (b"PK\3\4 broken", "not a readable zip"),
    "empty": (b"", "not a readable zip"),
    "many": (zipped(FOUR | {f"{k}.txt": b"" for k in range(300)}), "members"),
    "up": (zipped(FOUR | {"../x.shp": b""}), "unsafe path"),
    "root": (zipped(FOUR | {"/etc/x.shp": b""}), "unsafe path"),
    "back": (zipped(FOUR | {"..\\x.shp": b""}), "unsafe path"),
    "link": (zipped(FOUR, link="a.prj"), "link"),
    "no shp": (zipped({k: v for k, v in FOUR.items() if k != "a.shp"}), "no .shp"),
    "no index": (zipped({k: v for k, v in FOUR.items() if k not in ("a.shx", "a.dbf")}), "no .shx, .dbf"),
    "no prj": (zipped({k: v for k, v in FOUR.items() if k != "a.prj"}), "any datum"),
    "large": (zipped(FOUR | {"a.sbn": b"\0" * 3_000_000}), "more than"),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_archives_are_refused(name):
    data, why = HOSTILE[name]
    with pytest.raises(shapefile.LayerError, match=why):
        shapefile.inflated(data, most=2_000_000)


def test_an_archive_that_lies_about_its_size_is_refused():
    data = bytearray(zipped(FOUR | {"a.sbn": b"\0" * 3_000_000}))
    # the directory claims 10 bytes for the large member
    at = data.rfind(b"PK\1\2", 0, data.rfind(b"a.sbn"))
    struct.pack_into("<I", data, at + 24, 10)
    with pytest.raises(shapefile.LayerError):
        shapefile.inflated(bytes(data), most=2_000_000)


def test_refusals_come_as_rows(spark):
    good = shapefile.archive_of(SHAPES, ATTRIBUTES, PRJ)
    rows = [("good", bytearray(good)), ("null", None)] + [(k, bytearray(v)) for k, (v, _) in HOSTILE.items() if k != "large"]
    got = shapefile.from_archives(spark.createDataFrame(rows, "source string, content binary")).collect()
    problems = {r.source: r.problem for r in got if r.problem}
    assert set(problems) == {"null", *HOSTILE} - {"large"} and sum(r.source == "good" for r in got) == len(SHAPES)


def test_broken_records_and_other_kinds():
    assert shapefile.shape(b"") == shapefile.shape(b"\5\0\0\0") == shapefile.shape(struct.pack("<i", 0)) == shapefile.shape(struct.pack("<i", 99)) == (None, None, None)
    assert shapefile.shape(struct.pack("<i2d", 1, 3.0, 4.0)) == ("Point", None, [[[3.0, 4.0]]])
    line = struct.pack("<i4d2i2i", 13, 0, 0, 1, 1, 2, 4, 0, 2) + struct.pack("<8d", *range(8)) + b"z" * 40
    assert shapefile.shape(line) == ("LineString", None, [[[0.0, 1.0], [2.0, 3.0]], [[4.0, 5.0], [6.0, 7.0]]])
    bad = struct.pack("<i4d2i2i", 5, 0, 0, 1, 1, 2, 4, 0, 9) + struct.pack("<8d", *range(8))
    assert shapefile.shape(bad) == (None, None, None)
    assert shapefile.shape(struct.pack("<i4di", 8, 0, 0, 1, 1, 2) + struct.pack("<4d", 1, 2, 3, 4)) == ("MultiPoint", None, [[[1.0, 2.0], [3.0, 4.0]]])


def test_table_values():
    head = struct.pack("<4BIHH20x", 3, 126, 1, 1, 1, 32 + 32 * 3 + 1, 1 + 5 + 4 + 1)[:29] + b"\x57\0\0"
    head += b"".join(struct.pack("<11sc4xBB14x", n, k, s, 0) for n, k, s in ((b"name", b"C", 5), (b"n", b"N", 4), (b"ok", b"L", 1))) + b"\r"
    t = shapefile.Table.of(head, None)
    assert t.attributes(" caf\xe9   42T".encode("latin-1")) == {"name": "café", "n": "42", "ok": "T"}
    assert t.attributes(b"      ****?") == {"name": None, "n": None, "ok": None} and t.attributes(b"*deleted   ") == {} and t.attributes(b"") == {}
