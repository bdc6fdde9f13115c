"""Points of the published examples of coordinate operations, within their accuracy."""

import pytest
from pyspark.sql import functions as F

from rillwork.functions import datum
from rillwork.sources import shapefile

from .test_shapefile import ATTRIBUTES, square

AIRY, CLARKE66, INTL, BESSEL = (6377563.396, 299.32496), (6378206.4, 294.978698214), (6378388.0, 297.0), (6377397.155, 299.1528128)
FOOT = 0.30480060960121924


def system(ball, name="d", projection=None, unit=1.0, **p):
    params = "".join(f',PARAMETER["{k}",{v!r}]' for k, v in p.items())
    geog = f'GEOGCS["g",DATUM["{name}",SPHEROID["s",{ball[0]},{ball[1]}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    return f'PROJCS["p",{geog},PROJECTION["{projection}"]{params},UNIT["u",{unit}]]' if projection else geog


PUBLISHED = [
    # transverse Mercator of Great Britain
    (system(AIRY, projection="Transverse_Mercator", latitude_of_origin=49.0, central_meridian=-2.0, scale_factor=0.9996012717, false_easting=400000.0, false_northing=-100000.0), 577274.99, 69740.50, 0.5, 50.5, 2e-7),
    # Lambert's conic with two parallels, Texas in feet
    (system(CLARKE66, projection="Lambert_Conformal_Conic_2SP", unit=FOOT, standard_parallel_1=28.0 + 23 / 60, standard_parallel_2=30.0 + 17 / 60, latitude_of_origin=27.0 + 50 / 60, central_meridian=-99.0, false_easting=2000000.0, false_northing=0.0), 2963503.91, 254759.80, -96.0, 28.5, 1e-7),
    # and with one, Jamaica
    (system(CLARKE66, projection="Lambert_Conformal_Conic_1SP", latitude_of_origin=18.0, central_meridian=-77.0, scale_factor=1.0, false_easting=250000.0, false_northing=150000.0), 255966.58, 142493.51, -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600, 1e-7),
    # Mercator, Makassar
    (system(BESSEL, projection="Mercator_1SP", latitude_of_origin=0.0, central_meridian=110.0, scale_factor=0.997, false_easting=3900000.0, false_northing=900000.0), 5009726.58, 569150.82, 120.0, -3.0, 1e-7),
]


@pytest.mark.parametrize("case", range(len(PUBLISHED)))
def test_published_projections(spark, case):
    text, x, y, lon, lat, within = PUBLISHED[case]
    d = spark.createDataFrame([(text, x, y)], "t string, x double, y double").withColumn("c", datum.parsed(F.col("t")))
    r = d.select(datum.unprojected(F.col("c"), F.col("x"), F.col("y")).alias("p")).first().p
    assert r.lon == pytest.approx(lon, abs=within) and r.lat == pytest.approx(lat, abs=within)


SHIFT = "dx double, dy double, dz double, rx double, ry double, rz double, ppm double"


def test_published_shifts(spark):
    # WGS 72 to WGS 84 by seven parameters, between geocentric points
    d = spark.createDataFrame([((0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219),)], f"s struct<{SHIFT.replace(' double', ':double')}>")
    p = F.struct(F.lit(3657660.66).alias("x"), F.lit(255768.55).alias("y"), F.lit(5201382.11).alias("z"))
    q = d.select(datum.helmert(p, F.col("s")).alias("q")).first().q
    assert (q.x, q.y, q.z) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)
    # WGS 84 to ED50 by three: degrees and height, through geocentric points
    s = F.struct(*[F.lit(v).alias(c) for c, v in zip(("dx", "dy", "dz", "rx", "ry", "rz", "ppm"), (84.87, 96.49, 116.95, 0.0, 0.0, 0.0, 0.0), strict=True)])
    g = datum.geocentric(F.lit(2 + 7 / 60 + 46.38 / 3600), F.lit(53 + 48 / 60 + 33.82 / 3600), F.lit(73.0), F.lit(6378137.0), F.lit(1 / 298.257223563))
    h = datum.helmert(g, s)
    back = datum.geodetic(h["x"], h["y"], h["z"], F.lit(INTL[0]), F.lit(1 / INTL[1]))
    r = spark.range(1).select(back.alias("p")).first().p
    assert r.lat == pytest.approx(53 + 48 / 60 + 36.565 / 3600, abs=3e-7) and r.lon == pytest.approx(2 + 7 / 60 + 51.477 / 3600, abs=3e-7) and r.height == pytest.approx(28.02, abs=0.02)


def test_geodetic_undoes_geocentric(spark):
    rows = [(float(lon), float(lat), float(h)) for lon in (-180, -75, 0, 81) for lat in (-89.9, -45, 0, 21.25, 60, 90) for h in (-100, 0, 8000)]
    d = spark.createDataFrame(rows, "lon double, lat double, h double")
    a, f = F.lit(6377301.243), F.lit(1 / 300.8017)
    g = datum.geocentric(F.col("lon"), F.col("lat"), F.col("h"), a, f)
    b = datum.geodetic(g["x"], g["y"], g["z"], a, f)
    for r in d.select("lon", "lat", "h", b.alias("b")).collect():
        assert r.b.lat == pytest.approx(r.lat, abs=1e-10) and r.b.height == pytest.approx(r.h, abs=1e-5)
        assert abs(r.lat) == 90 or abs((r.b.lon - r.lon + 180) % 360 - 180) < 1e-10


def test_grid_shift(spark):
    east = [[0.0, 1.0, 2.0], [10.0, 11.0, 12.0]]
    north = [[1.0, 1.0, 1.0], [3.0, 3.0, None]]
    d = spark.createDataFrame([(77.0, 20.0), (77.25, 20.25), (77.5, 20.5), (78.0, 20.0), (77.75, 20.4), (76.9, 20.0), (78.1, 20.0), (77.0, 20.6)], "lon double, lat double")
    g = lambda a: F.array(*[F.array(*[F.lit(v).cast("double") for v in r]) for r in a])
    got = d.select("lon", "lat", datum.grid_shift(F.col("lon"), F.col("lat"), F.lit(77.0), F.lit(20.0), F.lit(0.5), g(east), g(north)).alias("p")).collect()
    want = {(77.0, 20.0): (77.0, 21.0), (77.25, 20.25): (77.25 + 5.5, 22.25), (77.5, 20.5): (88.5, 23.5), (78.0, 20.0): (80.0, 21.0)}
    assert {(r.lon, r.lat): r.p and (r.p.lon, r.p.lat) for r in got} == {(r.lon, r.lat): want.get((r.lon, r.lat)) for r in got}


@pytest.mark.parametrize("text", ["", None, "nonsense", 'GEOGCS["x"]', 'PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["s",1,2]]],PROJECTION["Krovak"],UNIT["m",1]]', 'GEOGCS["g",DATUM["d",SPHEROID["s",', '[]'])
def test_texts_that_are_not_understood(text):
    assert datum.crs_of(text) is None


def test_layers_are_moved_or_refused(spark):
    """A layer on another datum lands where its shift says, one of WGS 84 stays, one without a known shift is refused."""
    wgs = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    everest = system((6377299.151, 300.8017255), "Kalianpur_1975")
    shapes, one = [[square(81.29, 21.25, 0.01)], []], ATTRIBUTES[:2]
    layers = [("w", bytearray(shapefile.archive_of(shapes, one, wgs))), ("k", bytearray(shapefile.archive_of(shapes, one, everest))), ("u", bytearray(shapefile.archive_of(shapes, one, everest.replace("1975", "unknown")))), ("x", bytearray(shapefile.archive_of(shapes, one, "?")))]
    ops = spark.createDataFrame(
        [("Kalianpur_1975", "far", 2, False, 3.0, (0.0,) * 7), ("Kalianpur_1975", "local", 1, False, 22.0, (295.0, 736.0, 257.0, 0.0, 0.0, 0.0, 0.0)), ("Kalianpur_unknown", "ballpark", 1, True, 0.1, (0.0,) * 7)],
        f"source string, operation string, tier int, ballpark boolean, accuracy_m double, shift struct<{SHIFT.replace(' double', ':double')}>",
    )
    got = {(r.source, r.record): r for r in shapefile.to_wgs84(shapefile.from_archives(spark.createDataFrame(layers, "source string, content binary")), ops).collect()}
    assert len(got) == 8 and got["w", 0].polygons[0][0][0] == [81.29, 21.25] and got["w", 0].operation == "none"
    k = got["k", 0]
    (lon, lat), metres = k.polygons[0][0][0], 111_320
    assert k.operation == "local" and k.accuracy_m == 22.0 and 100 < (((lon - 81.29) * metres * 0.932) ** 2 + ((lat - 21.25) * metres) ** 2) ** 0.5 < 400
    assert got["u", 0].polygons is None and "no shift is known" in got["u", 0].refused and "not understood" in got["x", 0].refused
    assert got["k", 1].polygons is None and got["k", 1].refused is None
