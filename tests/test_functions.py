import datetime as dt
import io
import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from rillwork.functions import classify, geo, hydro, names
from rillwork.operators import decide, flow, land, pond, rainfall, registers, runoff, survey, terrain
from rillwork.sources import kml, services, sinks
from rillwork.streaming import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def test_curve_number_example(spark):
    r = one(spark, hydro.retention_mm(F.lit(78.4)), hydro.runoff_mm(F.lit(60.0), F.lit(78.4)), hydro.runoff_mm(F.lit(10.0), F.lit(78.4)), hydro.dry_cn(F.lit(None).cast("double")))
    assert r[0] == pytest.approx(69.98, abs=0.01) and r[1] == pytest.approx(13.96, abs=0.01) and r[2] == 0 and r[3] is None


def test_pond_example(spark):
    r = one(spark, hydro.prismoidal(F.lit(60.0), F.lit(45.0), F.lit(3.5), F.lit(1.5)).alias("p"), hydro.prismoidal(F.lit(9.0), F.lit(9.0), F.lit(3.5), F.lit(1.5)).alias("q"))
    assert r.p.volume == pytest.approx(7647.6, abs=0.1) and (r.p.bottom_length, r.p.bottom_width) == (49.5, 34.5) and r.q is None


def test_water_balance_against_a_loop(spark):
    runoff_mm, et0 = [0, 0, 0, 0, 2, 30, 90, 80, 40, 10, 0, 0], [110, 120, 170, 190, 210, 170, 120, 110, 115, 120, 105, 100]
    area, bl, z, h = 180_000.0, 60.0, 1.5, 4.0
    at = lambda d: (bl + 2 * z * d) ** 2
    vol = lambda d: d / 3 * (at(d) + bl * bl + (at(d) * bl * bl) ** 0.5)
    cap, s, year = vol(h), 0.0, []
    for m in range(36):
        lo, hi = 0.0, h
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if vol(mid) < s else (lo, mid)
        surface = 0.0 if s <= 0 else at(h if s >= cap else (lo + hi) / 2)
        full = s + runoff_mm[m % 12] / 1000 * area
        held = min(full, cap)
        want = (et0[m % 12] * 1.05 + 2.0 * hydro.DAYS_IN_MONTH[m % 12]) / 1000 * surface
        s = max(0.0, held - min(held, want))
        year.append(s)
    d = spark.createDataFrame([([float(x) for x in runoff_mm], [float(x) for x in et0], area, bl, bl, h, z, cap, "D")], "runoff_mm array<double>, et0_mm array<double>, catchment_m2 double, bottom_length double, bottom_width double, depth double, side_slope double, capacity_m3 double, soil string")
    b = pond.water_balance(d).collect()[0].balance
    assert [m.storage for m in b.months] == pytest.approx(year[24:], rel=1e-6)
    assert b.months_with_water == sum(x > 0.1 * cap for x in year[24:])


def test_names_fold(spark):
    for spelling in ("kutelabhatha", "kutelabhata", "Kutelabhaata", "KUTELABHATA", "कुटेलाभाटा"):
        assert names.fold(spelling) == "kutelabat", spelling
    assert names.fold("Jevra") == names.fold("Jewra") and names.fold("Rampur") == names.fold("Rampura") == names.fold("रामपुर") == names.fold("Rām-pur")
    assert names.devanagari_to_latin("कमल") == "kamal" and names.fold("  ") == "" and names.fold("a") == ""
    assert names.fold(names.fold("Chhattisgarh")) == names.fold("Chhattisgarh")
    r = one(spark, names.folded(F.lit("Shirsa")), names.folded_latin(F.lit("Sirsa")), names.rupees(F.lit(1234567)), names.rupees(F.lit(-950)), names.first_number(F.lit("Contour -12.5m")), names.census_code(F.lit("11-22-442569")), names.display_hierarchy(F.array(F.lit("kute"), F.lit("KUTE"), F.lit(None), F.lit("durg"))))
    assert list(r) == ["sirs", "sirs", "₹12,34,567", "-₹950", -12.5, "442569", "Kute, Durg"]


def test_utm_round_trip_and_known_point(spark):
    p = geo.to_utm(F.col("lon"), F.col("lat"))
    d = spark.createDataFrame([(81.297, 21.25), (-70.5, -33.4), (3.0, 0.0)], "lon double, lat double").select("lon", "lat", p.alias("p"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("e"))
    for r in d.select("*", geo.from_utm(F.col("p.x"), F.col("p.y"), F.col("e")).alias("b")).collect():
        assert r.b.lon == pytest.approx(r.lon, abs=1e-10) and r.b.lat == pytest.approx(r.lat, abs=1e-10)
    c = d.where("lon = 3.0").collect()[0]
    assert c.p.x == pytest.approx(500000.0, abs=1e-6) and c.p.y == pytest.approx(0.0, abs=1e-6) and c.e == 32631


def test_boxes(spark):
    err = lambda *b: geo.box_error(*[F.lit(x) for x in b])
    r = one(spark, err(81.28, 21.24, 81.31, 21.26), err(81.31, 21.24, 81.28, 21.26), err(0.0, 0.0, 9.0, 9.0), err(81.28, 21.24, 81.2801, 21.2401), geo.box_area_km2(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), geo.rain_cell("open_meteo", F.lit(81.297), F.lit(21.2517))["key"], geo.rain_cell("open_meteo", F.lit(81.300), F.lit(21.2530))["key"])
    assert list(r)[:4] == [None, "not ordered", "too large", "too small"]
    assert r[4] == pytest.approx(12308.8, rel=1e-3) and r[5] == r[6]


def test_rainfall_years_and_windows(spark):
    rows = [(1, dt.date(y, 1, 1) + dt.timedelta(k), 10.0 if (dt.date(y, 1, 1) + dt.timedelta(k)).month in (6, 7, 8, 9) and k % 3 == 0 else 0.0) for y in (2019, 2020, 2021) for k in range(365 if y < 2021 else 40)]
    d = spark.createDataFrame(rows, "series int, observed_on date, mm double")
    s = rainfall.rainfall_stats(d).collect()[0]
    assert s.years == 2 and s.monsoon.months == [6, 7, 8, 9] and s.monsoon.kind == "southwest" and s.dependable_75 <= s.dependable_50
    got = rainfall.antecedent(spark.createDataFrame([(1, dt.date(2020, 1, k), float(k)) for k in range(1, 9)], "series int, observed_on date, mm double")).orderBy("observed_on").collect()
    assert [r.antecedent for r in got] == [0, 1, 3, 6, 10, 15, 20, 25]
    assert rainfall.annual_totals(d.limit(0)).count() == 0


def test_cross_check_regions(spark):
    d = spark.createDataFrame([(1, "Karnataka", 200.0, 1000.0), (2, None, 10.0, 1000.0)], "site int, state string, scs_mm double, annual_mm double")
    d = d.withColumns({"monsoon_mm": F.lit(800.0), "monthly_mm": F.array(*[F.lit(float(x)) for x in (0, 0, 0, 0, 0, 200, 300, 200, 100, 0, 0, 0)]), "monthly_temp": F.array_repeat(F.lit(28.0), 12), "catchment_class": F.lit("average")})
    a, b = runoff.cross_check(d).orderBy("site").collect()
    assert a.region == "deccan" and a.lowest == pytest.approx((100 - 17.8) * 100 / 254 * 10) and not a.agrees
    assert b.region == "general" and not next(m for m in b.methods if m.method == "khosla").applicable


def test_design_binds_by_the_smallest_limit(spark):
    d = spark.createDataFrame([(10_000.0, None, None, None), (10_000.0, None, 3.0, None), (100.0, None, None, None), (10_000.0, 9000.0, None, None)], "area_m2 double, runoff_m3 double, water_table_m double, budget double")
    d = d.withColumn("curve", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(5.0).alias("x"), F.lit(500.0).alias("y"))))
    got = [r.pond for r in pond.design(d).collect()]
    assert [p.binding for p in got] == ["practical_excavation_depth", "water_table_clearance", "plan_area_geometry", "sustainable_yield_share"]
    assert got[3].gross_m3 == pytest.approx(2700.0, rel=1e-6)


def test_ahp(spark):
    m = [[1.0, 3.0, 5.0], [1 / 3, 1.0, 3.0], [1 / 5, 1 / 3, 1.0]]
    bad = [[1.0, 9.0, 1 / 9], [1 / 9, 1.0, 9.0], [9.0, 1 / 9, 1.0]]
    a, b = decide.ahp(spark.createDataFrame([(1, m), (2, bad)], "id int, m array<array<double>>")).orderBy("id").collect()
    assert a.consistent and not b.consistent and a.weights == pytest.approx([0.637, 0.258, 0.105], abs=2e-3) and sum(a.weights) == pytest.approx(1)
    assert sum(decide.weights_for(decide.TERRAIN).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        decide.weights_for(("slope",), {"slope": 0.0})


def test_linking_never_guesses(spark):
    areas = spark.createDataFrame([(1, "cg", "durg", "nawagarh"), (2, "cg", "bemetara", "nawagarh"), (3, "cg", "durg", "patan"), (4, "mp", "x", "balod"), (5, "cg", "y", "baloda")], "area_id long, state string, district string, sub string")
    places = spark.createDataFrame([(1, "CG", "Durg", "Nawagarh "), (2, "CG", "Janjgir", "Nawagarh"), (3, "CG", "Moved", "Patan"), (4, "zz", "zz", "Balod"), (5, None, None, None)], "place_id long, state string, district string, sub string")
    got = {r.place_id: (r.area_id, r.by) for r in registers.link_places(places, areas).collect()}
    assert got == {1: (1, 1), 2: (None, None), 3: (3, 3), 4: (4, 5), 5: (None, None)}


def test_point_in_area_takes_the_smallest(spark):
    sq = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    areas = spark.createDataFrame([(1, sq(0.0, 0.0, 10.0), 100.0), (2, sq(2.0, 2.0, 2.0), 4.0)], "area_id long, ring array<struct<x:double,y:double>>, size double")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 8.0, 1.0), (3, 11.0, 1.0)], "point_id long, x double, y double")
    assert {r.point_id: r.area_id for r in registers.containing(pts, areas).collect()} == {1: 2, 2: 1, 3: None}
    layer = areas.select(F.col("area_id").alias("parcel_id"), "ring", F.lit("GOVT. WASTE").alias("owner"))
    assert {r.site_id: r.tenure for r in land.tenure(pts.withColumnRenamed("point_id", "site_id"), layer, 1.0).collect()} == {1: "allottable", 2: "allottable", 3: "unknown"}


def test_a_point_meets_each_different_ring_once(spark):
    """A layer of copies is as much work as one without (j12_site_tenure)."""
    sq = lambda s: [(0.0, 0.0), (s, 0.0), (s, s), (0.0, s)]
    rows = [(k, sq(2.0), 4.0) for k in range(400, 100, -1)] + [(k, sq(4.0), 3.0 if k == 7 else 16.0) for k in range(1, 90)] + [(900, None, 1.0)]
    areas = spark.createDataFrame(rows, "area_id long, ring array<struct<x:double,y:double>>, size double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 5.0, 1.0), (4, None, 1.0)], "point_id long, x double, y double")
    got = registers.containing(pts, areas)
    assert {r.point_id: r.area_id for r in got.collect()} == {1: 7, 2: 7, 3: None, 4: None}
    assert re.search(r"Aggregate \[ring#", got._jdf.queryExecution().analyzed().toString())
    layer = areas.select(F.col("area_id").alias("parcel_id"), "ring", F.when(F.col("area_id").isin(1, 101), "GOVT").otherwise("R. Patil").alias("owner"))
    tenure = land.tenure(pts.withColumnRenamed("point_id", "site_id"), layer.where("parcel_id > 50"), 0.5)
    assert {r.site_id: (r.parcel_id, r.tenure) for r in tenure.collect()} == {1: (51, "privately held"), 2: (51, "privately held"), 3: (None, "unknown"), 4: (None, "unknown")}


def test_regional_tiles_are_those_near_the_ring(spark):
    """The ring is worked out once, and only tiles of its own box are looked at (x03_regional_tiles)."""
    tiles = survey.regional_tiles((0.0, 0.0, 9.0, 9.0), F.col("my_ring"))
    assert str(tiles).count("my_ring") == 1
    rings = [(1, [(1.0, 1.0), (1.5, 1.0), (1.5, 1.5)]), (2, [(-9.0, 4.2), (30.0, 4.2), (30.0, 4.8), (-9.0, 4.8)]), (3, [(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)]), (4, []), (5, None)]
    d = spark.createDataFrame(rings, "id long, my_ring array<struct<x:double,y:double>>")
    got = {r.id: {(t.lat, t.lon) for t in r.t} for r in d.select("id", tiles.alias("t")).collect()}
    assert got == {1: {(0, 0), (0, 1), (1, 0), (1, 1)}, 2: {(4, c) for c in range(10)}, 3: set(), 4: set(), 5: set()}


def test_a_long_ring_is_repaired_in_one_pass(spark):
    """Steps are not copied into each other (g27_repaired_rings)."""
    assert str(geo.repaired_ring(F.col("my_ring"))).count("my_ring") == 1 and str(geo.ring_area_m2(F.col("my_ring"))).count("my_ring") == 1
    n = 3000
    circle = [(100 * math.cos(2 * math.pi * k / n), 100 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    ring = [p for c in circle for p in (c, c, None)] + [circle[0]]
    d = spark.createDataFrame([(ring,), (None,), ([],), ([(1.0, 1.0)],)], "my_ring array<struct<x:double,y:double>>")
    got = d.select(geo.repaired_ring(F.col("my_ring")).alias("r")).select("r", geo.ring_area_m2(F.col("r")).alias("a")).collect()
    assert [tuple(p) for p in got[0].r] == circle and got[0].a == pytest.approx(n / 2 * 1e4 * math.sin(2 * math.pi / n)) and [g.r for g in got[1:]] == [None] * 3


def test_few_shapes_are_burned_by_many_tasks(spark):
    """Cells are dealt before they are made, however few rows they come from (j19_burned_features)."""
    f = spark.createDataFrame([(0, "building", [0.0, 4000.0, 4000.0, 0.0], [0.0, 0.0, 4000.0, 4000.0], True), (0, "road", [0.0, 5000.0], [7.5, 7.5], False)], "grid_id long, kind string, x array<double>, y array<double>, closed boolean").coalesce(1)
    got = land.burned(f, 5.0, {"road": 0.0, "building": 0.0}).withColumn("task", F.spark_partition_id()).groupBy("kind", "task").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got if r.kind == "building") == 801 * 801 and sum(r.n for r in got if r.kind == "road") == 1001
    assert len({r.task for r in got}) >= 3 and max(r.n for r in got) < 400_000


@pytest.mark.parametrize("radius", [0.0, 1.0, 2**0.5, 4.0, 6.5])
def test_dilation_goes_by_bits(spark, radius):
    """No cell of the widened mask is a key of a hash table (d12_siting_vetoes)."""
    members = [(1, 0, 0), (1, 5, 63), (1, 5, 64), (1, 9, 130), (2, 3, -2)]
    grown = flow.dilated(spark.createDataFrame(members, "grid_id long, row int, col int"), radius)
    got = [tuple(r) for r in grown.collect()]
    k = int(radius)
    want = {(g, r + a, c + b) for g, r, c in members for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= radius * radius + 1e-9}
    assert len(got) == len(want) and set(got) == want and [f.dataType.simpleString() for f in grown.schema] == ["bigint", "int", "int"]
    assert not re.search(r"(Aggregate|Deduplicate|Distinct) ?\[?grid_id#\d+L?, row#\d+, col#|^Distinct|Deduplicate", grown._jdf.queryExecution().analyzed().toString())


def test_burned_line_touches_its_cells(spark):
    f = spark.createDataFrame([(0, "road", [2.5, 12.5], [2.5, 2.5], False), (0, "building", [20.0, 30.0, 30.0, 20.0], [20.0, 20.0, 30.0, 30.0], True)], "grid_id long, kind string, x array<double>, y array<double>, closed boolean")
    got = {(r.row, r.col, r.kind) for r in land.burned(f, 5.0, {"road": 0.0, "building": 0.0}).collect()}
    assert {(0, 0, "road"), (0, 1, "road"), (0, 2, "road")} == {g for g in got if g[2] == "road"}
    assert (4, 4, "building") in got and (5, 5, "building") in got


def test_nested_catchments(spark):
    cells = spark.createDataFrame([(0, r, c, 10.0 - r) for r in range(6) for c in range(2)], "grid_id long, row int, col int, z double")
    f = terrain.flow_direction(cells)
    sites = spark.createDataFrame([(1, 0, 2, 0), (2, 0, 4, 0)], "site_id long, grid_id long, row int, col int")
    flow.shared_checkpoints(spark)
    got = flow.catchments(f, sites).groupBy("site_id").agg(F.count("*").alias("n"), F.max("dist").alias("d")).orderBy("site_id").collect()
    assert [(r.n, r.d) for r in got] == [(3, 2.0), (5, 4.0)]


def kml_bytes(body, z=""):
    line = lambda n, k: f"<Placemark><name>{n}</name>{body(n)}<LineString><coordinates>77,{21 + k}{z and ',' + str(n)} 77.1,{21 + k}{z and ',' + str(n)} bad</coordinates></LineString></Placemark>"
    return ("<kml xmlns='http://www.opengis.net/kml/2.2'><Document><Folder><name>contours_1.0m</name>" + "".join(line(n, k) for k, n in enumerate((100, 101, 102))) + "<Placemark><Point><coordinates>1,2</coordinates></Point></Placemark></Folder></Document></kml>").encode()


def test_kml_strategies_and_problems(spark):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("doc.kml", kml_bytes(lambda n: ""))
    field = kml_bytes(lambda n: f"<ExtendedData><Data name='ELEV'><value>{n + 5}</value></Data></ExtendedData>")
    files = [("name", kml_bytes(lambda n: "")), ("z", kml_bytes(lambda n: "", "z")), ("field", field), ("zip", zipped.getvalue()), ("bad.kmz", b"nothing"), ("xxe", b"<!DOCTYPE a><kml/>"), ("broken", b"<kml>")]
    pm = kml.parsed(spark.createDataFrame([(a, bytearray(b)) for a, b in files], "map_id string, content binary"))
    got = {r.map_id: r for r in kml.summary(kml.contour_lines(pm)).collect()}
    assert set(got) == {"name", "z", "field", "zip"} and got["field"].levels == [105.0, 106.0, 107.0] and got["z"].interval_m == 1.0
    assert {r.map_id for r in kml.problems(pm).collect()} == {"bad.kmz", "xxe", "broken"}
    assert {r.strategy for r in kml.contour_lines(pm).where("map_id = 'z'").collect()} == {"coordinate_z"}


def test_rain_maps_and_sinks(spark):
    body = '{"rain":{"20200101":5.0,"20200102":-999,"20200103":1,"20200104":1,"20200105":1,"20200106":1,"20200107":1,"20200108":1,"20200109":1,"20200110":1,"20200111":1},"t2m":{"20200101":20,"20200102":-999},"t2m_max":{"20200101":26},"t2m_min":{"20200101":14}}'
    got = services.rainfall_maps(spark.createDataFrame([(1, 21.0, body)], "series int, lat double, body string")).orderBy("observed_on").collect()
    assert got[1].mm == 0 and got[1].filled and got[1].temperature_c is None and got[0].et0_mm > 1
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, None)], "grid_id long, row int, col int, z double")
    assert sinks.pictures(cells, "z", 0, 2).collect()[0].png[:4] == b"\x89PNG"


def test_job_states_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, "running"), (1, 2, "running"), (1, 3, "done"), (1, 4, "queued"), (2, 1, "done")]
    e = spark.createDataFrame(rows, "job_id long, seq long, state string")
    want = {1: ("done", 1), 2: ("queued", 1)}
    assert {r.job_id: (r.state, r.refused) for r in jobs.job_states(e).collect()} == want
    e.write.parquet(str(tmp_path / "in"))
    q = jobs.job_states_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.job_id: (r.state, r.refused) for r in spark.table("job_states").collect()} == want


def test_classes(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    r = one(spark, classify.feature_kind(m(building="yes", landuse="residential")), classify.feature_kind(m(landuse="reservoir")), classify.water_kind(m(natural="water", water="river")), classify.water_kind(m(natural="water"), F.lit(6.0), F.lit(30_000.0)), classify.water_kind(m(waterway="stream")), hydro.soil_group(hydro.texture_class(F.lit(45.0), F.lit(20.0), F.lit(35.0))), classify.screening(F.lit(5.0), F.lit(None).cast("double"), F.lit(1.0), 1, 30, 0.1))
    assert list(r) == ["building", "water", "major", "major", "minor", "D", "indeterminate"]
