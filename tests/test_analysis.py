"""The whole chain on a valley that is known, and the pieces that it adds."""

import numpy as np
from pyspark.sql import functions as F

from rillwork.operators import analysis, flow, kernels, registers, siting, survey
from rillwork.plans.q_analysis import ET0, LOOSE, valley, valley_kml
from rillwork.sources import kml, services
from rillwork.streaming import jobs, steps

from .conftest import SF


def test_contours_give_the_valley_back_and_its_hollow_gets_the_pond(spark):
    maps = spark.createDataFrame([("a", valley_kml(0.04, 77.0, 20.0).encode())], "map_id string, content binary")
    lines = kml.contour_lines(kml.parsed(maps))
    cells, frames = analysis.gridded(lines)
    frame = frames.collect()[0]
    got = cells.toPandas()
    # the same place in the drawn valley: its cells are five metres, and the map's box starts at its outermost line
    z = np.full((frame.n_rows, frame.n_cols), np.nan)
    z[got.row, got.col] = got.z
    k = frame.cell_m / 5
    r, c = np.indices(z.shape)
    want = valley((64, 64), 0.04)
    rr, cc = np.clip(((r + 0.5) * k - 0.5).round().astype(int), 0, 63), np.clip(((c + 0.5) * k - 0.5).round().astype(int), 0, 63)
    off = np.abs(z - want[rr, cc])
    assert np.isfinite(z).mean() > 0.8 and np.nanmedian(off) < 0.3
    daily = spark.sql("SELECT explode(sequence(date'1995-01-01', date'2000-12-31')) AS observed_on").withColumn("mm", F.when((F.month("observed_on").between(6, 9)) & (F.dayofmonth("observed_on") % 3 == 0), 90.0).otherwise(0.0))
    made = analysis.analyse_maps(lines, lambda x: x.withColumn("cover", F.lit(30)), daily, ET0, **LOOSE).checkpoint()
    out = made.orderBy("rank").toPandas()
    best = out.iloc[0]
    # the hollow is at the valley's middle row and six tenths of its length
    hollow = out[out.kind == "natural_depression"].iloc[0]
    assert best["rank"] == 1 and abs(best.row * k - 32) < 8
    assert abs(hollow.row * k - 32) < 8 and abs(hollow.col * k - 38) < 10 and hollow.score > 30
    assert best.gross_m3 > 0 and best.annual_m3 > best.dependable_m3 * 0.99 > 0 and 0 < best.months_with_water <= 12
    assert best.expected_m3 == min(best.live_m3, best.dependable_m3) and best.explanation.startswith("Rank 1, score ")
    # the pour point is where most flows within the radius, the pond fits the buildable land, the hollow holds water by itself, and two criteria speak for a site
    assert (out.snapped_m <= 151).all() and (out.catchment_m2 > 0).all() and (out.usable_m2 <= 20_000).all()
    assert (out.gross_m3 <= out.usable_m2 * out.depth_m + 1).all() and hollow.terrain_m3 > 0 and "chiefly for" in best.explanation
    import json

    report = json.loads(analysis.reports(made).collect()[0].report)
    assert report["headline"]["site_rank"] == 1 and [x["rank"] for x in report["sites"]] == list(range(1, len(out) + 1)) and report["sites"][0]["pond"]["gross_m3"] > 0
    # a river through the hollow vetoes it
    c = cells.withColumn("cover", F.lit(30))
    river = spark.createDataFrame([(frame.grid_id, "major", [0.0, 320.0], [160.0, 160.0], False)], "grid_id long, kind string, x array<double>, y array<double>, closed boolean")
    free = siting.sites(c, frame.cell_m, **LOOSE).where("rank = 1").collect()[0]
    vetoed = siting.sites(c, frame.cell_m, features=river, **LOOSE).collect()
    assert abs(free.row - best.row) <= 1
    assert all(abs((s.row + 0.5) * frame.cell_m - 160) > 50 for s in vetoed)


def test_nested_catchments_by_doubled_chains(spark):
    """A line of 40 cells with an outlet in each: every outlet's catchment is all cells above it."""
    flow.shared_checkpoints(spark)
    f = spark.range(40).select(F.lit(1).cast("long").alias("grid_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.lit(1).alias("fdir"), F.lit(0).alias("down_row"), F.when(F.col("id") < 39, F.col("id").cast("int") + 1).alias("down_col"))
    s = spark.range(40).select((F.col("id") + 100).alias("site_id"), F.lit(1).cast("long").alias("grid_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"))
    got = {(r.site_id - 100, r.col): r.dist for r in flow.catchments(f, s, 2.0).collect()}
    assert got == {(k, c): 2.0 * (k - c) for k in range(40) for c in range(k + 1)}


def test_labels_and_fill_against_plain_forms():
    rng = np.random.default_rng(3)
    lab = rng.integers(0, 6, (9, 7))
    got = kernels.by_label(lab)
    assert [g.tolist() for g in got] == [np.flatnonzero(lab.ravel() == k).tolist() for k in range(1, lab.max() + 1)]
    z = rng.normal(0, 1, (20, 25))
    z[5, 5:9] = np.nan
    w = kernels.fill(z)
    low = np.where(kernels.outlets(z), z, np.inf)
    for _ in range(500):
        near = np.fmin.reduce([kernels.shifted(low, r, c, np.inf) for r, c in kernels.STEPS])
        low = np.where(kernels.outlets(z), z, np.where(np.isfinite(z), np.minimum(low, np.maximum(z, near + kernels.EPSILON)), np.inf))
    ok = np.isfinite(z)
    assert np.allclose(w[ok], low[ok], atol=1e-12) and np.isnan(w[~ok]).all()


def test_names_with_marks_and_scripts_link_and_match(spark):
    places = spark.createDataFrame([(1, "Mahārāshtra", "Puṇe", "Haveli"), (2, "महाराष्ट्र", "पुणे", "हवेली"), (3, "Goa", "North", "Bicholim")], "place_id long, state string, district string, sub string")
    areas = spark.createDataFrame([(10, "MAHARASHTRA", "PUNE", "HAVELI"), (11, "Goa", "North", "Bicholim")], "area_id long, state string, district string, sub string")
    got = {r.place_id: r.area_id for r in registers.link_places(places, areas).collect()}
    assert got == {1: 10, 2: 10, 3: 11}
    from rillwork.functions import names

    a = spark.createDataFrame([(1, "Nāgpur"), (2, "नागपुर"), (3, "Kolkata")], "l_id long, n string").select("l_id", names.folded(F.col("n")).alias("l_name"))
    b = spark.createDataFrame([(7, "Nagpur")], "r_id long, n string").select("r_id", names.folded(F.col("n")).alias("r_name"))
    assert {(r.l_id, r.sim) for r in registers.fuzzy_pairs(a, b).collect()} == {(1, 1.0), (2, 1.0)}


def test_prefixes_lose_no_pair(spark):
    import random

    from rillwork.functions import names

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcpur") for _ in range(rng.randint(2, 9))) for _ in range(150)})
    w = spark.createDataFrame([(k, x) for k, x in enumerate(words)], "id long, n string")
    for least in (0.3, 0.5):
        got = {(r.l_id, r.r_id) for r in registers.fuzzy_pairs(w.toDF("l_id", "l_name"), w.toDF("r_id", "r_name"), least).collect()}
        t = {r.id: set(r.t) for r in w.select("id", names.trigrams(F.col("n")).alias("t")).collect()}
        assert got == {(a, b) for a in t for b in t if len(t[a] & t[b]) / len(t[a] | t[b]) >= least}


def test_files_of_parcels_and_boundaries(spark, tmp_path):
    import json

    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    features = [
        {"type": "Feature", "properties": {"id": 7, "Owner": "Govt"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(5, 5, 1)]]}},
        {"type": "Feature", "properties": {"Owner": "A. B."}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 9), square(2, 2, 2)]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r.parcel_id: r for r in services.parcels(spark, str(path)).collect()}
    assert got[0].own_id == "7" and got[0].public and not got[1].public and [got[k].skipped for k in range(3)] == [False, False, True]
    for f in features:
        f["properties"] = {"shapeName": "A", "shapeID": str(len(str(f))), "shapeType": "ADM2", "boundaryCanonical": "District"}
    path.write_text(json.dumps({"features": features}))
    areas = services.boundaries(spark, str(path), "ADM2")
    at = spark.createDataFrame([(1, 5.5, 5.5), (2, 3.0, 3.0), (3, 8.0, 8.0)], "area_id long, x double, y double")
    size = {r.area_id: r.size for r in areas.collect()}
    parents = {r.area_id: size.get(r.parent_id) for r in registers.link_hierarchy(at, areas).collect()}
    assert parents == {1: 36.0, 2: None, 3: 81.0}


def test_reports_of_steps_and_requests(spark):
    rep = spark.range(1).select(F.explode(F.array(*[steps.report(F.lit(1), "dem", k, F.lit(i), F.lit(t)) for i, (k, t) in enumerate([("start", None), ("fail", "no tile"), ("retry", "slow"), ("finish", None)])], steps.report(F.lit(1), "soil", "start", F.lit(9)))).alias("r")).select("r.*")
    got = {r.step: r for r in steps.step_states(rep).collect()}
    assert (got["dem"].state, got["dem"].attempts, got["dem"].warnings, got["dem"].error) == ("done", 2, 1, None) and got["soil"].state == "running"
    assert {r.step: r.state for r in steps.settled(steps.step_states(rep), rep.select("job_id")).collect()} == {"dem": "done", "soil": "failed"}
    r = spark.createDataFrame([("a", "2024-01-01 00:00"), ("a", "2024-01-01 00:30"), ("a", "2024-01-01 01:00"), ("b", "2024-01-01 00:10")], "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(x.key for x in jobs.first_requests(r, 60).collect()) == ["a", "a", "b"]
    assert survey.respaced(np.array([[0.0, 0.0], [10.0, 0.0]]), 4.0).tolist() == [[0, 0], [10 / 3, 0], [20 / 3, 0], [10, 0]] and SF


def test_only_tiles_that_can_have_cells_are_made_and_sites_rain_is_dealt(spark):
    from rillwork.operators import analysis as a
    from rillwork.operators import runoff, tiled

    at = spark.range(1).select(F.lit(0).alias("row"), F.lit(5).alias("col"))
    assert [(t.tr, t.tc) for t in at.select(tiled._tiles_near(F.col("row"), F.col("col"), 8, True).alias("t")).first().t] == [(0, 0)]
    daily = spark.sql("SELECT explode(sequence(date'1995-01-01', date'1996-12-31')) AS observed_on").withColumn("mm", F.when(F.dayofmonth("observed_on") % 3 == 0, 60.0).otherwise(0.0))
    cells = spark.range(8).select(F.lit(1).cast("long").alias("grid_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.when(F.col("id") < 3, 30).otherwise(40).alias("cover"))
    members = cells.select(F.col("col").cast("long").alias("site_id"), "grid_id", "row", "col")
    metrics = members.select("site_id", F.lit(25.0).alias("area_m2"))
    got = a.site_water(members, cells, metrics, daily, F.lit("B"))
    for r in got.collect():
        alone = runoff.runoff_estimate(daily.withColumn("series", F.lit(0)), F.lit(r.cn2), F.lit(25.0)).first()
        assert abs(alone.annual_mean_m3 - r.annual_m3) < 1e-9 and abs(alone.dependable_75_m3 - r.dependable_m3) < 1e-9 and len(r.monthly_mm) == 12
