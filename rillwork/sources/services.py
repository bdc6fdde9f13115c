"""Stored answers of rainfall, map, soil and boundary services as rows, and caches over them. Fetching is an ingest job's work, not the engine's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import classify, hydro, names

MODELS, MAX_MISSING, SENTINEL, OSM_TTL_DAYS, SOIL_TTL_DAYS, MOST_NAME = ("era5_land", "default"), 0.10, -998.0, 14, 180, 200
OSM = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"


def rainfall_arrays(bronze: DataFrame) -> DataFrame:
    """SRC-13: bronze(series, model, body JSON {"daily": {"time": [...], "precipitation_sum": [...], ...}}) -> series, observed_on, mm, et0_mm, temperature_c of the most preferred model with at most 10 % missing days; missing rain is 0."""
    kind = "daily struct<time:array<string>,precipitation_sum:array<double>,et0_fao_evapotranspiration:array<double>,temperature_2m_mean:array<double>>"
    d = bronze.withColumn("d", F.from_json("body", kind)["daily"])
    holes = F.size(F.filter("d.precipitation_sum", lambda x: x.isNull())) / F.size("d.precipitation_sum")
    rank = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    fit = d.where((F.size("d.precipitation_sum") > 0) & (holes <= MAX_MISSING) & (rank > 0)).withColumn("r", F.row_number().over(Window.partitionBy("series").orderBy(rank))).where("r = 1")
    at = lambda c, i: F.try_element_at(F.col(f"d.{c}"), i + 1)
    rows = fit.select("series", F.explode(F.transform("d.time", lambda t, i: F.struct(t.cast("date").alias("observed_on"), F.coalesce(at("precipitation_sum", i), F.lit(0.0)).alias("mm"), F.coalesce(at("et0_fao_evapotranspiration", i), F.lit(0.0)).alias("et0_mm"), at("temperature_2m_mean", i).alias("temperature_c")))).alias("x"))
    return rows.select("series", "x.*")


def rainfall_maps(bronze: DataFrame) -> DataFrame:
    """SRC-14: bronze(series, lat, body JSON {"rain": {"yyyymmdd": v}, "t2m": ..., "t2m_max": ..., "t2m_min": ...}) -> daily rows; sentinels are 0 rain and no temperature; series with more than 10 % of them are left out; ET0 by Hargreaves."""
    m = "map<string,double>"
    d = bronze.withColumn("b", F.from_json("body", f"rain {m}, t2m {m}, t2m_max {m}, t2m_min {m}"))
    ok = lambda c: F.when(F.try_element_at(F.col(f"b.{c}"), F.col("k")) > SENTINEL, F.try_element_at(F.col(f"b.{c}"), F.col("k")))
    rows = d.select("series", "lat", "b", F.explode("b.rain").alias("k", "v")).select("series", "lat", F.to_date("k", "yyyyMMdd").alias("observed_on"), (F.col("v") <= SENTINEL).alias("filled"), F.when(F.col("v") > SENTINEL, F.col("v")).otherwise(0.0).alias("mm"), ok("t2m").alias("temperature_c"), ok("t2m_max").alias("hi"), ok("t2m_min").alias("lo"))
    share = F.avg(F.col("filled").cast("double")).over(Window.partitionBy("series"))
    ra = hydro.extraterrestrial_radiation(F.col("lat"), F.dayofyear("observed_on"))
    return rows.withColumn("share", share).where(F.col("share") <= MAX_MISSING).withColumn("et0_mm", hydro.hargreaves_et0(ra, F.col("temperature_c"), F.col("hi"), F.col("lo"))).drop("share", "hi", "lo", "lat")


def osm_features(bronze: DataFrame) -> DataFrame:
    """SRC-16, P-15: bronze(window, body JSON) -> window, kind, osm_type, osm_id, tags, rings (null nodes dropped; outer and unnamed roles; two points or more)."""
    e = bronze.select("window", F.explode(F.from_json("body", OSM)["elements"]).alias("e"))
    clean = lambda g: F.filter(g, lambda p: p.isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull())
    outer = F.transform(F.filter("e.members", lambda m: F.coalesce(m["role"], F.lit("")).isin("outer", "")), lambda m: clean(m["geometry"]))
    rings = F.filter(F.when(F.col("e.geometry").isNotNull(), F.array(clean(F.col("e.geometry")))).otherwise(outer), lambda r: F.size(r) >= 2)
    d = e.select("window", classify.feature_kind(F.col("e.tags")).alias("kind"), F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"), rings.alias("rings"))
    return d.where("kind is not null and size(rings) > 0")


def with_relations(features: DataFrame, relations: DataFrame) -> DataFrame:
    """J-16: relations that features don't have by type and id."""
    return features.unionByName(relations.join(features.select("window", "osm_type", "osm_id"), ["window", "osm_type", "osm_id"], "left_anti"))


def soil_profiles(bronze: DataFrame) -> DataFrame:
    """SRC-12: bronze(site, body JSON {"clay": g/kg, "sand": ..., "silt": ...}) -> site, percentages, texture, soil group."""
    d = bronze.withColumn("b", F.from_json("body", "clay double, sand double, silt double")).select("site", *[(F.col(f"b.{c}") / 10).alias(c) for c in ("clay", "sand", "silt")])
    d = d.withColumn("texture", hydro.texture_class(F.col("clay"), F.col("sand"), F.col("silt")))
    return d.withColumn("soil", hydro.soil_group(F.col("texture")))


def fresh(cache: DataFrame, now: Column, ttl_days: int, key: str = "key") -> DataFrame:
    """SRC-17, SRC-22: the newest row of each key, if it isn't older than the time to live."""
    newest = cache.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fetched_at")))).where("__k = 1").drop("__k")
    return newest.where(F.col("fetched_at") >= now - F.expr(f"interval {ttl_days} days"))


def window_rows(features: DataFrame, version: int) -> DataFrame:
    """X-09: features(window, kind, osm_id, tags, ...) -> window, version, body: all features of a window as JSON, in order of id, for a cache."""
    item = F.struct(*[c for c in features.columns if c != "window"])
    return features.groupBy("window").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("osm_id").alias("at"), item.alias("feature"))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))).alias("body")).withColumn("version", F.lit(version))


def read_windows(cache: DataFrame, kind: str, version: int, now: Column, ttl_days: int = OSM_TTL_DAYS) -> DataFrame:
    """X-09: cache(window, version, body, fetched_at) -> the features of windows of this version that aren't too old; kind is a feature's schema."""
    good = fresh(cache.where(F.col("version") == version), now, ttl_days, "window")
    return good.select("window", F.explode(F.from_json("body", f"array<struct<at:long,feature:struct<{kind}>>>")).alias("x")).select("window", "x.feature.*")


def preferred(fetched: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """X-06: fetched rows, else cached ones."""
    return fetched.unionByName(cached.join(fetched.select(key).distinct(), key, "left_anti"))


def places(spark: SparkSession, path: str, state: str | None = None, district: str | None = None) -> DataFrame:
    """SRC-18: a register of tab-separated names: shrid2, state_name, district_name, subdistrict_name, town_name, village_name, place; names that fold to nothing are left out."""
    return place_rows(spark.read.option("sep", "\t").option("header", True).csv(path), state, district)


def place_rows(raw: DataFrame, state: str | None = None, district: str | None = None) -> DataFrame:
    """SRC-18 of rows as read; X-31: names are cut at MOST_NAME characters."""
    t = {c: F.substring(names.unquoted(F.col(c)), 1, MOST_NAME) for c in raw.columns}
    name = F.coalesce(F.nullif(t["village_name"], F.lit("")), F.nullif(t["town_name"], F.lit("")))
    d = raw.select(t["shrid2"].alias("shrid"), t["state_name"].alias("state"), t["district_name"].alias("district"), t["subdistrict_name"].alias("sub"), name.alias("name"))
    d = d.withColumn("folded", names.folded(F.col("name"))).where("folded <> ''").withColumn("code", names.census_code(F.col("shrid")))
    for c, v in (("state", state), ("district", district)):
        if v is not None:
            d = d.where(names.folded(F.col(c)) == names.fold(v))
    return d


def panchayat_links(spark: SparkSession, path: str, village: str, code: str, name: str) -> DataFrame:
    """SRC-19: tab-separated links; codes 0 and blank panchayats are left out. The columns' names are parameters."""
    return panchayat_rows(spark.read.option("sep", "\t").option("header", True).csv(path), village, code, name)


def panchayat_rows(raw: DataFrame, village: str, code: str, name: str) -> DataFrame:
    """SRC-19 of rows as read."""
    d = raw.select(*[names.unquoted(F.col(c)).alias(a) for c, a in ((village, "village_code"), (code, "code"), (name, "name"))])
    return d.where("village_code is not null and village_code not in ('', '0') and code is not null and code not in ('', '0') and name is not null and name <> ''")


def rings(geometry: Column) -> Column:
    """S-04, SRC-20: array<struct<x, y>> ring of each outer and inner boundary of a Polygon or MultiPolygon given as struct(type, coordinates as text); other kinds have none."""
    one, many = F.from_json(geometry["coordinates"], "array<array<array<double>>>"), F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    parts = F.when(geometry["type"] == "Polygon", one).when(geometry["type"] == "MultiPolygon", F.flatten(many)).otherwise(F.array().cast("array<array<array<double>>>"))
    return F.transform(parts, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def joined_rings(parts: Column) -> Column:
    """One ring that goes along all of them and back to each one's start: the even-odd rule over it is that over all, so holes and several outer boundaries count as they should."""
    closed = F.transform(parts, lambda r: F.concat(r, F.slice(r, 1, 1)))
    starts = F.transform(F.reverse(parts), lambda r: F.element_at(r, 1))
    return F.concat(F.flatten(closed), starts)


def boundaries(spark: SparkSession, path: str, level: str) -> DataFrame:
    """SRC-20, J-09: GeoJSON features (shapeName, shapeID, shapeType) -> area_id, name, ring (all boundaries joined), size (box area, to choose the smallest around a point); only those whose label still names the level.
    Files of one feature a line are split among tasks; one document of many features is a task."""
    kind = "features array<struct<properties:struct<shapeName:string,shapeID:string,shapeType:string,boundaryCanonical:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    d = f.select(F.col("f.properties.shapeID").alias("area_id"), F.col("f.properties.shapeName").alias("name"), joined_rings(rings(F.col("f.geometry"))).alias("ring"), F.coalesce("f.properties.boundaryCanonical", F.lit("")).alias("label"))
    d = d.where(classify.same_level(level, F.col("label")) & (F.size("ring") > 0)).drop("label")
    v = lambda c: F.transform("ring", lambda p: p[c])
    return d.withColumn("size", (F.array_max(v("x")) - F.array_min(v("x"))) * (F.array_max(v("y")) - F.array_min(v("y"))))


def parcel_features(features: DataFrame) -> DataFrame:
    """SRC-21, P-17: features(parcel_id, f: struct(properties map, geometry struct(type, coordinates as text))) -> parcel_id, own_id (the file's id property, if any), ring (all boundaries, holes too, joined), attributes,
    owner, public, skipped (no polygon: counted by the caller, not lost without a word)."""
    p = F.col("f.properties")
    owner = F.try_element_at(p, classify.owner_field(p))
    ring = joined_rings(rings(F.col("f.geometry")))
    own = F.coalesce(F.try_element_at(p, F.lit("id")), F.try_element_at(p, F.lit("ID")), F.try_element_at(p, F.lit("parcel_id")))
    return features.select("parcel_id", own.alias("own_id"), ring.alias("ring"), p.alias("attributes"), F.trim(owner).alias("owner"), classify.is_public(owner).alias("public"), (F.size(F.coalesce(ring, F.array().cast("array<struct<x:double,y:double>>"))) == 0).alias("skipped"))


def parcels(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: GeoJSON parcels as parcel_features, parcel_id being the place in the file. WGS84 only (X-10)."""
    kind = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    return parcel_features(spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("features").alias("parcel_id", "f")))
