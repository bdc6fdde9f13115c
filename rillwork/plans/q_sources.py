"""Queries of sources and job states on the generic tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.plans.views import cells, table
from rillwork.sources import kml, services, sinks
from rillwork.streaming import jobs, steps

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("src03_coordinates", "SELECT vec_id AS id, 3 AS points, round(embedding[1]::DOUBLE + embedding[3]::DOUBLE + embedding[5]::DOUBLE, 5) AS lon_sum FROM embeddings")
def _src03(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i: F.format_string("%.12f", F.col("embedding")[i].cast("double"))
    text = F.concat(v(0), F.lit(","), v(1), F.lit(" \n"), v(2), F.lit(","), v(3), F.lit(",10 oops, x,y "), v(4), F.lit(","), v(5))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), kml.parse_coordinates(text).alias("c"))
    return e.select("id", F.size("c").alias("points"), F.round(F.aggregate("c", F.lit(0.0), lambda s, p: s + p["lon"]), 5).alias("lon_sum"))


@query(
    "src05_kml_maps",
    """WITH l AS (SELECT n_regionkey::VARCHAR AS map_id, n_nationkey * 5 + 100.0::DOUBLE AS e FROM nation), s AS (SELECT map_id, e - lag(e) OVER (PARTITION BY map_id ORDER BY e) AS d FROM l),
m AS (SELECT map_id, d, row_number() OVER (PARTITION BY map_id ORDER BY count(*) DESC, d) AS k FROM s WHERE d > 0 GROUP BY map_id, d), g AS (SELECT map_id, list(e ORDER BY e) AS levels, count(*) AS lines, 3 * count(*) AS points FROM l GROUP BY 1)
SELECT map_id, levels, lines, points, d AS interval_m FROM g LEFT JOIN m USING (map_id) WHERE k = 1 OR k IS NULL""",
)
def _src05(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("<Placemark><name>"), (F.col("n_nationkey") * 5 + 100).cast("string"), F.lit(" m</name><LineString><coordinates>77,21 77.1,21.1 77.2,21</coordinates></LineString></Placemark>"))
    maps = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("map_id")).agg(F.concat(F.lit("<kml><Document>"), F.concat_ws("", F.sort_array(F.collect_list(line))), F.lit("</Document></kml>")).cast("binary").alias("content"))
    return kml.summary(kml.contour_lines(kml.parsed(maps)))


@query("src16_osm_features", "SELECT event_id AS osm_id, CASE WHEN event_id % 3 = 0 THEN 'building' ELSE 'water' END AS kind, 1 AS rings FROM events WHERE event_id % 3 < 2")
def _src16(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("event_id") % 3 == 0, '{"building":"yes"}').when(F.col("event_id") % 3 == 1, '{"natural":"water"}').otherwise('{"amenity":"well"}')
    body = F.concat(F.lit('{"elements":[{"type":"way","id":'), F.col("event_id").cast("string"), F.lit(',"tags":'), tags, F.lit(',"geometry":[{"lat":1,"lon":2},null,{"lat":1.5,"lon":2}]}]}'))
    bronze = table(spark, d, "events").select(F.lit("w").alias("window"), body.alias("body"))
    return services.osm_features(bronze).select("osm_id", "kind", F.size("rings").alias("rings"))


@query("src13_rain_json", "SELECT s_suppkey AS series, 11 AS days, round(10.0 * (1 + s_suppkey % 7), 4) AS mm FROM supplier WHERE s_suppkey % 5 <> 0")
def _src13(spark: SparkSession, d: str) -> DataFrame:
    days = F.concat(F.lit('["'), F.array_join(F.transform(F.sequence(F.lit("2020-01-01").cast("date"), F.lit("2020-01-11").cast("date")), lambda x: x.cast("string")), '","'), F.lit('"]'))
    v = (1 + F.col("s_suppkey") % 7).cast("string")
    rain = F.concat(F.lit("[null,"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("null,")).otherwise(F.concat(v, F.lit(","))), F.concat_ws(",", F.array_repeat(v, 9)), F.lit("]"))
    bronze = table(spark, d, "supplier").select(F.col("s_suppkey").alias("series"), F.lit("era5_land").alias("model"), F.concat(F.lit('{"daily":{"time":'), days, F.lit(',"precipitation_sum":'), rain, F.lit("}}")).alias("body"))
    return services.rainfall_arrays(bronze).groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("days"), F.round(F.sum("mm"), 4).alias("mm"))


@query("src12_soil_json", "SELECT s_suppkey AS site, round(s_suppkey % 60 * 1.0, 4) AS clay FROM supplier")
def _src12(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct((F.col("s_suppkey") % 60 * 10).cast("double").alias("clay"), F.lit(300.0).alias("sand"), F.lit(400.0).alias("silt")))
    return services.soil_profiles(table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), body.alias("body"))).select("site", F.round("clay", 4).alias("clay"))


@query("src17_cache_ttl", "SELECT user_id AS key, max(event_id) AS newest FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND max_by(event_id, ts) = max(event_id)".replace(" AND max_by(event_id, ts) = max(event_id)", "").replace("max(event_id)", "max_by(event_id, (ts))"))
def _src17(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").alias("fetched_at"))
    now = e.agg(F.max("fetched_at").alias("now"))
    newest = services.fresh(e.crossJoin(F.broadcast(now)), F.col("now"), 1)  # one row
    return newest.select("key", F.col("event_id").alias("newest"))




_MAY = "CASE now WHEN 'queued' THEN s IN ('running', 'cancelled', 'failed') WHEN 'running' THEN s IN ('retrying', 'done', 'partial', 'failed', 'cancelled') WHEN 'retrying' THEN s IN ('running', 'failed', 'cancelled') ELSE false END"


@query(
    "st01_job_states",
    f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, (['running', 'retrying', 'done', 'queued', 'failed'])[event_id % 5 + 1] AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT job_id, 0::BIGINT AS k, 'queued' AS now, 0 AS bad FROM e UNION ALL SELECT job_id, k, CASE WHEN {_MAY} THEN s ELSE now END, bad + CASE WHEN s = now OR {_MAY} THEN 0 ELSE 1 END FROM (SELECT e.job_id, e.k, e.s, f.now, f.bad FROM f JOIN e ON e.job_id = f.job_id AND e.k = f.k + 1))
SELECT job_id, arg_max(now, k) AS state, arg_max(bad, k) AS refused FROM f GROUP BY 1""",
)
def _st01(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in ("running", "retrying", "done", "queued", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    return jobs.job_states(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state")))


@query(
    "st05_first_requests",
    """WITH RECURSIVE e AS (SELECT user_id || event_type AS key, ts FROM events), f AS (SELECT key, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT f.key, (SELECT min(e.ts) FROM e WHERE e.key = f.key AND e.ts >= f.ts + INTERVAL 3 DAY) FROM f WHERE f.ts IS NOT NULL)
SELECT key, count(*) AS n, max(ts) AS last FROM f WHERE ts IS NOT NULL GROUP BY 1""",
)
def _st05(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    return jobs.first_requests(e, 3 * 24 * 60).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query("k09_retained", "WITH n AS (SELECT user_id AS store, event_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY) SELECT store, key FROM n WHERE k <= 4")
def _k09(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("store"), F.col("event_id").alias("key"), F.col("ts").alias("used_at"))
    d_ = e.crossJoin(F.broadcast(e.agg(F.max("used_at").alias("now"))))  # one row
    return sinks.retained(d_, 4, by="store", now=F.col("now"), hours=480).select("store", "key")


@query("src21_parcel_features", "SELECT s_suppkey AS parcel_id, 'P' || s_suppkey AS own_id, CASE s_suppkey % 4 WHEN 0 THEN 7 WHEN 3 THEN 0 ELSE 14 END AS points, s_suppkey % 4 = 3 AS skipped, s_suppkey % 2 = 0 AS public, s_suppkey % 4 IN (0, 2) AS edge, s_suppkey % 4 IN (0, 1) AS middle FROM supplier")
def _src21(spark: SparkSession, d: str) -> DataFrame:
    """Polygons, polygons with a hole, two polygons in one, and points; whether a corner and the middle of the first square are inside."""
    from rillwork.operators.registers import inside

    square = lambda x, y, w: f"[[{x},{y}],[{x + w},{y}],[{x + w},{y + w}],[{x},{y + w}],[{x},{y}]]"
    shapes = [("Polygon", f"[{square(0, 0, 4)}]"), ("MultiPolygon", f"[[{square(1, 1, 2)}],[{square(8, 8, 1)}]]"), ("Polygon", f"[{square(0, 0, 4)},{square(1, 1, 2)}]"), ("Point", "[1,2]")]
    k = F.col("s_suppkey")
    geometry = F.element_at(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(c).alias("coordinates")) for t, c in shapes]), (k % 4 + 1).cast("int"))
    props = F.create_map(F.lit("id"), F.concat(F.lit("P"), k.cast("string")), F.lit("Owner"), F.when(k % 2 == 0, " Govt land ").otherwise("A. Shinde"))
    p = services.parcel_features(table(spark, d, "supplier").select(k.alias("parcel_id"), F.struct(props.alias("properties"), geometry.alias("geometry")).alias("f")))
    at = lambda x, y: F.coalesce(inside(F.lit(x), F.lit(y), F.col("ring")), F.lit(False))
    return p.select("parcel_id", "own_id", F.size("ring").alias("points"), "skipped", "public", at(0.5, 0.4).alias("edge"), at(2.1, 2.0).alias("middle"))


@query("src14_rain_maps", "SELECT s_suppkey AS series, 20 AS days, round(sum(CASE WHEN s_suppkey % 3 = 1 AND i = 0 THEN 0 ELSE (s_suppkey * (i + 1)) % 37 END)::DOUBLE, 4) AS mm, CASE WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END AS missing FROM supplier CROSS JOIN (SELECT unnest(range(0, 20)) AS i) WHERE s_suppkey % 3 < 2 GROUP BY 1, 4")
def _src14(spark: SparkSession, d: str) -> DataFrame:
    """Series by number: none, one or three of twenty days are sentinels; those with three are left out."""
    k = F.col("s_suppkey")
    days = F.sequence(F.lit(0), F.lit(19))
    name = lambda i: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), i), "yyyyMMdd")
    gone = lambda i: ((k % 3 == 1) & (i == 0)) | ((k % 3 == 2) & (i < 3))
    rain = F.map_from_entries(F.transform(days, lambda i: F.struct(name(i), F.when(gone(i), -999.0).otherwise((k * (i + 1) % 37).cast("double")))))
    heat = lambda v: F.map_from_entries(F.transform(days, lambda i: F.struct(name(i), F.when(gone(i), -999.0).otherwise(v))))
    body = F.to_json(F.struct(rain.alias("rain"), heat(25.0).alias("t2m"), heat(31.0).alias("t2m_max"), heat(19.0).alias("t2m_min")))
    got = services.rainfall_maps(table(spark, d, "supplier").select(k.alias("series"), F.lit(21.0).alias("lat"), body.alias("body")))
    return got.groupBy("series").agg(F.count(F.lit(1)).cast("int").alias("days"), F.round(F.sum("mm"), 4).alias("mm"), F.count_if(F.col("temperature_c").isNull()).cast("int").alias("missing"))


@query("j16_new_relations", "SELECT 'w' AS win, count(*) AS n, count(*) FILTER (WHERE event_id % 3 <> 0) AS relations FROM events")
def _j16(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("w").alias("window"), F.when(F.col("event_id") % 3 == 0, "way").otherwise("relation").alias("osm_type"), F.col("event_id").alias("osm_id"))
    got = services.with_relations(e.where("osm_type = 'way'"), e)
    return got.groupBy(F.col("window").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("osm_type") == "relation").alias("relations"))


@query("x06_preferred_rows", "SELECT user_id AS key, count(*) FILTER (WHERE event_type = 'purchase') AS fetched, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN count(*) ELSE 0 END AS cached FROM events GROUP BY 1")
def _x06(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_type") == "purchase").alias("bought"), F.lit(True).alias("new"))
    got = services.preferred(e.where("bought"), e.withColumn("new", F.lit(False)), "key")
    return got.groupBy("key").agg(F.count_if("new").alias("fetched"), F.count_if(~F.col("new")).alias("cached"))


@query("snk10_catalogue", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id DESC) AS n FROM events) SELECT sha256(concat_ws('|', event_type, (user_id % 5)::VARCHAR)) AS hash, event_id AS bytes FROM k WHERE n = 1")
def _snk10(spark: SparkSession, d: str) -> DataFrame:
    from rillwork.functions import geo
    from rillwork.operators import registers

    e = table(spark, d, "events").select(geo.cache_key(F.col("event_type"), F.col("user_id") % 5).alias("hash"), F.col("event_id").alias("bytes"), F.col("event_id").alias("seq"))
    return registers.upsert(e.where("seq % 2 = 0"), e, ["hash"], "seq").select("hash", "bytes")

@query(
    "snk03_geojson",
    """WITH s AS (SELECT s_nationkey AS job_id, s_suppkey AS rank, 77.0 + s_suppkey * 0.001 AS lon, 30 / (111320.0 * cos(radians(21.0))) AS dx, 30 / 111320.0 AS dy FROM supplier)
SELECT job_id, count(*) AS features, round(sum(4 * lon), 6) AS lon_sum, round(sum(4 * 21.0), 6) AS lat_sum, list(rank ORDER BY rank) AS ranks FROM s GROUP BY 1""",
)
def _snk03(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("job_id"), F.col("s_suppkey").alias("rank"), (77.0 + F.col("s_suppkey") * 0.001).alias("lon"), F.lit(21.0).alias("lat"), F.lit(60.0).alias("top_m"))
    c = sinks.collections(sinks.pond_features(s))
    # read again as GeoJSON: four corners of each rectangle
    kind = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<kind:string,values:struct<rank:long,top_m:double>>>>"
    f = c.withColumn("j", F.from_json("collection", kind)).where("j.type = 'FeatureCollection'")
    at = lambda i: F.round(F.aggregate("j.features", F.lit(0.0), lambda t, x: t + F.aggregate(F.slice(x["geometry"]["coordinates"][0], 1, 4), F.lit(0.0), lambda u, p: u + p[i])), 6)
    return f.select("job_id", F.size("j.features").cast("long").alias("features"), at(0).alias("lon_sum"), at(1).alias("lat_sum"), F.transform("j.features", lambda x: x["properties"]["values"]["rank"]).alias("ranks"))


@query(
    "src06_map_problems",
    """SELECT 'm' || s_suppkey AS map_id, CASE s_suppkey % 7 WHEN 0 THEN 'coordinate_z' WHEN 1 THEN 'extended_data' WHEN 2 THEN 'placemark_name' WHEN 3 THEN 'folder_name' ELSE 'none' END AS strategy, CASE WHEN s_suppkey % 7 < 4 THEN 3 ELSE 0 END AS lines,
CASE s_suppkey % 7 WHEN 4 THEN 'no heights of two levels or more' WHEN 5 THEN 'document types and entities are refused' WHEN 6 THEN 'a .kmz that isn''t a zip' ELSE '' END AS problem FROM supplier""",
)
def _src06(spark: SparkSession, d: str) -> DataFrame:
    """Maps with their heights in each of the four places (some zipped), one without any, one that declares a type, and one that only says it is zipped."""
    import pandas as pd

    def line(k: int, i: int) -> str:
        z = f",{100 + 5 * i}" if k == 0 else ""
        extra = f"<ExtendedData><Data name='Elevation'><value>{100 + 5 * i} m</value></Data></ExtendedData>" if k == 1 else ""
        name = f"<name>{100 + 5 * i}</name>" if k == 2 else "<name>contour</name>"
        mark = f"<Placemark>{name}{extra}<LineString><coordinates>77,{20 + i}{z} 77.1,{20 + i}{z} oops 77.2,{20.5 + i}{z}</coordinates></LineString></Placemark>"
        return f"<Folder><name>level {100 + 5 * i}</name>{mark}</Folder>" if k == 3 else mark

    def draw(batches):  # noqa: ANN001, ANN202
        import io
        import zipfile

        for b in batches:
            content = []
            for s in b["k"]:
                k = s % 7
                text = ("<!DOCTYPE kml>" if k == 5 else "") + "<kml xmlns='http://www.opengis.net/kml/2.2'><Document>" + "".join(line(k, i) for i in range(3)) + "</Document></kml>"
                data = text.encode()
                if s % 2 and k != 6:
                    held = io.BytesIO()
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("other.txt", "x")
                        z.writestr("doc.kml", data)
                    data = held.getvalue()
                content.append(data)
            yield pd.DataFrame({"map_id": [f"m{s}" + (".kmz" if s % 7 == 6 else "") for s in b["k"]], "content": content})

    pm = kml.parsed(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).mapInPandas(draw, "map_id string, content binary"))
    got = kml.contour_lines(pm).groupBy("map_id").agg(F.max("strategy").alias("strategy"), F.count(F.lit(1)).alias("lines"))
    out = pm.select("map_id").distinct().join(got, "map_id", "left").join(kml.problems(pm), "map_id", "left")
    return out.select(F.replace("map_id", F.lit(".kmz"), F.lit("")).alias("map_id"), F.coalesce("strategy", F.lit("none")).alias("strategy"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.coalesce("problem", F.lit("")).alias("problem"))


@query("src18_place_register", "SELECT c_custkey::VARCHAR AS code, 'st' || c_nationkey % 3 AS state, CASE WHEN c_custkey % 4 = 0 THEN 'Nagar ' || c_custkey ELSE 'Vil ' || c_custkey END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'nagar' || c_custkey ELSE 'vil' || c_custkey END AS folded FROM customer WHERE c_custkey % 9 > 0 AND c_nationkey % 3 = 1")
def _src18(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    quoted = lambda *x: F.concat(F.lit(' "'), *x, F.lit('"'))
    raw = table(spark, d, "customer").select(
        F.concat_ws("-", F.lit("11"), F.lit("27"), k.cast("string")).alias("shrid2"), quoted(F.lit("st"), (F.col("c_nationkey") % 3).cast("string")).alias("state_name"), quoted(F.lit("d")).alias("district_name"), F.lit("s").alias("subdistrict_name"),
        F.when(k % 9 == 0, '"--"').when(k % 4 == 0, quoted(F.lit("Nagar "), k.cast("string"))).alias("town_name"), F.when((k % 4 != 0) & (k % 9 != 0), quoted(F.lit("Vil "), k.cast("string"))).otherwise('""').alias("village_name"),
    )
    return services.place_rows(raw, state="ST 1").select("code", "state", "name", "folded")


@query("src19_panchayat_links", "SELECT c_custkey::VARCHAR AS village_code, (c_nationkey + 100)::VARCHAR AS code, 'GP ' || c_nationkey AS name FROM customer WHERE c_custkey % 5 > 1")
def _src19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(k.cast("string").alias("V Code"), F.when(k % 5 == 0, "0").otherwise((F.col("c_nationkey") + 100).cast("string")).alias("GP Code"), F.when(k % 5 == 1, '" "').otherwise(F.concat(F.lit('"GP '), F.col("c_nationkey").cast("string"), F.lit('"'))).alias("GP Name"))
    return services.panchayat_rows(raw, "V Code", "GP Code", "GP Name")


@query("x32_step_states", """WITH e AS (SELECT user_id AS job_id, event_type AS step, event_id AS seq, (['start', 'retry', 'finish', 'skip', 'fail'])[event_id % 5 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN 'w' || event_id END AS text FROM events),
g AS (SELECT job_id, step, arg_max(kind, seq) AS kind, count(*) FILTER (WHERE kind IN ('start', 'retry')) AS attempts, count(*) FILTER (WHERE text IS NOT NULL AND kind <> 'fail') AS warnings, max(seq) FILTER (WHERE kind = 'fail') AS bad FROM e GROUP BY ALL)
SELECT job_id, step, CASE kind WHEN 'start' THEN 'running' WHEN 'retry' THEN 'retrying' WHEN 'finish' THEN 'done' WHEN 'skip' THEN 'skipped' ELSE 'failed' END AS state, attempts, warnings, CASE WHEN kind = 'fail' AND bad % 3 = 0 THEN 'w' || bad ELSE '' END AS error,
 CASE WHEN job_id % 2 = 0 AND kind IN ('start', 'retry', 'fail') THEN 'failed' WHEN kind = 'start' THEN 'running' WHEN kind = 'retry' THEN 'retrying' WHEN kind = 'finish' THEN 'done' WHEN kind = 'skip' THEN 'skipped' ELSE 'failed' END AS settled FROM g""")
def _x32(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("start", "retry", "finish", "skip", "fail")]), (k % 5 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), kind.alias("kind"), k.alias("seq"), F.when(k % 3 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("text"))
    s = steps.step_states(e)
    after = steps.settled(s.select("job_id", "step", "state"), e.where("job_id % 2 = 0")).withColumnRenamed("state", "settled")
    return s.withColumn("error", F.coalesce("error", F.lit(""))).join(after, ["job_id", "step"])


@query("st06_refusals", "WITH e AS (SELECT user_id AS key, max(ts + CASE event_id % 3 WHEN 0 THEN INTERVAL 60 MINUTE WHEN 1 THEN INTERVAL 10 MINUTE ELSE INTERVAL 0 MINUTE END) AS until FROM events GROUP BY 1) SELECT key, until, until <= (SELECT max(ts) FROM events) AS probe FROM e")
def _st06(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.when(k == 0, "refused").when(k == 1, "unreachable").otherwise("other").alias("kind"), F.col("ts").alias("at"))
    now = e.agg(F.max("at").alias("now"))
    return steps.refusals_in_force(e, F.lit(now.first()[0]))


@query("g27_repaired_rings", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS points, CASE s_suppkey % 4 WHEN 0 THEN 16.0 WHEN 1 THEN 8.0 ELSE 0.0 END AS area FROM supplier")
def _g27(spark: SparkSession, d: str) -> DataFrame:
    """A closed square with a null and a repeat, an open triangle, two points there and back, and a line."""
    from rillwork.functions import geo

    shapes = ([(0, 0), (0, 0), None, (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (4, 0), (4, 4)], [(0, 0), (4, 0), (0, 0)], [(0, 0), (2, 0), (4, 0)])
    point = lambda p: F.lit(None).cast("struct<x:double,y:double>") if p is None else F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    k = F.col("s_suppkey") % 4
    ring = geo.repaired_ring(F.when(k == 0, F.array(*map(point, shapes[0]))).when(k == 1, F.array(*map(point, shapes[1]))).when(k == 2, F.array(*map(point, shapes[2]))).otherwise(F.array(*map(point, shapes[3]))))
    of = geo.let(ring, lambda r: F.struct(F.coalesce(F.size(r), F.lit(0)).alias("points"), F.coalesce(geo.ring_area_m2(r), F.lit(0.0)).alias("area")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), of.alias("of")).select("id", "of.*")


@query("snk05_pictures", "SELECT DISTINCT vec_id // 64 AS grid_id, true AS is_png, 64 AS width FROM embeddings")
def _snk05(spark: SparkSession, d: str) -> DataFrame:
    p = sinks.pictures(cells(spark, d), "z", 40.0, 60.0)
    return p.select("grid_id", (F.hex(F.substring("png", 1, 8)) == "89504E470D0A1A0A").alias("is_png"), F.conv(F.hex(F.substring("png", 17, 4)), 16, 10).cast("int").alias("width"))


@query("w06_even_steps", "SELECT s_suppkey AS line_id, (greatest(1, ceil((s_suppkey % 9 + 1 + s_suppkey % 4) * 3.0 / 2.5)) + 1)::INT AS points, (s_suppkey % 9 + 1 + s_suppkey % 4) * 3.0 AS length FROM supplier")
def _w06(spark: SparkSession, d: str) -> DataFrame:
    from rillwork.functions import geo
    from rillwork.operators import survey

    k = F.col("s_suppkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b = (k % 9 + 1) * 3, k % 4 * 3
    lines = table(spark, d, "supplier").select(k.alias("line_id"), F.array(at(F.lit(0), F.lit(0)), at(a, F.lit(0)), at(a, F.lit(0)), at(a + b, F.lit(0))).alias("points"))
    got = survey.resampled(lines, 2.5).withColumn("length", F.round(geo.line_length(F.col("points")), 6))
    return got.select("line_id", "length", F.size("points").alias("n")).withColumnRenamed("n", "points")


@query("x09_windows_again", "SELECT user_id AS win, count(*) AS features, sum(event_id)::BIGINT AS ids, count(DISTINCT event_type) AS kinds FROM events WHERE user_id % 3 > 0 GROUP BY 1")
def _x09(spark: SparkSession, d: str) -> DataFrame:
    """Features into cached windows and back; a third of the windows has another version and is fetched anew."""
    e = table(spark, d, "events").select(F.col("user_id").alias("window"), F.col("event_type").alias("kind"), F.col("event_id").alias("osm_id"), F.create_map(F.lit("k"), F.col("event_type")).alias("tags"))
    now = F.lit("2024-06-10").cast("timestamp")
    cache = services.window_rows(e, 3).withColumn("version", F.when(F.col("window") % 3 == 0, 2).otherwise(3)).withColumn("fetched_at", F.lit("2024-06-01").cast("timestamp"))
    f = services.read_windows(cache, "kind:string,osm_id:long,tags:map<string,string>", 3, now)
    return f.groupBy(F.col("window").alias("win")).agg(F.count(F.lit(1)).alias("features"), F.sum("osm_id").alias("ids"), F.count_distinct("kind").alias("kinds"))


_A, _F, _EA, _EF = 6378137.0, 1 / 298.257223563, 6377299.151, 1 / 300.8017255
_SHIFT = {"dx": 295.0, "dy": 736.0, "dz": 257.0, "rx": 0.5, "ry": -0.25, "rz": 1.0, "ppm": 2.0}
_SEC = 4.84813681109536e-06


@query(
    "x10_datum_shift",
    f"""WITH p AS (SELECT c_custkey AS id, radians(70 + c_custkey % 200 / 10.0) AS lam, radians(8 + (c_nationkey * 7 + c_custkey) % 280 / 10.0) AS phi FROM customer),
n AS (SELECT *, {_EA} / sqrt(1 - {_EF * (2 - _EF)} * sin(phi) * sin(phi)) AS n FROM p),
g AS (SELECT id, n * cos(phi) * cos(lam) AS x, n * cos(phi) * sin(lam) AS y, n * (1 - {_EF * (2 - _EF)}) * sin(phi) AS z FROM n),
h AS (SELECT id, 295 + (1 + 2e-6) * (x - {1.0 * _SEC} * y + {-0.25 * _SEC} * z) AS x, 736 + (1 + 2e-6) * ({1.0 * _SEC} * x + y - {0.5 * _SEC} * z) AS y, 257 + (1 + 2e-6) * ({0.25 * _SEC} * x + {0.5 * _SEC} * y + z) AS z FROM g),
t AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {_A}, sqrt(x * x + y * y) * {_A * (1 - _F)}) AS u FROM h)
SELECT id, round(degrees(atan2(y, x)), 7) AS lon, round(degrees(atan2(z + {_F * (2 - _F) / (1 - _F) ** 2 * _A * (1 - _F)} * sin(u) ^ 3, p - {_F * (2 - _F) * _A} * cos(u) ^ 3)), 7) AS lat FROM t""",
)
def _x10(spark: SparkSession, d: str) -> DataFrame:
    from rillwork.functions import datum

    c = table(spark, d, "customer")
    lon, lat = 70 + F.col("c_custkey") % 200 / 10.0, 8 + (F.col("c_nationkey") * 7 + F.col("c_custkey")) % 280 / 10.0
    shift = F.struct(*[F.lit(v).alias(k) for k, v in _SHIFT.items()])
    p = c.select(F.col("c_custkey").alias("id"), datum.to_wgs84(lon, lat, F.lit(_EA), F.lit(_EF), shift).alias("p"))
    return p.select("id", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query("src21_shapefile_parcels", "SELECT 'P' || s_suppkey AS own_id, CASE s_suppkey % 4 WHEN 0 THEN 6 WHEN 3 THEN 0 ELSE 12 END AS points, s_suppkey % 4 = 3 AS skipped, s_suppkey % 2 = 0 AS public, s_suppkey % 4 IN (0, 2) AS edge, s_suppkey % 4 IN (0, 1) AS middle FROM supplier")
def _shapefile(spark: SparkSession, d: str) -> DataFrame:
    """A zipped layer for each nation and block of 1000 suppliers, written by tasks and read back: one square, two, one with a hole, none."""
    from rillwork.operators.registers import inside
    from rillwork.sources import shapefile

    def archive(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        square = lambda x, y, w: [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]
        kinds = ([square(0, 0, 4)], [square(1, 1, 2), square(8, 8, 1)], [square(0, 0, 4), square(1, 1, 2)[::-1]], [])
        keys = pdf["s_suppkey"].tolist()
        about = [{"id": f"P{k}", "Owner": "Govt land" if k % 2 == 0 else "A. Shinde"} for k in keys]
        data = shapefile.archive_of([kinds[k % 4] for k in keys], about, 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],UNIT["Degree",0.0174532925199433]]')
        return pd.DataFrame({"source": [f"{pdf['s_nationkey'].iloc[0]}"], "content": [data]})

    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.floor(F.col("s_suppkey") / 1000).alias("block"))
    p = shapefile.parcel_features(shapefile.from_archives(s.groupBy("s_nationkey", "block").applyInPandas(archive, "source string, content binary")))
    at = lambda x, y: F.coalesce(inside(F.lit(x), F.lit(y), F.col("ring")), F.lit(False))
    return p.select("own_id", F.size("ring").alias("points"), "skipped", "public", at(0.5, 0.4).alias("edge"), at(2.1, 2.0).alias("middle"))
