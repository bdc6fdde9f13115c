"""Queries of names and registers on nations, customers, parts and suppliers, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import names
from rillwork.operators import registers
from rillwork.plans.views import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def fold_sql(x: str) -> str:
    """RE2 has no back-references: doubled consonants go letter by letter."""
    out = f"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', '', 'g')"
    for pattern, repl in names.FOLDS:
        if "\\1+" in pattern:
            for c in "bcdfghjklmnpqrstvy":
                out = f"regexp_replace({out}, '{c}{c}+', '{c}', 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '{repl}', 'g')"
    return out


WORDS = "words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"
WORDS_OF_DOCS = r"w AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents)"


@query("f01_folded_names", f"WITH {WORDS}, n AS (SELECT w FROM words UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer) SELECT w AS name, {fold_sql('w')} AS folded FROM n")
def _f01(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    n = w.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"))).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name"))).distinct()
    return n.select("name", names.folded(F.col("name")).alias("folded"))


@query("f04_strip_marks", rf"WITH {WORDS_OF_DOCS} SELECT count(*) AS words, count(DISTINCT strip_accents(w)) AS stripped, count(*) FILTER (WHERE strip_accents(w) <> w) AS changed FROM w WHERE regexp_matches(w, '^[A-Za-zÀ-ÿ]+$')")
def _f04(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w")).distinct().where(F.col("w").rlike("^[A-Za-zÀ-ÿ]+$"))
    return w.withColumn("s", names.without_marks(F.col("w"))).agg(F.count(F.lit(1)).alias("words"), F.count_distinct("s").alias("stripped"), F.count_if(F.col("s") != F.col("w")).alias("changed"))


TRI = "CASE WHEN f = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length(f) + 2), lambda i: substr('  ' || f || ' ', i, 3))) END"


@query("j06_fuzzy_join", f"WITH {WORDS}, n AS (SELECT w, {fold_sql('w')} AS f FROM words), t AS (SELECT w, {TRI} AS t FROM n) SELECT a.w AS l_id, b.w AS r_id, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS sim FROM t a JOIN t b ON len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.3")
def _j06(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().withColumn("f", names.folded(F.col("w")))
    got = registers.fuzzy_pairs(w.select(F.col("w").alias("l_id"), F.col("f").alias("l_name")), w.select(F.col("w").alias("r_id"), F.col("f").alias("r_name")))
    return got.select("l_id", "r_id", F.round("sim", 6).alias("sim"))


@query(
    "k01_name_index",
    f"""WITH {WORDS}, reg AS (SELECT w FROM words UNION SELECT n_name FROM nation UNION SELECT c_mktsegment FROM customer), n AS (SELECT w, {fold_sql('w')} AS f FROM reg), t AS (SELECT w, {TRI} AS t FROM n),
q AS (SELECT DISTINCT c_mktsegment AS s FROM customer UNION SELECT r_name FROM region), h AS (SELECT a.w AS s, b.w AS id, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS sim FROM t a JOIN q ON q.s = a.w JOIN t b ON true)
SELECT c_custkey AS query_id, id, round(sim, 6) AS sim FROM customer JOIN h ON h.s = c_mktsegment WHERE sim >= 0.3""",
)
def _index(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's segment searched at once in an index of two segments: the words of parts' names, and nations and segments."""
    from rillwork.operators import flow, name_index

    flow.shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/names-{uuid.uuid4().hex}"
    folded = lambda x: x.select(F.col("w").alias("id"), names.folded(F.col("w")).alias("folded"))
    c = table(spark, d, "customer")
    name_index.append(folded(table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()), path)
    name_index.append(folded(table(spark, d, "nation").select(F.col("n_name").alias("w")).union(c.select("c_mktsegment")).distinct()), path)
    # spellings are folded and searched once each, not once a customer
    asked = c.select(F.col("c_mktsegment").alias("w")).distinct()
    hits = name_index.search(spark, path, asked.select(F.col("w").alias("query_id"), names.folded(F.col("w")).alias("folded"))).select(F.col("query_id").alias("c_mktsegment"), "id", F.round("sim", 6).alias("sim"))
    return c.select("c_custkey", "c_mktsegment").join(hits, "c_mktsegment").select(F.col("c_custkey").alias("query_id"), "id", "sim")


@query("f06_name_similarity", f"WITH n AS (SELECT n_name, r_name, {fold_sql('n_name')} AS f, {fold_sql('r_name')} AS g FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT n_name, {TRI} AS a, {TRI.replace('f =', 'g =').replace('(f)', '(g)').replace('|| f ||', '|| g ||')} AS b FROM n) SELECT n_name, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS sim FROM t")
def _f06(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumns({"f": names.folded(F.col("n_name")), "g": names.folded(F.col("r_name"))})
    return n.select("n_name", F.round(names.similarity(names.trigrams(F.col("f")), names.trigrams(F.col("g"))), 6).alias("sim"))


AREAS = "areas AS (SELECT row_number() OVER (ORDER BY r_name, n_name, seg)::BIGINT AS area_id, r_name AS state, n_name AS district, seg AS sub FROM (SELECT DISTINCT r_name, n_name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 3 = 0))"
PLACES = "places AS (SELECT c_custkey AS place_id, r_name AS state, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE n_name END AS district, CASE WHEN c_custkey % 2 = 0 THEN replace(c_mktsegment, 'I', 'II') ELSE c_mktsegment END AS sub FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _areas_places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = c.where("c_custkey % 3 = 0").select("r_name", "n_name", "c_mktsegment").distinct()
    # a few hundred distinct areas at most, so one task can number them
    areas = a.select(F.row_number().over(Window.orderBy("r_name", "n_name", "c_mktsegment")).cast("long").alias("area_id"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("sub"))
    sub = F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace("c_mktsegment", "I", "II")).otherwise(F.col("c_mktsegment"))
    places = c.select(F.col("c_custkey").alias("place_id"), F.col("r_name").alias("state"), F.when(F.col("c_custkey") % 4 == 0, "moved").otherwise(F.col("n_name")).alias("district"), sub.alias("sub"))
    return areas, places


def _j10_sql() -> str:
    def norm(alias: str, c: str, k: str) -> str:
        return f"lower(trim({alias}.{c}))" if k == "x" else fold_sql(f"{alias}.{c}")

    ctes, joins = [], []
    for n, (k, up) in enumerate([(k, up) for up in ("district", "state", None) for k in "xf"], 1):
        cols = ["sub"] + ([up] if up else [])
        keys = ", ".join(f"{norm('areas', c, k)} AS k{i}" for i, c in enumerate(cols))
        ctes.append(f"m{n} AS (SELECT {keys}, min(area_id) AS id FROM areas GROUP BY {', '.join(f'k{i}' for i in range(len(cols)))} HAVING count(*) = 1)")
        joins.append(f"LEFT JOIN m{n} ON " + " AND ".join(f"m{n}.k{i} = {norm('places', c, k)}" for i, c in enumerate(cols)))
    by = " ".join(f"WHEN m{n}.id IS NOT NULL THEN {n}" for n in range(1, 7))
    return f"WITH {AREAS}, {PLACES}, {', '.join(ctes)} SELECT place_id, coalesce({', '.join(f'm{n}.id' for n in range(1, 7))}, -1) AS area_id, coalesce(CASE {by} END, 0) AS by FROM places {' '.join(joins)}"


@query("j10_link_places", _j10_sql())
def _j10(spark: SparkSession, d: str) -> DataFrame:
    areas, places = _areas_places(spark, d)
    return registers.link_places(places, areas).select("place_id", F.coalesce("area_id", F.lit(-1)).alias("area_id"), F.coalesce("by", F.lit(0)).alias("by"))


@query("k08_unmatched_top", "SELECT sub, count(*) AS count FROM (" + _j10_sql().replace("SELECT place_id, coalesce(m1.id", "SELECT places.sub AS sub, coalesce(m1.id") + ") WHERE area_id = -1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _k08(spark: SparkSession, d: str) -> DataFrame:
    areas, places = _areas_places(spark, d)
    return registers.unmatched_top(registers.link_places(places, areas), places)


REGISTER = f"reg AS (SELECT c_custkey AS id, c_mktsegment AS name, {fold_sql('c_mktsegment')} AS f, r_name AS state, n_name AS district, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 's' || (c_custkey % 7) END AS subdistrict FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(
    "k01_place_search",
    f"""WITH {REGISTER}, t AS (SELECT *, {TRI} AS t, list_distinct(list_transform(range(1, 10), lambda i: substr('  househol ', i, 3))) AS q FROM reg),
s AS (SELECT *, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) AS sim, f = 'househol' AS ex, starts_with(f, 'househol') AS pre FROM t)
SELECT id, name, CASE WHEN lower(trim(name)) = 'house-hol' THEN 'exact' WHEN ex THEN 'folded' WHEN pre THEN 'prefix' ELSE 'trigram' END AS match, round(sim, 6) AS sim FROM s WHERE ex OR pre OR sim >= 0.3 ORDER BY ex DESC, pre DESC, sim DESC, state NULLS LAST, district NULLS LAST, subdistrict NULLS LAST, id LIMIT 50""",
)
def _k01(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sub = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("s"), F.col("c_custkey") % 7))
    reg = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), names.folded(F.col("c_mktsegment")).alias("folded"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), sub.alias("subdistrict"))
    return registers.search(reg, "House-hol", limit=50).select("id", "name", "match", F.round("sim", 6).alias("sim"))


@query("j07_point_in_area", """WITH p AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings), a AS (SELECT n_nationkey AS area_id, (n_nationkey % 5 - 2.5)::DOUBLE AS x0, (n_nationkey // 5 - 2.5)::DOUBLE AS y0, (1 + n_nationkey % 3 * 0.5)::DOUBLE AS side FROM nation),
h AS (SELECT point_id, arg_min(area_id, (side * 1000 + area_id)) AS area_id FROM p JOIN a ON x >= x0 AND x < x0 + side AND y >= y0 AND y < y0 + side GROUP BY 1) SELECT p.point_id, coalesce(h.area_id, -1) AS area_id FROM p LEFT JOIN h USING (point_id)""")
def _j07(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"))
    k = F.col("n_nationkey")
    x0, y0, s = k % 5 - 2.5, F.floor(k / 5) - 2.5, 1 + k % 3 * 0.5
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    areas = table(spark, d, "nation").select(k.alias("area_id"), F.array(pt(x0, y0), pt(x0 + s, y0), pt(x0 + s, y0 + s), pt(x0, y0 + s)).alias("ring"), (s * s).alias("size"))
    return registers.containing(p, areas).select("point_id", F.coalesce("area_id", F.lit(-1)).alias("area_id"))


@query("j08_parent_chain", "SELECT c_custkey AS area_id, c_name AS name, n_name AS district, r_name AS state FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _j08(spark: SparkSession, d: str) -> DataFrame:
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, d, "customer").select(k("c", "c_custkey").alias("area_id"), F.col("c_name").alias("name"), k("n", "c_nationkey").alias("parent_id"))
    a = a.unionByName(table(spark, d, "nation").select(k("n", "n_nationkey").alias("area_id"), F.col("n_name").alias("name"), k("r", "n_regionkey").alias("parent_id")))
    a = a.unionByName(table(spark, d, "region").select(k("r", "r_regionkey").alias("area_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id")))
    return registers.with_parents(a).where(F.col("area_id").startswith("c")).select(F.substring("area_id", 2, 20).cast("long").alias("area_id"), "name", "district", "state")


@query("a21_panchayat_lists", "SELECT l_partkey AS village_id, string_agg(s_name || ':' || s_suppkey, ',' ORDER BY s_name, s_suppkey) AS panchayats FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def _a21(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    got = registers.panchayat_lists(li.select(F.col("l_partkey").alias("village_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("code")))
    return got.select("village_id", F.array_join(F.transform("panchayats", lambda p: F.concat_ws(":", p["name"], p["code"].cast("string"))), ",").alias("panchayats"))


@query("a22_link_stats", "SELECT count(*) AS links, count(DISTINCT l_partkey) AS villages, count(*) FILTER (WHERE n > 1) AS shared FROM (SELECT l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))")
def _a22(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("village_id"), "l_suppkey").distinct()
    return registers.link_stats(li)


@query("j11_new_links", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'R')")
def _j11(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return registers.new_links(li.select("l_partkey", "l_suppkey"), li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@query("snk08_upsert", "WITH o AS (SELECT o_custkey AS k, max_by(o_totalprice, (o_orderkey)) AS v FROM orders GROUP BY 1) SELECT c_custkey AS k, round(coalesce(v, c_acctbal), 2) AS v FROM customer LEFT JOIN o ON k = c_custkey UNION ALL SELECT k, round(v, 2) FROM o WHERE k NOT IN (SELECT c_custkey FROM customer)")
def _snk08(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("seq"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return registers.upsert(old, new, ["k"], "seq").select("k", F.round("v", 2).alias("v"))


@query("a25_first_per_code", "SELECT l_suppkey AS code, min_by(l_partkey, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000) AS village FROM lineitem GROUP BY 1")
def _a25(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey") % 10000)
    return registers.first_per_key(li, ["l_suppkey"], "seq").select(F.col("l_suppkey").alias("code"), F.col("l_partkey").alias("village"))


@query(
    "a23_orphans_by_level",
    """WITH a AS (SELECT 'r' || r_regionkey AS area_id, NULL AS parent_id, 'state' AS level FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'r99' ELSE 'r' || n_regionkey END, 'district' FROM nation
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'n' || (c_nationkey + 90) ELSE 'n' || c_nationkey END, 'subdistrict' FROM customer) SELECT level, count(*) AS orphans FROM a WHERE level <> 'state' AND parent_id NOT IN (SELECT area_id FROM a) GROUP BY 1""",
)
def _a23(spark: SparkSession, d: str) -> DataFrame:
    at = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    r = table(spark, d, "region").select(at("r", F.col("r_regionkey")).alias("area_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("state").alias("level"))
    n = table(spark, d, "nation").select(at("n", F.col("n_nationkey")).alias("area_id"), F.when(F.col("n_nationkey") % 6 == 0, "r99").otherwise(at("r", F.col("n_regionkey"))).alias("parent_id"), F.lit("district").alias("level"))
    c = table(spark, d, "customer").select(at("c", F.col("c_custkey")).alias("area_id"), at("n", F.col("c_nationkey") + F.when(F.col("c_custkey") % 5 == 0, 90).otherwise(0)).alias("parent_id"), F.lit("subdistrict").alias("level"))
    return registers.orphans_by_level(r.unionByName(n).unionByName(c))


@query(
    "j03_located_villages",
    """WITH l AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey ORDER BY l_suppkey::VARCHAR) AS p FROM lineitem GROUP BY 1)
SELECT p_partkey AS village_id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 1.0 WHEN p_partkey % 7 < 5 THEN 70.0 + p_partkey % 25 ELSE -1 END AS lon, CASE WHEN p_partkey % 3 = 0 THEN 'village' WHEN p_partkey % 7 >= 5 THEN 'none' WHEN p_partkey % 25 % 2 = 0 THEN 'district' ELSE 'subdistrict' END AS located,
 coalesce(len(p), 0) AS panchayats, coalesce(p[1], -1) AS first FROM part LEFT JOIN l ON k = p_partkey""",
)
def _j03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v = table(spark, d, "part").select(k.alias("village_id"), F.col("p_name").alias("name"), F.when(k % 7 < 5, k % 25).alias("area_id"), F.when(k % 3 == 0, F.col("p_size") * 1.0).alias("lon"), F.when(k % 3 == 0, 20.0).alias("lat"))
    n = F.col("n_nationkey")
    areas = table(spark, d, "nation").select(n.cast("int").alias("area_id"), F.when(n % 2 == 0, "district").otherwise("subdistrict").alias("level"), (70.0 + n).alias("lon"), F.lit(15.0).alias("lat"))
    s = F.col("l_suppkey").cast("string")
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("village_id"), s.alias("name"), s.alias("code")).distinct()
    r = registers.village_rows(v, areas, links)
    return r.select("village_id", F.coalesce("lon", F.lit(-1.0)).alias("lon"), "located", F.size("panchayats").alias("panchayats"), F.coalesce(F.try_element_at("panchayats", F.lit(1))["code"].cast("long"), F.lit(-1)).alias("first"))


@query("j09_hierarchy_by_place", "SELECT c_custkey AS area_id, c_nationkey AS parent_id FROM customer")
def _j09(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries as GeoJSON geometries: each a square with a hole, and a second square where the points are."""
    from rillwork.sources import services

    n = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("[[[["), n, F.lit(",0],["), n, F.lit(".9,0],["), n, F.lit(".9,1],["), n, F.lit(",1],["), n, F.lit(",0]],[["), n, F.lit(".2,0.2],["), n, F.lit(".4,0.2],["), n, F.lit(".4,0.4],["), n, F.lit(".2,0.2]]],[[["), n, F.lit(",5],["), n, F.lit(".9,5],["), n, F.lit(".9,6],["), n, F.lit(",5]]]]"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), text.alias("coordinates"))
    parents = table(spark, d, "nation").select(F.col("n_nationkey").alias("area_id"), services.joined_rings(services.rings(geometry)).alias("ring"), F.lit(1.0).alias("size"))
    kids = table(spark, d, "customer").select(F.col("c_custkey").alias("area_id"), (F.col("c_nationkey") + 0.61 + F.col("c_custkey") % 10 / 50.0).alias("x"), F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(5.1 + F.col("c_custkey") % 5 / 10.0).alias("y"))
    return registers.link_hierarchy(kids, parents, 0.5)


@query("j17_filter_spelling", "SELECT n_nationkey AS id, n_name AS spelled FROM nation")
def _j17(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    typed = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit(" "), F.lower("n_name"), F.lit(".")).alias("typed"))
    return registers.resolved(n.select(F.col("n_name").alias("v")), typed).select("id", F.col("value").alias("spelled"))


@query("f08_display_hierarchy", "SELECT c_custkey AS id, 'Area, ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS shown FROM customer")
def _f08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.display_hierarchy(F.array(F.lit("area"), F.lit("AREA"), F.lit(" "), F.col("c_mktsegment"), F.lower("c_mktsegment"))).alias("shown"))
