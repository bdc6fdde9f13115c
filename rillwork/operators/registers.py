"""Registers of places: linking by names, fuzzy search, points in polygons, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions import geo, names

MIN_SIMILARITY, PREFIX_CHARS, DEFAULT_HITS, MOST_HITS, STRONG = 0.3, 3, 10, 50, 0.9


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """SNK-08, SNK-10, A-25: new rows replace old ones of the same key; of several new rows the last by seq wins. Columns are those of old."""
    cols = old.columns
    order = [F.desc("__new")] + ([F.desc(seq)] if seq else [])
    all_ = old.select(*cols, F.lit(0).alias("__new")).unionByName(new.select(*cols, F.lit(1).alias("__new")))
    return all_.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *[c for c in cols if c not in keys and c != seq]))).where("__k = 1").select(*cols)


def first_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A-25: the first row of each key by seq."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("__k = 1").drop("__k")


def link_places(places: DataFrame, areas: DataFrame) -> DataFrame:
    """J-10: places(place_id, state, district, sub) to areas(area_id, state, district, sub) by the first of six keys that names one area only.

    Exact before folded: district and sub, state and sub, sub alone. An ambiguous key never matches. Result: place_id, area_id (null if none), by (1 to 6).
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    both = {"x": clean, "f": names.folded}
    levels = [(k, up) for up in ("district", "state", None) for k in "xf"]
    p = places.select("place_id", *[f(F.col(c)).alias(f"{c}_{k}") for k, f in both.items() for c in ("state", "district", "sub")])
    a = areas.select("area_id", *[f(F.col(c)).alias(f"{c}_{k}") for k, f in both.items() for c in ("state", "district", "sub")])
    for n, (k, up) in enumerate(levels, 1):
        on = [f"sub_{k}"] + ([f"{up}_{k}"] if up else [])
        known = a.where(F.col(on[-1]) != "") if up else a
        one = known.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("area_id").alias(f"m{n}")).where("n = 1").drop("n")
        p = p.join(one, on, "left")
    found = F.coalesce(*[F.col(f"m{n}") for n in range(1, 7)])
    by = F.coalesce(*[F.when(F.col(f"m{n}").isNotNull(), n) for n in range(1, 7)])
    return p.select("place_id", found.alias("area_id"), by.alias("by"))


def unmatched_top(links: DataFrame, places: DataFrame, n: int = 10) -> DataFrame:
    """K-08: the names that most places without a link have; a report of n rows."""
    gone = links.where("area_id is null").select("place_id")
    return places.join(gone, "place_id", "left_semi").groupBy("sub").count().orderBy(F.desc("count"), "sub").limit(n)


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """J-06: left(l_id, l_name), right(r_id, r_name), folded -> l_id, r_id, sim.

    Prefix filtering: with each name's trigrams in order of rarity, two names of similarity `least` or more share one of the first n - ceil(least n) + 1 of either, and their sizes are within that ratio. So the
    commonest trigrams are never joined on, and no pair is lost; candidates are compared in full. Names are joined once each, so that equal names don't multiply.
    """
    grams = lambda d, c: d.select(F.col(c).alias("name")).distinct().select("name", names.trigrams(F.col("name")).alias("t")).where("size(t) > 0")
    ln, rn = grams(left, "l_name"), grams(right, "r_name")
    often = ln.unionByName(rn).select(F.explode("t").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("often"))

    def prefix(d: DataFrame, side: str) -> DataFrame:
        ranked = d.select("name", F.explode("t").alias("g")).join(often, "g").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("t"))
        n = F.size("t")
        return ranked.select(F.col("name").alias(side + "_name"), F.transform("t", lambda x: x["g"]).alias(side + "t"), F.explode(F.slice("t", 1, (n - F.ceil(least * n - 1e-9) + 1).cast("int"))).alias("p")).select(side + "_name", side + "t", F.col("p.g").alias("g"))

    near = (F.size("lt") * least <= F.size("rt") + 1e-9) & (F.size("rt") * least <= F.size("lt") + 1e-9)
    met = prefix(ln, "l").join(prefix(rn, "r"), "g").where(near).dropDuplicates(["l_name", "r_name"])
    sim = met.select("l_name", "r_name", names.similarity(F.col("lt"), F.col("rt")).alias("sim")).where(F.col("sim") >= least)
    return left.join(sim, "l_name").join(right, "r_name").select("l_id", "r_id", "sim")


def search(register: DataFrame, query: str, state: str | None = None, district: str | None = None, limit: int = DEFAULT_HITS) -> DataFrame:
    """K-01, P-21..P-23, A-29: register(id, name, folded, state, district, subdistrict, lon, lat) -> hits in order: exact, prefix, similarity, then hierarchy with nulls last, then id.

    match: exact (as written), folded, prefix or trigram. ambiguous: another hit has the same hierarchy. limit is the number of hits that the caller asks for.
    """
    q = names.fold(query)
    if not q:
        return register.limit(0).select("id", "name", "state", "district", "subdistrict", F.lit("").alias("match"), F.lit(0.0).alias("sim"), F.lit(False).alias("ambiguous"))
    f, sim = F.col("folded"), names.similarity(names.trigrams(F.col("folded")), names.trigrams(F.lit(q)))
    rows = register.withColumn("sim", sim).withColumn("is_exact", f == q).withColumn("is_prefix", f.startswith(q) if len(q) >= PREFIX_CHARS else F.lit(False))
    for col, value in (("state", state), ("district", district)):
        if value is not None:
            rows = rows.where(names.folded(F.col(col)) == names.fold(value))
    rows = rows.where(F.col("is_exact") | F.col("is_prefix") | (F.col("sim") >= MIN_SIMILARITY))
    match = F.when(F.lower(F.trim("name")) == query.strip().lower(), "exact").when(F.col("is_exact"), "folded").when(F.col("is_prefix"), "prefix").otherwise("trigram")
    top = rows.orderBy(F.desc("is_exact"), F.desc("is_prefix"), F.desc("sim"), F.asc_nulls_last("state"), F.asc_nulls_last("district"), F.asc_nulls_last("subdistrict"), "id").limit(max(1, min(limit, MOST_HITS)))
    twins = F.count(F.lit(1)).over(Window.partitionBy(names.display_hierarchy(F.array("name", "subdistrict", "district", "state"))))
    return top.withColumn("match", match).withColumn("ambiguous", twins > 1).select("id", "name", "state", "district", "subdistrict", "match", "sim", "ambiguous")


def containing(points: DataFrame, areas: DataFrame, bucket: float = 1.0) -> DataFrame:
    """J-07, K-06, J-12: points(point_id, x, y), areas(area_id, ring array<struct<x,y>>, size) -> the smallest area around each point, null if none.

    Of areas with the same ring only the smallest can be the answer, so the others are left out first: a point meets each different ring once, however many copies a layer holds.
    Both sides meet in square buckets (an area in each that its box touches), then the box and the ring decide, the ring by crossing edges. Points on an edge may fall on either side.
    """
    b = F.lit(float(bucket))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    once = areas.groupBy("ring").agg(F.min(F.struct("size", "area_id")).alias("m")).select("ring", "m.*")
    boxed = once.withColumns({"west": F.array_min(xs), "east": F.array_max(xs), "south": F.array_min(ys), "north": F.array_max(ys)})
    boxed = boxed.withColumn("bx", F.explode(F.sequence(F.floor(F.col("west") / b), F.floor(F.col("east") / b)))).withColumn("by", F.explode(F.sequence(F.floor(F.col("south") / b), F.floor(F.col("north") / b))))
    p = points.select("point_id", "x", "y", F.floor(F.col("x") / b).alias("bx"), F.floor(F.col("y") / b).alias("by"))
    in_box = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
    hits = p.join(boxed, ["bx", "by"]).where(in_box & inside(F.col("x"), F.col("y"), F.col("ring")))
    best = hits.groupBy("point_id").agg(F.min(F.struct("size", "area_id")).alias("m")).select("point_id", F.col("m.area_id").alias("area_id"))
    return points.select("point_id").join(best, "point_id", "left")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; the ring closes by itself."""
    return odd_before(crossings(y, ring), x)


def crossings(y: Column, ring: Column) -> Column:
    """array<double>: where the ring's edges cross the line at y; edges with a missing end cross nothing."""

    def of(both: Column) -> Column:
        def crosses(p: Column, i: Column) -> Column:
            q = F.element_at(both["before"], i + 1)
            at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
            return F.when((p["y"] > y) != (q["y"] > y), at)

        return F.filter(F.transform(both["ring"], crosses), lambda at: at.isNotNull())

    # each is worked out once, not once an edge; place i + 1 of before holds the point before point i
    return geo.let(ring, lambda r: geo.let(F.struct(r.alias("ring"), F.concat(F.slice(r, -1, 1), r).alias("before")), of))


def odd_before(crossings: Column, x: Column) -> Column:
    """An odd number of crossings lies beyond x, so x is inside; null without a ring."""
    return F.array_size(F.filter(crossings, lambda at: x < at)) % 2 == 1


def with_parents(areas: DataFrame, levels: tuple[str, ...] = ("district", "state")) -> DataFrame:
    """J-08: areas(area_id, name, parent_id) with the names of parents up the chain, null where it ends."""
    out, at = areas.withColumn("__p", F.col("parent_id")), "__p"
    for level in levels:
        up = areas.select(F.col("area_id").alias("__id"), F.col("name").alias(level), F.col("parent_id").alias("__n"))
        out = out.join(up, out[at] == up["__id"], "left").drop("__id", at).withColumnRenamed("__n", at)
    return out.drop(at)


def link_hierarchy(children: DataFrame, parents: DataFrame, bucket: float = 1.0) -> DataFrame:
    """J-09: children(area_id, x, y: an inner point) -> area_id, parent_id by containment, one parent each."""
    got = containing(children.select(F.col("area_id").alias("point_id"), "x", "y"), parents, bucket)
    return got.select(F.col("point_id").alias("area_id"), F.col("area_id").alias("parent_id"))


def panchayat_lists(links: DataFrame) -> DataFrame:
    """A-21, J-04: links(village_id, name, code) -> village_id, panchayats by name and code."""
    return links.groupBy("village_id").agg(F.array_sort(F.collect_list(F.struct("name", "code"))).alias("panchayats"))


def village_rows(villages: DataFrame, areas: DataFrame, links: DataFrame) -> DataFrame:
    """J-03, J-04, X-25: villages(village_id, name, area_id, lon, lat), areas(area_id, level, lon, lat), links(village_id, name, code) -> villages with a place: their own, else their area's centre, and which
    (located: village, the area's level or none), and their panchayats in order."""
    a = areas.select("area_id", "level", F.col("lon").alias("__lon"), F.col("lat").alias("__lat"))
    d = villages.join(a, "area_id", "left").join(panchayat_lists(links), "village_id", "left")
    located = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), "village").when(F.col("__lon").isNotNull(), F.col("level")).otherwise("none")
    return d.select("village_id", "name", F.coalesce("lon", "__lon").alias("lon"), F.coalesce("lat", "__lat").alias("lat"), located.alias("located"), F.coalesce("panchayats", F.array().cast("array<struct<name:string,code:string>>")).alias("panchayats"))


def orphans_by_level(areas: DataFrame, top: str = "state") -> DataFrame:
    """A-23: level, orphans: areas below the top level whose parent isn't there."""
    have = areas.select(F.col("area_id").alias("parent_id")).distinct()
    return areas.where(F.col("level") != top).join(have, "parent_id", "left_anti").groupBy("level").agg(F.count(F.lit(1)).alias("orphans"))


def link_stats(links: DataFrame) -> DataFrame:
    """A-22, W-02: links, villages, villages' links where a village has several."""
    n = F.count(F.lit(1)).over(Window.partitionBy("village_id"))
    return links.withColumn("n", n).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("village_id").alias("villages"), F.count_if(F.col("n") > 1).alias("shared"))


def new_links(links: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """J-11: links not there yet, once each."""
    return links.dropDuplicates(keys).join(have.select(*keys), keys, "left_anti")


def resolve_filter(values: DataFrame, value: str) -> str:
    """J-17, X-26: the register's spelling of a filter (values: one distinct column), or the value itself."""
    hit = values.where(names.folded(F.col(values.columns[0])) == names.fold(value)).orderBy(values.columns[0]).limit(1).collect()
    return hit[0][0] if hit else value


def resolved(values: DataFrame, typed: DataFrame) -> DataFrame:
    """J-17 for many filters: values(v), distinct spellings; typed(id, typed) -> id, value: the register's first spelling of the same folded name, or what was typed."""
    first = values.select(names.folded(F.col("v")).alias("f"), "v").where("f <> ''").groupBy("f").agg(F.min("v").alias("v"))
    return typed.withColumn("f", names.folded(F.col("typed"))).join(first, "f", "left").select("id", F.coalesce("v", "typed").alias("value"))


def search_note(hits: DataFrame, unfiltered: DataFrame | None = None) -> DataFrame:
    """D-20: one row: why a search may be wrong: nothing found (or only outside the filters), or no strong match."""
    best = hits.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("match") == "trigram", F.col("sim")).otherwise(1.0)).alias("best"))
    other = (unfiltered if unfiltered is not None else hits.limit(0)).agg(F.count(F.lit(1)).alias("outside"))
    note = F.when((F.col("n") == 0) & (F.col("outside") > 0), "found only outside the filters").when(F.col("n") == 0, "nothing found").when(F.col("best") < STRONG, "no strong match")
    return best.crossJoin(F.broadcast(other)).select("n", "outside", note.alias("note"))  # one row each


def datum_operations(operations: DataFrame) -> DataFrame:
    """K-05, X-10: operations(source, operation, tier, ballpark, accuracy_m; tier 1 is for the area of interest) -> source, operation: of the first tier that has one the most accurate, unknown accuracy last, then by name;
    ballpark ones never. A source without any has null: it is refused."""
    best = operations.where(~F.col("ballpark")).groupBy("source").agg(F.min(F.struct("tier", F.col("accuracy_m").isNull().alias("unknown"), "accuracy_m", "operation")).alias("m"))
    return operations.select("source").distinct().join(best.select("source", F.col("m.operation").alias("operation")), "source", "left")
