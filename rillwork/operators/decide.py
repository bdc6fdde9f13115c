"""Weights, scores, choices and comparisons of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elicited priorities, and Saaty's random index by matrix size.
PRIORITIES = {"flow_accumulation": 0.21, "slope": 0.18, "depression_depth": 0.14, "soil_runoff_potential": 0.13, "land_availability": 0.12, "distance_to_stream": 0.08, "plan_concavity": 0.08, "distance_to_settlement": 0.06, "distance_to_waterbody": 0.05}
RANDOM_INDEX = (0, 0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49, 1.51, 1.48, 1.56, 1.57, 1.59)
CONSISTENCY_LIMIT, UNIFORM_PCT, NARROW_MARGIN, LOW_CAPTURE_PCT = 0.10, 1.0, 3.0, 5.0
TERRAIN = ("flow_accumulation", "slope", "depression_depth", "plan_concavity")


def weights_for(names: tuple[str, ...], override: dict[str, float] | None = None) -> dict[str, float]:
    """D-01: the priorities, or a caller's weights, of the criteria in use, made to sum to one."""
    source = PRIORITIES if override is None else override
    if missing := [n for n in names if n not in source]:
        raise ValueError(f"no weight for {missing}")
    part = {n: float(source[n]) for n in names}
    if min(part.values()) < 0 or sum(part.values()) <= 0:
        raise ValueError("weights must not be negative, nor all zero")
    return {n: w / sum(part.values()) for n, w in part.items()}


def weights_from(requests: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """X-35, U-02: requests(id, weights: JSON object of criterion to weight, or null) -> id, weights map made to sum to one, problem: not an object of numbers, an unknown criterion, a negative one, all zero. Null
    takes the priorities; criteria in use that aren't named count 0."""
    got = F.from_json("weights", "map<string,double>")
    unknown = F.array_sort(F.filter(F.map_keys("w"), lambda k: ~k.isin(*names)))
    sums = F.aggregate(F.map_values("w"), F.lit(0.0), lambda s, v: s + v)
    default = F.create_map(*[F.lit(x) for kv in weights_for(names).items() for x in kv])
    bad = F.col("weights").isNotNull() & (F.col("w").isNull() | (F.size("w") == 0) | F.exists(F.map_values("w"), lambda v: v.isNull()))
    d = requests.withColumn("w", got)
    why = F.when(bad, "not numbers by criterion").when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))).when(F.exists(F.map_values("w"), lambda v: v < 0), "negative").when(sums <= 0, "all zero")
    made = F.map_from_entries(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct(n, F.coalesce(F.try_element_at("w", n), F.lit(0.0)) / sums)))
    return d.withColumn("problem", F.when(F.col("weights").isNotNull(), why)).select("id", F.when(F.col("weights").isNull(), default).when(F.col("problem").isNull(), made).alias("weights"), "problem")


def ahp(matrices: DataFrame, rounds: int = 60) -> DataFrame:
    """D-06, X-14: matrices(id, m array<array<double>>) -> weights (principal eigenvector, by power iteration), row_mean, lambda_max, ci, cr, consistent (cr below the limit)."""
    n = F.size("m")
    start = F.transform("m", lambda _: F.lit(1.0) / n)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def turn(w: Column, _: Column) -> Column:
        # a one-element transform names the product, so that it is worked out once
        return F.element_at(F.transform(F.array(F.transform("m", lambda r: dot(r, w))), lambda v: F.transform(v, lambda x: x / total(v))), 1)

    d = matrices.withColumn("weights", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn))
    ratio = F.zip_with(F.transform("m", lambda r: dot(r, F.col("weights"))), "weights", lambda a, w: a / w)
    d = d.withColumn("lambda_max", total(ratio) / n)
    means = F.transform("m", lambda r: F.exp(F.aggregate(r, F.lit(0.0), lambda s, x: s + F.ln(x)) / n))
    d = d.withColumn("row_mean", F.transform(means, lambda x: x / total(means)))
    d = d.withColumn("ci", F.when(n > 1, (F.col("lambda_max") - n) / (n - 1)).otherwise(0.0))
    ri = F.element_at(F.array(*[F.lit(float(x)) for x in RANDOM_INDEX]), n)
    d = d.withColumn("cr", F.when(ri > 0, F.col("ci") / ri).otherwise(0.0))
    return d.withColumn("consistent", F.col("cr") < CONSISTENCY_LIMIT)


def saaty(ratio: Column) -> Column:
    """M-24: the value of 1/9 .. 1 .. 9 nearest in logs; the smaller of equals."""
    scale = F.array(*[F.lit(x) for x in [1.0 / k for k in range(9, 1, -1)] + [float(k) for k in range(1, 10)]])
    return F.array_min(F.transform(scale, lambda v: F.struct(F.abs(F.ln(v) - F.ln(ratio)).alias("d"), v.alias("v"))))["v"]


def matrix_of(weights: Column) -> Column:
    """M-24, D-23: a reciprocal Saaty matrix that weights would have come from."""
    return F.transform(weights, lambda a, i: F.transform(weights, lambda b, j: F.when(i == j, 1.0).when(i < j, saaty(a / b)).otherwise(1 / saaty(b / a))))


def weighted_score(layers: dict[str, Column], feasible: Column, override: dict[str, float] | None = None) -> Column:
    """D-02: the weighted sum of layers (0..1) where feasible, else 0."""
    score = F.lit(0.0)
    for name, w in weights_for(tuple(layers), override).items():
        score = score + w * layers[name]
    return F.when(feasible, score).otherwise(0.0)


def score_candidates(regions: DataFrame, by: str = "grid_id", override: dict[str, float] | None = None) -> DataFrame:
    """D-03, D-18: regions(acc, slope_pct, depth_m, concavity, availability) of one run scored against each other, 0..100, with criteria array<struct<criterion, contribution>> that add up to it; availability counts as it is, and only where it is given."""
    from rillwork.operators import terrain

    made = regions.withColumns({"__a": F.log1p(F.col("acc").cast("double")), "__s": F.col("slope_pct").cast("double"), "__d": F.least(F.col("depth_m").cast("double"), F.lit(3.0)), "__c": F.col("concavity").cast("double")})
    p = lambda c: F.percentile(c, F.array(F.lit(0.02), F.lit(0.98)))
    b = made.groupBy(by).agg(*[p(c).alias("b" + c) for c in ("__a", "__s", "__d", "__c")])
    j = made.join(b, by)
    n = lambda c, inv=False: terrain.normalised(F.col(c), F.col("b" + c)[0], F.col("b" + c)[1], inv)
    layers = {"flow_accumulation": n("__a"), "slope": n("__s", True), "depression_depth": n("__d"), "plan_concavity": n("__c")}
    plain = weighted_score(layers, F.lit(True), override)
    full = weighted_score(layers | {"land_availability": F.col("availability").cast("double")}, F.lit(True), override) if "availability" in regions.columns else plain
    score = F.when(F.col("availability").isNotNull(), full).otherwise(plain) if "availability" in regions.columns else plain
    parts = lambda layers: F.array(*[F.struct(F.lit(k).alias("criterion"), (100 * w * layers[k]).alias("contribution")) for k, w in weights_for(tuple(layers), override).items()])
    criteria = parts(layers)
    if "availability" in regions.columns:
        criteria = F.when(F.col("availability").isNotNull(), parts(layers | {"land_availability": F.col("availability").cast("double")})).otherwise(criteria)
    return j.withColumns({"score": 100 * score, "criteria": criteria}).drop(*["__a", "__s", "__d", "__c"], *["b" + c for c in ("__a", "__s", "__d", "__c")])


def spaced_best(sites: DataFrame, separation: float, most: int = 5, by: str = "grid_id") -> DataFrame:
    """K-02: of each group the best sites (site_id, x, y, score), each at least the separation from better ones: a fold over the group's candidates, which siting keeps few. rank from 1."""
    best = F.sort_array(F.collect_list(F.struct("score", (-F.col("site_id")).alias("k"), "x", "y")), asc=False)
    kind = "array<struct<score:double,k:long,x:double,y:double>>"

    def take(kept: Column, s: Column) -> Column:
        near = F.exists(kept, lambda k: F.hypot(k["x"] - s["x"], k["y"] - s["y"]) < separation)
        return F.when((F.size(kept) < most) & ~near, F.concat(kept, F.array(s))).otherwise(kept)

    g = sites.select(by, F.col("site_id").cast("long").alias("site_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("score").cast("double").alias("score")).groupBy(by).agg(best.alias("all"))
    kept = g.select(by, F.posexplode(F.aggregate("all", F.array().cast(kind), take)).alias("rank", "s"))
    return kept.select(by, (-F.col("s.k")).alias("site_id"), (F.col("rank") + 1).alias("rank"), F.col("s.score").alias("score"))


#: D-22, U-04: metric -> (label, larger is better, unit), in the order of reading. Values come as columns of that name.
METRICS = {
    "suitability_score": ("Suitability score", True, "/100"),
    "catchment_area_ha": ("Catchment area", True, "ha"),
    "annual_runoff_m3": ("Annual runoff", True, "m3"),
    "gross_capacity_m3": ("Pond capacity", True, "m3"),
    "live_storage_m3": ("Live storage", True, "m3"),
    "capture_fraction_pct": ("Share of yield held", True, "%"),
    "estimated_cost_inr": ("Indicative cost", False, "INR"),
    "cost_per_live_m3": ("Cost per m3 of live storage", False, "INR/m3"),
    "months_with_water": ("Months holding water", True, "months"),
}


def compare(sites: DataFrame, by: str = "job_id") -> DataFrame:
    """A-26, D-18: sites(job_id, rank, metrics...) -> by metric: lowest, highest, spread_pct (of the lowest, where that is above 0), uniform (two values or more that hardly differ), best_rank (null where uniform; the lowest rank of equals)."""
    present = [m for m in METRICS if m in sites.columns]
    parts = ", ".join(f"'{m}', {'true' if METRICS[m][1] else 'false'}, CAST(`{m}` AS double)" for m in present)
    long = sites.selectExpr(by, "rank", f"stack({len(present)}, {parts}) AS (metric, up, value)").where("value is not null")
    signed = F.when(F.col("up"), -F.col("value")).otherwise(F.col("value"))
    g = long.groupBy(by, "metric").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.min_by("rank", F.struct(signed, "rank")).alias("best"))
    g = g.withColumn("spread_pct", F.when(F.col("lowest") > 0, 100 * (F.col("highest") - F.col("lowest")) / F.col("lowest")))
    near = (F.col("highest") - F.col("lowest") < 1e-9) | F.coalesce(F.col("spread_pct") < UNIFORM_PCT, F.lit(False))
    g = g.withColumn("uniform", (F.col("n") > 1) & near)
    return g.withColumn("best_rank", F.when(~F.col("uniform"), F.col("best"))).drop("best", "n")


def wins(compared: DataFrame, by: str = "job_id") -> DataFrame:
    return compared.where("best_rank is not null").groupBy(by, F.col("best_rank").alias("rank")).agg(F.count(F.lit(1)).alias("wins"))


def margins(ranked: DataFrame, by: str = "job_id") -> DataFrame:
    """W-08: the best site's lead over the next, and whether it is narrow."""
    lead = F.col("score") - F.lead("score").over(Window.partitionBy(by).orderBy("rank"))
    return ranked.withColumn("margin", lead).where("rank = 1").select(by, "margin", (F.col("margin") < NARROW_MARGIN).alias("narrow"))


def top_criteria(criteria: Column, n: int = 2) -> Column:
    """K-04: names of the largest contributions of array<struct<criterion, contribution>>, ties in the order given."""
    keyed = F.transform(criteria, lambda c, i: F.struct((-c["contribution"]).alias("v"), i.alias("i"), c["criterion"].alias("name")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda c: c["name"])


def explanation(rank: Column, kind: Column, score: Column, top: Column, margin: Column, limited_by: Column) -> Column:
    """D-19: a deterministic sentence; parts that are not known are left out."""
    parts = F.array(
        F.concat(F.lit("Rank "), rank.cast("string"), F.lit(", score "), F.format_number(score, 1)),
        F.when(kind == "natural_depression", F.lit("it stands in a natural depression")).when(kind == "channel_position", F.lit("it stands on a drainage line")),
        F.when(F.size(top) > 0, F.concat(F.lit("chiefly for "), F.array_join(F.transform(top, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), " and "))),
        F.when(margin < NARROW_MARGIN, F.lit("the next site is close behind")),
        F.when(limited_by.isNotNull(), F.concat(F.lit("its water is limited by the "), limited_by)),
    )
    return F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; "), F.lit("."))


def confidence(touches_edge: Column, relief_m: Column) -> Column:
    """P-24."""
    return F.when(touches_edge, "low").when(relief_m < 5, "medium").when(relief_m.isNotNull(), "high")


def tier(has_cover: Column, has_soil: Column) -> Column:
    """D-13: full only with both; without soil cover is still used, but the tier says so."""
    return F.when(has_cover & has_soil, "full").when(has_cover | has_soil, "no_soil_lulc").otherwise("terrain_only")


def job_progress(steps: DataFrame) -> DataFrame:
    """ST-02: steps(job_id, step, weight, required, state), weights summing to 1 -> pct done by weight (skipped and failed count as done; 99 at most until it is settled) and the settled state: a required failure fails, an optional one leaves it partial."""
    ended = F.col("state").isin("done", "skipped", "failed")
    g = steps.groupBy("job_id").agg(
        (100 * F.sum(F.when(ended, F.col("weight")).otherwise(0.0))).alias("earned"),
        F.bool_and(ended).alias("ended"),
        F.bool_or((F.col("state") == "failed") & F.col("required")).alias("bad"),
        F.bool_or((F.col("state") == "failed") & ~F.col("required")).alias("some"),
    )
    state = F.when(F.col("bad"), "failed").when(~F.col("ended"), "running").when(F.col("some"), "partial").otherwise("done")
    pct = F.when(state.isin("done", "partial"), 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), F.rint(F.round("earned", 6)).cast("int"))))
    return g.select("job_id", pct.alias("pct"), state.alias("state"))
