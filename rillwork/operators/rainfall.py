"""Rainfall statistics of daily series: any number of series at once, one row a series in the end.

daily: series, observed_on (date), mm; further columns as named. A series is a source and cell, so a shuffle by series moves little more than
days; everything a series needs later is aggregated by year or month first (at most a few hundred rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions.hydro import COMPLETE_YEAR_DAYS, RAINY_DAY_MM

NOTABLE_SPREAD, MIN_COVERAGE = 0.20, 0.95


def annual_totals(daily: DataFrame, value: str = "mm", least_days: int = COMPLETE_YEAR_DAYS) -> DataFrame:
    """A-01: series, year, days, total; years short of least_days are dropped."""
    by = daily.groupBy("series", F.year("observed_on").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.sum(value).alias("total"))
    return by.where(F.col("days") >= least_days)


def monthly_normals(daily: DataFrame, value: str = "mm", least_days: int = COMPLETE_YEAR_DAYS) -> DataFrame:
    """A-02: series, month, normal: all days' sum by month over the number of complete years."""
    by = daily.groupBy("series", F.year("observed_on").alias("year"), F.month("observed_on").alias("month")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    years = by.groupBy("series", "year").agg(F.sum("n").alias("n")).where(F.col("n") >= least_days).groupBy("series").agg(F.count(F.lit(1)).alias("years"))
    return by.groupBy("series", "month").agg(F.sum("s").alias("s")).join(years, "series").select("series", "month", (F.col("s") / F.col("years")).alias("normal"))


def monthly_means(daily: DataFrame, value: str) -> DataFrame:
    """A-03: series, month, mean of finite values; null for a month without one."""
    finite = F.when(F.isnan(value), None).otherwise(F.col(value))
    return daily.groupBy("series", F.month("observed_on").alias("month")).agg(F.avg(finite).alias("mean"))


def interpolated(probability: float, points: Column) -> Column:
    """A-05: points is array<struct<p, v>> by ascending p; linear between them, the end values beyond."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    lower = F.element_at(F.filter(points, lambda x: x["p"] <= probability), -1)
    upper = F.element_at(F.filter(points, lambda x: x["p"] > probability), 1)
    between = lower["v"] + (upper["v"] - lower["v"]) * (F.lit(probability) - lower["p"]) / (upper["p"] - lower["p"])
    return F.when(first["p"] >= probability, first["v"]).when(last["p"] <= probability, last["v"]).otherwise(between)


def exceedance(annual: DataFrame, value: str = "total") -> DataFrame:
    """W-03: annual with rank and exceedance m / (N + 1), the largest year first."""
    w = Window.partitionBy("series")
    return annual.withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), "year"))).withColumn("exceedance", F.col("rank") / (F.count(F.lit(1)).over(w) + 1))


def dependable(annual: DataFrame, probabilities: tuple[float, ...] = (0.5, 0.75, 0.9), value: str = "total") -> DataFrame:
    """A-05: series, dependable_50, dependable_75, ...: reached or exceeded in that share of years (Weibull)."""
    ranked = exceedance(annual, value).groupBy("series").agg(F.array_sort(F.collect_list(F.struct(F.col("exceedance").alias("p"), F.col(value).cast("double").alias("v")))).alias("points"))
    return ranked.select("series", *[interpolated(p, F.col("points")).alias(f"dependable_{round(100 * p)}") for p in probabilities])


def annual_statistics(daily: DataFrame, value: str = "mm") -> DataFrame:
    """A-04: mean, median, sample deviation (0 for one year), coefficient of variation, extremes, rainy days a year, largest day."""
    years = annual_totals(daily, value)
    a = years.groupBy("series").agg(
        F.count(F.lit(1)).alias("years"),
        F.avg("total").alias("mean_annual"),
        F.percentile("total", F.lit(0.5)).alias("median_annual"),
        F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("std_annual"),
        F.min("total").alias("min_annual"),
        F.max("total").alias("max_annual"),
    )
    d = daily.groupBy("series").agg(F.count_if(F.col(value) >= RAINY_DAY_MM).alias("rainy"), F.max(value).alias("max_1day"))
    cv = F.when(F.col("mean_annual") > 0, F.col("std_annual") / F.col("mean_annual")).otherwise(0.0)
    return a.join(d, "series").select("*", cv.alias("cv"), (F.col("rainy") / F.col("years")).alias("rainy_days_per_year")).drop("rainy")


def wet_window(normals: Column) -> Column:
    """W-04: of 12 monthly normals, struct(start, months, total, share, kind) of the four consecutive months (around the year) with the most rain; the first of equals."""
    total = F.aggregate(normals, F.lit(0.0), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, k: s + F.element_at(normals, (i + k) % 12 + 1)).alias("s"), (-i).alias("i")))
    best = F.array_max(sums)
    start = F.when(total > 0, -best["i"]).otherwise(5)
    months = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (start + k) % 12 + 1)
    southwest = F.exists(months, lambda m: m.isin(6, 7, 8)) & (F.array_max(months) <= 10)
    kind = F.when(total <= 0, "undetermined").when(southwest, "southwest").when(F.exists(months, lambda m: m.isin(10, 11, 12)), "northeast").otherwise("other")
    return F.struct((start + 1).alias("start"), months.alias("months"), F.when(total > 0, best["s"]).otherwise(0.0).alias("total"), F.when(total > 0, 100 * best["s"] / total).otherwise(0.0).alias("share"), kind.alias("kind"))


def as_months(normals: DataFrame, value: str = "normal") -> DataFrame:
    """series, normals: array of 12 by month, 0 where a month has no row."""
    got = normals.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("month", F.col(value).cast("double")))).alias("m"))
    return got.select("series", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("normals"))


def rainfall_stats(daily: DataFrame, value: str = "mm") -> DataFrame:
    """DM-10: all statistics of a series in one row."""
    windows = as_months(monthly_normals(daily, value)).withColumn("monsoon", wet_window(F.col("normals")))
    return annual_statistics(daily, value).join(dependable(annual_totals(daily, value)), "series").join(windows, "series")


def antecedent(daily: DataFrame, value: str = "mm", rows: int = 5) -> DataFrame:
    """W-01: daily with `antecedent`, the sum of the five rows before (not the day itself), by order of date."""
    w = Window.partitionBy("series").orderBy("observed_on").rowsBetween(-rows, -1)
    return daily.withColumn("antecedent", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def month_filled(daily: DataFrame, value: str) -> DataFrame:
    """W-09: missing values of a series get their month's mean; series with a month that has none are left out."""
    finite = F.when(F.isnan(value), None).otherwise(F.col(value))
    w = Window.partitionBy("series", F.month("observed_on"))
    filled = daily.withColumn("mean", F.avg(finite).over(w)).withColumn("gap", F.min(F.col("mean").isNotNull()).over(Window.partitionBy("series")))
    return filled.where("gap").withColumn(value, F.coalesce(finite, F.col("mean"))).drop("mean", "gap")


def ensemble(stats: DataFrame, value: str = "mean_annual") -> DataFrame:
    """A-06: place, members, median, range, spread (range over median), sigma, notable; stats has a row for each place and source."""
    a = stats.groupBy("place").agg(F.count(F.lit(1)).alias("members"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sigma"))
    spread = F.when(F.col("median") > 0, (F.col("highest") - F.col("lowest")) / F.col("median")).otherwise(0.0)
    return a.withColumn("spread", spread).withColumn("notable", F.col("spread") > NOTABLE_SPREAD)


def primary(stats: DataFrame, preference: list[str]) -> DataFrame:
    """D-21: of each place's sources, the row of the most preferred one; unknown sources come last, by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("source")), F.lit(0)), F.lit(len(preference) + 1))
    return stats.withColumn("__r", F.row_number().over(Window.partitionBy("place").orderBy(rank, "source"))).where("__r = 1").drop("__r")


def merge_cache(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """SNK-09: upsert; what the new row lacks stays as it was."""
    a, b = old.select(*keys, *[F.col(v).alias("__" + v) for v in values]), new.select(*keys, *values)
    return b.join(a, keys, "full").select(*keys, *[F.coalesce(v, "__" + v).alias(v) for v in values])


def cached_range(cache: DataFrame, cells: DataFrame, start: Column, stop: Column, least: float = MIN_COVERAGE) -> DataFrame:
    """SRC-23: rows of cells(series) between two dates, for cells whose rows cover at least that share of the days."""
    rows = cache.join(cells, "series", "left_semi").where(F.col("observed_on").between(start, stop))
    n = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") / (F.datediff(stop, start) + 1) >= least)
    return rows.join(n.select("series"), "series", "left_semi")


def cached_stats(cache: DataFrame, cells: DataFrame, start: Column, stop: Column) -> DataFrame:
    """X-05: cells(series) with hit and annual statistics from the cache; a cell that isn't covered, or without a complete year, is a miss."""
    got = annual_statistics(cached_range(cache, cells, start, stop))
    return cells.join(got, "series", "left").withColumn("hit", F.col("years").isNotNull())


def dated_values(daily: DataFrame, names: dict[str, tuple[float, float | None]]) -> DataFrame:
    """SRC-14: per column (sentinel, replacement): values at or below the sentinel become the replacement, and are counted in <name>_filled."""
    out = daily
    for name, (sentinel, repl) in names.items():
        bad = F.col(name) <= sentinel
        out = out.withColumn(name + "_filled", F.coalesce(bad, F.lit(False))).withColumn(name, F.when(bad, F.lit(repl)).otherwise(F.col(name)))
    return out
