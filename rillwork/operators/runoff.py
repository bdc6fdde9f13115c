"""SCS curve-number runoff over daily series, and checks of it by Indian regional formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import hydro
from rillwork.operators import rainfall

MONSOON = (6, 7, 8, 9)


def composite_curve_number(fractions: DataFrame) -> DataFrame:
    """A-10: fractions(site, cover, fraction, soil) -> site, cn2, cn1, cn3, breakdown (by fraction, largest first)."""
    rows = fractions.withColumn("cn", hydro.curve_number(F.col("cover"), F.col("soil")))
    parts = F.sort_array(F.collect_list(F.struct("fraction", "cover", "cn")), asc=False)
    cn2 = F.try_divide(F.sum(F.col("fraction") * F.col("cn")), F.sum("fraction"))
    got = rows.groupBy("site").agg(cn2.alias("cn2"), parts.alias("breakdown"))
    return got.select("site", "cn2", hydro.dry_cn(F.col("cn2")).alias("cn1"), hydro.wet_cn(F.col("cn2")).alias("cn3"), "breakdown")


def daily_runoff(daily: DataFrame, cn2: Column, growing_months: tuple[int, ...] = MONSOON, lam: float = hydro.INITIAL_ABSTRACTION) -> DataFrame:
    """daily with antecedent (unless it is there already), amc and runoff (mm). cn2 may be a column of daily, so many catchments go at once."""
    d = daily if "antecedent" in daily.columns else rainfall.antecedent(daily)
    d = d.withColumn("amc", hydro.moisture_class(F.col("antecedent"), F.month("observed_on").isin(*growing_months)))
    cn = F.when(F.col("amc") == "I", hydro.dry_cn(cn2)).when(F.col("amc") == "III", hydro.wet_cn(cn2)).otherwise(cn2)
    return d.withColumn("runoff", hydro.runoff_mm(F.col("mm"), cn, lam))


def runoff_estimate(daily: DataFrame, cn2: Column, area_m2: Column, growing_months: tuple[int, ...] = MONSOON) -> DataFrame:
    """D-07: series, years, annual_mean_mm, annual_mean_m3, dependable_75_mm, dependable_75_m3, coefficient, monthly_mm (12). Dependable runoff ranks the runoff of years, not their rain."""
    d = daily_runoff(daily, cn2, growing_months)
    by = d.groupBy("series", F.year("observed_on").alias("year"), F.month("observed_on").alias("month")).agg(F.sum("runoff").alias("runoff"), F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("days"))
    years = by.groupBy("series", "year").agg(F.sum("runoff").alias("total"), F.sum("mm").alias("rain"), F.sum("days").alias("days")).where(F.col("days") >= hydro.COMPLETE_YEAR_DAYS)
    means = years.groupBy("series").agg(F.count(F.lit(1)).alias("years"), F.avg("total").alias("annual_mean_mm"), F.avg("rain").alias("rain"))
    months = by.groupBy("series", "month").agg(F.sum("runoff").alias("normal"))
    got = means.join(rainfall.dependable(years, (0.75,)), "series").join(rainfall.as_months(months), "series")
    return got.select(
        "series",
        "years",
        "annual_mean_mm",
        (F.col("annual_mean_mm") / 1000 * area_m2).alias("annual_mean_m3"),
        F.col("dependable_75").alias("dependable_75_mm"),
        (F.col("dependable_75") / 1000 * area_m2).alias("dependable_75_m3"),
        F.when(F.col("rain") > 0, F.col("annual_mean_mm") / F.col("rain")).otherwise(0.0).alias("coefficient"),
        F.transform("normals", lambda x: x / F.col("years")).alias("monthly_mm"),
    )


def region(state: Column) -> Column:
    """P-19: the region whose formulas hold, by parts of a state's name."""
    s = F.lower(F.trim(F.coalesce(state, F.lit(""))))
    hit = lambda *names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(s, n))
    return F.when(hit("maharashtra", "karnataka"), "deccan").when(hit("goa", "konkan", "kerala"), "western_ghats").when(hit("uttar pradesh", "bihar", "haryana", "punjab", "delhi"), "gangetic").otherwise("general")


def cross_check(rows: DataFrame) -> DataFrame:
    """D-08, A-28: rows(site, state, scs_mm, annual_mm, monsoon_mm, monthly_mm, monthly_temp, catchment_class) -> region, methods, lowest, highest, agrees, ratio.

    agrees: within the formulas' range widened by a quarter; ratio: to the nearest bound outside the range.
    """
    r = region(F.col("state"))

    def method(name: str, value: Column, of: Column = F.col("annual_mm"), fits: Column = F.lit(True)) -> Column:
        coefficient = F.try_divide(value, F.when(of > 0, of))
        return F.struct(F.lit(name).alias("method"), value.alias("runoff_mm"), coefficient.alias("coefficient"), (value.isNotNull() & fits).alias("applicable"))

    total = F.aggregate("monthly_mm", F.lit(0.0), lambda s, p: s + p)
    khosla = hydro.khosla_mm(F.col("monthly_mm"), F.col("monthly_temp"))
    # what Khosla's loss leaves of heavy rain is reported, but doesn't widen the range
    khosla_fits = F.coalesce(khosla <= hydro.KHOSLA_IMPLAUSIBLE * total, F.lit(False))
    plains, ghat = hydro.inglis_desouza_mm(F.col("annual_mm"), "plains"), hydro.inglis_desouza_mm(F.col("annual_mm"), "ghat")
    methods = (
        F.when(r == "deccan", F.array(method("inglis_desouza", plains)))
        .when(r == "western_ghats", F.array(method("inglis_desouza", ghat)))
        .when(r == "gangetic", F.array(method("barlow", hydro.barlow_mm(F.col("monsoon_mm"), F.col("catchment_class"))), method("khosla", khosla, total, khosla_fits)))
        .otherwise(F.array(method("khosla", khosla, total, khosla_fits), method("inglis_desouza", plains)))
    )
    out = rows.withColumn("region", r).withColumn("methods", methods)
    values = F.transform(F.filter("methods", lambda m: m["applicable"]), lambda m: m["runoff_mm"])
    out = out.withColumn("lowest", F.array_min(values)).withColumn("highest", F.array_max(values))
    t, x = hydro.CROSS_CHECK_TOLERANCE, F.col("scs_mm")
    agrees = F.when(F.col("lowest").isNotNull(), x.between(F.col("lowest") * (1 - t), F.col("highest") * (1 + t)))
    ratio = F.when(x < F.col("lowest"), F.try_divide(x, F.col("lowest"))).when(x > F.col("highest"), F.try_divide(x, F.col("highest"))).when(F.col("lowest").isNotNull(), 1.0)
    return out.withColumn("agrees", agrees).withColumn("ratio", ratio)
