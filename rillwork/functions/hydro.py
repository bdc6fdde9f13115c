"""Hydrology, soil and pond formulas as Column expressions. Null in, null out; undefined geometry is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indian SCS-CN practice, NRCS curve numbers and pond defaults.
INITIAL_ABSTRACTION = 0.3
AMC_GROWING = (35.5, 53.3)
AMC_DORMANT = (12.7, 27.9)
COMPLETE_YEAR_DAYS = 360
RAINY_DAY_MM = 2.5
CURVE_NUMBERS: dict[int, tuple[int, int, int, int]] = {
    10: (30, 55, 70, 77),
    20: (35, 56, 70, 77),
    30: (49, 69, 79, 84),
    40: (67, 78, 85, 89),
    50: (77, 85, 90, 92),
    60: (77, 86, 91, 94),
    70: (98, 98, 98, 98),
    80: (100, 100, 100, 100),
    90: (85, 88, 90, 92),
    95: (100, 100, 100, 100),
    100: (68, 79, 86, 89),
}
FALLBACK_COVER = 40
BARLOW_K = {"flat_cultivated": 0.07, "flat_partly_cultivated": 0.12, "average": 0.16, "hilly_barren": 0.36}
KHOSLA_LOSS, KHOSLA_IMPLAUSIBLE, CROSS_CHECK_TOLERANCE = 0.48, 0.75, 0.25
SEEPAGE_MM_PER_DAY = {"A": 25.0, "B": 12.0, "C": 6.0, "D": 2.0}
DEFAULT_SEEPAGE, OPEN_WATER, USABLE_FRACTION, SPIN_UP_YEARS = 6.0, 1.05, 0.10, 3
DAYS_IN_MONTH = (31.0, 28.25, 31.0, 30.0, 31.0, 30.0, 31.0, 31.0, 30.0, 31.0, 30.0, 31.0)
POND_DEPTHS, SIDE_SLOPE, FREEBOARD, SILT, YIELD_SHARE = (2.5, 4.5), 1.5, 0.5, 0.10, 0.30
EXCAVATION_RATE, EMBANKMENT_RATE, EMBANKMENT_SHARE = 130.0, 70.0, 0.25


def retention_mm(cn: Column) -> Column:
    """M-05: S = 25400 / CN - 254."""
    return F.lit(25400.0) / cn - 254.0


def runoff_mm(rain: Column, cn: Column, lam: float = INITIAL_ABSTRACTION) -> Column:
    """M-05: Q = (P - lam S)^2 / (P - lam S + S), 0 up to the initial abstraction."""
    s = retention_mm(cn)
    over = rain - lam * s
    return F.when(over > 0, over * over / (over + s)).when(over.isNotNull(), F.lit(0.0))


def dry_cn(cn: Column) -> Column:
    """M-06: CN(I), within 1 to 100."""
    return F.when(cn.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(100.0), 4.2 * cn / (10.0 - 0.058 * cn))))


def wet_cn(cn: Column) -> Column:
    """M-06: CN(III), within 1 to 100."""
    return F.when(cn.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(100.0), 23.0 * cn / (10.0 + 0.13 * cn))))


def moisture_class(antecedent_mm: Column, growing: Column) -> Column:
    """P-20: I below the lower threshold, III above the upper, II from one to the other."""
    lo = F.when(growing, AMC_GROWING[0]).otherwise(AMC_DORMANT[0])
    hi = F.when(growing, AMC_GROWING[1]).otherwise(AMC_DORMANT[1])
    return F.when(antecedent_mm < lo, "I").when(antecedent_mm > hi, "III").when(antecedent_mm.isNotNull(), "II")


def kirpich_min(length_m: Column, slope: Column) -> Column:
    """M-07: time of concentration in minutes."""
    return F.when((length_m > 0) & (slope > 0), 0.01947 * F.pow(length_m, 0.77) * F.pow(slope, -0.385))


def form_factor(area_m2: Column, length_m: Column) -> Column:
    return F.when(length_m > 0, area_m2 / (length_m * length_m))


def compactness(perimeter_m: Column, area_m2: Column) -> Column:
    return F.when(area_m2 > 0, perimeter_m / (2 * F.sqrt(math.pi * area_m2)))


def extraterrestrial_radiation(lat_deg: Column, day_of_year: Column) -> Column:
    """M-09: FAO-56 equations 21 to 25, MJ per m2 and day."""
    phi = F.radians(lat_deg)
    turn = 2 * math.pi * day_of_year / 365.0
    near = 1 + 0.033 * F.cos(turn)
    decl = 0.409 * F.sin(turn - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(decl))))
    ra = 24 * 60 / math.pi * 0.0820 * near * (sunset * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(sunset))
    return F.when(ra.isNotNull(), F.greatest(F.lit(0.0), ra))


def hargreaves_et0(ra: Column, t_mean: Column, t_max: Column, t_min: Column) -> Column:
    """M-09: mm a day; the radiation's evaporation equivalent is 0.408."""
    et0 = 0.0023 * 0.408 * ra * (t_mean + 17.8) * F.when(t_max >= t_min, F.sqrt(t_max - t_min)).when((t_max - t_min).isNotNull(), 0.0)
    return F.when(et0.isNotNull(), F.greatest(F.lit(0.0), et0))


def inglis_desouza_mm(annual_mm: Column, terrain: str) -> Column:
    """M-10: in cm, ghat 0.85 P - 30.5 and plains (P - 17.8) P / 254; 0 below their range, null where more would run off than fell."""
    p = annual_mm / 10.0
    cm = 0.85 * p - 30.5 if terrain == "ghat" else (p - 17.8) * p / 254.0
    return F.when(cm <= 0, F.lit(0.0)).when(cm <= p, cm * 10.0)


def khosla_mm(monthly_rain: Column, monthly_temp: Column) -> Column:
    """M-11: sum over months of max(0, P - 0.48 max(T, 0))."""
    pairs = F.arrays_zip(monthly_rain.alias("p"), monthly_temp.alias("t"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x["p"] - KHOSLA_LOSS * F.greatest(x["t"], F.lit(0.0))))


def barlow_mm(monsoon_mm: Column, catchment_class: Column) -> Column:
    """M-12."""
    k = F.create_map(*[F.lit(x) for kv in BARLOW_K.items() for x in kv])
    return monsoon_mm * F.try_element_at(k, catchment_class)


def rational_peak_m3s(area_ha: Column, intensity_mm_h: Column, coefficient: Column) -> Column:
    """M-13."""
    return coefficient * intensity_mm_h * area_ha / 360.0


def curve_number(cover: Column, soil: Column) -> Column:
    """J-13: CN of a land-cover class and soil group; classes without one count as cropland, groups without one are null."""
    table = F.create_map(*[x for code, row in CURVE_NUMBERS.items() for x in (F.lit(code), F.array(*[F.lit(float(v)) for v in row]))])
    row = F.coalesce(F.try_element_at(table, cover), F.array(*[F.lit(float(v)) for v in CURVE_NUMBERS[FALLBACK_COVER]]))
    place = F.instr(F.lit("ABCD"), soil)
    return F.when(place > 0, F.try_element_at(row, place))


def prismoidal(top_length: Column, top_width: Column, depth: Column, slope: Column) -> Column:
    """M-14: struct(volume, bottom_length, bottom_width); null if the sides meet before the bottom."""
    lb, wb = top_length - 2 * slope * depth, top_width - 2 * slope * depth
    at, ab = top_length * top_width, lb * wb
    volume = depth / 3 * (at + ab + F.sqrt(at * ab))
    return F.when((lb > 0) & (wb > 0), F.struct(volume.alias("volume"), lb.alias("bottom_length"), wb.alias("bottom_width")))


def frustum_area(bl: Column, bw: Column, slope: Column, depth: Column, d: Column) -> Column:
    """M-15: water surface at depth d above the bottom."""
    d = F.greatest(F.lit(0.0), F.least(d, depth))
    return (bl + 2 * slope * d) * (bw + 2 * slope * d)


def frustum_volume(bl: Column, bw: Column, slope: Column, depth: Column, d: Column) -> Column:
    d = F.greatest(F.lit(0.0), F.least(d, depth))
    low, top = bl * bw, (bl + 2 * slope * d) * (bw + 2 * slope * d)
    return d / 3 * (top + low + F.sqrt(top * low))


def frustum_depth(bl: Column, bw: Column, slope: Column, depth: Column, volume: Column) -> Column:
    """M-15: the depth that holds a volume. Volume is convex in depth and its slope is the water surface (nearly so where the plan isn't square), so Newton's steps down from the full depth
    settle within a few; sixteen are ample."""
    full = depth.cast("double")

    def closer(d: Column, _: Column) -> Column:
        new = d - (frustum_volume(bl, bw, slope, depth, d) - volume) / frustum_area(bl, bw, slope, depth, d)
        return F.greatest(F.lit(0.0), F.least(full, new))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(16)), full, closer)
    return F.when(volume <= 0, F.lit(0.0)).when(volume >= frustum_volume(bl, bw, slope, depth, depth), full).otherwise(found)


def texture_class(clay: Column, sand: Column, silt: Column) -> Column:
    """P-18: the USDA triangle; its classes touch, so the corners come first and loam takes the rest."""
    fine, coarse = silt + 2 * clay, silt + 1.5 * clay
    sandy = F.when((sand >= 85) & (coarse < 15), "sand").when(sand.between(70, 91) & (coarse >= 15) & (fine < 30), "loamy sand")
    heavy = F.when(silt >= 40, "silty clay").when(sand >= 45, "sandy clay").otherwise("clay")
    middle = F.when(sand <= 20, "silty clay loam").when(sand <= 45, "clay loam")
    silty = F.when((silt >= 80) & (clay < 12), "silt").when((silt >= 50) & (clay < 27), "silt loam")
    light = F.when(((clay < 20) & (sand > 52) & (fine >= 30)) | ((clay < 7) & (silt < 50) & sand.between(43, 52)), "sandy loam")
    found = F.coalesce(
        sandy,
        F.when(clay >= 40, heavy).when((clay >= 35) & (sand >= 45), "sandy clay"),
        F.when((clay >= 27) & (clay < 40), middle),
        F.when((clay >= 20) & (clay < 35) & (silt < 28) & (sand > 45), "sandy clay loam"),
        silty,
        light,
        F.lit("loam"),
    )
    return F.when(clay.isNotNull() & sand.isNotNull() & silt.isNotNull(), found)


#: Hydrologic soil group of a texture.
SOIL_GROUPS = {"sand": "A", "loamy sand": "A", "sandy loam": "A", "loam": "B", "silt loam": "B", "silt": "B", "sandy clay loam": "C", "clay loam": "D", "silty clay loam": "D", "sandy clay": "D", "silty clay": "D", "clay": "D"}


def soil_group(texture: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SOIL_GROUPS.items() for x in kv]), texture)


def fill_note(ratio: Column) -> Column:
    """X-23: what a pond's share of its inflow means."""
    return F.when(ratio <= 0, "no inflow").when(ratio < 0.05, "fills readily").when(ratio < YIELD_SHARE, "well matched").when(ratio.isNotNull(), "too large")
