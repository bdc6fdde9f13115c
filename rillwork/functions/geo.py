"""Coordinates, areas, tiles and cells as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84, UTM, India's envelope, resolutions and rainfall cells.
A, FLAT = 6378137.0, 1 / 298.257223563
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10_000_000.0
INDIA = (68.0, 6.0, 97.5, 37.6)
LADDER = (1.0, 2.0, 2.5, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0)
RAIN_CELLS = {"open_meteo": (0.1, 0.1), "nasa_power": (0.5, 0.625)}
M_PER_DEG = 111_320.0
DISPLAY_INTERVALS = (1.0, 2.0, 5.0, 10.0, 20.0, 25.0, 50.0, 100.0, 200.0)

_N = FLAT / (2 - FLAT)
_E2 = FLAT * (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Krueger's series to the sixth order in the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f uses it (else each use is a copy of the whole expression)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def utm_zone(lon: Column) -> Column:
    """P-04: 1 to 60; 180 degrees is zone 1."""
    return F.pmod(F.floor((lon + 180) / 6), F.lit(60)).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def is_projected(epsg: Column) -> Column:
    """P-06: a metric grid's reference system."""
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def in_india(lon: Column, lat: Column) -> Column:
    """P-05."""
    return lon.between(INDIA[0], INDIA[2]) & lat.between(INDIA[1], INDIA[3])


def to_utm(lon: Column, lat: Column, zone: Column | None = None, south: Column | None = None) -> Column:
    """M-22: struct(x, y)."""
    zone = utm_zone(lon) if zone is None else zone
    south = lat < 0 if south is None else south
    lam, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    e = math.sqrt(_E2)

    def project(v: Column) -> Column:
        x, y = v["eta"], v["xi"]
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            y = y + a * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return F.struct((K0 * _RADIUS * x + FALSE_EAST).alias("x"), (K0 * _RADIUS * y + v["north"]).alias("y"))

    def sphere(v: Column) -> Column:
        t = F.sinh(F.atanh(v["s"]) - e * F.atanh(e * v["s"]))
        return let(F.struct(t.alias("t"), v["lam"].alias("lam"), v["north"].alias("north")), lambda w: let(F.struct(F.atan2(w["t"], F.cos(w["lam"])).alias("xi"), F.asinh(F.sin(w["lam"]) / F.sqrt(w["t"] * w["t"] + F.cos(w["lam"]) * F.cos(w["lam"]))).alias("eta"), w["north"].alias("north")), project))

    return let(F.struct(F.sin(phi).alias("s"), lam.alias("lam"), F.when(south, FALSE_NORTH).otherwise(0.0).alias("north")), sphere)


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """M-22: struct(lon, lat)."""
    south, zone = epsg >= 32700, epsg % 100
    start = F.struct(((x - FALSE_EAST) / (K0 * _RADIUS)).alias("eta"), ((y - F.when(south, FALSE_NORTH).otherwise(0.0)) / (K0 * _RADIUS)).alias("xi"), (zone * 6 - 183).alias("mid"))

    def back(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        for j, b in enumerate(_BETA, 1):
            xi = xi - b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return let(F.struct(xi.alias("xi"), eta.alias("eta"), v["mid"].alias("mid")), lambda w: let(F.struct(F.asin(F.sin(w["xi"]) / F.cosh(w["eta"])).alias("chi"), (F.degrees(F.atan2(F.sinh(w["eta"]), F.cos(w["xi"]))) + w["mid"]).alias("lon")), geodetic))

    def geodetic(v: Column) -> Column:
        # the latitude of a conformal latitude, by its series
        c2 = 2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45 + 26 * _N**5 / 45 - 2854 * _N**6 / 675
        c4 = 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45 + 2704 * _N**5 / 315 + 2323 * _N**6 / 945
        c6 = 56 * _N**3 / 15 - 136 * _N**4 / 35 - 1262 * _N**5 / 105 + 73814 * _N**6 / 2835
        c8 = 4279 * _N**4 / 630 - 332 * _N**5 / 35 - 399572 * _N**6 / 14175
        chi = v["chi"]
        phi = chi + c2 * F.sin(2 * chi) + c4 * F.sin(4 * chi) + c6 * F.sin(6 * chi) + c8 * F.sin(8 * chi)
        return F.struct(v["lon"].alias("lon"), F.degrees(phi).alias("lat"))

    return let(start, back)


def cell_centre(transform: Column, row: Column, col: Column) -> Column:
    """P-01, X-21: struct(x, y) of an affine (a, b, c, d, e, f) at a cell's centre; fractions are allowed."""
    return F.struct((transform[2] + transform[0] * (col + 0.5)).alias("x"), (transform[5] + transform[4] * (row + 0.5)).alias("y"))


def cell_of(transform: Column, x: Column, y: Column, n_rows: Column, n_cols: Column) -> Column:
    """P-02: struct(row, col), null outside the grid."""
    row, col = F.floor((y - transform[5]) / transform[4]).cast("int"), F.floor((x - transform[2]) / transform[0]).cast("int")
    return F.when((row >= 0) & (row < n_rows) & (col >= 0) & (col < n_cols), F.struct(row.alias("row"), col.alias("col")))


def box_area_km2(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """M-17: a lon/lat rectangle between parallels on the ellipsoid, in closed form. Geodesic edges differ from parallels: by less than 0.01 % for sides under a degree."""
    e = math.sqrt(_E2)
    b2 = (A * (1 - FLAT)) ** 2

    def q(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return s / (1 - _E2 * s * s) + F.atanh(e * s) / e

    return F.abs(F.radians(max_lon - min_lon) * b2 / 2 * (q(max_lat) - q(min_lat))) / 1e6


def box_error(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, max_km2: float = 100.0) -> Column:
    """P-07: why a rectangle is refused, null if it isn't."""
    all_ = (min_lon, min_lat, max_lon, max_lat)
    bad = F.lit(False)
    for c in all_:
        bad = bad | c.isNull() | F.isnan(c.cast("double")) | (F.abs(c) == F.lit(float("inf")))
    area = box_area_km2(*all_)
    ranges = min_lon.between(-180, 180) & max_lon.between(-180, 180) & min_lat.between(-90, 90) & max_lat.between(-90, 90)
    return F.when(bad, "not finite").when(~ranges, "out of range").when((min_lon >= max_lon) | (min_lat >= max_lat), "not ordered").when(area < 0.1, "too small").when(area > max_km2, "too large")


def ring_area_m2(points: Column) -> Column:
    """M-18: shoelace area of array<struct<x, y>> in a projected system; the ring closes by itself."""

    def area(both: Column) -> Column:
        parts = F.transform(both["ring"], lambda p, i: F.element_at(both["before"], i + 1)["x"] * p["y"] - p["x"] * F.element_at(both["before"], i + 1)["y"])
        return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) / 2

    return let(points, lambda r: let(F.struct(r.alias("ring"), F.concat(F.slice(r, -1, 1), r).alias("before")), area))


def repaired_ring(points: Column) -> Column:
    """G-27: a ring without null, repeated and closing points; null if fewer than three are left or they have no area."""

    def opened(apart: Column) -> Column:
        n = F.size(apart)
        closed = (n > 1) & (F.try_element_at(apart, F.lit(1)) == F.try_element_at(apart, n))
        return F.when(closed, F.slice(apart, F.lit(1), n - 1)).otherwise(apart)

    # each step is worked out once: as plain expressions they would be copied into each other, and again for each point
    real = F.filter(points, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    apart = let(real, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.try_element_at(r, i))))
    return let(let(apart, opened), lambda r: F.when((F.size(r) >= 3) & (ring_area_m2(r) > 0), r))


def line_length(points: Column) -> Column:
    """M-19."""

    def along(r: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(2), F.greatest(F.size(r), F.lit(2))), lambda i: F.hypot(F.try_element_at(r, i)["x"] - F.try_element_at(r, i - 1)["x"], F.try_element_at(r, i)["y"] - F.try_element_at(r, i - 1)["y"]))
        return F.aggregate(steps, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    return let(points, along)


def cell_size(area_m2: Column, length_m: Column) -> Column:
    """M-20: half the mean spacing of contour lines, 1 to 30 m, on the ladder; the finer of equals. Null without lines."""
    want = F.greatest(F.lit(LADDER[0]), F.least(F.lit(LADDER[-1]), area_m2 / length_m / 2))
    best = F.array_min(F.transform(F.array(*[F.lit(x) for x in LADDER]), lambda c: F.struct(F.abs(c - want).alias("d"), c.alias("c"))))["c"]
    return F.when(length_m > 0, best)


def contour_levels(low: Column, high: Column, interval: Column, most: int = 400) -> Column:
    """M-21: multiples of the interval in the range, rounded to 6 places; null if there are none or too many."""
    first = F.ceil(low / interval) * interval
    n = F.floor((high - first) / interval) + 1
    levels = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda k: F.round(first + k * interval, 6))
    return F.when((interval > 0) & (high > low) & (n > 0) & (n <= most), levels)


def display_interval(relief: Column, most: int = 40) -> Column:
    """M-25: the first interval that gives few enough levels, else the largest."""
    fits = F.filter(F.array(*[F.lit(x) for x in DISPLAY_INTERVALS]), lambda x: relief / x <= most)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(DISPLAY_INTERVALS[-1]))


def tiles(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, step: int = 1) -> Column:
    """SRC-08, X-07: array<struct<lat, lon, name>> of the tiles of that many degrees that a box touches, from the south-west; a name has the south-west corner."""
    first = lambda v: (F.floor(v / step) * step).cast("int")
    pairs = F.flatten(F.transform(F.sequence(first(min_lat), first(max_lat), F.lit(step)), lambda la: F.transform(F.sequence(first(min_lon), first(max_lon), F.lit(step)), lambda lo: F.struct(la.alias("lat"), lo.alias("lon")))))
    name = lambda t: F.concat(F.when(t["lat"] >= 0, "N").otherwise("S"), F.lpad(F.abs(t["lat"]).cast("string"), 2, "0"), F.when(t["lon"] >= 0, "E").otherwise("W"), F.lpad(F.abs(t["lon"]).cast("string"), 3, "0"))
    return F.transform(pairs, lambda t: F.struct(t["lat"].alias("lat"), t["lon"].alias("lon"), name(t).alias("name")))


def rain_cell(source: str, lon: Column, lat: Column) -> Column:
    """M-23, J-21: struct(key, lat, lon, offset_km) of a source's cell; halves round to even."""
    dy, dx = RAIN_CELLS.get(source, (0.1, 0.1))
    la, lo = F.round(F.rint(lat / dy) * dy, 6), F.round(F.rint(lon / dx) * dx, 6)
    km = F.hypot((lo - lon) * 111.320 * F.cos(F.radians((lat + la) / 2)), (la - lat) * 110.574)
    return F.struct(F.format_string("%.4f,%.4f", la, lo).alias("key"), la.alias("lat"), lo.alias("lon"), F.round(km, 2).alias("offset_km"))


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """X-02."""
    return F.hypot((lon2 - lon1) * M_PER_DEG * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * M_PER_DEG)


def box_around(lon: Column, lat: Column, half_m: Column) -> Column:
    """X-04."""
    dlat = half_m / M_PER_DEG
    dlon = half_m / (M_PER_DEG * F.cos(F.radians(lat)))
    return F.struct((lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"), (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"))


def cache_key(*parts: Column) -> Column:
    """SRC-09, X-30: SHA-256 of parameters, joined."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def pond_rectangle(lon: Column, lat: Column, length_m: Column, width_m: Column) -> Column:
    """SNK-04: a closed ring to the north, array<array<double>>."""
    dlat = width_m / 2 / M_PER_DEG
    dlon = length_m / 2 / (M_PER_DEG * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    corner = lambda sx, sy: F.array(lon + sx * dlon, lat + sy * dlat)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def mm_to_m3(mm: Column, area_m2: Column) -> Column:
    """M-16."""
    return mm / 1000 * area_m2
