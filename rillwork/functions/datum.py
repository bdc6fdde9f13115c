"""X-10: coordinates of other datums and projections to WGS 84, as Column expressions.

A reference system is a struct(name, datum, projection, a, f, lat0, lon0, k0, lat1, lat2, east0, north0, unit), as `parsed` makes of the text of a .prj file: angles in degrees, `unit` metres (or degrees, without a projection) of a unit.
A shift is a struct(dx, dy, dz, rx, ry, rz, ppm): metres, seconds of arc (position vector) and millionths. Which one is used is chosen by registers.datum_operations; what has none is null, never left as it is.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.functions.geo import FLAT, A, let

CRS_DDL = "struct<name:string,datum:string,projection:string,a:double,f:double,lat0:double,lon0:double,k0:double,lat1:double,lat2:double,east0:double,north0:double,unit:double>"
# Names of projections and their parameters in well-known text.
PROJECTIONS = {
    "transverse_mercator": "tm", "gauss_kruger": "tm", "lambert_conformal_conic": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic_2sp": "lcc",
    "mercator": "merc", "mercator_1sp": "merc", "mercator_2sp": "merc",
}
PARAMETERS = {
    "latitude_of_origin": "lat0", "latitude_of_center": "lat0", "central_meridian": "lon0", "longitude_of_center": "lon0", "longitude_of_origin": "lon0", "scale_factor": "k0",
    "standard_parallel_1": "lat1", "standard_parallel_2": "lat2", "false_easting": "east0", "false_northing": "north0",
}
_SECONDS = math.pi / 180 / 3600
_ROUNDS = 8


def wkt(text: str) -> list | None:
    """Well-known text as nested lists [keyword, values...]; None if it is none."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[\[\](),]|[^\s\[\](),"]+', text)
    at = 0

    def node() -> list:
        nonlocal at
        out = [tokens[at].upper()]
        at += 1
        if at < len(tokens) and tokens[at] in "[(":
            at += 1
            while tokens[at] not in "])":
                if tokens[at] == ",":
                    at += 1
                elif at + 1 < len(tokens) and tokens[at + 1] in "[(":
                    out.append(node())
                else:
                    t = tokens[at]
                    out.append(t[1:-1] if t.startswith('"') else t)
                    at += 1
            at += 1
        return out

    try:
        got = node()
    except IndexError:
        return None
    return got if at == len(tokens) and len(got) > 1 else None


def crs_of(text: str | None) -> dict | None:
    """The system that well-known text of a .prj (GEOGCS or PROJCS) names; None if it isn't understood."""
    top = wkt(text or "")
    if top is None or top[0] not in ("GEOGCS", "PROJCS"):
        return None

    def find(n: list, key: str) -> list | None:
        return next((x for x in n if isinstance(x, list) and x[0] == key), None)

    try:
        geo = top if top[0] == "GEOGCS" else find(top, "GEOGCS")
        datum = find(geo, "DATUM")
        ball = find(datum, "SPHEROID")
        flat = float(ball[3])
        turn = float((find(geo, "UNIT") or [0, 0, math.pi / 180])[2]) * 180 / math.pi
        turn = 1.0 if abs(turn - 1) < 1e-12 else turn  # a degree as it is written
        start = float((find(geo, "PRIMEM") or [0, 0, 0])[2]) * turn
        out = {"name": top[1], "datum": datum[1], "projection": None, "a": float(ball[2]), "f": 1 / flat if flat else 0.0, "lat0": 0.0, "lon0": start, "k0": 1.0, "lat1": None, "lat2": None, "east0": 0.0, "north0": 0.0, "unit": turn}
        if top[0] == "PROJCS":
            kind = PROJECTIONS.get(find(top, "PROJECTION")[1].lower())
            if kind is None:
                return None
            unit = float(find(top, "UNIT")[2])
            out |= {"projection": kind, "unit": unit}
            for p in top:
                if isinstance(p, list) and p[0] == "PARAMETER" and (name := PARAMETERS.get(p[1].lower())):
                    v = float(p[2])
                    out[name] = v * unit if name in ("east0", "north0") else v if name == "k0" else v * turn + (start if name == "lon0" else 0)
    except (TypeError, ValueError, IndexError):
        return None
    return out


def parsed(text: Column) -> Column:
    """CRS_DDL of well-known text; null for text that isn't understood. Meant for the few different texts of layers, not for each row."""

    @F.pandas_udf(CRS_DDL)
    def parse(s: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(x.split(":")[0] for x in CRS_DDL.removeprefix("struct<").removesuffix(">").split(","))
        return pd.DataFrame([crs_of(t) or empty for t in s])

    got = parse(text)
    return F.when(got["a"].isNotNull(), got)


def geocentric(lon: Column, lat: Column, height: Column, a: Column, f: Column) -> Column:
    """struct(x, y, z) in metres of degrees on an ellipsoid."""
    lam, phi, e2 = F.radians(lon), F.radians(lat), f * (2 - f)
    return let(a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi)), lambda n: F.struct(((n + height) * F.cos(phi) * F.cos(lam)).alias("x"), ((n + height) * F.cos(phi) * F.sin(lam)).alias("y"), ((n * (1 - e2) + height) * F.sin(phi)).alias("z")))


def geodetic(x: Column, y: Column, z: Column, a: Column, f: Column) -> Column:
    """struct(lon, lat, height) of a geocentric point, by a fixed-point iteration that gains three digits a round near the ground."""
    e2, p = f * (2 - f), F.sqrt(x * x + y * y)

    def better(phi: Column, _: Column) -> Column:
        return F.atan2(z + e2 * a * F.sin(phi) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi)), p)

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), F.atan2(z, p * (1 - e2)), better)

    def done(v: Column) -> Column:
        n = a / F.sqrt(1 - e2 * F.sin(v) * F.sin(v))
        # the height along the axis that is the longer one here
        h = F.when(F.abs(F.cos(v)) > 0.5, p / F.cos(v) - n).otherwise(z / F.sin(v) - n * (1 - e2))
        return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(v).alias("lat"), h.alias("height"))

    return let(phi, done)


def helmert(p: Column, s: Column) -> Column:
    """A geocentric struct(x, y, z) moved by seven parameters, rotations as those of a position vector."""
    (rx, ry, rz), m = (s[c] * _SECONDS for c in ("rx", "ry", "rz")), 1 + s["ppm"] * 1e-6
    return F.struct((s["dx"] + m * (p["x"] - rz * p["y"] + ry * p["z"])).alias("x"), (s["dy"] + m * (rz * p["x"] + p["y"] - rx * p["z"])).alias("y"), (s["dz"] + m * (-ry * p["x"] + rx * p["y"] + p["z"])).alias("z"))


def to_wgs84(lon: Column, lat: Column, a: Column, f: Column, shift: Column) -> Column:
    """struct(lon, lat, height) on WGS 84 of degrees on another datum's ellipsoid at height 0; null without a shift."""
    moved = let(geocentric(lon, lat, F.lit(0.0), a, f), lambda p: let(helmert(p, shift), lambda q: geodetic(q["x"], q["y"], q["z"], F.lit(A), F.lit(FLAT))))
    return F.when(shift.isNotNull(), moved)


def _latitude(t: Column, e: Column) -> Column:
    """The latitude (radians) with a conformal latitude's exp(-psi) = t."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), F.lit(math.pi / 2) - 2 * F.atan(t), lambda phi, _: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), e / 2)))


def _t(phi: Column, e: Column) -> Column:
    return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), e / 2)


def _m(phi: Column, e: Column) -> Column:
    return F.cos(phi) / F.sqrt(1 - e * e * F.sin(phi) * F.sin(phi))


def _conic(c: Column, x: Column, y: Column) -> Column:
    """Lambert's conformal conic with one standard parallel (lat0 with k0) or two."""
    e = F.sqrt(c["f"] * (2 - c["f"]))
    one = F.radians(F.coalesce(c["lat1"], c["lat0"]))
    two = F.radians(F.coalesce(c["lat2"], c["lat1"], c["lat0"]))
    both = F.abs(one - two) > 1e-12
    n = F.when(both, (F.ln(_m(one, e)) - F.ln(_m(two, e))) / (F.ln(_t(one, e)) - F.ln(_t(two, e)))).otherwise(F.sin(one))

    def back(v: Column) -> Column:
        scale = c["k0"] * _m(one, e) / (v["n"] * F.pow(_t(one, e), v["n"])) * c["a"]
        r0 = scale * F.pow(_t(F.radians(c["lat0"]), e), v["n"])
        dx, dy = x - c["east0"], r0 - (y - c["north0"])
        r = F.signum(v["n"]) * F.sqrt(dx * dx + dy * dy)
        angle = F.atan2(F.signum(v["n"]) * dx, F.signum(v["n"]) * dy)
        return let(F.struct(F.pow(r / scale, 1 / v["n"]).alias("t"), (angle / v["n"]).alias("lam")), lambda w: F.struct((F.degrees(w["lam"]) + c["lon0"]).alias("lon"), F.degrees(_latitude(w["t"], e)).alias("lat")))

    return let(F.struct(n.alias("n")), back)


def _mercator(c: Column, x: Column, y: Column) -> Column:
    e = F.sqrt(c["f"] * (2 - c["f"]))
    k = F.when(c["lat1"].isNotNull(), _m(F.radians(c["lat1"]), e)).otherwise(c["k0"])
    return F.struct((F.degrees((x - c["east0"]) / (k * c["a"])) + c["lon0"]).alias("lon"), F.degrees(_latitude(F.exp((c["north0"] - y) / (k * c["a"])), e)).alias("lat"))


def _transverse(c: Column, x: Column, y: Column) -> Column:
    """Krueger's series to the fourth order in the third flattening, for any ellipsoid and origin."""
    n = c["f"] / (2 - c["f"])

    def series(s: Column) -> Column:
        n, e = s["n"], s["e"]
        radius = c["a"] / (1 + n) * (1 + n * n / 4 + F.pow(n, 4) / 64)
        beta = (n / 2 - 2 * n * n / 3 + 37 * F.pow(n, 3) / 96 - F.pow(n, 4) / 360, n * n / 48 + F.pow(n, 3) / 15 - 437 * F.pow(n, 4) / 1440, 17 * F.pow(n, 3) / 480 - 37 * F.pow(n, 4) / 840, 4397 * F.pow(n, 4) / 161280)
        alpha = (n / 2 - 2 * n * n / 3 + 5 * F.pow(n, 3) / 16 + 41 * F.pow(n, 4) / 180, 13 * n * n / 48 - 3 * F.pow(n, 3) / 5 + 557 * F.pow(n, 4) / 1440, 61 * F.pow(n, 3) / 240 - 103 * F.pow(n, 4) / 140, 49561 * F.pow(n, 4) / 161280)
        phi0 = F.radians(c["lat0"])
        # the origin's conformal latitude and its arc
        chi0 = F.atan(F.sinh(F.asinh(F.tan(phi0)) - e * F.atanh(e * F.sin(phi0))))
        arc = chi0
        for j, a in enumerate(alpha, 1):
            arc = arc + a * F.sin(2 * j * chi0)
        start = F.struct(((y - c["north0"]) / (c["k0"] * radius) + arc).alias("xi"), ((x - c["east0"]) / (c["k0"] * radius)).alias("eta"))

        def back(v: Column) -> Column:
            xi, eta = v["xi"], v["eta"]
            for j, b in enumerate(beta, 1):
                xi = xi - b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
                eta = eta - b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])

            def out(w: Column) -> Column:
                chi = F.asin(F.sin(w["xi"]) / F.cosh(w["eta"]))
                t = F.tan(F.lit(math.pi / 4) - chi / 2)
                return F.struct((F.degrees(F.atan2(F.sinh(w["eta"]), F.cos(w["xi"]))) + c["lon0"]).alias("lon"), F.degrees(_latitude(t, e)).alias("lat"))

            return let(F.struct(xi.alias("xi"), eta.alias("eta")), out)

        return let(start, back)

    return let(F.struct(n.alias("n"), F.sqrt(c["f"] * (2 - c["f"])).alias("e")), series)


def unprojected(c: Column, x: Column, y: Column) -> Column:
    """struct(lon, lat) in degrees on the system's own ellipsoid of coordinates in its units; null without a system."""
    mx, my = x * c["unit"], y * c["unit"]
    plain = F.struct((mx + c["lon0"]).alias("lon"), my.alias("lat"))
    kind = c["projection"]
    return F.when(c.isNull(), None).when(kind.isNull(), plain).when(kind == "tm", _transverse(c, mx, my)).when(kind == "lcc", _conic(c, mx, my)).when(kind == "merc", _mercator(c, mx, my))


def grid_shift(lon: Column, lat: Column, west: Column, south: Column, step: Column, east_of: Column, north_of: Column) -> Column:
    """struct(lon, lat) moved by a grid of shifts in degrees: east_of and north_of are array<array<double>> from the south-west, by row; between four nodes bilinear, null outside."""
    u, v = (lon - west) / step, (lat - south) / step
    at = F.struct(F.floor(u).cast("int").alias("c"), F.floor(v).cast("int").alias("r"), (u - F.floor(u)).alias("fu"), (v - F.floor(v)).alias("fv"))

    def moved(p: Column) -> Column:
        # the last node's row and column belong to the cell before
        def value(g: Column) -> Column:
            node = lambda r, c: F.try_element_at(F.try_element_at(g, r + 1), c + 1)
            right = lambda r: F.when(p["fu"] > 0, node(r, p["c"]) * (1 - p["fu"]) + node(r, p["c"] + 1) * p["fu"]).otherwise(node(r, p["c"]))
            return F.when(p["fv"] > 0, right(p["r"]) * (1 - p["fv"]) + right(p["r"] + 1) * p["fv"]).otherwise(right(p["r"]))

        inside = (p["c"] >= 0) & (p["r"] >= 0)
        to = F.struct((lon + value(east_of)).alias("lon"), (lat + value(north_of)).alias("lat"))
        return F.when(inside & to["lon"].isNotNull() & to["lat"].isNotNull(), to)

    return let(at, moved)
