"""Map features, land and tenure classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and tokens of the map and of parcel registers.
WATERWAYS = ("river", "stream", "canal", "drain", "ditch", "riverbank")
MAJOR_WATERWAYS, MINOR_WATERWAYS = ("river", "canal", "riverbank"), ("stream", "drain", "ditch")
MAJOR_WATER, MINOR_WATER = ("river", "canal", "oxbow", "riverbank"), ("stream", "drain", "ditch", "canal_ditch")
MAJOR_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
TRACKS = ("track", "path", "footway", "cycleway", "bridleway", "steps", "service")
BLOCKING = ("residential", "industrial", "commercial", "retail", "quarry", "cemetery", "railway", "military", "landfill", "construction")
PUBLIC_TENURE = ("government", "govt", "gram panchayat", "panchayat", "gairan", "gochar", "shamlat", "poramboke", "waste", "common", "public", "revenue")
OWNER_FIELDS = ("ownership", "owner", "owner_type", "tenure", "land_type", "landtype", "category", "class", "khata_type", "type")
LEGEND = {10: "tree_cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built_up", 60: "bare_sparse", 70: "snow_ice", 80: "permanent_water", 90: "herbaceous_wetland", 95: "mangroves", 100: "moss_lichen"}
ALLOTTABLE, CROPLAND, BLOCKED = (20, 30, 60), 40, (10, 50, 70, 80, 95)
LEVELS = {"ADM1": ("state", "state/union territory"), "ADM2": ("district",), "ADM3": ("subdistrict",), "ADM4": ("cd_block",)}
CHANNEL_ELONGATION, CHANNEL_AREA_M2 = 5.0, 20_000.0


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def feature_kind(tags: Column) -> Column:
    """P-15: building, water, road, track or landuse, in this order; null for what doesn't matter."""
    t = lambda k: _tag(tags, k)
    water = (t("natural") == "water") | t("landuse").isin("reservoir", "basin") | t("waterway").isin(*WATERWAYS)
    return F.when(t("building") != "", "building").when(water, "water").when(t("highway").isin(*MAJOR_ROADS), "road").when(t("highway").isin(*TRACKS), "track").when(t("landuse").isin(*BLOCKING), "landuse")


def water_kind(tags: Column, elongation: Column | None = None, area_m2: Column | None = None) -> Column:
    """P-16, X-15: major, minor or standing; water without a tag of its own is a channel if it is long, thin and large."""
    way, water = F.lower(_tag(tags, "waterway")), F.lower(_tag(tags, "water"))
    shape = (F.coalesce(elongation, F.lit(0.0)) >= CHANNEL_ELONGATION) & (F.coalesce(area_m2, F.lit(0.0)) >= CHANNEL_AREA_M2) if elongation is not None and area_m2 is not None else F.lit(False)
    return F.when(way.isin(*MAJOR_WATERWAYS) | water.isin(*MAJOR_WATER), "major").when(way.isin(*MINOR_WATERWAYS) | water.isin(*MINOR_WATER), "minor").when((way == "") & (water == "") & shape, "major").otherwise("standing")


def owner_field(attributes: Column) -> Column:
    """P-17: the first field of the list that the attributes have, by any case."""
    keys = F.map_keys(attributes)
    hits = F.transform(F.array(*[F.lit(f) for f in OWNER_FIELDS]), lambda f: F.try_element_at(F.filter(keys, lambda k: F.lower(k) == f), F.lit(1)))
    return F.try_element_at(F.filter(hits, lambda h: h.isNotNull()), F.lit(1))


def is_public(owner: Column) -> Column:
    """P-17."""
    text = F.lower(F.trim(owner))
    return F.coalesce(F.exists(F.array(*[F.lit(t) for t in PUBLIC_TENURE]), lambda t: F.contains(text, t)), F.lit(False))


def may_allot(cover: Column, cropland: bool = False) -> Column:
    """P-13."""
    return cover.isin(*ALLOTTABLE, *((CROPLAND,) if cropland else ()))


def is_blocked(cover: Column) -> Column:
    """P-13."""
    return cover.isin(*BLOCKED)


def cover_name(cover: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LEGEND.items() for x in kv]), cover)


def same_level(level: str, label: Column) -> Column:
    """F-13: a published label still names the level, by letters, digits and slashes; unknown levels and empty labels pass."""
    known = LEVELS.get(level.upper())
    if not known:
        return F.lit(True)
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9/]+", "")
    return F.coalesce(label == "", F.lit(True)) | squash(label).isin(*["".join(ch for ch in k if ch.isalnum() or ch == "/") for k in known])


def flatness_note(fraction: Column) -> Column:
    """P-27."""
    return F.when(fraction < 0.05, "well defined").when(fraction < 0.15, "some flat ground").when(fraction < 0.40, "flat").when(fraction.isNotNull(), "very flat")


def exclusion_confidence(sources: Column) -> Column:
    """P-26, X-16: high with the map and land cover, partial with one, terrain-only with none."""
    n = F.array_contains(sources, "osm").cast("int") + F.array_contains(sources, "land_cover").cast("int")
    return F.when(n == 2, "high").when(n == 1, "partial").otherwise("terrain-only")


def screening(relief: Column, built: Column, water: Column, least_relief: float, most_built: float, least_water: float) -> Column:
    """P-25: pass or fail once all three are measured, else indeterminate."""
    every = (relief >= least_relief) & (built <= most_built) & (water >= least_water)
    measured = relief.isNotNull() & built.isNotNull() & water.isNotNull()
    return F.when(~measured, "indeterminate").when(every, "pass").otherwise("fail")
