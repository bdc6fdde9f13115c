"""All registered queries and their SQL twins."""

from __future__ import annotations

from rillwork.plans import q_analysis, q_decide, q_functions, q_land, q_rain, q_raster, q_registers, q_sources, q_survey, q_terrain

MODULES = (q_rain, q_terrain, q_registers, q_decide, q_functions, q_land, q_sources, q_survey, q_raster, q_analysis)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
