"""Registry of the panel queries and their SQL."""

from __future__ import annotations

from quillon.plans import chains, cross, files, frames, models, overlays, series, shape, technicals, universe

MODULES = (universe, technicals, shape, series, cross, overlays, models, frames, files, chains)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
