"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from floorgraph.plans import extras, graph, outlines, relational, shapes, spatial, stations

FLAGSHIP = "shortest_cost_all"
_MODULES: tuple = (relational, spatial, graph, shapes, outlines, stations, extras)


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
