"""Query name -> builder and oracle SQL, gathered from the query modules of this package."""

from __future__ import annotations

from quillet.plans import building, crawling, parsing, runs, scalar, searching, serving

FLAGSHIP = "search_flagship"
MODULES = (scalar, searching, parsing, building, serving, runs, crawling)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
