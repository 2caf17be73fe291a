"""All registered queries and their SQL oracles."""

from __future__ import annotations

from loamstone.plans import catalogue, oracles


def queries() -> dict:
    return {f.__name__: f for f in catalogue.QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
