"""Every query of the library, by name, with the SQL it is held against."""

from __future__ import annotations

from .queries import ORACLES, QUERIES, Query, flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
