"""Registered queries of the reference operators."""

from gridwx.plans import grid_queries, ingest_queries, point_queries  # noqa: F401  (registers its queries)
from gridwx.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
