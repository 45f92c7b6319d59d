"""Queries of the core operators on the driver's tables."""

from __future__ import annotations

from veldmark.plans import files, flows, formats, graphs, images, matrices, more, planes, points, series, texts  # noqa: F401
from veldmark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
