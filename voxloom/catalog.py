"""Named queries of the spatial engine and their SQL, merged from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.plans import files, fits, joins, kernels, layouts, points, poses, regions, rings, scenes, surfaces, text

MODULES = (points, joins, rings, text, kernels, surfaces, poses, layouts, files, scenes, regions, fits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for m in MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for m in MODULES:
        found |= m.SQL
    return found
