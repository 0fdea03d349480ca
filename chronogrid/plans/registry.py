"""All registered queries and their oracle SQL, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronogrid.plans import control, curves, files, frames, grid, history, jobs, records, scalars, state, tables, web

FLAGSHIP = "scale_to_zones"
MODULES = (grid, history, records, frames, control, tables, curves, state, web, scalars, jobs, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
