"""Every query of the engine by name, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geostrata.plans import checks, documents, fields, more, places, rasters, rules, series, shapes, tables

FLAGSHIP = "area_class_profile"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in (rasters, tables, rules, series, more, checks, fields, shapes, places, documents):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
