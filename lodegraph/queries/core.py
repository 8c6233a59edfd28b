"""All queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.queries import calls, graph, graphs, profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (graph, graphs, profiles, calls):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
