"""All queries of the engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, maintenance, places, portals, ranking, review, search, texts, vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for module in (search, ranking, maintenance, texts, vectors, review, places, portals, answers):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
