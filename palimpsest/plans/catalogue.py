"""Registered queries of the library proper, by name, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import catalog_queries, history, lifetime_queries, relations, script_queries, shapes, statement_queries, stream_queries

#: Modules that register their queries with shapes.
REGISTERING = (script_queries, statement_queries, lifetime_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**history.QUERIES, **relations.QUERIES, **shapes.QUERIES, **catalog_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict[str, str] = {**history.ORACLES, **relations.ORACLES, **shapes.ORACLES, **catalog_queries.ORACLES, **stream_queries.ORACLES}
