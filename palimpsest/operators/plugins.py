"""Plugins: rewrites of statements that are in force where their signs are found.

A plugin is a name, a priority, a test of a statement (a Column function), a rewrite of its text, and the plugins that it
excludes. Which ones are in force is one row of an aggregate over all statements; rewrites are Column functions, applied in
the order of priorities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plugin:
    name: str
    priority: int
    detects: Callable[[Column], Column]
    rewrites: Callable[[Column], Column]
    excludes: tuple[str, ...] = ()


class Registry:
    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        """A name that is taken is an error."""
        if plugin.name in self.plugins:
            raise ValueError(f"plugin {plugin.name!r} is registered already")
        self.plugins[plugin.name] = plugin

    def in_force(self, statements: DataFrame, enabled: dict[str, bool] | None = None) -> list[Plugin]:
        """The plugins whose signs statements(sql) hold, or that are enabled, less those that are disabled or that one of
        higher priority (of equal ones, the first by name) excludes; in that order. Unknown names are errors."""
        if unknown := sorted(set(enabled or {}) - set(self.plugins)):
            raise ValueError(f"unknown plugins {unknown}")
        ranked = sorted(self.plugins.values(), key=lambda p: (-p.priority, p.name))
        if not ranked:
            return []
        seen = statements.agg(*[F.coalesce(F.bool_or(p.detects(F.col("sql"))), F.lit(False)).alias(p.name) for p in ranked]).first()
        on: list[Plugin] = []
        for p in ranked:
            if (enabled or {}).get(p.name, seen[p.name]) and not any(p.name in x.excludes for x in on):
                on.append(p)
        return on


def rewritten(statements: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """statements(…, sql) with the rewrites of the plugins, one after the other, on every statement."""
    return statements.withColumn("sql", reduce(lambda sql, p: p.rewrites(sql), plugins, F.col("sql")))
