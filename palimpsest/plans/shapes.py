"""Queries over scripts made from the driver's tables: each row's key picks one of a list of shapes, with the key put in.

The SQL states the expected result of each shape literally, so it shares nothing with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.history import table

QUERIES, ORACLES = {}, {}


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def filled(text: str | Column, key: Column) -> Column:
    return F.replace(F.lit(text) if isinstance(text, str) else text, F.lit("{n}"), key.cast("string"))


def shaped(spark: SparkSession, sf_dir: str, source: tuple[str, str], shapes: list[str]) -> DataFrame:
    """n, sql: a row for each key of a table, source being (table, key)."""
    key = F.col(source[1])
    pick = F.get(F.array(*map(F.lit, shapes)), F.pmod(key, F.lit(len(shapes))).cast("int"))
    return table(spark, sf_dir, source[0]).select(key.cast("long").alias("n"), filled(pick, key).alias("sql"))


def case(values: list, key: str, cast: str | None = None) -> str:
    """SQL of the value of a key's shape, with the key put in."""
    whens = " ".join(f"WHEN {i} THEN {quoted(v) if v is None or isinstance(v, str) else v}" for i, v in enumerate(values))
    text = f"CASE {key} % {len(values)} {whens} END"
    if cast:
        return f"CAST({text} AS {cast})"
    return f"replace({text}, '{{n}}', CAST({key} AS VARCHAR))"


def expected(source: tuple[str, str], columns: dict[str, tuple[list, str | None]]) -> str:
    own = ", ".join(f"{case(values, source[1], cast)} AS {name}" for name, (values, cast) in columns.items())
    return f"SELECT CAST({source[1]} AS BIGINT) AS n, {own} FROM {source[0]}"


def expected_rows(source: tuple[str, str], columns: list[str], rows: list[list[tuple]], casts: dict[str, str] | None = None) -> str:
    """SQL of several rows for each shape: rows[shape] lists their values, text with the key put in where it says so."""
    casts = casts or {}
    shapes = []
    for i, some in enumerate(rows):
        for row in some:
            values = []
            for name, v in zip(columns, row, strict=True):
                text = quoted(v) if v is None or isinstance(v, str) else str(v)
                if isinstance(v, str) and "{n}" in v:
                    text = f"replace({text}, '{{n}}', CAST({source[1]} AS VARCHAR))"
                values.append(f"CAST({text} AS {casts.get(name, 'VARCHAR')}) AS {name}")
            shapes.append(f"SELECT CAST({source[1]} AS BIGINT) AS n, {', '.join(values)} FROM {source[0]} WHERE {source[1]} % {len(rows)} = {i}")
    return "\nUNION ALL ".join(shapes)


def registered(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def told(name: str, source: tuple[str, str], made: dict[str, Callable[[Column], Column]], casts: dict[str, str], cases: list[tuple]) -> None:
    """A query of Column functions over statements. cases: (statement, expected value of each function, …)."""
    shapes = [c[0] for c in cases]
    columns = {k: ([c[i + 1] for c in cases], casts.get(k)) for i, k in enumerate(made)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(spark, sf_dir, source, shapes).select("n", *[f(F.col("sql")).alias(k) for k, f in made.items()])

    registered(name, expected(source, columns), run)
