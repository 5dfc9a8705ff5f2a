"""Windows over keys that may hold a large part of all rows: the order is cut into slices, and edges are carried over.

A window by key puts a key into one task. Here rows are windowed by (key, slice), slices being ranges of the order with about
equally many rows; what a row needs of rows in other slices comes from one summary row for each (key, slice), and only these
meet in a window by key: at most as many for each key as there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64
SLICE = "__slice"


def sliced(rows: DataFrame, order: str, slices: int = SLICES) -> DataFrame:
    """rows with the slice that each lies in, by about equally full ranges of the column `order` (a number or a time; others
    are one slice). Equal values lie in one slice, nulls in the first."""
    kind = dict(rows.dtypes)[order]
    if kind.startswith(("timestamp", "date")):
        value = F.col(order).cast("timestamp").cast("double")
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.col(order).cast("double")
    else:
        return rows.withColumn(SLICE, F.lit(0))
    at = [i / slices for i in range(1, slices)]
    bounds = sorted(set(rows.agg(F.percentile_approx(value, at, 2000)).first()[0] or []))
    if not bounds:
        return rows.withColumn(SLICE, F.lit(0))
    below = F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)
    return rows.withColumn(SLICE, F.when(value.isNull(), 0).otherwise(F.size(below)))


def within(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, SLICE)


def across(keys: list[str]) -> Window:
    """Over the summary rows of a key."""
    return Window.partitionBy(*keys).orderBy(SLICE)


def earlier(keys: list[str]) -> Window:
    """The summary rows of a key's slices before."""
    return across(keys).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows(…, slice) with the columns of `carry`: windows (see across, earlier) over the aggregates `summary` of each (keys,
    slice). Null keys are a key like any other."""
    sums = rows.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in summary.items()])
    over = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("__s"), *[c.alias(n) for n, c in carry.items()])
    same = F.col(SLICE) == F.col("__s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(over, same).drop("__s", *[f"__k{i}" for i in range(len(keys))])
