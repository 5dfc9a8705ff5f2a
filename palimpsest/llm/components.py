"""Connected components of a graph held as rows, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """node, root of each node of edges(u long, v long): root is the smallest node that can be reached.

    Each round is two grouped minima, which combine before the shuffle, and two joins, whose hot keys AQE splits; its
    result is written to the shared folder. Edges stay one row for each node and root, so nothing grows. Self loops and
    repeated edges are harmless; nulls must not occur.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges"
    )
    before = _state(now)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of these
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = written(small.where("u != v").distinct(), "small-star")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
