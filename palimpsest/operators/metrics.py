"""Reports on compaction: reductions, breakdowns, recommended actions, evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Rounded to two places; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / F.when(whole == 0, 1).otherwise(whole), 2))


def reduction(plan: DataFrame) -> DataFrame:
    """One row of totals of a compaction plan (key, rule, n_before, n_after)."""
    total = plan.agg(
        F.count("*").alias("n_objects"),
        F.coalesce(F.sum("n_before"), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("n_after"), F.lit(0)).alias("n_after"),
        F.count_if(F.col("n_after") < F.col("n_before")).alias("n_reduced"),
    )
    return total.withColumn("reduction_pct", percent(F.col("n_before") - F.col("n_after"), F.col("n_before")))


def by_rule(plan: DataFrame) -> DataFrame:
    return plan.groupBy("rule").agg(
        F.count("*").alias("n_objects"), F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after")
    )


#: Actions, with the least (True) or most (False) reduction in percent at which they are advised.
ACTIONS = (
    ("apply", True, 35.0),
    ("review", True, 15.0),
    ("raise_safety_level", False, 15.0),
)


def recommendations(totals: DataFrame) -> DataFrame:
    """A row for each action that a row of reduction() calls for."""
    r = F.col("reduction_pct")
    found = F.array_compact(
        F.array(*[F.when(r >= at if least else r < at, F.struct(F.lit(a).alias("action"), r.alias("reduction_pct"))) for a, least, at in ACTIONS])
    )
    return totals.select(F.inline(found))


def evidence(statements: DataFrame, script: str) -> DataFrame:
    """For each script: number of statements, checksum of their texts in order, distinct operations and objects, and
    whether it is safe to compact (nothing dropped, nothing dynamic). statements(script, idx, sql, operation, …)."""
    dynamic = F.upper("sql").rlike(r"\bEXECUTE (FORMAT|CONCAT|')|\bFOREACH\b")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "sql"))), lambda x: x["sql"])
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return statements.groupBy(script).agg(
        F.count("*").alias("n_statements"),
        F.sha2(F.encode(F.array_join(texts, "\n"), "UTF-8"), 256).alias("checksum"),
        joined("operation").alias("operations"),
        joined(F.concat_ws(":", "object_type", "object_name")).alias("objects"),
        (~F.max((F.col("operation") == "DROP") | dynamic)).alias("safe"),
    )


def prometheus(totals: DataFrame, prefix: str) -> DataFrame:
    """The numbers of a one-row table as lines of a metrics page."""
    numbers = [c for c, t in totals.dtypes if t in ("int", "bigint", "double")]
    lines = F.array(*[F.concat(F.lit(f"{prefix}_{c} "), F.col(c).cast("string")) for c in numbers])
    return totals.select(F.explode(lines).alias("value"))
