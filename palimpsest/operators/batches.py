"""Batches of an ordered list of changes: gaps and islands, conflicts, warnings, and what stays pending.

The list is cut by stream (a column), so batches of different streams are found in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import slices


def in_batches(log: DataFrame, stream: str, alone: Column, *order: str) -> DataFrame:
    """log with `batch`, counted from 1 within its stream: a change for which `alone` holds is a batch by itself and
    ends the one before."""
    at, w = F.struct(*order), slices.within([stream]).orderBy(*order)
    own = slices.sliced(log.withColumn("alone", alone), order[0])
    # what stands at the end of the slice before, then how many batches begin in all slices before
    over = slices.across([stream])
    own = slices.carried(own, [stream], {"__end": F.max_by("alone", at)}, {"__before": F.coalesce(F.lag("__end").over(over), F.lit(True))})
    before = F.when(F.lag(F.lit(True)).over(w).isNull(), F.col("__before")).otherwise(F.lag("alone").over(w))
    own = own.withColumn("starts", F.when(F.col("alone") | before, 1).otherwise(0))
    own = slices.carried(own, [stream], {"__n": F.sum("starts")}, {"__sum": F.coalesce(F.sum("__n").over(slices.earlier([stream])), F.lit(0))})
    batch = F.col("__sum") + F.sum("starts").over(w)
    return own.withColumn("batch", batch.cast("long")).drop("starts", "__before", "__sum", slices.SLICE)


def batch_summary(batched: DataFrame, stream: str, exclusive: Column) -> DataFrame:
    """Size, exclusiveness and distinct targets of each batch of batched(…, batch, alone, target)."""
    return batched.groupBy(stream, "batch").agg(
        F.count("*").alias("n_changes"),
        F.max("alone").alias("alone"),
        F.max(exclusive).alias("exclusive"),
        F.count_distinct("target").alias("n_targets"),
    )


def altered_targets(statements: DataFrame, stream: str) -> DataFrame:
    """stream, batch, targets: the distinct tables that statements(stream, batch, operation, object_type, object_name) of each
    batch alter, sorted."""
    own = statements.where("operation = 'ALTER' and object_type = 'TABLE' and object_name is not null")
    return own.groupBy(stream, "batch").agg(F.array_sort(F.collect_set("object_name")).alias("targets"))


def lock_conflicts(batched: DataFrame, stream: str, exclusive: Column, concurrent: Column, position: str) -> DataFrame:
    """Pairs of changes of one target in the same or the next batch: HIGH if both are exclusive, MEDIUM if one is
    concurrent and the other not, LOW if they are neither but lie in different batches.

    The pairs meet in an equi join by target and batch, never in a range join: a change offers itself to its own batch
    and to the next one.
    """
    own = batched.withColumn("x", exclusive).withColumn("c", concurrent)
    fields = [F.col(position).alias("p"), F.col("batch").alias("b"), "x", "c"]
    left = own.select(stream, "target", *fields).withColumn("meet", F.explode(F.array(F.col("b"), F.col("b") + 1)))
    right = own.select(stream, "target", *fields).withColumn("meet", F.col("b"))
    a, z = left.alias("a"), right.alias("z")
    same = (F.col(f"a.{stream}") == F.col(f"z.{stream}")) & (F.col("a.target") == F.col("z.target"))
    pairs = a.join(z, same & (F.col("a.meet") == F.col("z.meet"))).where("a.b < z.b or (a.b = z.b and a.p < z.p)")
    severity = (
        F.when(F.col("a.x") & F.col("z.x"), "HIGH")
        .when(F.col("a.c") != F.col("z.c"), "MEDIUM")
        .when(F.col("a.b") != F.col("z.b"), "LOW")
    )
    return pairs.select(
        F.col(f"a.{stream}").alias(stream),
        F.col("a.target").alias("target"),
        F.col("a.p").alias("first"),
        F.col("z.p").alias("second"),
        severity.alias("severity"),
    ).where("severity is not null")


def warnings(summaries: DataFrame, stream: str, most: int = 50) -> DataFrame:
    """A row for each warning of a batch: LARGE (over `most` changes), EXCLUSIVE, MANY_TARGETS (over one, not alone)."""
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("n_changes") > most, F.lit("LARGE")),
            F.when(c("exclusive"), F.lit("EXCLUSIVE")),
            F.when(~c("alone") & (c("n_targets") > 1), F.lit("MANY_TARGETS")),
        )
    )
    return summaries.select(stream, "batch", "n_changes", "n_targets", F.explode(found).alias("warning"))


def pending(actions: DataFrame, adds: Column, clears: Column, *order: str) -> DataFrame:
    """key, since of actions(key, …) whose last deciding action adds; actions that neither add nor clear don't count."""
    at = F.struct(*order)
    own = actions.withColumn("adds", adds).where(adds | clears)
    last = own.groupBy("key").agg(F.max_by("adds", at).alias("open"), F.max(at).alias("at"), F.count("*").alias("n_actions"))
    return last.where("open").select("key", F.col(f"at.{order[-1]}").alias("since"), "n_actions")


def statement_warnings(statements: DataFrame, stream: str, most: int = 50, most_concurrent: int = 5) -> DataFrame:
    """stream, batch, warning, n of the batches of statements(stream, batch, alone, sql, lock_level, no_transaction,
    execution_time, object_name): LARGE, SLOW, EXCLUSIVE, MANY_TARGETS (tables altered in one transaction), NOT_VALID
    (constraints added without it), NOT_CONCURRENT (indexes made or dropped so); and MANY_CONCURRENT for a stream, with a
    null batch. n counts what the warning is about."""
    from palimpsest.operators.statements import bare

    b, c = bare(F.col("sql")), F.col
    alters = b.startswith("ALTER TABLE ")
    adds = alters & b.rlike(r"\bADD CONSTRAINT\b|\bADD (CHECK|FOREIGN KEY|UNIQUE|PRIMARY KEY)\b") & ~b.rlike(r"\bNOT VALID\b")
    locks = b.rlike(r"^(CREATE (UNIQUE )?INDEX|DROP INDEX|REINDEX)\b") & ~b.rlike(r"\bCONCURRENTLY\b")
    batches = statements.groupBy(stream, "batch").agg(
        F.count("*").alias("n"),
        F.count_if(c("execution_time") == "SLOW").alias("slow"),
        F.count_if(c("lock_level") == "ACCESS_EXCLUSIVE").alias("exclusive"),
        F.count_distinct(F.when(alters & ~c("no_transaction"), c("object_name"))).alias("targets"),
        F.count_if(adds).alias("not_valid"),
        F.count_if(locks).alias("not_concurrent"),
    )
    cases = (("LARGE", "n", c("n") > most), ("SLOW", "slow", c("slow") > 0), ("EXCLUSIVE", "exclusive", c("exclusive") > 0),
             ("MANY_TARGETS", "targets", c("targets") > 1), ("NOT_VALID", "not_valid", c("not_valid") > 0), ("NOT_CONCURRENT", "not_concurrent", c("not_concurrent") > 0))
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(name).alias("warning"), c(n).alias("n"))) for name, n, hit in cases]))
    each = batches.select(stream, "batch", F.inline(found))
    busy = statements.groupBy(stream).agg(F.count_if(b.rlike(r"\bCONCURRENTLY\b")).alias("n")).where(F.col("n") > most_concurrent)
    return each.unionByName(busy.select(stream, F.lit(None).cast("long").alias("batch"), F.lit("MANY_CONCURRENT").alias("warning"), "n"))
