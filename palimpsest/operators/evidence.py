"""Evidence of a compaction as rows and JSON: contexts with a hash, plans checked against them, provenance, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import graph

CONTEXT_SCHEMA = (
    "context_version string, generated_at string, context_hash string, "
    "candidates array<struct<group_id: string, allowed_actions: array<string>, blocked_by: array<string>>>, "
    "cases array<struct<case_id: string, risk_level: string, allowed_decisions: array<string>>>, "
    "nodes array<string>, edges array<struct<src: string, dst: string>>, cycles array<array<string>>, metrics map<string, bigint>"
)
PLAN_SCHEMA = (
    "plan_version string, context_version string, context_hash string, "
    "decisions array<struct<group_id: string, decision: string, confidence: double>>, "
    "resolutions array<struct<case_id: string, decision: string, confidence: double>>, reviews array<string>"
)
PROVENANCE_SCHEMA = "source_file string, source_idx bigint, target_file string, target_position bigint, rule string"
VERSION = "1"


def context_hash(context: DataFrame) -> Column:
    """SHA-256 of the JSON of a context's columns in the order of their names, without the hash itself and the time."""
    own = sorted(set(context.columns) - {"context_hash", "generated_at"})
    text = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
    return F.sha2(F.encode(text, "UTF-8"), 256)


def sealed(context: DataFrame) -> DataFrame:
    """context with its hash put in."""
    return context.withColumn("context_hash", context_hash(context))


def schema_evidence(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, value rows of a schema: object (kind:name), edge (src > dst) and cycle (nodes of a shortest cycle of each
    strongly connected part), each once. objects(kind, name), edges(src, dst)."""
    own = objects.select(F.lit("object").alias("kind"), F.concat_ws(":", F.lower("kind"), "name").alias("value"))
    arrows = graph.clean(edges).select(F.lit("edge").alias("kind"), F.concat_ws(" > ", "src", "dst").alias("value"))
    cycles = graph.cycle_paths(edges).select(F.lit("cycle").alias("kind"), F.array_join("path", " > ").alias("value"))
    return own.distinct().unionByName(arrows).unionByName(cycles)


def plan_issues(plan: DataFrame, context: DataFrame, *, threshold: float = 0.85, review_critical: bool = True) -> DataFrame:
    """code, field, item of what is wrong with plan (one row of PLAN_SCHEMA) for context (one row of CONTEXT_SCHEMA); no row if
    it is valid. Items are joined by their ids."""
    c, p = context.withColumn("computed", context_hash(context)), plan
    # one row of each, side by side
    sides = p.select("plan_version", F.col("context_version").alias("p_version"), F.col("context_hash").alias("p_hash")).unionByName(
        c.select("context_version", "context_hash", "computed"), allowMissingColumns=True
    )
    head = sides.agg(*[F.max(x).alias(x) for x in sides.columns])
    issue = lambda code, field, hit: F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    version, own = F.trim("context_version"), F.trim("context_hash")
    checks = F.array_compact(F.array(
        issue("PLAN_INVALID", "plan_version", ~F.col("plan_version").eqNullSafe(F.lit(VERSION))),
        issue("PLAN_INVALID", "context_version", ~version.eqNullSafe(F.lit(VERSION)) | ~F.trim("p_version").eqNullSafe(version)),
        issue("CONTEXT_INTEGRITY", "context_hash", ~own.eqNullSafe(F.col("computed"))),
        issue("PLAN_INVALID", "context_hash", ~F.trim("p_hash").eqNullSafe(own)),
    ))
    heads = head.select(F.inline(checks)).select("code", "field", F.lit(None).cast("string").alias("item"))

    candidates, cases = c.select(F.inline("candidates")), c.select(F.inline("cases"))
    decisions, resolutions = p.select(F.inline("decisions")), p.select(F.inline("resolutions"))
    reviews = p.select(F.explode("reviews").alias("id"))

    def rows(df: DataFrame, code: str, field: str, item: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(field).alias("field"), F.col(item).alias("item"))

    def twice(df: DataFrame, key: str, code: str, field: str) -> DataFrame:
        return rows(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), code, field, key)

    ids = candidates.select(F.col("group_id").alias("id")).unionByName(cases.select(F.col("case_id").alias("id"))).distinct()
    decided = decisions.join(candidates.dropDuplicates(["group_id"]), "group_id")
    solved = resolutions.join(cases.dropDuplicates(["case_id"]), "case_id")
    confirmed = decisions.where("decision = 'confirm'").select(F.col("group_id").alias("b")).distinct()
    blocked = decided.where("decision = 'confirm'").select("group_id", F.explode("blocked_by").alias("b")).join(confirmed, "b", "left_anti")
    unsure = lambda df, key: df.where(F.col("confidence") < threshold).join(reviews.withColumnRenamed("id", key), key, "left_anti")
    wrong = ~F.col("decision").isin("confirm", "reject", "split") | ((F.size("allowed_actions") > 0) & ~F.array_contains("allowed_actions", F.col("decision")))
    found = [
        heads,
        twice(candidates, "group_id", "CONTEXT_INVALID", "candidates"),
        twice(cases, "case_id", "CONTEXT_INVALID", "cases"),
        twice(reviews, "id", "PLAN_INVALID", "reviews"),
        rows(reviews.join(ids, "id", "left_anti"), "PLAN_INVALID", "reviews", "id"),
        twice(decisions, "group_id", "PLAN_INVALID", "decisions"),
        twice(resolutions, "case_id", "PLAN_INVALID", "resolutions"),
        rows(candidates.select("group_id").distinct().join(decisions, "group_id", "left_anti"), "PLAN_INCOMPLETE", "decisions", "group_id"),
        rows(cases.select("case_id").distinct().join(resolutions, "case_id", "left_anti"), "PLAN_INCOMPLETE", "resolutions", "case_id"),
        rows(decisions.join(candidates, "group_id", "left_anti"), "PLAN_INVALID", "decisions", "group_id"),
        rows(resolutions.join(cases, "case_id", "left_anti"), "PLAN_INVALID", "resolutions", "case_id"),
        rows(decided.where(wrong), "PLAN_INVALID", "decisions.decision", "group_id"),
        rows(decided.where("confidence < 0 or confidence > 1"), "PLAN_INVALID", "decisions.confidence", "group_id"),
        rows(solved.where("confidence < 0 or confidence > 1"), "PLAN_INVALID", "resolutions.confidence", "case_id"),
        rows(solved.where(~F.array_contains("allowed_decisions", F.col("decision"))), "PLAN_INVALID", "resolutions.decision", "case_id"),
        rows(blocked, "DEPENDENCY_ORDER", "decisions", "group_id"),
        rows(unsure(decided, "group_id"), "LOW_CONFIDENCE", "decisions.confidence", "group_id"),
        rows(unsure(solved.where("decision != 'manual_review'"), "case_id"), "LOW_CONFIDENCE", "resolutions.confidence", "case_id"),
    ]
    if review_critical:
        found.append(rows(solved.where("lower(risk_level) = 'critical' and decision != 'manual_review'"), "CRITICAL_REVIEW", "resolutions", "case_id"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def provenance(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_file, source_idx, target_file, target_position, rule: from which statements before(key, file, idx) each
    statement after(key, position, rule) of the same object comes."""
    a = before.select("key", F.col("file").cast("string").alias("source_file"), F.col("idx").cast("long").alias("source_idx"))
    b = after.select("key", F.col("position").cast("long").alias("target_position"), "rule")
    return a.join(b, "key").select("source_file", "source_idx", F.lit("compacted.sql").alias("target_file"), "target_position", "rule")


def comparison_outcome(runs: DataFrame) -> DataFrame:
    """runs(…, apply_error, n_differences) with comparison_valid and success: an error while applying makes the comparison
    invalid; no comparison (null) is no success."""
    valid = F.col("apply_error").isNull()
    return runs.withColumn("comparison_valid", valid).withColumn("success", valid & F.coalesce(F.col("n_differences") == 0, F.lit(False)))


def analysis_actions(totals: DataFrame) -> DataFrame:
    """action, reason, priority, risk of totals(n_redundant, n_warnings, reduction_pct), one row: what to do after an
    analysis; guarded_apply with a low priority if nothing else is called for."""
    n, w, r = F.col("n_redundant"), F.col("n_warnings"), F.col("reduction_pct")
    row = lambda action, reason, priority, risk: F.struct(F.lit(action).alias("action"), reason.alias("reason"), F.lit(priority).alias("priority"), F.lit(risk).alias("risk"))
    found = F.array_compact(F.array(
        F.when(n > 0, row("auto_cleanup", F.concat(n.cast("string"), F.lit(" redundant operations can go")), "high", "safe")),
        F.when(w > 0, row("manual_review", F.concat(w.cast("string"), F.lit(" warnings to look at first")), "medium", "moderate")),
        F.when(r >= 50, row("guarded_apply", F.lit("much can go: validate the result before use"), "medium", "safe")),
    ))
    nothing = F.array(row("guarded_apply", F.lit("nothing stands in the way"), "low", "safe"))
    return totals.select(F.inline(F.when(F.size(found) > 0, found).otherwise(nothing)))


def summaries(actions: DataFrame) -> DataFrame:
    """One row: the distinct non-empty reasons (or names) of actions, in order of their texts, as `summary`."""
    text = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.replace("action", F.lit("_"), F.lit(" ")))
    return actions.agg(F.array_join(F.array_sort(F.collect_set(text)), "; ").alias("summary"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in files of a new folder."""
    rows.write.mode("errorifexists").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_json wrote: contexts, plans, provenance or reports, by their schema."""
    return spark.read.schema(schema).json(path)
