import pytest
from pyspark.sql import functions as F

from palimpsest.operators import columns, evidence, graph, patterns, relate, rules, statements


def test_contexts_are_sealed_and_written(spark, tmp_path):
    rows = [("1", "now", "", [("g1", ["confirm"], [])], [("c1", "critical", ["merge", "manual_review"])], ["a"], [], [], {"n": 1})]
    context = evidence.sealed(spark.createDataFrame(rows, evidence.CONTEXT_SCHEMA))
    later = evidence.sealed(context.withColumn("generated_at", F.lit("later")))
    assert later.first()["context_hash"] == context.first()["context_hash"]
    assert evidence.sealed(context.withColumn("nodes", F.array(F.lit("b")))).first()["context_hash"] != context.first()["context_hash"]
    evidence.write_json(context, str(tmp_path / "context"))
    read = evidence.read_json(spark, str(tmp_path / "context"), evidence.CONTEXT_SCHEMA)
    assert read.first() == context.select(read.columns).first()
    seal = context.first()["context_hash"]
    good = spark.createDataFrame([("1", "1", seal, [("g1", "confirm", 0.9)], [("c1", "manual_review", 0.1)], [])], evidence.PLAN_SCHEMA)
    assert evidence.plan_issues(good, read).count() == 0
    bad = spark.createDataFrame([("2", "1", seal, [("g1", "split", 2.0)], [("c1", "merge", 0.5), ("c1", "merge", 0.5)], ["x", "x"])], evidence.PLAN_SCHEMA)
    found = {(r["code"], r["field"], r["item"]) for r in evidence.plan_issues(bad, read).collect()}
    assert found == {
        ("PLAN_INVALID", "plan_version", None), ("PLAN_INVALID", "reviews", "x"), ("PLAN_INVALID", "decisions.decision", "g1"),
        ("PLAN_INVALID", "decisions.confidence", "g1"), ("PLAN_INVALID", "resolutions", "c1"), ("LOW_CONFIDENCE", "resolutions.confidence", "c1"),
        ("CRITICAL_REVIEW", "resolutions", "c1"),
    }


def test_rules_are_registered_once(spark):
    more = (("own_rule", "table_ops", 10, ("safe",), "me"),)
    assert rules.rule_table(spark, more, ("own_rule",)).where("provider = 'me' and not enabled").count() == 1
    for wrong in ({"more": (("separate_alter", "x", 1, (), "me"),)}, {"disabled": ("no_such_rule",)}):
        with pytest.raises(ValueError):
            rules.rule_table(spark, **wrong)
    with pytest.raises(ValueError):
        patterns.compatibility(spark, ["nobody"])


def test_parts_of_columns_and_constraints():
    part = columns.column_parts("text CONSTRAINT c NOT NULL DEFAULT ('a' || coalesce((b), 'NOT NULL')) CHECK (x IS NOT NULL) REFERENCES t(id) ON DELETE SET NULL")
    assert part == {"type": "text", "default": "('a' || coalesce((b), 'NOT NULL'))", "not_null": True, "rest": "CHECK (x IS NOT NULL) REFERENCES t(id) ON DELETE SET NULL"}
    assert columns.column_parts("int DEFAULT NULL")["default"] == "NULL"
    assert columns.renamed_in("a > 0 AND b = 'a' AND a(1) REFERENCES a(a)", "a", "Z z") == "\"Z z\" > 0 AND b = 'a' AND a(1) REFERENCES a(a)"


def test_fixes_that_overlap_or_lie_outside_are_skipped(spark):
    fixes = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("past"), F.lit(t).alias("fix")) for a, b, t in ((0, 1, "X"), (2, 4, "YY"), (3, 5, "Z"), (9, 12, "no"), (5, 4, "no"))])
    assert spark.range(1).select(statements.repaired_by(F.lit("abcdef"), fixes).alias("t")).first()["t"] == "XbcZf"


def test_deep_lists_are_split_or_left_whole(spark):
    for depth, n in ((30, 3), (60, 1)):
        text = "a, f" + "(" * depth + "x, 'y)'" + ")" * depth + ", c"
        assert len(spark.range(1).select(statements.items(F.lit(text)).alias("x")).first()["x"]) == n


def test_strong_parts_and_hot_copies(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, 9)] + [(100 + i, 100 + (i + 1) % 40) for i in range(40)]
    got = graph.cycle_edges(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {(r["src"], r["dst"], r["component"], r["n_nodes"]) for r in got} == {
        (1, 2, 1, 3), (2, 3, 1, 3), (3, 1, 1, 3), (4, 5, 4, 2), (5, 4, 4, 2), *((100 + i, 100 + (i + 1) % 40, 100, 40) for i in range(40))
    }
    assert graph.cycle_edges(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("h"))
    first = relate.first_of(rows, [F.col("h")], "id")
    assert first.columns == ["id", "h", "n_copies"] and first.where("h = 'hot'").first() == (0, "hot", 1000) and first.count() == 2001
