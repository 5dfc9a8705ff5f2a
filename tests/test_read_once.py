"""Statements are read once, by all cores, and tables are folded without groups of their own."""

from palimpsest.operators import columns, statements
from palimpsest.plans import compact as c
from palimpsest.plans import catalog_queries, script_queries


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_plan_of_objects_does_not_read_statements_again(spark):
    scripts = spark.createDataFrame([(1, "CREATE TABLE t (a int); ALTER TABLE t ADD b int"), (2, "DROP TABLE t")], "seq long, content string")
    plan = c.analyze(scripts)
    assert "regexp_extract" not in planned(plan)
    assert [(r["key"], r["rule"], r["n_before"], r["pattern"]) for r in plan.collect()] == [("t::TABLE", "create_alter", 3, "CREATE_ALTER")]


def test_scripts_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    spark.range(9).selectExpr("id as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    scripts = script_queries.history(spark, str(tmp_path), script_queries.CUSTOMERS, ["CREATE TABLE t{n} (a int)"])
    assert scripts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tables_are_folded_as_they_come(spark):
    long = "CREATE TABLE t (a int); " + "; ".join(f"ALTER TABLE t ADD c{i} int, DROP c{i - 1}" for i in range(1, 40))
    texts = [(i, f"CREATE TABLE u{i} (a int DEFAULT {i})") for i in range(2, 20)]
    scripts = spark.createDataFrame([(1, long), *texts], "seq long, content string")
    changes = columns.column_operations(statements.told(statements.split(scripts, "seq"), "operation", "object_type"))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        states = columns.table_states(changes)
        assert "FlatMapGroups" not in planned(states)
        rows = sorted((r["key"], r["place"], r["text"]) for r in states.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert rows == sorted([("t", 0, "a int"), ("t", 1, "c39 int"), *[(f"u{i}", 0, f"a int DEFAULT {i}") for i in range(2, 20)]])


def test_catalog_scripts_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(9).selectExpr("id as s_suppkey", "'s' as s_name", "1 as s_nationkey", "0.5D as s_acctbal")
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert catalog_queries.scripts(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
