from pyspark.sql import functions as F

from palimpsest.operators import patterns as p


def values(spark, texts, make):
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, x string")
    return [r["y"] for r in own.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def rows(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "seq long, idx long, sql string")


def test_tags(spark):
    assert values(spark, ["SELECT auth.uid()", "x"], p.foreign_references) == [["auth.uid()"], []]
    tags = ["auth.jwt() ->> 'sub'", "CREATE POLICY a ON storage.objects", "ALTER TABLE t ENABLE ROW LEVEL SECURITY", "SELECT current_user", "SELECT 1"]
    assert values(spark, tags, p.auth_pattern) == ["jwt", "storage_policy", "row_security", "session", "none"]
    assert values(spark, ["EXECUTE format('x')", "EXECUTE p"], p.is_dynamic) == [True, False]
    block = "DO $x$ BEGIN CREATE TYPE mood AS ENUM ('a'); IF true THEN NULL; ALTER TABLE t  ADD c int; END $x$"
    assert values(spark, [block], p.block_statements) == [["CREATE TYPE mood AS ENUM ('a')", "ALTER TABLE t ADD c int"]]
    assert values(spark, [block], p.nested_types) == [["mood"]]
    assert values(spark, ["a\nb\nc"], lambda x: p.line_of(x, F.lit(4))) == [3]
    assert values(spark, ["COMMENT ON COLUMN s.t.c IS 'x'", "COMMENT ON TABLE t IS 'x'"], p.comment_target) == ["table:s.t", "table:t"]
    assert values(spark, ["INSERT INTO t", "SELECT 1", "a + 1", ""], p.volatility) == ["VOLATILE", "STABLE", "IMMUTABLE", "STABLE"]
    assert values(spark, ["a/b/c.sql", "c.sql", "a/c.txt"], lambda x: p.matches_glob(x, "**/*.sql")) == [True, True, False]
    assert values(spark, ["a/b.sql", "a/b/c.sql"], lambda x: p.matches_glob(x, "a/?.sql")) == [True, False]


def test_rollback(spark):
    got = p.rollback(rows(spark, "CREATE TABLE t (a int)", "ALTER TABLE t ADD COLUMN b int", "ALTER TABLE t RENAME COLUMN a TO c", "ALTER TABLE t ADD CONSTRAINT k CHECK (a > 0)",
                          "GRANT SELECT ON t TO u", "DELETE FROM t", "CREATE TYPE e AS ENUM ('x')"))
    assert [(r["seq"], r["sql"], r["seconds"]) for r in got.orderBy("seq").collect()] == [
        (0, "DROP TABLE IF EXISTS t", 3), (1, "ALTER TABLE t DROP COLUMN IF EXISTS b", 6), (2, "ALTER TABLE t RENAME COLUMN c TO a", 6),
        (3, "ALTER TABLE t DROP CONSTRAINT IF EXISTS k", 6), (5, "-- can't be undone: DELETE FROM t", 1), (6, "DROP TYPE IF EXISTS e", 1),
    ]


def test_publications_extensions_vendors_names(spark):
    own = rows(spark, "ALTER PUBLICATION p ADD TABLE a", "ALTER PUBLICATION p ADD TABLE public.a", "ALTER PUBLICATION q ADD TABLE ONLY s.b")
    assert sorted(tuple(r) for r in p.publication_targets(own).collect()) == [(0, 0, "p", "public.a"), (2, 0, "q", "s.b")]
    own = rows(spark, 'CREATE EXTENSION "zz"', "CREATE EXTENSION IF NOT EXISTS earthdistance", "CREATE EXTENSION cube", "create extension CUBE")
    assert [r["name"] for r in p.extensions(own).orderBy("place").collect()] == ["cube", "earthdistance", "zz"]
    own = rows(spark, "SELECT auth.uid()", "CREATE TABLE _prisma_migrations (a int)", "--> statement-breakpoint")
    assert {r["vendor"] for r in p.vendors(own).collect()} == {"supabase", "prisma"}
    assert p.vendors(own.where("false")).count() == 0
    catalog = spark.createDataFrame([("public", "t"), ("app", "t"), ("app", "u")], "schema string, object string")
    names = spark.createDataFrame([("t",), ("u",), ("public.u",), ("App.t",), ("x",)], "name string")
    got = {r["name"]: r["schema"] for r in p.resolved(names, catalog, ["app", "public"]).collect()}
    assert got == {"t": "app", "u": "app", "public.u": None, "App.t": "app", "x": None}
    from palimpsest.operators.statements import analysed

    named = analysed(rows(spark, "CREATE INDEX foo ON t (a)", "CREATE TABLE users (a int)", 'CREATE TABLE "order" (a int)'))
    assert sorted((r["seq"], r["warning"]) for r in p.naming_warnings(named, "seq").collect()) == [(0, "INDEX_NAME"), (2, "RESERVED_WORD")]
