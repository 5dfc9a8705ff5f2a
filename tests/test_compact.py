from palimpsest.operators import columns, statements
from palimpsest.plans import compact as c


def scripts(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "seq long, content string")


def built(spark, *texts):
    return [r["sql"] for r in c.compact(scripts(spark, *texts)).orderBy("position").collect()]


def test_alters_fold_into_create(spark):
    got = built(
        spark,
        "CREATE TABLE users (id serial PRIMARY KEY, name varchar(20) DEFAULT 'a, b' NOT NULL, old int, total decimal(10,2) CHECK (total > 0))",
        "ALTER TABLE users ADD COLUMN email text, DROP COLUMN old; ALTER TABLE users RENAME COLUMN name TO full_name;",
        "ALTER TABLE users ALTER COLUMN full_name TYPE text; ALTER TABLE users ALTER email SET DEFAULT 'x'; ALTER TABLE users ALTER full_name DROP NOT NULL;"
        "ALTER TABLE users ADD CONSTRAINT c CHECK (id > 0) NOT VALID; ALTER TABLE users VALIDATE CONSTRAINT c; ALTER TABLE users ENABLE ROW LEVEL SECURITY",
    )
    assert got == [
        "CREATE TABLE users (id serial PRIMARY KEY, full_name text DEFAULT 'a, b', total decimal(10,2) CHECK (total > 0), email text DEFAULT 'x', CONSTRAINT c CHECK (id > 0))",
        "ALTER TABLE users ENABLE ROW LEVEL SECURITY",
    ]


def test_dropped_objects_and_their_dependents_go(spark):
    got = built(
        spark,
        "CREATE TABLE a (id int); CREATE TABLE b (id int); CREATE INDEX i ON a (id); CREATE INDEX j ON b (id);"
        "INSERT INTO a VALUES (1); INSERT INTO b VALUES ('x;y'); CREATE VIEW v AS SELECT * FROM b; CREATE VIEW w AS SELECT 1",
        "DROP TABLE a; DROP VIEW w; CREATE TABLE t (x int); DROP TABLE t; CREATE TABLE t (y int)",
    )
    assert got == ["CREATE TABLE b (id int)", "CREATE TABLE t (y int)", "CREATE INDEX j ON b (id)", "CREATE VIEW v AS SELECT * FROM b", "INSERT INTO b VALUES ('x;y')"]


def test_order_cycles_enums_grants(spark):
    got = built(
        spark,
        "CREATE TABLE z (id int PRIMARY KEY, s status); CREATE TYPE status AS ENUM ('a', 'c');"
        "CREATE TABLE y (id int, z int REFERENCES z(id) ON DELETE CASCADE); ALTER TABLE z ADD COLUMN y int REFERENCES y(id);"
        "CREATE TABLE p (id int); CREATE TABLE b (p int REFERENCES p(id)); CREATE FUNCTION f() RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql",
        "ALTER TYPE status ADD VALUE 'b' AFTER 'a'; ALTER TYPE status ADD VALUE 'd'; GRANT SELECT, INSERT ON p TO ann, bob; REVOKE INSERT ON p FROM bob;"
        "CREATE OR REPLACE FUNCTION f() RETURNS int AS $$ SELECT 2; $$ LANGUAGE sql; GRANT ALL ON b TO cy; REVOKE ALL ON b FROM cy",
    )
    assert got == [
        "CREATE TYPE status AS ENUM ('a', 'b', 'c', 'd')",
        "CREATE TABLE p (id int)", "CREATE TABLE y (id int, z int)", "CREATE TABLE z (id int PRIMARY KEY, s status, y int)", "CREATE TABLE b (p int REFERENCES p(id))",
        "ALTER TABLE y ADD FOREIGN KEY (z) REFERENCES z(id) ON DELETE CASCADE", "ALTER TABLE z ADD FOREIGN KEY (y) REFERENCES y(id)",
        "CREATE OR REPLACE FUNCTION f() RETURNS int AS $$ SELECT 2; $$ LANGUAGE sql",
        "GRANT INSERT, SELECT ON p TO ann", "GRANT SELECT ON p TO bob",
    ]


def test_enum_values_on_added_anchors_and_dropped_types(spark):
    got = built(
        spark,
        "CREATE TYPE s AS ENUM ('x', 'y'); ALTER TYPE s ADD VALUE 'a' AFTER 'x'; ALTER TYPE s ADD VALUE 'b' AFTER 'a';"
        "ALTER TYPE s ADD VALUE 'c' BEFORE 'b'; ALTER TYPE s ADD VALUE 'd' BEFORE 'a'; ALTER TYPE s ADD VALUE 'e' AFTER 'x';"
        "CREATE TYPE t AS ENUM ('old'); ALTER TYPE t ADD VALUE 'older' BEFORE 'old'; DROP TYPE t; CREATE TYPE t AS ENUM ('new')",
        "ALTER TYPE t ADD VALUE 'newer'; ALTER TYPE t ADD VALUE 'newest' AFTER 'newer'",
    )
    assert got == ["CREATE TYPE s AS ENUM ('x', 'e', 'd', 'a', 'c', 'b', 'y')", "CREATE TYPE t AS ENUM ('new', 'newer', 'newest')"]


def test_compaction_is_idempotent_and_equivalent(spark):
    one = ["CREATE TABLE a (id int, b text)", "ALTER TABLE a ADD c int; ALTER TABLE a DROP COLUMN b"]
    once = built(spark, *one)
    assert built(spark, ";\n".join(once)) == once
    assert c.equivalence(scripts(spark, *one), scripts(spark, "CREATE TABLE a (id  int, c int);")).count() == 0
    assert c.equivalence(scripts(spark, *one), scripts(spark, "CREATE TABLE a (id int, c bigint)")).count() == 2
    assert built(spark, "-- nothing", "", "SELECT 1") == []


def test_reports(spark):
    s = scripts(spark, "CREATE TABLE a (id int); ALTER TABLE a ADD b int; ALTER TABLE a ADD d int", "DROP TABLE a; CREATE VIEW v AS SELECT 1")
    r = c.report(s).first()
    assert (r["n_objects"], r["n_before"]) == (2, 5) and r["n_after"] < 5
    codes = sorted(x["code"] for x in c.lint(s).collect())
    assert codes == ["ban-drop-table", "prefer-bigint", "prefer-bigint", "prefer-bigint"]


def test_column_operations(spark):
    own = spark.createDataFrame([(1, 0, 'ALTER TABLE "Big T" ADD x numeric(10, 2) DEFAULT f(1, 2), DROP CONSTRAINT IF EXISTS k, CLUSTER ON i')], "seq long, idx long, sql string")
    got = columns.column_operations(statements.analysed(own)).orderBy("sub").collect()
    assert [(r["key"], r["op"], r["column"], r["arg"]) for r in got] == [
        ("Big T", "ADD", "x", "numeric(10, 2) DEFAULT f(1, 2)"), ("Big T", "DROP_CONSTRAINT", "k", ""), ("Big T", "OTHER", "", "CLUSTER ON i"),
    ]
