"""Queries of the operators on histories of scripts: compaction, columns, enums, grants, renames, comparisons, evidence,
graphs. Each history is made from a driver's table, one small script for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import rewrites
from palimpsest.operators import batches, changelog, columns, evidence, graph, metrics, plugins, relate, rules, signature, statements
from palimpsest.plans import compact as c
from palimpsest.plans.history import LOG, log, spread, table
from palimpsest.plans.shapes import expected, expected_rows, filled, registered, shaped

SUPPLIERS, NATIONS, CUSTOMERS, ORDERS, PARTS = (
    ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"),
)
LONG, BOOL = "BIGINT", "BOOLEAN"


def history(spark, sf_dir, source, shapes) -> DataFrame:
    """seq, content: a script for each key."""
    return spread(shaped(spark, sf_dir, source, shapes).select(F.col("n").alias("seq"), F.col("sql").alias("content")), "seq")


def split(scripts: DataFrame) -> DataFrame:
    return statements.analysed(statements.split(scripts, "seq"))


def changes(scripts: DataFrame) -> DataFrame:
    """The column operations of scripts."""
    return columns.column_operations(statements.told(statements.split(scripts, "seq"), "operation", "object_type"))


#: A script, and the statements that are left of it: phase, key, text.
_COMPACTED = [
    ("CREATE TABLE t{n} (id int, name varchar(20)); ALTER TABLE t{n} ADD COLUMN c text DEFAULT 'a;b', DROP COLUMN name; INSERT INTO t{n} VALUES (1)",
     [("structure", "t{n}::TABLE", "CREATE TABLE t{n} (id int, c text DEFAULT 'a;b')"), ("data", None, "INSERT INTO t{n} VALUES (1)")]),
    ("CREATE TABLE t{n} (a int, CONSTRAINT k CHECK (a > 0)); ALTER TABLE t{n} RENAME COLUMN a TO b; CREATE INDEX i{n} ON t{n} (b); DROP TABLE t{n}", []),
    ("CREATE TABLE t{n} (a int, z int, CONSTRAINT k CHECK (a > 0)); CREATE INDEX i{n} ON t{n} (a); CREATE INDEX j{n} ON t{n} (z); ALTER TABLE t{n} RENAME a TO b; ALTER TABLE t{n} DROP z",
     [("structure", "t{n}::TABLE", "CREATE TABLE t{n} (b int, CONSTRAINT k CHECK (b > 0))"), ("performance", "i{n}::INDEX", "CREATE INDEX i{n} ON t{n} (b)")]),
    ("CREATE TABLE t{n} (a int, CONSTRAINT k CHECK (a > 0)); ALTER TABLE t{n} RENAME a TO b; ALTER TABLE t{n} ADD c int; ALTER TABLE t{n} DROP COLUMN b; ALTER TABLE t{n} ENABLE ROW LEVEL SECURITY; ALTER TABLE t{n} FORCE ROW LEVEL SECURITY",
     [("structure", "t{n}::TABLE", "CREATE TABLE t{n} (c int)"), ("security", "t{n}::0::000001", "ALTER TABLE t{n} ENABLE ROW LEVEL SECURITY"),
      ("security", "t{n}::0::000002", "ALTER TABLE t{n} FORCE ROW LEVEL SECURITY")]),
    ("CREATE TABLE t{n} (id int); INSERT INTO t{n} VALUES (1); CREATE TABLE k{n} (t int REFERENCES t{n}(id)); ALTER TABLE t{n} RENAME TO s{n}; ALTER TABLE s{n} RENAME TO u{n}",
     [("structure", "u{n}::TABLE", "CREATE TABLE u{n} (id int)"), ("structure", "k{n}::TABLE", "CREATE TABLE k{n} (t int REFERENCES u{n}(id))"), ("data", None, "INSERT INTO u{n} VALUES (1)")]),
    ("ALTER TABLE old{n} ADD COLUMN x int; DROP TABLE IF EXISTS gone{n}, lost{n} CASCADE; CREATE TABLE gone{n} (a int)",
     [("drops", "gone{n}::TABLE", "DROP TABLE IF EXISTS gone{n} CASCADE"), ("drops", "lost{n}::TABLE", "DROP TABLE IF EXISTS lost{n} CASCADE"),
      ("structure", "gone{n}::TABLE", "CREATE TABLE gone{n} (a int)"), ("references", "old{n}::TABLE", "ALTER TABLE old{n} ADD COLUMN x int")]),
    ("CREATE SEQUENCE q{n}; ALTER SEQUENCE q{n} INCREMENT BY 5; CREATE VIEW v{n} AS SELECT 1; ALTER VIEW v{n} RENAME TO w{n}; CREATE VIEW x{n} AS SELECT * FROM w{n}",
     [("foundation", "q{n}::SEQUENCE", "CREATE SEQUENCE q{n}"), ("foundation", "q{n}::SEQUENCE", "ALTER SEQUENCE q{n} INCREMENT BY 5"),
      ("views", "w{n}::VIEW", "CREATE VIEW w{n} AS SELECT 1"), ("views", "x{n}::VIEW", "CREATE VIEW x{n} AS SELECT * FROM w{n}")]),
    ("CREATE TYPE e{n} AS ENUM ('a', 'z'); ALTER TYPE e{n} ADD VALUE 'b' AFTER 'a'; ALTER TYPE e{n} ADD VALUE 'c' AFTER 'b'; ALTER TYPE e{n} ADD VALUE 'y{n}' BEFORE 'z'; ALTER TYPE e{n} OWNER TO x",
     [("foundation", "e{n}::TYPE", "CREATE TYPE e{n} AS ENUM ('a', 'b', 'c', 'y{n}', 'z')"), ("foundation", "e{n}::TYPE", "ALTER TYPE e{n} OWNER TO x")]),
    ("CREATE TABLE t{n} (a int); -- no-merge\nALTER TABLE t{n} ADD b int; ALTER TABLE t{n} ADD c int",
     [("structure", "t{n}::TABLE", "CREATE TABLE t{n} (a int)"), ("references", "t{n}::TABLE", "-- no-merge\nALTER TABLE t{n} ADD b int"),
      ("references", "t{n}::TABLE", "ALTER TABLE t{n} ADD c int")]),
    ("CREATE FUNCTION f{n}(a int) RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql; CREATE FUNCTION f{n}(a text) RETURNS int AS $$ SELECT 2; $$ LANGUAGE sql; CREATE OR REPLACE FUNCTION f{n}(b integer) RETURNS int AS $$ SELECT 3; $$ LANGUAGE sql; DROP FUNCTION f{n}(text)",
     [("logic", "f{n}(integer)::FUNCTION", "CREATE OR REPLACE FUNCTION f{n}(b integer) RETURNS int AS $$ SELECT 3; $$ LANGUAGE sql")]),
    ("CREATE TABLE t{n} (a int NOT NULL, b text CHECK (b IS NOT NULL)) PARTITION BY RANGE (a); CREATE TABLE p{n} PARTITION OF t{n} FOR VALUES FROM (1) TO (2); GRANT SELECT, INSERT ON t{n} TO ann; REVOKE INSERT ON t{n} FROM ann",
     [("structure", "t{n}::TABLE", "CREATE TABLE t{n} (a int NOT NULL, b text CHECK (b IS NOT NULL)) PARTITION BY RANGE (a)"),
      ("structure", "p{n}::TABLE", "CREATE TABLE p{n} PARTITION OF t{n} FOR VALUES FROM (1) TO (2)"), ("security", "~t{n}::ann", "GRANT SELECT ON t{n} TO ann")]),
    ("CREATE TABLE a{n} (id int PRIMARY KEY, b int); CREATE TABLE b{n} (id int PRIMARY KEY, a int REFERENCES a{n}(id)); ALTER TABLE a{n} ADD FOREIGN KEY (b) REFERENCES b{n}(id)",
     [("structure", "a{n}::TABLE", "CREATE TABLE a{n} (id int PRIMARY KEY, b int)"), ("structure", "b{n}::TABLE", "CREATE TABLE b{n} (id int PRIMARY KEY, a int)"),
      ("references", "a{n}::000002", "ALTER TABLE a{n} ADD FOREIGN KEY (b) REFERENCES b{n}(id)"), ("references", "b{n}::000001", "ALTER TABLE b{n} ADD FOREIGN KEY (a) REFERENCES a{n}(id)")]),
    ('CREATE TABLE "Order {n}" ("user" int, "Id" int); ALTER TABLE "Order {n}" ALTER "Id" SET NOT NULL; COMMENT ON TABLE "Order {n}" IS \'x\'',
     [("structure", "Order {n}::TABLE", 'CREATE TABLE "Order {n}" ("user" int, "Id" int NOT NULL)'), ("other", None, 'COMMENT ON TABLE "Order {n}" IS \'x\'')]),
]


def compact_final_state(spark, sf_dir):
    out = c.compact(history(spark, sf_dir, SUPPLIERS, [s for s, _ in _COMPACTED]))
    return out.select("category", F.when(~F.col("category").isin("data", "other"), F.col("key")).alias("key"), "sql")


registered(
    "compact_final_state",
    "SELECT category, key, sql FROM (" + expected_rows(SUPPLIERS, ["category", "key", "sql"], [r for _, r in _COMPACTED]) + ")",
    compact_final_state,
)


def compact_order(spark, sf_dir):
    """Tables whose references form chains: each must come after what it refers to."""
    shapes = ["CREATE TABLE t{n} (id int)", "CREATE TABLE t{n} (id int); CREATE TABLE u{n} (t int REFERENCES t{n}(id)); CREATE VIEW v{n} AS SELECT * FROM w{n}; CREATE VIEW w{n} AS SELECT 1"]
    out = c.compact(history(spark, sf_dir, NATIONS, shapes))
    return out.select(F.col("position").cast("long").alias("position"), "key")


registered(
    "compact_order",
    """SELECT row_number() OVER (ORDER BY phase, level, key) AS position, key FROM (
  SELECT 1 AS phase, 0 AS level, 't' || n_nationkey || '::TABLE' AS key FROM nation
  UNION ALL SELECT 1, 1, 'u' || n_nationkey || '::TABLE' FROM nation WHERE n_nationkey % 2 = 1
  UNION ALL SELECT 2, 0, 'w' || n_nationkey || '::VIEW' FROM nation WHERE n_nationkey % 2 = 1
  UNION ALL SELECT 2, 1, 'v' || n_nationkey || '::VIEW' FROM nation WHERE n_nationkey % 2 = 1)""",
    compact_order,
)


def history_equivalence(spark, sf_dir):
    left = ["CREATE TABLE t{n} (a int); ALTER TABLE t{n} ADD b text", "CREATE TABLE t{n} (a int); DROP TABLE t{n}", "CREATE TABLE t{n} (a int)"]
    right = ["create table t{n} (a  int, b text);", "SELECT {n}", "CREATE TABLE t{n} (a bigint)"]
    return c.equivalence(history(spark, sf_dir, NATIONS, left), history(spark, sf_dir, NATIONS, right))


registered(
    "history_equivalence",
    """SELECT 'table|t' || n_nationkey || '|sha256:' || substr(sha256('create table t' || n_nationkey || ' ( a ' || t || ' )'), 1, 32) AS line, side
FROM nation, (VALUES ('int', 'left'), ('bigint', 'right')) AS s(t, side) WHERE n_nationkey % 3 = 2""",
    history_equivalence,
)

_ACTIONS = [
    ("ALTER TABLE t{n} ADD x numeric(10, 2) DEFAULT f(1, 2), DROP CONSTRAINT IF EXISTS k", [(0, "ADD", "x", "numeric(10, 2) DEFAULT f(1, 2)"), (1, "DROP_CONSTRAINT", "k", "")]),
    ("CREATE TABLE t{n} (id serial PRIMARY KEY, CONSTRAINT c CHECK (id IN (1, 2)), UNIQUE (id))", [(0, "ADD", "id", "serial PRIMARY KEY"), (1, "ADD_CONSTRAINT", "c", "CONSTRAINT c CHECK (id IN (1, 2))"), (2, "ADD_CONSTRAINT", "", "UNIQUE (id)")]),
    ("ALTER TABLE t{n} RENAME COLUMN a TO \"B\"", [(0, "RENAME", "a", '"B"')]), ("ALTER TABLE t{n} RENAME TO u", [(0, "RENAME_TABLE", "u", "u")]),
    ("ALTER TABLE ONLY t{n} ALTER a TYPE bigint USING a::bigint, ALTER COLUMN b SET DEFAULT 'x, y', ALTER c DROP DEFAULT", [(0, "TYPE", "a", "bigint"), (1, "SET_DEFAULT", "b", "'x, y'"), (2, "DROP_DEFAULT", "c", "")]),
    ("ALTER TABLE t{n} ALTER a SET NOT NULL, ALTER b DROP NOT NULL, VALIDATE CONSTRAINT k", [(0, "SET_NOT_NULL", "a", ""), (1, "DROP_NOT_NULL", "b", ""), (2, "VALIDATE", "k", "")]),
    ("ALTER TABLE t{n} FORCE ROW LEVEL SECURITY", [(0, "ROW_SECURITY", "force row level security", "FORCE ROW LEVEL SECURITY")]),
    ("ALTER TABLE t{n} CLUSTER ON i, DROP IF EXISTS z CASCADE", [(0, "OTHER", "", "CLUSTER ON i"), (1, "DROP", "z", "")]),
    ("ALTER TABLE t{n} ADD a text DEFAULT ((((((lower('x, y')))))))", [(0, "ADD", "a", "text DEFAULT ((((((lower('x, y')))))))")]),
    ("DROP TABLE t{n}", []),
]
registered(
    "column_operations",
    "SELECT n, sub, op, \"column\", arg FROM (" + expected_rows(ORDERS, ["sub", "op", '"column"', "arg"], [r for _, r in _ACTIONS], {"sub": LONG}) + ")",
    lambda spark, sf_dir: changes(history(spark, sf_dir, ORDERS, [s for s, _ in _ACTIONS])).select(
        F.col("seq").cast("long").alias("n"), F.col("sub").cast("long").alias("sub"), "op", "column", "arg"
    ),
)

_FOLDED = [
    ("CREATE TABLE t{n} (a int NOT NULL DEFAULT 1, b text); ALTER TABLE t{n} ALTER a TYPE bigint, ALTER a DROP DEFAULT; ALTER TABLE t{n} RENAME b TO c",
     [("COLUMN", "a", "a bigint NOT NULL", "MODIFIED", None), ("COLUMN", "c", "c text", "RENAMED", "b")]),
    ("CREATE TABLE t{n} (a int, CONSTRAINT k CHECK (a > 0) NOT VALID); ALTER TABLE t{n} VALIDATE CONSTRAINT k, DROP CONSTRAINT t_pkey",
     [("COLUMN", "a", "a int", "ADDED", None), ("CONSTRAINT", "k", "CONSTRAINT k CHECK (a > 0)", "ADDED", None), ("OTHER", "", "DROP CONSTRAINT IF EXISTS t_pkey", "ADDED", None)]),
    ("CREATE UNLOGGED TABLE t{n} (a int REFERENCES u(id) ON DELETE SET NULL, b int GENERATED BY DEFAULT AS IDENTITY) WITH (fillfactor = 70); CREATE TABLE IF NOT EXISTS t{n} (z int)",
     [("COLUMN", "a", "a int REFERENCES u(id) ON DELETE SET NULL", "ADDED", None), ("COLUMN", "b", "b int GENERATED BY DEFAULT AS IDENTITY", "ADDED", None),
      ("BEFORE", "", "UNLOGGED ", "ADDED", None), ("AFTER", "", "WITH (fillfactor = 70)", "ADDED", None)]),
    ("CREATE TABLE t{n} (a int, b int, UNIQUE (a, b), CHECK (b > 0)); ALTER TABLE t{n} DROP a; ALTER TABLE t{n} ENABLE ROW LEVEL SECURITY, FORCE ROW LEVEL SECURITY, NO FORCE ROW LEVEL SECURITY",
     [("COLUMN", "b", "b int", "ADDED", None), ("CONSTRAINT", "#1", "CHECK (b > 0)", "ADDED", None), ("SECURITY", "", "ENABLE ROW LEVEL SECURITY", "ADDED", None)]),
]
registered(
    "table_states",
    expected_rows(CUSTOMERS, ["part", "name", "text", "status", "was"], [r for _, r in _FOLDED]),
    lambda spark, sf_dir: columns.table_states(changes(history(spark, sf_dir, CUSTOMERS, [s for s, _ in _FOLDED]))).select(
        F.expr("substring(key, 2)").cast("long").alias("n"), "part", "name", "text", "status", "was"
    ),
)

_ENUMS = [
    ("CREATE TYPE e{n} AS ENUM ('a', 'z'); ALTER TYPE e{n} ADD VALUE 'm{n}' BEFORE 'z'; ALTER TYPE e{n} ADD VALUE 'o' AFTER 'm{n}'; ALTER TYPE e{n} ADD VALUE 'last'", "CREATE TYPE e{n} AS ENUM ('a', 'm{n}', 'o', 'z', 'last')"),
    ("CREATE TYPE e{n} AS ENUM ('old'); DROP TYPE e{n}; CREATE TYPE e{n} AS ENUM ('it''s'); ALTER TYPE e{n} ADD VALUE IF NOT EXISTS 'it''s'", "CREATE TYPE e{n} AS ENUM ('it''s')"),
    ("CREATE TYPE e{n} AS ENUM ('x'); ALTER TYPE e{n} ADD VALUE 'a' AFTER 'x'; ALTER TYPE e{n} ADD VALUE 'b' AFTER 'x'; ALTER TYPE e{n} ADD VALUE 'c' BEFORE 'a'", "CREATE TYPE e{n} AS ENUM ('x', 'b', 'c', 'a')"),
]
registered(
    "enum_values",
    expected(CUSTOMERS, {"sql": ([e for _, e in _ENUMS], None)}),
    lambda spark, sf_dir: c.enum_types(graph.cut(c.objects(split(history(spark, sf_dir, CUSTOMERS, [s for s, _ in _ENUMS]))))).select(
        F.regexp_extract("key", "^e([0-9]+)::", 1).cast("long").alias("n"), "sql"
    ),
)

_GRANTS = [
    ("GRANT SELECT, INSERT ON t{n} TO ann, bob; REVOKE INSERT ON t{n} FROM bob", [("t{n}::ann", "GRANT INSERT, SELECT ON t{n} TO ann"), ("t{n}::bob", "GRANT SELECT ON t{n} TO bob")]),
    ("GRANT ALL ON t{n} TO cy; REVOKE ALL ON t{n} FROM cy", []),
    ("REVOKE select ON t{n} FROM dee; GRANT select ON t{n} TO dee", [("t{n}::dee", "GRANT SELECT ON t{n} TO dee")]),
    ("-- REVOKE x\nGRANT admin{n} TO eve", [("::eve", "GRANT ADMIN{n} TO eve")]),
]
registered(
    "permission_scripts",
    # membership in roles is one list for each member
    """SELECT * FROM (SELECT key, sql FROM (""" + expected_rows(CUSTOMERS, ["key", "sql"], [*[r for _, r in _GRANTS[:3]], []]) + """))
UNION ALL SELECT '::eve', 'GRANT ' || string_agg('ADMIN' || c_custkey, ', ' ORDER BY 'ADMIN' || c_custkey) || ' TO eve' FROM customer WHERE c_custkey % 4 = 3""",
    lambda spark, sf_dir: c.grants(split(history(spark, sf_dir, CUSTOMERS, [s for s, _ in _GRANTS]))),
)

_OBJECTS = [
    ("DROP TABLE a{n}, S.\"B\"", [("a{n}::TABLE", "DROP"), ("s.B::TABLE", "DROP")]),
    ("CREATE FUNCTION f{n}(a int, VARIADIC b text[] DEFAULT '{}', OUT c int) RETURNS int AS 'x' LANGUAGE sql", [("f{n}(integer,text[])::FUNCTION", "CREATE")]),
    ("DROP FUNCTION IF EXISTS g(double precision, timestamp with time zone), h{n}()", [("g(double precision,timestamp with time zone)::FUNCTION", "DROP"), ("h{n}()::FUNCTION", "DROP")]),
    ("ALTER VIEW v{n} RENAME TO w", [("v{n}::VIEW", "ALTER")]), ("CREATE TYPE e{n} AS ENUM ('a')", [("e{n}::TYPE", "CREATE")]), ("INSERT INTO t VALUES ({n})", []),
]
registered(
    "script_objects",
    expected_rows(ORDERS, ["key", "op"], [r for _, r in _OBJECTS]),
    lambda spark, sf_dir: c.objects(split(history(spark, sf_dir, ORDERS, [s for s, _ in _OBJECTS]))).select(F.col("seq").cast("long").alias("n"), "key", "op"),
)

_RENAMED = [
    ("CREATE TABLE a{n} (x int); ALTER TABLE a{n} RENAME TO b{n}; CREATE TABLE a{n} (y int); ALTER TABLE b{n} RENAME TO c{n}", [(0, "CREATE TABLE c{n} (x int)"), (2, "CREATE TABLE a{n} (y int)")]),
    ("ALTER TABLE old{n} RENAME TO new{n}; INSERT INTO new{n} VALUES ('FROM old{n}')", [(0, "ALTER TABLE old{n} RENAME TO new{n}"), (1, "INSERT INTO new{n} VALUES ('FROM old{n}')")]),
    ("CREATE VIEW s.v{n} AS SELECT 1; CREATE VIEW w AS SELECT * FROM s.v{n}; ALTER VIEW s.v{n} RENAME TO x{n}", [(0, "CREATE VIEW s.x{n} AS SELECT 1"), (1, "CREATE VIEW w AS SELECT * FROM s.x{n}")]),
]
registered(
    "last_names",
    expected_rows(CUSTOMERS, ["idx", "sql"], [r for _, r in _RENAMED], {"idx": LONG}),
    lambda spark, sf_dir: c.with_last_names(graph.cut(split(history(spark, sf_dir, CUSTOMERS, [s for s, _ in _RENAMED])))).select(
        F.col("seq").cast("long").alias("n"), F.col("idx").cast("long").alias("idx"), "sql"
    ),
)


def script_evidence(spark, sf_dir):
    shapes = ["CREATE TABLE t{n} (a int); INSERT INTO t{n} VALUES (1)", "DROP TABLE t{n}", "ALTER TABLE t{n} ADD b int; ALTER TABLE t{n} ADD c int"]
    own = split(history(spark, sf_dir, CUSTOMERS, shapes))
    return metrics.evidence(own, "seq").select(F.col("seq").cast("long").alias("n"), "n_statements", "checksum", "operations", "objects", "safe")


registered(
    "script_evidence",
    """SELECT n, CASE n % 3 WHEN 1 THEN 1 ELSE 2 END AS n_statements, sha256(replace(CASE n % 3 WHEN 0 THEN 'CREATE TABLE t{n} (a int)' || chr(10) || 'INSERT INTO t{n} VALUES (1)'
  WHEN 1 THEN 'DROP TABLE t{n}' ELSE 'ALTER TABLE t{n} ADD b int' || chr(10) || 'ALTER TABLE t{n} ADD c int' END, '{n}', CAST(n AS VARCHAR))) AS checksum,
  CASE n % 3 WHEN 0 THEN 'CREATE,INSERT' WHEN 1 THEN 'DROP' ELSE 'ALTER' END AS operations, 'TABLE:t' || n AS objects, n % 3 <> 1 AS safe
FROM (SELECT CAST(c_custkey AS BIGINT) AS n FROM customer)""",
    script_evidence,
)


def script_plan(spark, sf_dir):
    shapes = ["CREATE TABLE t{n} (a int); ALTER TABLE t{n} ADD b int; ALTER TABLE t{n} ADD c int", "CREATE TABLE t{n} (a int); DROP TABLE t{n}; CREATE TABLE t{n} (b int)", "CREATE VIEW v{n} AS SELECT 1"]
    return c.analyze(history(spark, sf_dir, CUSTOMERS, shapes)).select("key", "rule", "n_before", "n_after", "pattern")


registered(
    "script_plan",
    """SELECT CASE k WHEN 2 THEN 'v' ELSE 't' END || n || CASE k WHEN 2 THEN '::VIEW' ELSE '::TABLE' END AS key,
  CASE k WHEN 0 THEN 'create_alter' WHEN 1 THEN 'multiple_create' ELSE 'error_recovery' END AS rule, CASE k WHEN 2 THEN 1 ELSE 3 END AS n_before, 1 AS n_after,
  CASE k WHEN 0 THEN 'CREATE_ALTER' WHEN 1 THEN 'DROP_CREATE' END AS pattern
FROM (SELECT c_custkey AS n, c_custkey % 3 AS k FROM customer)""",
    script_plan,
)


def metrics_page(spark, sf_dir):
    plan = changelog.compaction_plan(log(spark, sf_dir), "standard")
    return metrics.prometheus(metrics.reduction(plan).select("n_objects"), "app")


registered("metrics_page", "SELECT 'app_n_objects ' || count(DISTINCT user_id) AS value FROM events", metrics_page)


# comparisons with what is there


def _made(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "integer").otherwise("text")
    return part.select(F.col("p_brand").alias("table"), filled("c{n}", F.col("p_partkey")).alias("column"), kind.alias("type"), "p_partkey", "p_size")


def schema_columns(spark, sf_dir):
    made = _made(spark, sf_dir)
    there = made.where("p_partkey % 4 != 0").withColumn("type", F.when(F.col("p_partkey") % 5 == 0, "bigint").otherwise(F.col("type")))
    there = there.unionByName(made.where("p_partkey % 11 = 0").withColumn("column", F.concat(F.lit("x"), "column")))
    return relate.missing_columns(made, there)


registered(
    "schema_columns",
    """WITH m AS (SELECT p_brand, p_partkey AS k, 'c' || p_partkey AS c, CASE WHEN p_size % 3 = 0 THEN 'integer' ELSE 'text' END AS t FROM part)
SELECT p_brand AS "table", c AS "column", t AS made_type, NULL AS there_type, 'missing' AS status FROM m WHERE k % 4 = 0
UNION ALL SELECT p_brand, c, t, 'bigint', 'type' FROM m WHERE k % 4 <> 0 AND k % 5 = 0
UNION ALL SELECT p_brand, 'x' || c, NULL, t, 'extra' FROM m WHERE k % 11 = 0""",
    schema_columns,
)


def schema_constraints(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 7 != 0, filled("k{n}", F.col("p_partkey")))
    made = part.select(F.col("p_brand").alias("table"), name.alias("name"))
    there = part.where("p_partkey % 3 != 0").select(F.col("p_brand").alias("table"), name.alias("name"), F.when(F.col("p_size") == 1, "PRIMARY KEY").otherwise("CHECK").alias("kind"))
    return relate.missing_constraints(made, there)


registered(
    "schema_constraints",
    """SELECT p_brand AS "table", 'k' || p_partkey AS name, 'missing' AS status FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 = 0
UNION ALL SELECT p_brand, NULL, 'NO_PRIMARY_KEY' FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand HAVING count_if(p_size = 1) = 0""",
    schema_constraints,
)


def schema_objects(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    made = cust.select(F.when(F.col("c_custkey") % 2 == 0, "TYPE").otherwise("FUNCTION").alias("kind"), filled(F.when(F.col("c_custkey") % 5 == 0, "app.o{n}").otherwise("o{n}"), F.col("c_custkey")).alias("name"))
    there = cust.where("c_custkey % 3 != 0").select(F.when(F.col("c_custkey") % 2 == 0, "TYPE").otherwise("FUNCTION").alias("kind"), F.when(F.col("c_custkey") % 4 == 1, "other").otherwise("public").alias("schema"), filled("o{n}", F.col("c_custkey")).alias("object"))
    return relate.missing_objects(made, there, ["app", "public"])


registered(
    "schema_objects",
    """SELECT CASE WHEN n % 2 = 0 THEN 'TYPE' ELSE 'FUNCTION' END AS kind, CASE WHEN n % 5 = 0 THEN 'app.o' ELSE 'o' END || n AS name
FROM (SELECT c_custkey AS n FROM customer) WHERE n % 5 = 0 OR n % 3 = 0 OR n % 4 = 1""",
    schema_objects,
)


def applied_alters(spark, sf_dir):
    made = split(history(spark, sf_dir, CUSTOMERS, ["CREATE TABLE t{n} (a int, CONSTRAINT k CHECK (a > 0))"])).select("seq", "idx", "sql")
    shapes = ["ALTER TABLE t{n} ADD a int", "ALTER TABLE t{n} ADD b int", "ALTER TABLE t{n} DROP COLUMN z", "ALTER TABLE t{n} ADD CONSTRAINT k CHECK (a > 1), DROP CONSTRAINT y", "ALTER TABLE t{n} ALTER a SET NOT NULL", "ALTER TABLE x{n} ADD a int"]
    alters = split(history(spark, sf_dir, CUSTOMERS, shapes)).select(F.col("seq").alias("id"), "seq", "idx", "sql")
    return rules.applied_alters(made, alters).select(F.col("id").cast("long").alias("n"), "applied")


registered("applied_alters", expected(CUSTOMERS, {"applied": ([True, False, True, True, False, False], BOOL)}), applied_alters)

_LOST = ["GRANT EXECUTE ON FUNCTION f{n}(int) TO x", "COMMENT ON FUNCTION s.f{n}() IS 'x'", "CREATE TRIGGER g BEFORE INSERT ON t EXECUTE FUNCTION f{n}()", "CREATE TABLE t{n} (a int)"]
registered(
    "lost_functions",
    "SELECT * FROM (" + expected(CUSTOMERS, {"sql": (_LOST, None)}) + ") WHERE n % 4 = 3 OR n % 3 <> 0",
    lambda spark, sf_dir: rules.without_lost_functions(
        shaped(spark, sf_dir, CUSTOMERS, _LOST), table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(filled("public.f{n}", F.col("c_custkey")).alias("name"))
    ),
)


def likely_renames(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("key"), F.col("c_custkey").alias("n"))
    gone = cust.where("n % 3 = 0").select("key", filled("name{n}", F.col("n")).alias("name"))
    final = cust.select("key", F.explode(F.array(filled("user_name{n}", F.col("n")), filled("name{n}_x", F.col("n")), F.lit("other"))).alias("name"))
    return rules.likely_renames(gone, final)


registered(
    "likely_renames",
    "SELECT c_custkey % 100 AS key, 'name' || c_custkey AS old, 'name' || c_custkey || '_x' AS new FROM customer WHERE c_custkey % 3 = 0",
    likely_renames,
)
registered(
    "can_be_compacted",
    LOG + """SELECT key, count_if(op = 'DROP') = 0 AND count_if(op = 'INSERT' AND back > 1) = 0 AS ok FROM h GROUP BY key""",
    lambda spark, sf_dir: rules.can_be_compacted(log(spark, sf_dir)),
)


def separated_alters(spark, sf_dir):
    own = split(history(spark, sf_dir, CUSTOMERS, ["CREATE TABLE t{n} (a int); ALTER TABLE t{n} ADD b int; ALTER TABLE t{n} OWNER TO x", "ALTER TABLE t{n} ADD b int; ALTER TABLE t{n} RENAME TO u"]))
    return rules.separated(c.objects(own).withColumnRenamed("sql", "value"))


registered(
    "separated_alters",
    "SELECT 't' || c_custkey || '::TABLE' AS key, CASE c_custkey % 2 WHEN 0 THEN 1 ELSE 0 END AS n_creates, 1 AS n_merged, 1 AS n_separate FROM customer",
    separated_alters,
)


# evidence


def provenance(spark, sf_dir):
    before = split(history(spark, sf_dir, CUSTOMERS, ["CREATE TABLE t{n} (a int); ALTER TABLE t{n} ADD b int", "DROP TABLE t{n}"]))
    after = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(filled("t{n}::TABLE", F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("position"), F.lit("create_alter").alias("rule"))
    return evidence.provenance(c.objects(before).select("key", F.col("seq").alias("file"), "idx"), after)


registered(
    "provenance",
    """SELECT CAST(c_custkey AS VARCHAR) AS source_file, i AS source_idx, 'compacted.sql' AS target_file, CAST(c_custkey AS BIGINT) AS target_position, 'create_alter' AS rule
FROM customer, (VALUES (CAST(0 AS BIGINT)), (1)) AS x(i) WHERE c_custkey % 2 = 0""",
    provenance,
)


def plan_issues(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    group = F.struct(filled("g{n}", k).alias("group_id"), F.array(F.lit("confirm"), F.lit("reject")).alias("allowed_actions"), F.when(k % 10 == 0, F.array(filled(F.lit("g{n}"), k + 1))).otherwise(F.array().cast("array<string>")).alias("blocked_by"))
    decision = F.struct(filled("g{n}", k).alias("group_id"), F.when(k % 7 == 0, "split").otherwise("confirm").alias("decision"), F.when(k % 6 == 0, 0.5).otherwise(0.9).alias("confidence"))
    lists = cust.agg(F.array_sort(F.collect_list(group)).alias("candidates"), F.array_sort(F.collect_list(F.when(k % 9 != 0, decision))).alias("decisions"))
    context = lists.select(
        F.lit("1").alias("context_version"), F.lit("now").alias("generated_at"), F.lit("").alias("context_hash"), "candidates",
        F.array().cast("array<struct<case_id: string, risk_level: string, allowed_decisions: array<string>>>").alias("cases"),
    )
    context = graph.cut(evidence.sealed(context))
    plan = lists.select(F.lit("1").alias("plan_version"), F.lit("1").alias("context_version"), F.lit("no hash").alias("context_hash"), "decisions",
                        F.array().cast("array<struct<case_id: string, decision: string, confidence: double>>").alias("resolutions"), F.array(F.lit("g6"), F.lit("nobody")).alias("reviews"))
    return evidence.plan_issues(plan, context)


registered(
    "plan_issues",
    """WITH k AS (SELECT c_custkey AS n FROM customer)
SELECT 'PLAN_INVALID' AS code, 'context_hash' AS field, NULL AS item UNION ALL SELECT 'PLAN_INVALID', 'reviews', 'nobody'
UNION ALL SELECT 'PLAN_INCOMPLETE', 'decisions', 'g' || n FROM k WHERE n % 9 = 0
UNION ALL SELECT 'PLAN_INVALID', 'decisions.decision', 'g' || n FROM k WHERE n % 9 <> 0 AND n % 7 = 0
UNION ALL SELECT 'DEPENDENCY_ORDER', 'decisions', 'g' || n FROM k WHERE n % 9 <> 0 AND n % 7 <> 0 AND n % 10 = 0 AND ((n + 1) % 9 = 0 OR (n + 1) % 7 = 0 OR n + 1 NOT IN (SELECT n FROM k))
UNION ALL SELECT 'LOW_CONFIDENCE', 'decisions.confidence', 'g' || n FROM k WHERE n % 9 <> 0 AND n % 6 = 0 AND n <> 6""",
    plan_issues,
)


def analysis_actions(spark, sf_dir):
    totals = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_redundant"), F.lit(0).alias("n_warnings"), F.lit(50.0).alias("reduction_pct"))
    return evidence.analysis_actions(totals)


registered(
    "analysis_actions",
    """SELECT 'auto_cleanup' AS action, count(*) || ' redundant operations can go' AS reason, 'high' AS priority, 'safe' AS risk FROM supplier
UNION ALL SELECT 'guarded_apply', 'much can go: validate the result before use', 'medium', 'safe'""",
    analysis_actions,
)
registered(
    "action_summary",
    "SELECT count(*) || ' redundant operations can go; much can go: validate the result before use' AS summary FROM supplier",
    lambda spark, sf_dir: evidence.summaries(analysis_actions(spark, sf_dir)),
)


def comparison_outcomes(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("n"), F.when(F.col("c_custkey") % 3 == 0, "failed").alias("apply_error"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 2).alias("n_differences")
    )
    return evidence.comparison_outcome(own).select("n", "comparison_valid", "success")


registered(
    "comparison_outcomes",
    "SELECT CAST(c_custkey AS BIGINT) AS n, c_custkey % 3 <> 0 AS comparison_valid, c_custkey % 3 <> 0 AND c_custkey % 4 = 2 AS success FROM customer",
    comparison_outcomes,
)


# graphs

_RINGS = """r AS (SELECT s_suppkey AS k, s_suppkey // 5 AS g, s_suppkey % 5 AS i FROM supplier),
e AS (SELECT 's' || lpad(CAST(a.k AS VARCHAR), 6, '0') AS src, 's' || lpad(CAST(b.k AS VARCHAR), 6, '0') AS dst, a.g, a.i AS ai
  FROM r a JOIN r b ON a.g = b.g AND b.i = a.i + 1
  UNION ALL SELECT 's' || lpad(CAST(a.k AS VARCHAR), 6, '0'), 's' || lpad(CAST(b.k AS VARCHAR), 6, '0'), a.g, a.i FROM r a JOIN r b ON a.g = b.g AND a.i = 4 AND b.i = 0 WHERE a.g % 2 = 0)"""


def _named(k: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(k.cast("string"), 6, "0"))


def _rings(spark, sf_dir) -> DataFrame:
    """Five suppliers in a row each; every second row is closed to a ring."""
    k, name = F.col("s_suppkey"), _named
    r = table(spark, sf_dir, "supplier").select(k.alias("k"), F.floor(k / 5).alias("g"), (k % 5).alias("i"))
    a, b = r.alias("a"), r.alias("b")
    closes = (F.col("a.i") == 4) & (F.col("b.i") == 0) & (F.col("a.g") % 2 == 0)
    return a.join(b, F.col("a.g") == F.col("b.g")).where((F.col("b.i") == F.col("a.i") + 1) | closes).select(name(F.col("a.k")).alias("src"), name(F.col("b.k")).alias("dst"))


registered(
    "cycle_paths",
    f"""WITH {_RINGS}, w AS (SELECT g, min(src) AS component, count(*) AS n FROM e GROUP BY g HAVING count(*) = 5 AND g % 2 = 0)
SELECT component, (SELECT string_agg('s' || lpad(CAST(r.k AS VARCHAR), 6, '0'), '>' ORDER BY r.k) FROM r WHERE r.g = w.g) || '>' || component AS path FROM w""",
    lambda spark, sf_dir: graph.cycle_paths(_rings(spark, sf_dir)).select("component", F.array_join("path", ">").alias("path")),
)
registered(
    "cycles_in_rings",
    f"""WITH {_RINGS} SELECT src, dst, min(src) OVER (PARTITION BY g) AS component, count(*) OVER (PARTITION BY g) AS n_nodes FROM e
WHERE g IN (SELECT g FROM e GROUP BY g HAVING count(*) = 5)""",
    lambda spark, sf_dir: graph.cycle_edges(_rings(spark, sf_dir)).select("src", "dst", "component", "n_nodes"),
)
registered(
    "edges_without_cycles",
    f"""WITH {_RINGS}, c AS (SELECT g FROM e GROUP BY g HAVING count(*) = 5)
SELECT src, dst FROM e WHERE NOT (g IN (SELECT g FROM c) AND ai = 4)""",
    # the closing edge weighs least
    lambda spark, sf_dir: graph.without_cycles(_rings(spark, sf_dir), F.when(F.col("src") > F.col("dst"), 1).otherwise(2)),
)
registered(
    "edges_without_node",
    f"WITH {_RINGS} SELECT src, dst FROM e WHERE CAST(substr(src, 2) AS BIGINT) % 7 <> 0 AND CAST(substr(dst, 2) AS BIGINT) % 7 <> 0",
    lambda spark, sf_dir: graph.without_node(_rings(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(_named(F.col("s_suppkey")).alias("node"))),
)
registered(
    "induced_edges",
    f"WITH {_RINGS} SELECT src, dst FROM e WHERE CAST(substr(src, 2) AS BIGINT) % 7 <> 0 AND CAST(substr(dst, 2) AS BIGINT) % 7 <> 0",
    lambda spark, sf_dir: graph.induced(_rings(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_suppkey % 7 != 0").select(_named(F.col("s_suppkey")).alias("node"))),
)


def out_of_order(spark, sf_dir):
    positions = table(spark, sf_dir, "supplier").select(_named(F.col("s_suppkey")).alias("node"), (F.col("s_suppkey") * 37 % 101).cast("long").alias("position"))
    return graph.out_of_order(positions, _rings(spark, sf_dir)).select("src", "dst", "src_position", "dst_position")


registered(
    "out_of_order",
    f"""WITH {_RINGS} SELECT src, dst, a * 37 % 101 AS src_position, b * 37 % 101 AS dst_position
FROM (SELECT src, dst, CAST(substr(src, 2) AS BIGINT) AS a, CAST(substr(dst, 2) AS BIGINT) AS b FROM e) WHERE a * 37 % 101 < b * 37 % 101""",
    out_of_order,
)


def build_order(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(_named(F.col("s_suppkey")).alias("node"))
    return graph.build_order(nodes, _rings(spark, sf_dir)).select("node", "level", "cyclic", "rank")


registered(
    "build_order",
    f"""WITH {_RINGS}, last AS (SELECT g, max(i) AS m, count(*) = 5 AND g % 2 = 0 AS ring FROM r GROUP BY g),
l AS (SELECT 's' || lpad(CAST(k AS VARCHAR), 6, '0') AS node, CASE WHEN ring THEN NULL ELSE m - i END AS level, ring AS cyclic FROM r JOIN last USING (g))
SELECT node, CAST(level AS BIGINT) AS level, cyclic, row_number() OVER (PARTITION BY level ORDER BY node) AS rank FROM l""",
    build_order,
)


def schema_evidence(spark, sf_dir):
    objects = table(spark, sf_dir, "supplier").select(F.lit("TABLE").alias("kind"), _named(F.col("s_suppkey")).alias("name"))
    return evidence.schema_evidence(objects, _rings(spark, sf_dir))


registered(
    "schema_evidence",
    f"""WITH {_RINGS}, w AS (SELECT g, min(src) AS component FROM e GROUP BY g HAVING count(*) = 5)
SELECT 'object' AS kind, 'table:s' || lpad(CAST(k AS VARCHAR), 6, '0') AS value FROM r UNION ALL SELECT 'edge', src || ' > ' || dst FROM e
UNION ALL SELECT 'cycle', (SELECT string_agg('s' || lpad(CAST(r.k AS VARCHAR), 6, '0'), ' > ' ORDER BY r.k) FROM r WHERE r.g = w.g) || ' > ' || component FROM w""",
    schema_evidence,
)
registered(
    "bucketed_fingerprints",
    "SELECT count(*) AS n_lines, true AS same, true AS differs FROM lineitem",
    lambda spark, sf_dir: _fingerprints(table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_shipdate").alias("line"))),
)


def _fingerprints(lines: DataFrame) -> DataFrame:
    """Lines in another order have the same digest, lines of which one is missing another."""
    a, b = signature.bucketed_fingerprint(lines), signature.bucketed_fingerprint(lines.repartition(7))
    last = lines.agg(F.max("line").alias("line"))
    d = signature.bucketed_fingerprint(lines.join(last, "line", "left_anti"))
    three = a.withColumn("x", F.lit("a")).unionByName(b.withColumn("x", F.lit("b"))).unionByName(d.withColumn("x", F.lit("d")))
    of = lambda x, c: F.max(F.when(F.col("x") == x, F.col(c)))
    return three.agg(of("a", "n_lines").alias("n_lines"), (of("a", "sha256") == of("b", "sha256")).alias("same"), (of("a", "sha256") != of("d", "sha256")).alias("differs"))


# further folds of change logs

registered(
    "data_statistics",
    LOG + "SELECT attr, count(*) AS n, count(DISTINCT key) AS n_keys, CAST(grouping(attr) AS BIGINT) AS level FROM log WHERE op = 'INSERT' GROUP BY GROUPING SETS ((attr), ())",
    lambda spark, sf_dir: changelog.data_statistics(log(spark, sf_dir)),
)
registered(
    "last_creates",
    LOG + """SELECT key, max(CASE WHEN k = 1 THEN idx END) AS idx, count(*) - 1 AS n_duplicates
FROM (SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS k FROM h WHERE op = 'CREATE') GROUP BY key""",
    lambda spark, sf_dir: changelog.last_creates(log(spark, sf_dir)),
)
registered(
    "neighbours",
    LOG + "SELECT idx, next_op, n = 1 AS is_first FROM h",
    lambda spark, sf_dir: changelog.with_next(log(spark, sf_dir)).select("idx", "next_op", "is_first"),
)


def altered_targets(spark, sf_dir):
    shapes = ["ALTER TABLE t{n} ADD a int", "ALTER VIEW v{n} OWNER TO x", "ALTER TABLE IF EXISTS s.t ADD a int"]
    own = statements.analysed(shaped(spark, sf_dir, CUSTOMERS, shapes)).withColumn("stream", F.lit(1)).withColumn("batch", F.floor(F.col("n") / 7))
    return batches.altered_targets(own, "stream").select("batch", F.array_join("targets", "|").alias("targets"))


registered(
    "altered_targets",
    """SELECT batch, string_agg(t, '|' ORDER BY t) AS targets FROM (
  SELECT DISTINCT CAST(c_custkey // 7 AS BIGINT) AS batch, CASE c_custkey % 3 WHEN 0 THEN 't' || c_custkey ELSE 's.t' END AS t FROM customer WHERE c_custkey % 3 <> 1) GROUP BY batch""",
    altered_targets,
)


def snapshots(spark, sf_dir):
    line = F.concat(F.lit("table|t"), F.col("n_nationkey").cast("string"))
    own = lambda where, version: table(spark, sf_dir, "nation").where(where).select(F.lit("1").alias("contract_version"), F.lit(version).alias("postgresql_version"), line.alias("line"))
    same = relate.snapshot_difference(own("n_nationkey < 20", "16"), own("n_nationkey > 3", "16")).withColumn("pair", F.lit("same"))
    return same.unionByName(relate.snapshot_difference(own("true", "16"), own("false or n_nationkey = 0", "17")).withColumn("pair", F.lit("other")))


registered(
    "snapshot_differences",
    """SELECT 'table|t' || n_nationkey AS line, CASE WHEN n_nationkey < 20 THEN 'left' ELSE 'right' END AS side, 'same' AS pair FROM nation WHERE n_nationkey <= 3 OR n_nationkey >= 20
UNION ALL SELECT * FROM (VALUES ('postgresql_version=16', 'left', 'other'), ('postgresql_version=17', 'right', 'other'))""",
    snapshots,
)


def plugin_rewrites(spark, sf_dir):
    registry = plugins.Registry()
    registry.register(plugins.Plugin("lengths", 50, lambda s: s.rlike("length"), rewrites.counted_in_characters))
    registry.register(plugins.Plugin("schemas", 60, lambda s: s.contains("old."), lambda s: F.replace(s, F.lit("old."), F.lit("new.")), ("absent",)))
    registry.register(plugins.Plugin("absent", 10, lambda s: s.contains("old."), lambda s: F.lit("never")))
    registry.register(plugins.Plugin("unseen", 99, lambda s: s.contains("nowhere"), lambda s: F.lit("never")))
    own = shaped(spark, sf_dir, CUSTOMERS, ["SELECT length(a) FROM old.t{n}", "SELECT {n}"])
    return plugins.rewritten(own, registry.in_force(own))


registered("plugin_rewrites", expected(CUSTOMERS, {"sql": (["SELECT char_length(a) FROM new.t{n}", "SELECT {n}"], None)}), plugin_rewrites)

_LADDER = [
    ("CREATE TYPE e{n} AS ENUM ('a'); CREATE TYPE e{n} AS ENUM ('a', 'b')", "e{n}::TYPE", "enum_deduplication", 2, 1),
    ("CREATE PUBLICATION p{n}; ALTER PUBLICATION p{n} ADD TABLE t; ALTER PUBLICATION p{n} ADD TABLE t", "p{n}::PUBLICATION", "publication_deduplication", 3, 2),
    ("ALTER TABLE t{n} ADD COLUMN a int; ALTER TABLE t{n} DROP COLUMN b", "t{n}::TABLE", "column_evolution", 2, 2),
    ("ALTER TABLE t{n} ENABLE ROW LEVEL SECURITY; ALTER TABLE t{n} FORCE ROW LEVEL SECURITY", "t{n}::TABLE", "rls_consolidation", 2, 1),
    ("ALTER SEQUENCE q{n} INCREMENT BY 2; ALTER SEQUENCE q{n} OWNED BY t.a; ALTER SEQUENCE q{n} CYCLE", "q{n}::SEQUENCE", "transaction_boundary", 3, 3),
    ("CREATE VIEW v{n} AS SELECT 1", "v{n}::VIEW", "error_recovery", 1, 1),
]
registered(
    "rule_ladder",
    expected_rows(CUSTOMERS, ["key", "rule", "n_before", "n_after"], [[row[1:]] for row in _LADDER], {"n_before": LONG, "n_after": LONG}).replace("SELECT CAST(c_custkey AS BIGINT) AS n, ", "SELECT "),
    lambda spark, sf_dir: c.analyze(history(spark, sf_dir, CUSTOMERS, [row[0] for row in _LADDER])).select("key", "rule", "n_before", "n_after"),
)
