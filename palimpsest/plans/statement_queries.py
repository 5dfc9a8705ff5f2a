"""Queries of the operators on single statements: classes, objects, rules, fixes, patterns, identifiers, types, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import identifiers, rewrites
from palimpsest.operators import batches, patterns, relate, rules, statements
from palimpsest.plans.history import table
from palimpsest.plans.shapes import ORACLES, QUERIES, expected, expected_rows, filled, quoted, registered, shaped, told

__all__ = ["ORACLES", "QUERIES"]

ORDERS, CUSTOMERS, PARTS, SUPPLIERS = ("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")
BOOL, LONG = "BOOLEAN", "BIGINT"
listed = lambda make: lambda s: F.array_join(make(s), "|")

told(
    "read_only_gate", ORDERS, {"class": statements.statement_class, "reason": statements.class_reason}, {},
    [
        ("SELECT * FROM t{n}", "read_only", None),
        ("SELECT '--', nextval('s{n}')", "write", "the query calls nextval"),
        ("WITH u AS (UPDATE t{n} AS a SET x = 1 RETURNING *) SELECT * FROM u", "write", "the query holds UPDATE"),
        ("SELECT \"setval\"('s{n}', 1)", "write", "the query calls setval"),
        ("SELECT lo_import('x{n}')", "write", "the query calls lo_import"),
        ("SELECT pg_catalog.pg_switch_wal() -- {n}", "write", "the query calls pg_switch_wal"),
        ("SELECT 1 /* /* */ ' */, nextval('s{n}') --'", "write", "quotes or comments can't be told apart"),
        ("SELECT E'\\'', nextval('s{n}') --'", "write", "the query calls nextval"),
        ("SELECT $x$ nextval('s{n}') $x$", "read_only", None),
        ("SELECT * FROM t{n} FOR NO KEY UPDATE", "read_only", None),
        ("PREPARE p{n} (int) AS DELETE FROM t", "write", "DELETE"),
        ("DECLARE c{n} CURSOR FOR SELECT 1", "read_only", None),
        ("EXPLAIN (VERBOSE, ANALYZE) DELETE FROM t{n}", "write", "DELETE"),
        ("EXPLAIN DELETE FROM t{n}", "read_only", None),
        ("SELECT * INTO u{n} FROM t", "ddl", "the query makes a table"),
        ("WITH a AS (WITH b AS (DELETE FROM t{n} RETURNING id) SELECT * FROM b) SELECT * FROM a", "write", "the query holds DELETE FROM"),
        ("VALUES (1), ({n})", "read_only", None),
        ("TABLE t{n}", "read_only", None),
        ("MERGE INTO t{n} USING s ON t.id = s.id WHEN MATCHED THEN DELETE", "write", "MERGE"),
        ("COPY t{n} TO '/tmp/x'", "write", "COPY"),
        ("DO $$ BEGIN PERFORM {n}; END $$", "write", "DO"),
        ("CALL p{n}()", "write", "CALL"),
        ("TRUNCATE t{n}", "ddl", "TRUNCATE"),
        ("CREATE TABLE t{n} AS SELECT * FROM u", "ddl", "CREATE"),
        ("COMMENT ON TABLE t{n} IS 'SELECT'", "ddl", "COMMENT"),
        ("SET search_path TO app{n}", "maintenance", "SET"),
        ("SET CONSTRAINTS ALL DEFERRED -- {n}", "write", "unknown: SET"),
        ("LOCK TABLE t{n} IN ACCESS EXCLUSIVE MODE", "maintenance", "LOCK"),
        ("PREPARE TRANSACTION 't{n}'", "maintenance", "PREPARE"),
        ("SELECT 'open, nextval({n})", "write", "quotes or comments can't be told apart"),
        ("FROBNICATE t{n}", "write", "unknown: FROBNICATE"),
        ("SELECT setval/* x */('s{n}', 1)", "write", "the query calls setval"),
    ],
)


def _read_only_scripts(spark, sf_dir):
    own = shaped(spark, sf_dir, CUSTOMERS, ["SELECT 1; SHOW x{n}", "SELECT 1; DELETE FROM t{n}", "SELECT 'a;b{n}'; -- ; x", "-- nothing {n}"])
    each = statements.split(own, "n", sql="sql").withColumn("class", statements.statement_class(F.col("sql")))
    return statements.is_read_only(each, "n")


registered(
    "read_only_scripts",
    "SELECT CAST(c_custkey AS BIGINT) AS n, c_custkey % 4 <> 1 AS read_only FROM customer WHERE c_custkey % 4 <> 3",
    _read_only_scripts,
)

told(
    "statement_objects", ORDERS,
    {
        "op": statements.operation, "kind": statements.object_type, "name": statements.object_name, "refs": listed(statements.references),
        "phase": lambda s: statements.category(statements.operation(s), statements.object_type(s)),
    },
    {},
    [
        ("CREATE TABLE IF NOT EXISTS s.t{n} (a int REFERENCES p{n}(id), b text)", "CREATE", "TABLE", "s.t{n}", "p{n}", "structure"),
        ("CREATE UNLOGGED TABLE t{n} (a int)", "CREATE", "TABLE", "t{n}", "", "structure"),
        ("CREATE FOREIGN TABLE t{n} (a int) SERVER s", "CREATE", "FOREIGN TABLE", "t{n}", "", "foundation"),
        ("CREATE TYPE e{n} AS ENUM ('a')", "CREATE", "ENUM", "e{n}", "", "foundation"),
        ("CREATE OR REPLACE VIEW \"V {n}\" AS SELECT * FROM a{n} JOIN s.b ON true", "CREATE", "VIEW", '"V {n}"', "a{n}|s.b", "views"),
        ("CREATE MATERIALIZED VIEW m{n} AS WITH x AS (SELECT 1 FROM q) SELECT * FROM x", "CREATE", "MATERIALIZED VIEW", "m{n}", "q", "views"),
        ("CREATE UNIQUE INDEX CONCURRENTLY i{n} ON t (a)", "CREATE", "INDEX", "i{n}", "", "performance"),
        ("CREATE OR REPLACE FUNCTION f{n}() RETURNS int AS $$ SELECT 1 FROM z; $$ LANGUAGE sql", "CREATE", "FUNCTION", "f{n}", "z", "logic"),
        ("CREATE TRIGGER g{n} BEFORE INSERT ON t EXECUTE FUNCTION f()", "CREATE", "TRIGGER", "g{n}", "", "logic"),
        ("CREATE POLICY p{n} ON t USING (a IN (SELECT id FROM o{n}))", "CREATE", "POLICY", "p{n}", "o{n}", "security"),
        ("ALTER TABLE ONLY t{n} ADD FOREIGN KEY (a) REFERENCES u(id)", "ALTER", "TABLE", "t{n}", "u", "structure"),
        ("DROP SCHEMA IF EXISTS s{n}", "DROP", "SCHEMA", "s{n}", "", "foundation"),
        ("INSERT INTO t{n} SELECT extract(year FROM now()) FROM u -- FROM v", "INSERT", "TABLE", "t{n}", "u", "data"),
        ("UPDATE t{n} SET a = 'FROM x'", "UPDATE", "TABLE", "t{n}", "", "data"),
        ("GRANT SELECT ON TABLE t{n} TO ann", "GRANT", "TABLE", "t{n}", "", "security"),
        ("REVOKE USAGE ON SCHEMA s{n} FROM ann", "REVOKE", "SCHEMA", "s{n}", "ann", "security"),
        ("COMMENT ON COLUMN t{n}.a IS 'x'", "COMMENT", "COLUMN", "t{n}.a", "", "foundation"),
        ("CREATE EVENT TRIGGER g{n} ON ddl_command_end EXECUTE FUNCTION f()", "CREATE", "EVENT TRIGGER", "g{n}", "", "foundation"),
        ("SELECT {n}", "SELECT", "UNKNOWN", None, "", "foundation"),
        ("/* x */ -- y\n CREATE SEQUENCE q{n}", "CREATE", "SEQUENCE", "q{n}", "", "foundation"),
    ],
)

told(
    "statement_traits", ORDERS,
    {
        "lock_level": statements.lock_level, "alone": statements.needs_no_transaction, "idempotent": statements.is_idempotent,
        "kept": statements.preserved, "gate": statements.version_gate, "time": statements.execution_time,
    },
    {"alone": BOOL, "idempotent": BOOL, "kept": BOOL},
    [
        ("CREATE INDEX CONCURRENTLY i{n} ON t (a)", "SHARE_UPDATE_EXCLUSIVE", True, False, False, "", "SLOW"),
        ("CREATE INDEX IF NOT EXISTS i{n} ON t (a)", "SHARE", False, True, False, "", "MEDIUM"),
        ("CREATE TRIGGER g{n} BEFORE INSERT ON t EXECUTE FUNCTION f()", "SHARE_ROW_EXCLUSIVE", False, False, False, "", "FAST"),
        ("ALTER TYPE e{n} ADD VALUE 'x'", "NONE", True, False, False, "PG<12: not in a transaction", "FAST"),
        ("ALTER TABLE t{n} VALIDATE CONSTRAINT c", "SHARE_UPDATE_EXCLUSIVE", False, False, False, "", "FAST"),
        ("ALTER TABLE t{n} ADD CONSTRAINT c CHECK (a > 0)", "ACCESS_EXCLUSIVE", False, False, False, "", "SLOW"),
        ("-- no-merge\nALTER TABLE t{n} ALTER a SET NOT NULL", "ACCESS_EXCLUSIVE", False, False, True, "", "SLOW"),
        ("CREATE TABLE t{n} (a int GENERATED ALWAYS AS (1) STORED)", "NONE", False, False, False, "PG>=12", "FAST"),
        ("CREATE STATISTICS s{n} ON a, b FROM t", "NONE", False, False, False, "PG>=10", "FAST"),
        ("VACUUM t{n}", "NONE", True, False, False, "", "SLOW"),
        ("INSERT INTO t{n} VALUES ('-- IGNORE')", "ROW_EXCLUSIVE", False, False, False, "", "UNKNOWN"),
        ("ALTER TABLE t{n} ADD COLUMN IF NOT EXISTS a int DEFAULT 1", "ACCESS_EXCLUSIVE", False, True, False, "", "FAST"),
        ("CREATE OR REPLACE VIEW v{n} AS SELECT 1", "NONE", False, True, False, "", "FAST"),
        ("DROP TABLE IF EXISTS t{n}", "ACCESS_EXCLUSIVE", False, True, False, "", "FAST"),
        ("SELECT {n}", "ACCESS_SHARE", False, False, False, "", "FAST"),
    ],
)

_SCRIPTS = [
    "CREATE TABLE t{n} (a text DEFAULT 'x;y'); INSERT INTO t{n} VALUES ('it''s; -- no')",
    "-- first; comment\nSELECT {n} /* ; /* ; */; SELECT \"a;b\"",
    "DO $body$ BEGIN DELETE FROM t; END $body$; SELECT {n};;",
    " ; -- nothing {n}",
    "SELECT E'a\\';b{n}'; SELECT $1; SELECT $$;$$",
]
_PARTS = [
    [(0, "CREATE TABLE t{n} (a text DEFAULT 'x;y')"), (1, "INSERT INTO t{n} VALUES ('it''s; -- no')")],
    [(0, "-- first; comment\nSELECT {n} /* ; /* ; */"), (1, 'SELECT "a;b"')],
    [(0, "DO $body$ BEGIN DELETE FROM t; END $body$"), (1, "SELECT {n}")],
    [],
    [(0, "SELECT E'a\\';b{n}'"), (1, "SELECT $1"), (2, "SELECT $$;$$")],
]
registered(
    "statement_split",
    expected_rows(ORDERS, ["idx", "sql"], _PARTS, {"idx": LONG}),
    lambda spark, sf_dir: statements.split(shaped(spark, sf_dir, ORDERS, _SCRIPTS), "n", sql="sql").withColumn("idx", F.col("idx").cast("long")),
)

_LINT = [
    ("ALTER TABLE t{n} DROP b", [("ban-drop-column", "t{n}", None, None, None)]),
    ("ALTER TABLE t{n} ALTER a DROP DEFAULT, DROP CONSTRAINT c", []),
    ("ALTER TABLE IF EXISTS t{n} RENAME TO u", [("ban-rename-table", "t{n}", None, None, None)]),
    ("ALTER TABLE ONLY s.t{n} RENAME a TO b", [("ban-rename-column", "s.t{n}", None, None, None)]),
    ("ALTER TABLE t{n} ADD CHECK (a > 0)", [("constraint-missing-not-valid", "t{n}", None, None, None)]),
    ("ALTER TABLE t{n} ADD CONSTRAINT c CHECK (a > 0) NOT VALID", []),
    ("UPDATE t{n} SET a = (SELECT b FROM c WHERE d = 1)", [("block-missing-where", "t{n}", None, None, None)]),
    ("DELETE FROM t{n} WHERE a IN (1, 2)", []),
    ("DROP TABLE a{n}, s.b", [("ban-drop-table", "a{n}", None, None, None), ("ban-drop-table", "s.b", None, None, None)]),
    ("ALTER TABLE t{n} ALTER COLUMN a SET DATA TYPE text", [("ban-type-change", "t{n}", None, None, None)]),
    ("CREATE TABLE t (a varchar(20), b int DEFAULT '1'::int, c numeric(10, 2), d{n} integer)", [("prefer-text", "t", 18, 29, "TEXT"), ("prefer-bigint", "t", 33, 36, "BIGINT"), ("prefer-bigint", "t", None, None, "BIGINT")]),
    ("CREATE INDEX i{n} ON t (a)", [("require-concurrent-index", "i{n}", None, None, None)]),
    ("CREATE TABLE t{n} (a text, b bigint)", []),
]


def _lint(spark, sf_dir):
    found = statements.violations(shaped(spark, sf_dir, ORDERS, [s for s, _ in _LINT]), "n")
    # where the key's own length moves a place, it is not compared
    moved = F.col("first") > 50
    place = lambda c: F.when(~moved, F.col(c)).cast("long").alias(c)
    return found.select("n", "code", "object", place("first"), place("past"), "fix")


registered(
    "lint_rules",
    expected_rows(ORDERS, ["code", "object", "first", "past", "fix"], [r for _, r in _LINT], {"first": LONG, "past": LONG}),
    _lint,
)

told(
    "lint_fixes", ORDERS, {"fixed": statements.fixed}, {},
    [
        ("CREATE TABLE t{n} (a varchar(20) DEFAULT 'x int', \"B c\" int, d character varying (30))", "CREATE TABLE t{n} (a TEXT DEFAULT 'x int', \"B c\" BIGINT, d TEXT)"),
        ("ALTER TABLE t{n} ADD COLUMN IF NOT EXISTS x int NOT NULL, ADD y int4", "ALTER TABLE t{n} ADD COLUMN IF NOT EXISTS x BIGINT NOT NULL, ADD y BIGINT"),
        ("-- lint-ignore: prefer-bigint\nCREATE TABLE t{n} (a int, b varchar(3))", "-- lint-ignore: prefer-bigint\nCREATE TABLE t{n} (a int, b TEXT)"),
        ("DELETE FROM t{n}", "DELETE FROM t{n}"),
        ("CREATE TABLE t{n} (a interval, b text /* int */)", "CREATE TABLE t{n} (a interval, b text /* int */)"),
    ],
)

_SCOPED = [
    "-- lint-ignore-file: ban-drop-table\nDROP TABLE a{n}; DROP TABLE b{n}",
    "DROP TABLE a{n} /* lint-ignore-next: prefer-bigint */; CREATE TABLE c (x int); CREATE TABLE d (y int)",
    "-- lint-ignore-next: ban-drop-table\nDROP TABLE a{n}; DROP TABLE b{n}",
    "-- lint-ignore: prefer-text\nDROP TABLE a{n}",
]
registered(
    "lint_scopes",
    expected_rows(CUSTOMERS, ["idx", "code", "ignored"], [
        [(0, "ban-drop-table", True), (1, "ban-drop-table", True)],
        [(0, "ban-drop-table", False), (1, "prefer-bigint", True), (2, "prefer-bigint", False)],
        [(0, "ban-drop-table", True), (1, "ban-drop-table", False)],
        [(0, "ban-drop-table", False)],
    ], {"idx": LONG, "ignored": BOOL}),
    lambda spark, sf_dir: statements.violations(
        statements.in_scripts(statements.split(shaped(spark, sf_dir, CUSTOMERS, _SCOPED), "n", sql="sql"), "n"), "n", "idx"
    ).select("n", F.col("idx").cast("long").alias("idx"), "code", "ignored"),
)
registered(
    "unused_ignores",
    "SELECT CAST(c_custkey AS BIGINT) AS n, 'prefer-text' AS code FROM customer WHERE c_custkey % 2 = 0",
    lambda spark, sf_dir: statements.unused_ignores(
        shaped(spark, sf_dir, CUSTOMERS, ["-- lint-ignore: ban-drop-table, prefer-text\nDROP TABLE t{n}", "-- lint-ignore: ban-drop-table\nDROP TABLE t{n}"]), "n"
    ),
)

told(
    "statement_patterns", ORDERS,
    {
        "foreign_refs": listed(patterns.foreign_references), "auth": patterns.auth_pattern, "dynamic": patterns.is_dynamic,
        "inner": listed(patterns.block_statements), "types": listed(patterns.nested_types), "target": patterns.comment_target,
        "volatility": patterns.volatility,
    },
    {"dynamic": BOOL},
    [
        ("SELECT auth.uid(), {n} FROM auth.users", "auth.uid()|auth.users", "session", False, "", "", "", "STABLE"),
        ("CREATE POLICY p{n} ON storage.objects USING (true)", "storage.objects", "storage_policy", False, "", "", "", "VOLATILE"),
        ("SELECT auth.jwt() ->> 'sub', {n}", "auth.jwt()", "jwt", False, "", "", "", "STABLE"),
        ("ALTER TABLE t{n} ENABLE ROW LEVEL SECURITY", "", "row_security", False, "", "", "", "VOLATILE"),
        ("DO $x$ BEGIN CREATE TYPE m{n} AS ENUM ('a'); ALTER TABLE t  ADD c int; END $x$", "", "none", False, "CREATE TYPE m{n} AS ENUM ('a')|ALTER TABLE t ADD c int", "m{n}", "", "IMMUTABLE"),
        ("COMMENT ON COLUMN s.t{n}.c IS 'x'", "", "none", False, "", "", "table:s.t{n}", "IMMUTABLE"),
        ("COMMENT ON TABLE t{n} IS 'x'", "", "none", False, "", "", "table:t{n}", "IMMUTABLE"),
        ("EXECUTE format('DROP TABLE %I', 't{n}')", "", "none", True, "", "", "", "IMMUTABLE"),
    ],
)

_ROLLBACK = [
    ("CREATE TABLE t{n} (a int)", "DROP TABLE IF EXISTS t{n}", 3),
    ("ALTER TABLE t{n} ADD COLUMN b int", "ALTER TABLE t{n} DROP COLUMN IF EXISTS b", 6),
    ("ALTER TABLE t{n} RENAME COLUMN a TO c", "ALTER TABLE t{n} RENAME COLUMN c TO a", 6),
    ("ALTER TABLE t{n} ADD CONSTRAINT k CHECK (a > 0)", "ALTER TABLE t{n} DROP CONSTRAINT IF EXISTS k", 6),
    ("GRANT SELECT ON t{n} TO u", None, None),
    ("DELETE FROM t{n}", "-- can't be undone: DELETE FROM t{n}", 1),
    ("CREATE TYPE e{n} AS ENUM ('x')", "DROP TYPE IF EXISTS e{n}", 1),
    ("CREATE MATERIALIZED VIEW v{n} AS SELECT 1", "DROP MATERIALIZED VIEW IF EXISTS v{n}", 1),
]
registered(
    "rollback_plan",
    "SELECT *, sha256(sql) AS checksum FROM ("
    + expected(ORDERS, {"sql": ([r for _, r, _ in _ROLLBACK], None), "seconds": ([s for _, _, s in _ROLLBACK], LONG)})
    + ") WHERE sql IS NOT NULL",
    lambda spark, sf_dir: patterns.rollback(
        shaped(spark, sf_dir, ORDERS, [s for s, *_ in _ROLLBACK]).select(F.col("n").alias("seq"), F.lit(0).alias("idx"), "sql")
    ).select(F.col("seq").alias("n"), "sql", "seconds", "checksum"),
)

told(
    "identifier_rules", ORDERS,
    {
        "folded": identifiers.folded, "valid": identifiers.is_valid, "repaired": identifiers.repaired, "parts": listed(identifiers.name_parts),
        "reserved": identifiers.is_keyword, "ddl": lambda s: identifiers.is_keyword_in(s, "ddl"), "safe": identifiers.quoted_if_needed,
    },
    {"valid": BOOL, "reserved": BOOL, "ddl": BOOL},
    [
        ("Abc{n}", "abc{n}", False, "abc{n}", "abc{n}", False, False, '"Abc{n}"'),
        ('"A""b{n}"', 'A"b{n}', False, "_a_b{n}_", 'A"b{n}', False, False, '"""A""""b{n}"""'),
        ("order", "order", True, "order", "order", True, True, '"order"'),
        ("cascade", "cascade", True, "cascade", "cascade", False, True, "cascade"),
        ("9 lives {n}", "9 lives {n}", False, "_9_lives_{n}", "9 lives {n}", False, False, '"9 lives {n}"'),
        ("app{n}.T", "app{n}.t", False, "app{n}_t", "app{n}|t", False, False, '"app{n}.T"'),
        ("x" * 70, "x" * 63, False, "x" * 63, "x" * 63, False, False, '"' + "x" * 70 + '"'),
    ],
)

told(
    "type_rules", ORDERS,
    {"canonical": identifiers.canonical_type, "dims": identifiers.array_dimensions, "size": identifiers.type_size},
    {"dims": LONG, "size": LONG},
    [("VARCHAR({n})", "character varying", 0, -1), ("int4[][]", "integer", 2, -1), ("numeric({n}, 2)", "numeric", 0, -1), ("Timestamp", "timestamp without time zone", 0, 8),
     ("uuid", "uuid", 0, 16), ("bool", "boolean", 0, 1), ("int8", "bigint", 0, 8), ("mood{n}", "mood{n}", 0, -1)],
)

_PAIRS = [
    ("int>bigint", "ALTER TABLE {table} ALTER COLUMN c{n} TYPE bigint", "ALTER TABLE {table} ALTER COLUMN c{n} TYPE int", True, False),
    ("bigint>int", "ALTER TABLE {table} ALTER COLUMN c{n} TYPE int", None, False, True),
    ("text>date", "ALTER TABLE {table} ALTER COLUMN c{n} TYPE date USING c{n}::date", None, False, False),
    ("boolean>date", None, None, False, False),
    ("varchar(9)>text", "ALTER TABLE {table} ALTER COLUMN c{n} TYPE text", "ALTER TABLE {table} ALTER COLUMN c{n} TYPE varchar(9)", True, False),
]


def _conversions(spark, sf_dir):
    own = shaped(spark, sf_dir, PARTS, [p for p, *_ in _PAIRS])
    side = lambda k: F.split_part("sql", F.lit(">"), F.lit(k))
    made = rewrites.type_conversion(side(1), side(2), F.concat(F.lit("c"), F.col("n").cast("string")))
    return own.select("n", made.alias("c")).select("n", "c.sql", "c.reverse", "c.reversible", "c.lossy")


registered(
    "type_conversions",
    expected(PARTS, {c: ([p[i + 1] for p in _PAIRS], BOOL if i > 1 else None) for i, c in enumerate(("sql", "reverse", "reversible", "lossy"))}),
    _conversions,
)

told(
    "text_rewrites", ORDERS,
    {
        "counted": rewrites.counted_in_characters, "policy": rewrites.repaired_drop_policy, "ended": rewrites.terminated,
        "replaced": lambda s: rewrites.whole_word_replaced(s, F.lit("t"), F.lit("u$1")), "times": lambda s: rewrites.word_count(s, F.lit("t")),
        "renamed": lambda s: rewrites.names_replaced(s, F.create_map(F.lit("mood"), F.lit("feeling"), F.lit("t"), F.lit("v"))),
        "marked": lambda s: rewrites.marked_volatility(s, F.lit("STABLE")),
    },
    {"times": LONG},
    [
        ("SELECT length(a{n}), char_length(b), t.length FROM t", "SELECT char_length(a{n}), char_length(b), t.length FROM t", "SELECT length(a{n}), char_length(b), t.length FROM t",
         "SELECT length(a{n}), char_length(b), t.length FROM t", "SELECT length(a{n}), char_length(b), u$1.length FROM u$1", 2,
         "SELECT length(a{n}), char_length(b), v.length FROM v", "SELECT length(a{n}), char_length(b), t.length FROM t"),
        ("DROP POLICY IF EXISTS s.x.p{n} ON t", "DROP POLICY IF EXISTS s.x.p{n} ON t", "DROP POLICY IF EXISTS p{n} ON t", "DROP POLICY IF EXISTS s.x.p{n} ON t;",
         "DROP POLICY IF EXISTS s.x.p{n} ON u$1", 1, "DROP POLICY IF EXISTS s.x.p{n} ON v", "DROP POLICY IF EXISTS s.x.p{n} ON t"),
        ("CREATE TABLE x{n} (\n  a mood\n)\nDROP TABLE moody", "CREATE TABLE x{n} (\n  a mood\n)\nDROP TABLE moody", "CREATE TABLE x{n} (\n  a mood\n)\nDROP TABLE moody",
         "CREATE TABLE x{n} (\n  a mood\n)\nDROP TABLE moody;", "CREATE TABLE x{n} (\n  a mood\n)\nDROP TABLE moody", 0,
         "CREATE TABLE x{n} (\n  a feeling\n)\nDROP TABLE moody", "CREATE TABLE x{n} (\n  a mood\n)\nDROP TABLE moody"),
        ("CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'x'", "CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'x'", "CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'x'",
         "CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'x'", "CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'x'", 0,
         "CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql AS 'x'", "CREATE FUNCTION f{n}() RETURNS int LANGUAGE sql STABLE AS 'x'"),
    ],
)

registered(
    "duration_texts",
    """SELECT CAST(o_orderkey AS BIGINT) AS n, CASE WHEN ms = 0 THEN 'N/A' WHEN ms < 1000 THEN ms || 'ms'
  WHEN ms < 60000 THEN ((ms + 5) // 1000) || '.' || lpad(CAST((ms + 5) % 1000 // 10 AS VARCHAR), 2, '0') || 's' ELSE (ms // 60000) || 'm' || ((ms % 60000) // 1000) || 's' END AS duration
FROM (SELECT o_orderkey, (o_orderkey * 7919) % 200000 * (o_orderkey % 3) AS ms FROM orders)""",
    lambda spark, sf_dir: table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("n"), rewrites.duration_text(F.col("o_orderkey") * 7919 % 200000 * (F.col("o_orderkey") % 3)).alias("duration")
    ),
)


def _indexes(spark, sf_dir):
    n = F.col("p_partkey")
    parts = F.array(
        F.struct(F.lit("Name").alias("column"), F.lit(None).cast("string").alias("expression"), F.when(n % 2 == 0, "DESC").alias("order")),
        F.struct(F.lit("x").alias("column"), F.when(n % 3 == 0, "lower(a)").alias("expression"), F.lit(None).cast("string").alias("order")),
    )
    made = rewrites.create_index(
        filled("i{n}", n), F.lit("s.t"), parts, unique=n % 2 == 1, method=F.when(n % 5 == 0, "GIN"), where=F.when(n % 7 == 0, "a > 0")
    )
    return table(spark, sf_dir, "part").select(n.cast("long").alias("n"), made.alias("sql"))


registered(
    "index_builder",
    """SELECT CAST(p_partkey AS BIGINT) AS n, 'CREATE ' || CASE WHEN p_partkey % 2 = 1 THEN 'UNIQUE ' ELSE '' END || 'INDEX i' || p_partkey || ' ON s.t'
  || CASE WHEN p_partkey % 5 = 0 THEN ' USING gin' ELSE '' END || ' ("Name"' || CASE WHEN p_partkey % 2 = 0 THEN ' DESC' ELSE '' END
  || ', ' || CASE WHEN p_partkey % 3 = 0 THEN 'lower(a)' ELSE 'x' END || ')' || CASE WHEN p_partkey % 7 = 0 THEN ' WHERE a > 0' ELSE '' END AS sql FROM part""",
    _indexes,
)

_NAMED = [
    ("CREATE INDEX foo{n} ON t (a)", ["INDEX_NAME"]), ("CREATE TABLE users{n} (a int)", []), ('CREATE TABLE "order" (a int)', ["RESERVED_WORD"]),
    ("CREATE FUNCTION f() RETURNS int AS 'x' LANGUAGE sql", ["SHORT_FUNCTION_NAME"]), ("CREATE INDEX idx_{n} ON t (a)", []),
    ("CREATE VIEW " + "v" * 70 + " AS SELECT 1", ["LONG_NAME"]), ("DROP INDEX foo{n}", []),
]
registered(
    "naming_warnings",
    expected_rows(ORDERS, ["warning"], [[(w,) for w in found] for _, found in _NAMED]),
    lambda spark, sf_dir: patterns.naming_warnings(statements.analysed(shaped(spark, sf_dir, ORDERS, [s for s, _ in _NAMED])), "n"),
)

_PUBLISHED = ["ALTER PUBLICATION p ADD TABLE a{n}", "ALTER PUBLICATION p ADD TABLE s.t", "ALTER PUBLICATION q ADD TABLE ONLY public.\"B\"", "DROP TABLE a{n}"]
registered(
    "publication_targets",
    """SELECT min(CAST(o_orderkey AS BIGINT)) AS seq, publication, target FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'q' ELSE 'p' END AS publication,
    CASE o_orderkey % 4 WHEN 0 THEN 'public.a' || o_orderkey WHEN 1 THEN 's.t' ELSE 'public.B' END AS target
  FROM orders WHERE o_orderkey % 4 < 3) GROUP BY publication, target""",
    lambda spark, sf_dir: patterns.publication_targets(
        shaped(spark, sf_dir, ORDERS, _PUBLISHED).select(F.col("n").alias("seq"), F.lit(0).alias("idx"), "sql")
    ).select("seq", "publication", "target"),
)

_EXTENDED = ['CREATE EXTENSION "zz{n}"', "SELECT ST_Distance(a, b) FROM t{n}", "create extension if not exists Earthdistance", "SELECT a <%> 'b{n}'", "SELECT 'uuid_generate_v4()', {n}"]
registered(
    "used_extensions",
    """SELECT 'zz' || c_custkey AS name, true AS made, false AS used FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT * FROM (VALUES ('postgis', false, true), ('earthdistance', true, false), ('cube', false, true), ('pg_trgm', false, true))""",
    lambda spark, sf_dir: patterns.used_extensions(shaped(spark, sf_dir, CUSTOMERS, _EXTENDED)),
)
registered(
    "extension_order",
    """SELECT name, row_number() OVER (ORDER BY name <> 'earthdistance', name) AS place FROM (
  SELECT 'zz' || s_suppkey AS name FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'earthdistance')""",
    lambda spark, sf_dir: patterns.extensions(shaped(spark, sf_dir, SUPPLIERS, _EXTENDED)).select("name", F.col("place").cast("long").alias("place")),
)

_VENDOR = ["SELECT auth.uid() -- {n}", "CREATE TABLE _prisma_migrations (a int)", "--> statement-breakpoint", "SELECT 'No legacy auth.uid()', {n}"]
registered(
    "vendors",
    "SELECT * FROM (VALUES ('supabase', 90), ('prisma', 75)) AS v(vendor, priority)",
    lambda spark, sf_dir: patterns.vendors(shaped(spark, sf_dir, CUSTOMERS, _VENDOR)),
)
told(
    "vendor_signs", CUSTOMERS, {v: (lambda s, v=v: patterns.vendor_signs(s, v)) for v, *_ in patterns.VENDORS}, {v: BOOL for v, *_ in patterns.VENDORS},
    [
        ("SELECT auth.jwt() -> 'o'->>'id', {n}", True, False, False, False), ("SELECT clerk_user_id(), {n}", True, False, False, False),
        ("SELECT auth.jwt() ->> 'sub', {n}", True, False, False, False), ("SELECT auth.jwt() ->> 'sub', auth.uid(), {n}", False, True, False, False),
        ("ALTER PUBLICATION supabase_realtime ADD TABLE t{n}", False, True, False, False), ("-- CreateTable\nCREATE TABLE t{n} (a varchar(191))", False, False, True, False),
        ("CREATE TABLE t{n} (id int GENERATED BY DEFAULT AS IDENTITY)", False, False, False, True), ("-- createtable\nSELECT {n}", False, False, False, False),
    ],
)


def _vendor_conflicts(spark, sf_dir):
    """The vendors that a customer asks for are the bits of its key."""
    names = ["clerk", "supabase", "prisma", "drizzle"]
    asked = F.array_compact(F.array(*[F.when(F.floor(F.col("c_custkey") / 2**i) % 2 == 1, F.lit(v)) for i, v in enumerate(names)]))
    return patterns.exclusions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), asked.alias("vendors")), "key")


registered(
    "vendor_conflicts",
    """SELECT c_custkey AS key, vendor, priority, NOT coalesce(c_custkey // o % 2 = 1, false) AS active, CASE WHEN c_custkey // o % 2 = 1 THEN other END AS excluded_by
FROM customer JOIN (VALUES (1, 'clerk', 95, NULL, NULL), (2, 'supabase', 90, 1, 'clerk'), (4, 'prisma', 75, NULL, NULL), (8, 'drizzle', 75, 4, 'prisma'))
  AS v(b, vendor, priority, o, other) ON c_custkey // b % 2 = 1""",
    _vendor_conflicts,
)


def _resolved(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, filled("App.t{n}", F.col("c_custkey"))).otherwise(filled("t{n}", F.col("c_custkey")))
    schema = F.explode(F.expr("CASE c_custkey % 4 WHEN 0 THEN array('public', 'app') WHEN 1 THEN array('public') WHEN 2 THEN array('other') ELSE array('app') END"))
    catalog = cust.select(schema.alias("schema"), filled("t{n}", F.col("c_custkey")).alias("object"))
    return patterns.resolved(cust.select(name.alias("name")), catalog, ["app", "public"])


registered(
    "search_path",
    """SELECT name, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 IN (0, 3) THEN 'app' END
  ELSE CASE k % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'public' WHEN 3 THEN 'app' END END AS schema
FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'App.t' ELSE 't' END || c_custkey AS name FROM customer)""",
    _resolved,
)

told(
    "alter_separation", ORDERS, {"separate": rules.must_be_separate, "checked": lambda s: rules.checked_result(s)["sql"], "error": lambda s: rules.checked_result(s)["error"], "function": rules.function_name},
    {"separate": BOOL},
    [
        ("ALTER TABLE t{n} ADD COLUMN a int", False, "ALTER TABLE t{n} ADD COLUMN a int;", None, None),
        ("ALTER TABLE t{n} ALTER COLUMN a TYPE text;", True, "ALTER TABLE t{n} ALTER COLUMN a TYPE text;", None, None),
        ("ALTER TABLE t{n} NO FORCE ROW LEVEL SECURITY", True, "ALTER TABLE t{n} NO FORCE ROW LEVEL SECURITY;", None, None),
        ("ALTER TABLE t{n} OWNER TO x", True, "ALTER TABLE t{n} OWNER TO x;", None, None),
        ("ALTER TABLE t{n} SET (fillfactor = 70)", True, "ALTER TABLE t{n} SET (fillfactor = 70);", None, None),
        ("DROP SCHEMA s{n}", False, "DROP SCHEMA s{n};", "DANGEROUS", None),
        ("SELECT 'TRUNCATE', {n}", False, "SELECT 'TRUNCATE', {n};", None, None),
        ("  ", False, "", "EMPTY", None),
        ("CREATE OR REPLACE FUNCTION s.\"F{n}\"(a int) RETURNS int AS 'x' LANGUAGE sql", False, "CREATE OR REPLACE FUNCTION s.\"F{n}\"(a int) RETURNS int AS 'x' LANGUAGE sql;", None, "F{n}"),
    ],
)


def _policies(spark, sf_dir):
    shapes = ["CREATE POLICY p{n} ON t USING (a = 1)", "CREATE POLICY q{n} ON t USING ( a = 1 ) WITH CHECK (f(b) > 0)", "CREATE POLICY r{n} ON t USING (a = 2)"]
    own = shaped(spark, sf_dir, CUSTOMERS, shapes).withColumn("owner", F.floor(F.col("n") / 2))
    return rules.same_policy_logic(own, "owner")


registered(
    "same_policies",
    """SELECT CAST(c_custkey // 2 AS BIGINT) AS owner, count(*) AS n, count(DISTINCT CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 1 END) = 1 AS same
FROM customer GROUP BY 1""",
    _policies,
)


def _functions(spark, sf_dir):
    shapes = ["CREATE FUNCTION f(a int) RETURNS int AS 'x' LANGUAGE sql", "CREATE OR REPLACE FUNCTION S.F() RETURNS int AS 'x' LANGUAGE sql", "CREATE FUNCTION g{n}() RETURNS int AS 'x' LANGUAGE sql"]
    return rules.same_function(shaped(spark, sf_dir, CUSTOMERS, shapes).withColumn("owner", F.floor(F.col("n") / 2)), "owner")


registered(
    "same_functions",
    """SELECT CAST(c_custkey // 2 AS BIGINT) AS owner, count(*) >= 2 AND count_if(c_custkey % 3 = 2) = 0 AS same FROM customer GROUP BY 1""",
    _functions,
)


def _dependencies(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    asked = F.explode(F.array(*[filled(x, F.col("c_custkey")) for x in ("app.t{n}", "column:t{n}.id", "mood{n}", "type:mood{n}", "function:f{n}", "schema:s")]))
    given = F.explode(F.array(*[filled(x, F.col("c_custkey")) for x in ("public.t{n}", "t{n}", "type:mood{n}", "function:f{n}", "function:t{n}")]))
    return relate.matched_dependencies(cust.select(asked.alias("dependency")), cust.select(given.alias("provision")))


registered(
    "dependency_matches",
    """SELECT replace(d, '{n}', CAST(c_custkey AS VARCHAR)) AS dependency, replace(p, '{n}', CAST(c_custkey AS VARCHAR)) AS provision
FROM customer, (VALUES ('app.t{n}', 'public.t{n}'), ('app.t{n}', 't{n}'), ('column:t{n}.id', 't{n}'), ('mood{n}', 'type:mood{n}'),
  ('type:mood{n}', 'type:mood{n}'), ('function:f{n}', 'function:f{n}')) AS m(d, p)""",
    _dependencies,
)
registered(
    "external_dependencies",
    "SELECT CAST(c_custkey AS BIGINT) AS n, 'public.t' || c_custkey AS dependency FROM customer WHERE c_custkey % 3 = 2",
    lambda spark, sf_dir: rules.without_external(
        shaped(spark, sf_dir, CUSTOMERS, ["Auth.users{n}", "type:storage.t{n}", "public.t{n}"]).withColumnRenamed("sql", "dependency"), ["auth", "storage"]
    ),
)



def _settings(spark, sf_dir):
    """Each customer's settings disable a rule, by its key."""
    name = F.get(F.array(*[F.lit(n) for n, *_ in rules.RULES]), (F.col("c_custkey") % len(rules.RULES)).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array(name).alias("disabled"))


registered(
    "rule_registry",
    """SELECT c_custkey AS key, name, priority, tags, c_custkey % 15 <> i AS enabled FROM customer, (VALUES
  (0, 'multiple_create_consolidation', 100, 'safe|standard'), (1, 'separate_alter', 95, 'safe|standard|execution-order'),
  (2, 'create_alter_consolidation', 90, 'safe|standard'), (3, 'drop_create_cycle', 85, 'safe|optimization'),
  (6, 'enum_deduplication', 75, 'safe|types'), (10, 'do_block_enum_type', 55, 'safe|types|do_block'), (12, 'conditional_schema', 45, 'safe|schema'))
  AS r(i, name, priority, tags)""",
    lambda spark, sf_dir: rules.rules_of(_settings(spark, sf_dir), rules.with_tag(rules.rule_table(spark), "safe").where("category = 'table_ops'")).select(
        "key", "name", "priority", F.array_join("tags", "|").alias("tags"), "enabled"
    ),
)
registered(
    "rule_counts",
    """WITH r AS (SELECT * FROM (VALUES ('table_ops', 9, [0, 1, 2, 3, 6, 7, 8, 10, 12]), ('function_ops', 1, [4]), ('optimization', 4, [5, 11, 13, 14]), ('security', 1, [9]))
  AS r(category, n, own))
SELECT c_custkey AS key, category, n, n - CASE WHEN list_contains(own, c_custkey % 15) THEN 1 ELSE 0 END AS n_enabled FROM customer, r""",
    lambda spark, sf_dir: rules.counts_of(_settings(spark, sf_dir), rules.rule_table(spark)),
)

_WARNED = [
    "ALTER TABLE a{n} ADD CONSTRAINT c CHECK (x > 0)", "ALTER TABLE b{n} ADD x int", "CREATE INDEX i{n} ON t (a)", "INSERT INTO t VALUES ({n})", "CREATE INDEX CONCURRENTLY j{n} ON t (a)",
]


def _warnings(spark, sf_dir):
    own = statements.analysed(shaped(spark, sf_dir, CUSTOMERS, _WARNED)).withColumn("stream", F.col("n") % 7).withColumn("batch", F.floor(F.col("n") / 40))
    return batches.statement_warnings(own, "stream", most=5, most_concurrent=20).withColumn("n", F.col("n").cast("long"))


registered(
    "batch_statement_warnings",
    """WITH s AS (SELECT c_custkey % 7 AS stream, CAST(c_custkey // 40 AS BIGINT) AS batch, c_custkey % 5 AS k, c_custkey FROM customer),
b AS (SELECT stream, batch, count(*) AS n, count_if(k IN (0, 4)) AS slow, count_if(k IN (0, 1)) AS x, count(DISTINCT CASE WHEN k IN (0, 1) THEN c_custkey END) AS targets,
  count_if(k = 0) AS nv, count_if(k = 2) AS nc FROM s GROUP BY stream, batch)
SELECT stream, batch, 'LARGE' AS warning, n FROM b WHERE n > 5 UNION ALL SELECT stream, batch, 'SLOW', slow FROM b WHERE slow > 0
UNION ALL SELECT stream, batch, 'EXCLUSIVE', x FROM b WHERE x > 0 UNION ALL SELECT stream, batch, 'MANY_TARGETS', targets FROM b WHERE targets > 1
UNION ALL SELECT stream, batch, 'NOT_VALID', nv FROM b WHERE nv > 0 UNION ALL SELECT stream, batch, 'NOT_CONCURRENT', nc FROM b WHERE nc > 0
UNION ALL SELECT stream, NULL, 'MANY_CONCURRENT', count_if(k = 4) FROM s GROUP BY stream HAVING count_if(k = 4) > 20""",
    _warnings,
)

told(
    "path_globs", CUSTOMERS, {"deep": lambda s: patterns.matches_glob(s, "**/*.sql"), "one": lambda s: patterns.matches_glob(s, "a/?.sql"), "plus": lambda s: patterns.matches_glob(s, "a+b/**")},
    {"deep": BOOL, "one": BOOL, "plus": BOOL},
    [("a/b/{n}.sql", True, False, False), ("a/b.sql", True, True, False), ("a+b/{n}/c.txt", False, False, True), ("aab/{n}", False, False, False)],
)
registered(
    "line_numbers",
    """SELECT doc_id, CAST(length(substr(t, 1, k)) - length(replace(substr(t, 1, k), chr(10), '')) + 1 AS BIGINT) AS line
FROM (SELECT doc_id, text AS t, doc_id % 997 AS k FROM documents WHERE text IS NOT NULL)""",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", patterns.line_of(F.col("text"), (F.col("doc_id") % 997).cast("int")).cast("long").alias("line")
    ),
)

told(
    "statement_dependencies", ORDERS,
    {"typed": listed(statements.typed_dependencies), "calls": listed(statements.called_functions), "schema": lambda s: statements.schema_of(statements.object_name(s)), "above": listed(statements.leading_comments)},
    {},
    [
        ("CREATE TABLE app.t{n} (a int REFERENCES p{n}(id), b int DEFAULT f(now()), FOREIGN KEY (b) REFERENCES S.q (x))", "REFERENCES:p{n}|REFERENCES:s.q", "app.t{n}|p{n}|f|now|s.q", "app", ""),
        ("-- one\n/* two */ ALTER TABLE t{n} ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES u(id), ADD COLUMN b int, DROP COLUMN z", "CONSTRAINT:c|REFERENCES:u|COLUMN:b", "u", "public", "one|two"),
        ("CREATE VIEW v{n} AS SELECT lower(a), count(*) FROM t WHERE EXISTS (SELECT 1 FROM u) AND x IN (1, 2) -- f(x)", "", "lower|count", "public", ""),
        ("SELECT 'g(1)', Auth.UID(), {n}", "", "auth.uid", "public", ""),
    ],
)
registered(
    "statement_positions",
    expected_rows(
        ORDERS, ["idx", "line", '"column"', '"offset"'], [[(0, 1, 1, 0), (1, 2, 2, 14)], [(0, 3, 1, 10), (1, 4, 3, 22)], []],
        {"idx": LONG, "line": LONG, '"column"': LONG, '"offset"': LONG},
    ),
    lambda spark, sf_dir: statements.positions(
        shaped(spark, sf_dir, ORDERS, ["SELECT 'a;';\n SELECT {n}", "-- c ;\n--\nSELECT 1;\n  SELECT {n}", "-- {n}"]), "n", sql="sql"
    ).withColumn("idx", F.col("idx").cast("long")),
)
told(
    "inverse_alters", ORDERS, {"undo": patterns.inverse}, {},
    [
        ("ALTER TABLE t{n} ADD a int, ADD CONSTRAINT c CHECK (a > 0), RENAME b TO d", "ALTER TABLE t{n} RENAME COLUMN d TO b, DROP CONSTRAINT IF EXISTS c, DROP COLUMN IF EXISTS a"),
        ("ALTER TABLE ONLY t{n} ALTER COLUMN a SET NOT NULL, ALTER b SET DEFAULT 'x, y'", "ALTER TABLE t{n} ALTER COLUMN b DROP DEFAULT, ALTER COLUMN a DROP NOT NULL"),
        ("ALTER TABLE t{n} RENAME TO u", "ALTER TABLE u RENAME TO t{n}"), ("ALTER TABLE t{n} FORCE ROW LEVEL SECURITY", "ALTER TABLE t{n} NO FORCE ROW LEVEL SECURITY"),
        ("ALTER TABLE t{n} ADD a int, DROP COLUMN b", "-- can't be undone: ALTER TABLE t{n} ADD a int, DROP COLUMN b"),
        ("ALTER TABLE t{n} ADD PRIMARY KEY (a)", "-- can't be undone: ALTER TABLE t{n} ADD PRIMARY KEY (a)"),
        ("CREATE POLICY p{n} ON app.t USING (true)", "DROP POLICY IF EXISTS p{n} ON app.t"), ("CREATE TRIGGER g AFTER UPDATE OF a ON t{n} EXECUTE FUNCTION f()", "DROP TRIGGER IF EXISTS g ON t{n}"),
        ("CREATE FUNCTION f{n}(a int, b numeric(4, 2) DEFAULT 1) RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql", "DROP FUNCTION IF EXISTS f{n}(a int, b numeric(4, 2))"),
        ("CREATE OR REPLACE VIEW v AS SELECT '{n}'", "-- can't be undone: CREATE OR REPLACE VIEW v AS SELECT '{n}'"), ("CREATE TABLE IF NOT EXISTS t{n} (a int)", "-- can't be undone: CREATE TABLE IF NOT EXISTS t{n} (a int)"),
        ("INSERT INTO t{n} VALUES (1)", "-- DELETE FROM t{n} WHERE <the rows of this INSERT>"), ("GRANT SELECT ON t{n} TO x", None),
    ],
)
_STRUCTURAL = [
    ("DROP SCHEMA s{n}", ["DATA_LOSS"]), ("ALTER TABLE t{n} DROP b", ["DATA_LOSS"]), ("ALTER TABLE t{n} ALTER a TYPE text", ["TYPE_CONVERSION"]),
    ("CREATE UNIQUE INDEX i{n} ON t (a)", ["UNIQUE_INDEX", "BLOCKING_INDEX"]), ("ALTER TABLE t{n} ADD a int NOT NULL", ["NOT_NULL_WITHOUT_DEFAULT"]),
    ("ALTER TABLE t{n} ADD a int NOT NULL DEFAULT 1", []), ("CREATE TABLE t{n} (a int GENERATED ALWAYS AS (1) STORED, b vector(3))", ["GENERATED_COLUMN", "VECTOR_TYPE"]),
    ("ALTER TABLE t{n} ALTER a DROP DEFAULT", []),
]
registered(
    "structural_warnings",
    expected_rows(ORDERS, ["warning"], [[(w,) for w in found] for _, found in _STRUCTURAL]),
    lambda spark, sf_dir: patterns.structural_warnings(shaped(spark, sf_dir, ORDERS, [s for s, _ in _STRUCTURAL]), "n"),
)
told(
    "array_types", ORDERS, {"element": lambda s: identifiers.element_type(s)["element"], "dims": lambda s: identifiers.element_type(s)["dimensions"], "system": lambda s: relate.is_system_function(s, F.lit(None).cast("string"))},
    {"dims": LONG, "system": BOOL},
    [("int4[][3]", "integer", 2, False), ("pg_sleep", "pg_sleep", 0, True), ("varchar({n})[]", "character varying", 1, False)],
)


def _dangling(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    name = lambda text: filled(text, F.col("c_custkey"))
    asked = cust.select(name(F.get(F.array(*map(F.lit, ("t{n}", "public.t{n}", "app.t{n}", "auth.t{n}"))), F.col("c_custkey") % 4)).alias("name"))
    there = cust.where("c_custkey % 3 != 0").select(name(F.when(F.col("c_custkey") % 5 == 0, "app.t{n}").otherwise("t{n}")).alias("name"))
    return relate.dangling_names(asked, there, ("^auth\\.",))


registered(
    "dangling_names",
    """SELECT ['t', 'public.t', 'app.t', 'auth.t'][1 + n % 4] || n AS name FROM (SELECT c_custkey AS n FROM customer)
WHERE n % 4 < 3 AND (n % 3 = 0 OR (n % 4 = 1 AND n % 5 = 0))""",
    _dangling,
)


def _on_path(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    schema = F.explode(F.expr("CASE c_custkey % 3 WHEN 0 THEN array('public', 'app') WHEN 1 THEN array('other') ELSE array('app', 'app') END"))
    return relate.found_on_path(cust.select(filled("f{n}", F.col("c_custkey")).alias("name")), cust.select(schema.alias("schema"), filled("f{n}", F.col("c_custkey")).alias("object")), ["app", "public"])


registered(
    "functions_on_path",
    """SELECT 'f' || c_custkey AS name, s AS schema, CAST(p AS BIGINT) AS place FROM customer, (VALUES ('app', 1), ('public', 2)) AS x(s, p)
WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND s = 'app')""",
    _on_path,
)
