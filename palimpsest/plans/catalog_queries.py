"""Queries of the catalog as relations. Each supplier has a script that makes objects of its own, what and how depending on its
columns; the SQL works the catalog rows out from the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, relate
from palimpsest.plans import catalog
from palimpsest.plans.history import spread, table

QUERIES, ORACLES = {}, {}

#: When a supplier's script has a statement, and the statement; {k} is the supplier's key, {n} its nation's, {b} its balance in whole
#: numbers, {s} its name.
SCRIPT = (
    ("true", "CREATE TYPE n{n}.state{k} AS ENUM ('new', 'c{b}')"),
    ("k % 4 = 0", "CREATE EXTENSION e{k} WITH SCHEMA n{n} VERSION '1.{b}'"),
    ("k % 8 = 0", "ALTER EXTENSION e{k} UPDATE TO '2.{n}'"),
    ("k % 2 = 0", "CREATE SEQUENCE n{n}.q{k} AS int START WITH {k} INCREMENT BY 3"),
    ("k % 6 = 0", "ALTER SEQUENCE n{n}.q{k} MAXVALUE 9{k} CYCLE"),
    ("true", "CREATE TABLE n{n}.t{k} (id bigserial PRIMARY KEY, balance numeric(12,2) DEFAULT {b} NOT NULL, name varchar(25), state n{n}.state{k} DEFAULT 'c{b}', parent int REFERENCES root{n} (id) ON DELETE CASCADE)"),
    ("k % 3 = 0", "ALTER TABLE n{n}.t{k} ADD CONSTRAINT low{k} CHECK (balance > -{k}), ALTER COLUMN name SET NOT NULL"),
    ("k % 3 = 1", "ALTER TABLE n{n}.t{k} DROP COLUMN name, ADD COLUMN note text UNIQUE"),
    ("k % 3 = 2", "ALTER TABLE n{n}.t{k} RENAME COLUMN name TO title"),
    ("k % 2 = 1", "CREATE INDEX i{k} ON n{n}.t{k} USING btree (balance, lower(state)) WHERE balance > {b}"),
    ("k % 5 = 1", "CREATE INDEX j{k} ON n{n}.t{k} (parent)"),
    ("k % 3 = 0", "CREATE VIEW n{n}.v{k} AS SELECT id FROM n{n}.t{k} WHERE balance > {b}"),
    ("k % 7 = 0", "CREATE MATERIALIZED VIEW n{n}.m{k} AS SELECT {k} AS k WITH NO DATA"),
    ("k % 2 = 0", "CREATE FUNCTION n{n}.f{k}(a int, b text DEFAULT '{s}') RETURNS trigger LANGUAGE plpgsql STABLE AS $$ BEGIN RETURN NEW{k}; END $$"),
    ("k % 10 = 0", "CREATE OR REPLACE FUNCTION n{n}.f{k}(x integer, y text) RETURNS trigger LANGUAGE plpgsql SECURITY DEFINER AS $$ BEGIN END $$"),
    ("k % 4 = 0", "CREATE TRIGGER g BEFORE UPDATE OR INSERT ON n{n}.t{k} FOR EACH ROW EXECUTE FUNCTION n{n}.f{k}()"),
    ("k % 5 = 0", "ALTER TABLE n{n}.t{k} ENABLE ROW LEVEL SECURITY"),
    ("k % 15 = 0", "ALTER TABLE n{n}.t{k} FORCE ROW LEVEL SECURITY"),
    ("k % 10 < 2", "CREATE POLICY p ON n{n}.t{k} FOR SELECT TO r{n}, app USING (id = {k})"),
    ("k % 9 = 0", "CREATE POLICY w ON n{n}.t{k} AS RESTRICTIVE WITH CHECK (balance < {b})"),
    ("true", "GRANT SELECT, INSERT ON n{n}.t{k} TO r{n}"),
    ("k % 3 = 0", "REVOKE INSERT ON n{n}.t{k} FROM r{n}"),
    ("true", "ALTER TABLE n{n}.t{k} OWNER TO first"),
    ("k % 2 = 0", "ALTER TABLE n{n}.t{k} OWNER TO o{n}"),
    ("true", "COMMENT ON TABLE n{n}.t{k} IS '{s}; it''s'"),
    ("k % 4 = 1", "COMMENT ON TABLE n{n}.t{k} IS NULL"),
)
SUPPLIERS = """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, 'n' || s_nationkey AS schema, CAST(s_nationkey AS VARCHAR) AS n,
  CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS VARCHAR) AS b, s_name AS name, CAST(s_suppkey AS VARCHAR) AS t FROM supplier)
"""


def scripts(spark, sf_dir):
    """seq, content: the script of each supplier."""
    own = spread(table(spark, sf_dir, "supplier"), "s_suppkey").select(
        F.col("s_suppkey").cast("long").alias("k"), F.col("s_nationkey").cast("string").alias("n"), F.floor(F.abs("s_acctbal")).cast("long").cast("string").alias("b"), "s_name"
    )

    def filled(text):
        for mark, value in (("{k}", F.col("k").cast("string")), ("{n}", F.col("n")), ("{b}", F.col("b")), ("{s}", F.col("s_name"))):
            text = F.replace(text if not isinstance(text, str) else F.lit(text), F.lit(mark), value)
        return text

    return own.select(F.col("k").alias("seq"), F.concat_ws(";\n", *[F.when(F.expr(on), filled(text)) for on, text in SCRIPT]).alias("content"))


def catalog_of(spark, sf_dir):
    return catalog.relations(scripts(spark, sf_dir))


def registered(name, sql, run):
    QUERIES[name], ORACLES[name] = run, SUPPLIERS + sql


def listed(df):
    """df with its lists as texts."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.select(*[F.array_join(c, ",").alias(c) if c in arrays else c for c in df.columns])


def relation(name, sql):
    registered(f"catalog_{name}", sql, lambda spark, sf_dir: listed(catalog_of(spark, sf_dir)[name]))


relation("extensions", """SELECT 'e' || t AS name, schema, CASE WHEN k % 8 = 0 THEN '2.' || n ELSE '1.' || b END AS version FROM s WHERE k % 4 = 0""")
relation(
    "relations",
    """SELECT schema, 't' || t AS name, 'table' AS kind, k % 5 = 0 AS row_security, k % 15 = 0 AS forced FROM s
UNION ALL SELECT schema, 'v' || t, 'view', false, false FROM s WHERE k % 3 = 0
UNION ALL SELECT schema, 'm' || t, 'materialized view', false, false FROM s WHERE k % 7 = 0""",
)
COLUMNS = """c(place, name, type, not_null, "default", on_) AS (VALUES
  (1, 'id', 'bigint', true, 'nextval(''{schema}.t{t}_id_seq''::regclass)', -1), (2, 'balance', 'numeric(12,2)', true, '{b}', -1),
  (3, 'name', 'character varying(25)', true, NULL, 0), (3, 'title', 'character varying(25)', false, NULL, 2),
  (4, 'state', '{schema}.state{t}', false, '''c{b}''', -1), (5, 'parent', 'integer', false, NULL, -1), (6, 'note', 'text', false, NULL, 1))
"""
FILL = "replace(replace(replace({0}, '{{schema}}', schema), '{{t}}', t), '{{b}}', b)"
relation(
    "columns",
    f""", {COLUMNS} SELECT schema, 't' || t AS "table", row_number() OVER (PARTITION BY k ORDER BY place) AS place, c.name,
 {FILL.format("type")} AS type, not_null, {FILL.format('"default"')} AS "default", CAST(NULL AS VARCHAR) AS generated, CAST(NULL AS VARCHAR) AS identity
 FROM s JOIN c ON on_ = -1 OR k % 3 = on_""",
)
CONSTRAINTS = """, con AS (
  SELECT k, schema, 't' || t AS "table", 't' || t || '_pkey' AS name, 'p' AS kind, 'id' AS columns, NULL AS target, '' AS target_columns, NULL AS on_delete, 'PRIMARY KEY' AS definition FROM s
  UNION ALL SELECT k, schema, 't' || t, 't' || t || '_parent_fkey', 'f', 'parent', 'root' || n, 'id', 'CASCADE', 'REFERENCES root' || n || ' (id) ON DELETE CASCADE' FROM s
  UNION ALL SELECT k, schema, 't' || t, 'low' || t, 'c', '', NULL, '', NULL, 'CHECK (balance > -' || t || ')' FROM s WHERE k % 3 = 0
  UNION ALL SELECT k, schema, 't' || t, 't' || t || '_note_key', 'u', 'note', NULL, '', NULL, 'UNIQUE' FROM s WHERE k % 3 = 1)
"""
relation("constraints", CONSTRAINTS + """SELECT schema, "table", name, kind, columns, target, target_columns, on_delete, definition FROM con""")
relation(
    "indexes",
    CONSTRAINTS
    + """SELECT schema, "table", name, true AS "unique", kind = 'p' AS "primary", 'btree' AS method, columns, CAST(NULL AS VARCHAR) AS predicate FROM con WHERE kind IN ('p', 'u')
UNION ALL SELECT schema, 't' || t, 'i' || t, false, false, 'btree', 'balance,lower(state)', 'balance > ' || b FROM s WHERE k % 2 = 1
UNION ALL SELECT schema, 't' || t, 'j' || t, false, false, 'btree', 'parent', NULL FROM s WHERE k % 5 = 1""",
)
relation(
    "views",
    """SELECT schema, 'v' || t AS name, false AS materialized, 'SELECT id FROM ' || schema || '.t' || t || ' WHERE balance > ' || b AS definition FROM s WHERE k % 3 = 0
UNION ALL SELECT schema, 'm' || t, true, 'SELECT ' || t || ' AS k' FROM s WHERE k % 7 = 0""",
)
relation(
    "routines",
    """SELECT schema, 'f' || t AS name, 'integer,text' AS arguments, 'function' AS kind, 'trigger' AS returns, 'plpgsql' AS language,
 CASE WHEN k % 10 = 0 THEN 'volatile' ELSE 'stable' END AS volatility, k % 10 = 0 AS security_definer,
 CASE WHEN k % 10 = 0 THEN 'BEGIN END' ELSE 'BEGIN RETURN NEW' || t || '; END' END AS body FROM s WHERE k % 2 = 0""",
)
relation(
    "triggers",
    """SELECT schema, 't' || t AS "table", 'g' AS name, 'BEFORE' AS timing, 'INSERT,UPDATE' AS events, 'ROW' AS level, schema || '.f' || t AS routine,
 CAST(NULL AS VARCHAR) AS condition FROM s WHERE k % 4 = 0""",
)
relation(
    "policies",
    """SELECT schema, 't' || t AS "table", 'p' AS name, true AS permissive, 'SELECT' AS command, 'app,r' || n AS roles, 'id = ' || t AS "using", NULL AS "check" FROM s WHERE k % 10 < 2
UNION ALL SELECT schema, 't' || t, 'w', false, 'ALL', 'public', NULL, 'balance < ' || b FROM s WHERE k % 9 = 0""",
)
relation(
    "sequences",
    """SELECT schema, 'q' || t AS name, 'integer' AS type, k AS start, CAST(3 AS BIGINT) AS increment, CAST(1 AS BIGINT) AS minimum,
 CASE WHEN k % 6 = 0 THEN CAST('9' || t AS BIGINT) ELSE 2147483647 END AS maximum, k % 6 = 0 AS cycles, CAST(NULL AS VARCHAR) AS owned_by FROM s WHERE k % 2 = 0
UNION ALL SELECT schema, 't' || t || '_id_seq', 'bigint', 1, 1, 1, 9223372036854775807, false, schema || '.t' || t || '.id' FROM s""",
)
relation("types", """SELECT schema, 'state' || t AS name, 'enum' AS kind, 'new,c' || b AS members FROM s""")
relation("owners", """SELECT 'table' AS kind, schema || '.t' || t AS object, CASE WHEN k % 2 = 0 THEN 'o' || n ELSE 'first' END AS owner FROM s""")
relation(
    "grants",
    """SELECT schema || '.t' || t AS object, 'TABLE' AS kind, '' AS col, p.privilege, 'r' || n AS grantee, '' AS grantor, false AS grantable
 FROM s JOIN (VALUES ('SELECT'), ('INSERT')) p(privilege) ON p.privilege = 'SELECT' OR k % 3 <> 0""",
)
relation("comments", """SELECT 'table' AS kind, schema || '.t' || t AS object, name || '; it''s' AS comment FROM s WHERE k % 4 <> 1""")
registered(
    "catalog_constraint_summary",
    CONSTRAINTS
    + """SELECT schema, "table", string_agg(name, ',' ORDER BY name) AS names, count(*) FILTER (kind IN ('p', 'u')) AS n_keys, count(*) FILTER (kind = 'f') AS n_references,
 string_agg(DISTINCT target, ',') AS refers_to FROM con GROUP BY ALL""",
    lambda spark, sf_dir: catalog.constraint_summary(catalog_of(spark, sf_dir)),
)
registered(
    "catalog_contents",
    """, o AS (SELECT schema, unnest(['table', 'type', 'sequence']) AS kind FROM s UNION ALL SELECT schema, 'view' FROM s WHERE k % 3 = 0
 UNION ALL SELECT schema, 'materialized view' FROM s WHERE k % 7 = 0 UNION ALL SELECT schema, unnest(['function', 'sequence']) FROM s WHERE k % 2 = 0
 UNION ALL SELECT schema, 'extension' FROM s WHERE k % 4 = 0)
 SELECT schema, kind, count(*) AS n FROM o GROUP BY ALL""",
    lambda spark, sf_dir: catalog.contents(catalog_of(spark, sf_dir)),
)
registered(
    "catalog_unindexed_references",
    """SELECT schema, 't' || t AS "table", 't' || t || '_parent_fkey' AS name FROM s WHERE k % 5 <> 1""",
    lambda spark, sf_dir: catalog.unindexed_references(catalog_of(spark, sf_dir)),
)
registered(
    "catalog_unguarded_policies",
    """SELECT schema, 't' || t AS "table", 'p' AS name FROM s WHERE k % 10 = 1 UNION ALL SELECT schema, 't' || t, 'w' FROM s WHERE k % 9 = 0 AND k % 5 <> 0""",
    lambda spark, sf_dir: catalog.unguarded_policies(catalog_of(spark, sf_dir)),
)


def catalog_signatures(spark, sf_dir):
    """Lines by kind, and those of them that differ where the history of every supplier but the even ones has gone on."""
    own = scripts(spark, sf_dir)
    more = own.where("seq % 2 = 1").select((F.col("seq") + (1 << 40)).alias("seq"), F.concat(F.lit("COMMENT ON TABLE x"), "seq", F.lit(" IS 'odd'; CREATE TYPE y"), "seq", F.lit(" AS ENUM ('z')")).alias("content"))
    lines = lambda df: graph.cut(catalog.signature_lines(catalog.relations(df)))
    left, right = lines(own), lines(own.unionByName(more))
    differing = catalog.differences(left, right).groupBy("kind").agg(F.count("*").alias("n_new"))
    counted = left.groupBy(F.split_part("line", F.lit("|"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))
    return counted.join(differing, "kind", "left").select("kind", "n", F.coalesce("n_new", F.lit(0)).alias("n_new"))


registered(
    "catalog_signatures",
    """, o AS (SELECT k, unnest(['relation', 'type', 'constraint', 'constraint', 'index', 'sequence', 'ownership', 'grant', 'column', 'column', 'column', 'column', 'column']) AS kind FROM s
 UNION ALL SELECT k, unnest(['function', 'sequence']) FROM s WHERE k % 2 = 0 UNION ALL SELECT k, unnest(['relation', 'view', 'constraint']) FROM s WHERE k % 3 = 0
 UNION ALL SELECT k, unnest(['constraint', 'index']) FROM s WHERE k % 3 = 1 UNION ALL SELECT k, unnest(['relation', 'view']) FROM s WHERE k % 7 = 0
 UNION ALL SELECT k, 'index' FROM s WHERE k % 2 = 1 UNION ALL SELECT k, 'index' FROM s WHERE k % 5 = 1 UNION ALL SELECT k, unnest(['trigger', 'extension']) FROM s WHERE k % 4 = 0
 UNION ALL SELECT k, unnest(['policy', 'policy_role', 'policy_role']) FROM s WHERE k % 10 < 2 UNION ALL SELECT k, unnest(['policy', 'policy_role']) FROM s WHERE k % 9 = 0
 UNION ALL SELECT k, 'grant' FROM s WHERE k % 3 <> 0 UNION ALL SELECT k, 'comment' FROM s WHERE k % 4 <> 1)
 SELECT kind, count(*) AS n, CAST(CASE WHEN kind IN ('comment', 'type') THEN (SELECT count(*) FROM s WHERE k % 2 = 1) ELSE 0 END AS BIGINT) AS n_new FROM o GROUP BY kind""",
    catalog_signatures,
)


def near_equal_names(spark, sf_dir):
    """Customers of one nation and segment whose names are an edit away: the near copies among definitions with equal values."""
    return relate.near_copies(table(spark, sf_dir, "customer"), "c_name", "c_nationkey", "c_mktsegment")


QUERIES["near_equal_names"] = near_equal_names
ORACLES["near_equal_names"] = """WITH c AS (SELECT DISTINCT c_nationkey, c_mktsegment, c_name AS name FROM customer WHERE c_name IS NOT NULL)
SELECT a.c_nationkey, a.c_mktsegment, a.name, count(b.name) AS n_near, least(a.name, min(b.name)) AS "primary" FROM c a
LEFT JOIN c b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.name <> b.name AND levenshtein(lower(a.name), lower(b.name)) <= 1 GROUP BY 1, 2, 3"""
