"""Queries that relate tables: as-of and range joins, references, comparisons, signatures, graphs, text and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import identifiers
from palimpsest.operators import graph, relate, signature, statements
from palimpsest.plans.history import LOG, log, table

QUERIES, ORACLES = {}, {}


def registered(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@registered(LOG + """SELECT key, idx, op, attr, value,
  last_value(CASE WHEN op = 'INSERT' THEN idx END IGNORE NULLS) OVER (
    PARTITION BY key ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM log""")
def prior_insert(spark, sf_dir):
    return relate.prior(log(spark, sf_dir), "key", F.col("op") == "INSERT", "idx", "seq", "idx").drop("seq")


@registered(LOG + """, d AS (SELECT * FROM log WHERE op = 'DROP'), c AS (
  SELECT key, seq, idx FROM (
    SELECT *, row_number() OVER (PARTITION BY key, seq ORDER BY idx DESC) AS r FROM log WHERE op = 'CREATE') WHERE r = 1)
SELECT d.key, d.idx, c.idx AS created FROM d ASOF LEFT JOIN c ON d.key = c.key AND d.seq >= c.seq""")
def asof_create(spark, sf_dir):
    own = log(spark, sf_dir)
    drops, made = own.where("op = 'DROP'").select("key", "seq", "idx"), own.where("op = 'CREATE'")
    found = relate.asof_join(drops, made.select("key", "seq", "idx"), "key", "seq", "idx", tie="idx")
    return found.select("key", "idx", F.col("asof").alias("created"))


@registered("""SELECT o.o_orderkey, l.l_linenumber, l.l_partkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 30 DAY""")
def data_op_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    near = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & near).select("o_orderkey", "l_linenumber", "l_partkey")


@registered("""SELECT p.p_partkey, b.p_brand, b.low, b.high FROM part p JOIN (
  SELECT p_brand, min(p_size) AS low, min(p_size) + 5 AS high FROM part GROUP BY p_brand) b
  ON p.p_size BETWEEN b.low AND b.high""")
def range_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    bands = part.groupBy("p_brand").agg(F.min("p_size").alias("low"), (F.min("p_size") + 5).alias("high"))
    found = relate.between_join(part.select("p_partkey", "p_size"), bands, "p_size", "low", "high", 8)
    return found.select("p_partkey", "p_brand", "low", "high")


@registered("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
FROM orders""")
def data_op_order(spark, sf_dir):
    return relate.places(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@registered("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (
  SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def dangling_refs(spark, sf_dir):
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return relate.dangling(table(spark, sf_dir, "orders"), good, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@registered("""SELECT doc_id, n_copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n_copies,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_first_seen(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return relate.first_of(own, [F.col("h")], "doc_id").select("doc_id", "n_copies")


@registered("""SELECT owner, primary_owner AS primary, n_owners FROM (
  SELECT owner, min(owner) OVER (PARTITION BY m) AS primary_owner, count(*) OVER (PARTITION BY m) AS n_owners
  FROM (SELECT p_brand AS owner, string_agg(DISTINCT k, '|' ORDER BY k) AS m
        FROM (SELECT p_brand || ':' || (p_size % 5) AS p_brand, substr(p_type, 1, 1) AS k FROM part) GROUP BY p_brand))
WHERE n_owners > 1""")
def enum_dedup(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(
        F.concat_ws(":", "p_brand", (F.col("p_size") % 5).cast("string")).alias("owner"), F.substring("p_type", 1, 1).alias("k")
    )
    return relate.same_sets(own, "owner", "k")


_LINE = """'{k}|' || {i} || '|sha256:' || substr(sha256(regexp_replace(trim(regexp_replace(
  replace(replace(replace(replace(lower({d}), '(', ' ( '), ')', ' ) '), ',', ' , '), ';', ' ; '),
  '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}]+', ' ', 'g')), ' ;$', '')), 1, 32)"""
_PART = "SELECT " + _LINE.format(k="part", i="p_partkey", d="p_name || ' (' || p_brand || ', ' || p_type || ');'") + " AS line FROM part"


def _lines(spark, sf_dir):
    definition = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(");"))
    line = signature.signature_line("part", F.col("p_partkey").cast("string"), definition)
    return table(spark, sf_dir, "part").select("p_size", line.alias("line"))


@registered(_PART)
def schema_signature(spark, sf_dir):
    return _lines(spark, sf_dir).select("line")


@registered(f"""WITH s AS (SELECT p_size, line FROM (SELECT p_size, p_partkey FROM part) JOIN (
    SELECT line, CAST(split_part(line, '|', 2) AS BIGINT) AS p_partkey FROM ({_PART})) USING (p_partkey)),
only_in AS (
  SELECT DISTINCT line, 'left' AS side FROM s WHERE p_size <= 30 AND line NOT IN (SELECT line FROM s WHERE p_size >= 10)
  UNION ALL
  SELECT DISTINCT line, 'right' FROM s WHERE p_size >= 10 AND line NOT IN (SELECT line FROM s WHERE p_size <= 30))
SELECT * FROM (SELECT * FROM only_in ORDER BY line, side LIMIT 250)
UNION ALL SELECT '... ' || (count(*) - 250) || ' more', '' FROM only_in HAVING count(*) > 250""")
def schema_diff(spark, sf_dir):
    own = _lines(spark, sf_dir)
    return relate.difference(own.where("p_size <= 30"), own.where("p_size >= 10"), ("left", "right"), 250)


@registered("""SELECT coalesce(a.n, b.n) AS nation, a.v AS left_value, b.v AS right_value,
  CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same'
       ELSE 'changed' END AS status
FROM (SELECT c_nationkey AS n, count(*) AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS n, count(*) AS v FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.n = b.n""")
def schema_compare_full(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("nation"))
    v = F.count("*").alias("v")
    return relate.compared(a.agg(v), b.agg(v), "nation", "v")


@registered("""SELECT count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256
FROM (SELECT 'nation|' || n_nationkey || '|' || n_name AS line FROM nation)""")
def fingerprint(spark, sf_dir):
    line = F.concat_ws("|", F.lit("nation"), F.col("n_nationkey").cast("string"), "n_name")
    return signature.fingerprint(table(spark, sf_dir, "nation").select(line.alias("line")))


@registered(r"""SELECT doc_id, md5(regexp_replace(trim(regexp_replace(
  replace(replace(replace(replace(lower(text), '(', ' ( '), ')', ' ) '), ',', ' , '), ';', ' ; '),
  '[\t\n\x0B\f\r \x{85}\x{A0}]+', ' ', 'g')), ' ;$', '')) AS digest FROM documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(signature.normalized(F.col("text"))).alias("digest"))


_LADDER = [("markup", r"<[a-z]+[ >]"), ("secret", r"(?i)password|secret|AKIA"), ("license", r"(?i)licensed?\b"), ("number", r"[0-9]{4,}")]


@registered(r"""SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '<[a-z]+[ >]') THEN 'markup'
  WHEN regexp_matches(t, '(?i)password|secret|AKIA') THEN 'secret' WHEN regexp_matches(t, '(?i)licensed?\b') THEN 'license'
  WHEN regexp_matches(t, '[0-9]{4,}') THEN 'number' ELSE 'prose' END AS label
  FROM (SELECT text AS t FROM documents UNION ALL SELECT html FROM pages)) GROUP BY label""")
def text_classifier(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select(F.col("text").alias("t"))
    both = both.unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("t")))
    return both.groupBy(statements.labelled(F.col("t"), _LADDER, "prose").alias("label")).agg(F.count("*").alias("n"))


_SQL_ROWS = """WITH s AS (
  SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN 'SELECT * FROM t' || o_custkey WHEN 1 THEN 'DELETE FROM t' || o_custkey
    WHEN 2 THEN 'UPDATE t' || o_custkey || ' SET a = ''where'' ' WHEN 3 THEN 'DELETE FROM t' || o_custkey || ' WHERE id = 1'
    WHEN 4 THEN 'DROP TABLE t' || o_custkey WHEN 5 THEN 'CREATE INDEX i ON t' || o_custkey || '(a)'
    WHEN 6 THEN 'VACUUM t' || o_custkey ELSE 'ALTER TABLE t' || o_custkey || ' DROP COLUMN a' END AS sql FROM orders)
"""


def _statements(spark, sf_dir):
    t = F.concat(F.lit("t"), F.col("o_custkey").cast("string"))
    texts = {
        0: F.concat(F.lit("SELECT * FROM "), t), 1: F.concat(F.lit("DELETE FROM "), t),
        2: F.concat(F.lit("UPDATE "), t, F.lit(" SET a = 'where' ")), 3: F.concat(F.lit("DELETE FROM "), t, F.lit(" WHERE id = 1")),
        4: F.concat(F.lit("DROP TABLE "), t), 5: F.concat(F.lit("CREATE INDEX i ON "), t, F.lit("(a)")),
        6: F.concat(F.lit("VACUUM "), t), 7: F.concat(F.lit("ALTER TABLE "), t, F.lit(" DROP COLUMN a")),
    }
    sql = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == k, x) for k, x in texts.items()])
    return table(spark, sf_dir, "orders").select("o_orderkey", sql.alias("sql"))


@registered(_SQL_ROWS + """SELECT o_orderkey, CASE split_part(sql, ' ', 1) WHEN 'SELECT' THEN 'read_only' WHEN 'DELETE' THEN 'write'
  WHEN 'UPDATE' THEN 'write' WHEN 'VACUUM' THEN 'maintenance' ELSE 'ddl' END AS class,
  CASE split_part(sql, ' ', 1) WHEN 'CREATE' THEN 'SHARE' WHEN 'SELECT' THEN 'ACCESS_SHARE' WHEN 'VACUUM' THEN 'NONE'
  WHEN 'DROP' THEN 'ACCESS_EXCLUSIVE' WHEN 'ALTER' THEN 'ACCESS_EXCLUSIVE' ELSE 'ROW_EXCLUSIVE' END AS lock_level FROM s""")
def statement_classifier(spark, sf_dir):
    s = F.col("sql")
    return _statements(spark, sf_dir).select(
        "o_orderkey", statements.statement_class(s).alias("class"), statements.lock_level(s).alias("lock_level")
    )


@registered(_SQL_ROWS + """SELECT o_orderkey, CASE WHEN sql LIKE 'ALTER%' THEN 'ban-drop-column' WHEN sql LIKE 'DROP%' THEN 'ban-drop-table'
  WHEN sql LIKE 'CREATE INDEX%' THEN 'require-concurrent-index' ELSE 'block-missing-where' END AS code, false AS ignored
FROM s WHERE sql LIKE 'ALTER%' OR sql LIKE 'DROP%' OR sql LIKE 'CREATE INDEX%' OR sql LIKE 'UPDATE%'
  OR (sql LIKE 'DELETE%' AND sql NOT LIKE '%WHERE%')""")
def lint_violations(spark, sf_dir):
    return statements.violations(_statements(spark, sf_dir), "o_orderkey").select("o_orderkey", "code", "ignored")


@registered("""WITH t AS (SELECT * FROM (VALUES (0, 'int', 'integer'), (1, 'bigint', 'bigint'), (2, 'varchar(20)', 'character varying'),
  (3, 'text', 'text'), (4, 'numeric(10,2)', 'numeric'), (5, 'boolean', 'boolean')) AS t(i, name, c))
SELECT c_custkey AS key, a.name AS source, b.name AS target, CASE WHEN a.c = b.c THEN 'none'
  WHEN (a.c, b.c) IN (('integer', 'bigint'), ('integer', 'numeric'), ('bigint', 'numeric'), ('character varying', 'text')) THEN 'implicit'
  WHEN (a.c, b.c) IN (('bigint', 'integer'), ('text', 'character varying')) THEN 'assignment'
  WHEN b.c IN ('text', 'character varying') OR a.c IN ('text', 'character varying')
    OR (a.c IN ('integer', 'bigint', 'numeric') AND b.c IN ('integer', 'bigint', 'numeric')) THEN 'explicit'
  ELSE 'impossible' END AS kind,
  (a.c, b.c) IN (('bigint', 'integer'), ('numeric', 'integer'), ('numeric', 'bigint'), ('text', 'character varying')) AS lossy
FROM customer JOIN t a ON a.i = c_custkey % 6 JOIN t b ON b.i = c_custkey // 6 % 6""")
def type_compat(spark, sf_dir):
    """A change of type for each customer: all pairs of types come up."""
    names = F.array(*map(F.lit, ["int", "bigint", "varchar(20)", "text", "numeric(10,2)", "boolean"]))
    pick = lambda i: F.get(names, (i % 6).cast("int"))
    k = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(k.alias("key"), pick(k).alias("source"), pick(F.floor(k / 6)).alias("target"))
    a, b = F.col("source"), F.col("target")
    return pairs.select("key", "source", "target", identifiers.cast_kind(a, b).alias("kind"), identifiers.is_lossy(a, b).alias("lossy"))


def _edges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    n = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    r = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    up = nation.select(n("n_nationkey").alias("src"), r.alias("dst"))
    sup = table(spark, sf_dir, "supplier")
    own = sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), n("s_nationkey").alias("dst"))
    return up.unionByName(own)


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


def _nodes(edges):
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@registered(f"""WITH RECURSIVE {_EDGES},
l AS (SELECT node, 0 AS level FROM nodes WHERE node NOT IN (SELECT src FROM e)
      UNION ALL SELECT e.src, l.level + 1 FROM e JOIN l ON e.dst = l.node)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY node""")
def dependency_levels(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.levels(_nodes(edges), edges)


@registered(f"""WITH RECURSIVE {_EDGES},
c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src)
SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY src, dst""")
def dependency_closure(spark, sf_dir):
    return graph.closure(_edges(spark, sf_dir))


_RING = "e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 3) % 25)"


def _ring(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst")
    )


@registered(f"""WITH RECURSIVE {_RING}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
m AS (SELECT a.src, a.dst FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src)
SELECT e.src, e.dst, k.component, k.n_nodes FROM e JOIN m ON e.src = m.src AND e.dst = m.dst
JOIN (SELECT src, min(dst) AS component, count(*) AS n_nodes FROM m GROUP BY src) k ON k.src = e.src""")
def cycles(spark, sf_dir):
    return graph.cycle_edges(_ring(spark, sf_dir)).select("src", "dst", "component", "n_nodes")


@registered("""SELECT n_nationkey, n_regionkey, CAST(100 + CASE WHEN n_regionkey = 0 THEN 500 ELSE 0 END
  + CASE WHEN n_nationkey % 3 = 0 AND n_regionkey % 2 = 0 THEN 150 ELSE 0 END
  - CASE WHEN n_nationkey % 3 = 1 THEN 30 ELSE 0 END AS BIGINT) AS weight FROM nation""")
def edge_weights(spark, sf_dir):
    src = F.when(F.col("n_nationkey") % 3 == 0, "TABLE").when(F.col("n_nationkey") % 3 == 1, "VIEW").otherwise("FUNCTION")
    dst = F.when(F.col("n_regionkey") % 2 == 0, "TABLE").otherwise("TYPE")
    weight = graph.edge_weight(src, dst, F.col("n_regionkey") == 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", weight.cast("long").alias("weight"))
