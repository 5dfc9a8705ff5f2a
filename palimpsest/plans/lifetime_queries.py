"""Queries of objects that live for a time, of one build order, and of rights: whole tables as histories, with SQL that states the
results by recursion of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, lifetimes, privileges, progress
from palimpsest.plans.history import table
from palimpsest.plans.shapes import registered

#: Users are objects that a signup makes and an error drops; a view makes its user depend on another, a click ends that.
EVENTS = """WITH RECURSIVE e AS (
  SELECT user_id AS node, event_id AS moment, event_type AS t, event_id * 7919 % (SELECT 1 + max(user_id) FROM events) AS dst FROM events),
lived AS (
  SELECT node, moment AS made, ended, t FROM (
    SELECT *, lead(moment) OVER (PARTITION BY node ORDER BY moment) AS ended FROM e WHERE t IN ('signup', 'error')) WHERE t = 'signup'),
held AS (
  SELECT DISTINCT e.node AS src, made, e.dst, e.moment AS since, ended AS until FROM e JOIN lived l
  ON e.t = 'view' AND l.node = e.node AND e.moment >= made AND (ended IS NULL OR e.moment < ended))
"""


def _changes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    users = events.agg((F.max("user_id") + 1).alias("n"))
    rows = events.select(F.col("user_id").alias("node"), F.col("event_id").alias("at"), F.col("event_type").alias("t"))
    return rows.join(F.broadcast(users)).withColumn("dst", F.col("at") * 7919 % F.col("n")).drop("n")


def _held(spark, sf_dir):
    rows = _changes(spark, sf_dir)
    op = F.when(F.col("t") == "signup", "CREATE").when(F.col("t") == "error", "DROP")
    alive = lifetimes.lives(rows.select("node", "at", op.alias("op")))
    return lifetimes.held(rows.where("t = 'view'").select(F.col("node").alias("src"), "dst", F.col("at").alias("since")), alive)


def object_lives(spark, sf_dir):
    op = F.when(F.col("t") == "signup", "CREATE").when(F.col("t") == "error", "DROP")
    return lifetimes.lives(_changes(spark, sf_dir).select("node", "at", op.alias("op")))


registered("object_lives", EVENTS + "SELECT node, made, ended FROM lived", object_lives)


def edges_through_time(spark, sf_dir):
    return _held(spark, sf_dir)


registered("edges_through_time", EVENTS + "SELECT src, made, dst, since, until FROM held", edges_through_time)


def cascading_drops(spark, sf_dir):
    drops = _changes(spark, sf_dir).where("t = 'error'").select("node", "at")
    return lifetimes.cascades(_held(spark, sf_dir), drops)


registered(
    "cascading_drops",
    EVENTS
    + """, taken AS (
  SELECT h.src AS node, h.made, e.moment FROM e JOIN held h ON e.t = 'error' AND h.dst = e.node AND since < e.moment AND (until IS NULL OR e.moment < until)
  UNION
  SELECT h.src, h.made, t.moment FROM taken t JOIN held h ON h.dst = t.node AND h.since < t.moment AND (h.until IS NULL OR t.moment < h.until))
SELECT node, made, min(moment) AS "at" FROM taken GROUP BY node, made""",
    cascading_drops,
)


#: Orders follow the customer's order before; orders, customers, nations and regions need what they belong to, and each region its
#: first nation, so these two are a cycle.
ORDER = """WITH RECURSIVE o AS (
  SELECT 'o' || o_orderkey AS node, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS phase, 'c' || o_custkey AS owner,
         lag('o' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
nodes AS (
  SELECT node, phase FROM o UNION ALL SELECT 'c' || c_custkey, 3 + length(c_mktsegment) % 4 FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 2 + n_nationkey % 3 FROM nation UNION ALL SELECT 'r' || r_regionkey, 5 FROM region),
edges AS (
  SELECT node AS src, owner AS dst FROM o UNION ALL SELECT node, before FROM o WHERE before IS NOT NULL
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey),
known AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)),
-- a node on a two-node cycle goes by the name of the smaller
pair AS (SELECT a.src AS node, least(a.src, a.dst) AS part FROM known a JOIN known b ON a.src = b.dst AND a.dst = b.src),
part AS (SELECT nodes.node, nodes.phase, coalesce(pair.part, nodes.node) AS part, pair.part IS NOT NULL AS cyclic FROM nodes LEFT JOIN pair ON pair.node = nodes.node),
link AS (
  SELECT DISTINCT s.part AS src, d.part AS dst FROM known JOIN part s ON s.node = known.src JOIN part d ON d.node = known.dst WHERE s.part <> d.part),
asked AS (
  SELECT part, phase FROM part UNION SELECT link.dst, asked.phase FROM asked JOIN link ON link.src = asked.part),
phased AS (SELECT part, min(phase) AS phase FROM asked GROUP BY part),
within AS (
  SELECT link.src, link.dst FROM link JOIN phased a ON a.part = link.src JOIN phased b ON b.part = link.dst WHERE a.phase = b.phase),
deep AS (SELECT part, 0 AS level FROM phased UNION SELECT w.src, deep.level + 1 FROM deep JOIN within w ON w.dst = deep.part)
SELECT part.node, phased.phase, CAST(l.level AS BIGINT) AS level, part.cyclic FROM part JOIN phased ON phased.part = part.part
JOIN (SELECT part, max(level) AS level FROM deep GROUP BY part) l ON l.part = part.part
"""


def one_build_order(spark, sf_dir):
    read = lambda name: table(spark, sf_dir, name)
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    orders = read("orders")
    from pyspark.sql import Window

    before = F.lag(key("o", "o_orderkey")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = orders.select(key("o", "o_orderkey").alias("node"), F.substring("o_orderpriority", 1, 1).cast("int").alias("phase"), key("c", "o_custkey").alias("owner"), before.alias("before"))
    c, n, r = read("customer"), read("nation"), read("region")
    nodes = (
        o.select("node", "phase")
        .unionByName(c.select(key("c", "c_custkey").alias("node"), (3 + F.length("c_mktsegment") % 4).alias("phase")))
        .unionByName(n.select(key("n", "n_nationkey").alias("node"), (2 + F.col("n_nationkey") % 3).alias("phase")))
        .unionByName(r.select(key("r", "r_regionkey").alias("node"), F.lit(5).alias("phase")))
    )
    edge = lambda df, src, dst: df.select(src.alias("src"), dst.alias("dst"))
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    edges = (
        edge(o, F.col("node"), F.col("owner")).unionByName(edge(o, F.col("node"), F.col("before")))
        .unionByName(edge(c, key("c", "c_custkey"), key("n", "c_nationkey"))).unionByName(edge(n, key("n", "n_nationkey"), key("r", "n_regionkey")))
        .unionByName(edge(first, key("r", "n_regionkey"), key("n", "first")))
    )
    return graph.phased_order(nodes, edges)


registered("one_build_order", ORDER, one_build_order)


#: Events as grants of rights along a tree of users: a user is granted by the user with half its number, the first by the owner.
RIGHTS = """WITH RECURSIVE e AS (
  SELECT event_id AS moment, user_id AS role, CASE WHEN user_id > 1 THEN user_id // 2 END AS grantor, json_extract_string(props, '$.k') AS object, event_type AS t FROM events),
p AS (
  SELECT moment, role, grantor, object, CASE WHEN t IN ('signup', 'purchase', 'view') THEN 'GRANT' ELSE 'REVOKE' END AS op, t IN ('purchase', 'click') AS option,
         unnest(CASE WHEN t IN ('signup', 'purchase') THEN ['USAGE', 'CREATE'] WHEN t = 'view' THEN ['USAGE'] WHEN t = 'click' THEN ['CREATE'] ELSE ['USAGE', 'CREATE'] END) AS privilege
  FROM e),
h AS (
  SELECT object, role, grantor, privilege, moment AS made, (
    SELECT min(q.moment) FROM p q WHERE q.object IS NOT DISTINCT FROM p.object AND q.role = p.role AND q.privilege = p.privilege AND q.op = 'REVOKE' AND NOT q.option AND q.moment > p.moment) AS ended
  FROM p WHERE op = 'GRANT'),
g AS (
  SELECT object, role, grantor, privilege, moment AS made, (
    SELECT min(q.moment) FROM p q WHERE q.object IS NOT DISTINCT FROM p.object AND q.role = p.role AND q.privilege = p.privilege AND q.op = 'REVOKE' AND q.moment > p.moment) AS ended
  FROM p WHERE op = 'GRANT' AND option),
-- an option lasts as long as the grantor's own
o AS (
  SELECT * FROM g WHERE grantor IS NULL
  UNION
  SELECT g.object, g.role, g.grantor, g.privilege, g.made, least(coalesce(g.ended, 9e18::BIGINT), coalesce(o.ended, 9e18::BIGINT))
  FROM o JOIN g ON g.grantor = o.role AND g.object IS NOT DISTINCT FROM o.object AND g.privilege = o.privilege AND o.made < g.made AND (o.ended IS NULL OR g.made < o.ended)),
f AS (SELECT * REPLACE (nullif(ended, 9e18::BIGINT) AS ended) FROM o),
r AS (
  SELECT object, role, grantor, privilege, made, ended FROM h WHERE grantor IS NULL
  UNION
  SELECT h.object, h.role, h.grantor, h.privilege, h.made, nullif(least(coalesce(h.ended, 9e18::BIGINT), coalesce(f.ended, 9e18::BIGINT)), 9e18::BIGINT)
  FROM h JOIN f ON h.grantor = f.role AND h.object IS NOT DISTINCT FROM f.object AND h.privilege = f.privilege AND f.made < h.made AND (f.ended IS NULL OR h.made < f.ended))
SELECT object, privilege, 'u' || role AS grantee, coalesce('u' || grantor, '') AS grantor, made, ended,
       ended IS NULL AND EXISTS (SELECT 1 FROM f WHERE f.ended IS NULL AND f.role = r.role AND f.object IS NOT DISTINCT FROM r.object AND f.privilege = r.privilege) AS grantable
FROM r
"""


def rights_held(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user = lambda c: F.concat(F.lit("u"), c.cast("string"))
    kind = F.col("event_type")
    privilege = F.when(kind == "view", "USAGE").when(kind == "click", "CREATE").otherwise("ALL")
    changes = events.select(
        F.get_json_object("props", "$.k").alias("object"), F.lit("SCHEMA").alias("kind"), F.lit("").alias("col"), privilege.alias("privilege"), user(F.col("user_id")).alias("grantee"),
        F.when(F.col("user_id") > 1, user(F.floor(F.col("user_id") / 2))).otherwise("").alias("grantor"), F.col("event_id").alias("at"),
        F.when(kind.isin("signup", "purchase", "view"), "GRANT").otherwise("REVOKE").alias("op"), kind.isin("purchase", "click").alias("option"),
    )
    return privileges.holdings(changes).select("object", "privilege", "grantee", "grantor", "made", "ended", "grantable")


registered("rights_held", RIGHTS, rights_held)


#: Customers refer to each other through their orders; what those of the first nation reach, before and after the changes of status.
REACH = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
was AS (SELECT DISTINCT o_custkey AS src, o_orderkey * 7919 % n AS dst, o_orderstatus FROM orders, n),
edges AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst),
walk AS (
  SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_nationkey = 0
  UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 24),
d AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT d.node, CAST(d.depth AS BIGINT) AS depth, min(b.node) AS previous
FROM d LEFT JOIN edges ON edges.dst = d.node LEFT JOIN d b ON b.node = edges.src AND b.depth = d.depth - 1 GROUP BY d.node, d.depth
"""
_MORE = "SELECT o_custkey AS src, o_orderkey * 104729 % n AS dst FROM orders, n WHERE o_orderstatus = 'P'"


def _customer_edges(spark, sf_dir, factor):
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").join(F.broadcast(n))
    return orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * factor % F.col("n")).alias("dst"), "o_orderstatus")


def _first_nation(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_nationkey = 0").select(F.col("c_custkey").alias("node"))


def reached_from_nodes(spark, sf_dir):
    return graph.reached_from(_customer_edges(spark, sf_dir, 7919), _first_nation(spark, sf_dir))


registered("reached_from_nodes", REACH.format(edges="was"), reached_from_nodes)


def reach_maintained(spark, sf_dir):
    edges = _customer_edges(spark, sf_dir, 7919)
    # an edge goes if any of its orders is filled
    removed, added = edges.where("o_orderstatus = 'F'"), _customer_edges(spark, sf_dir, 104729).where("o_orderstatus = 'P'")
    return graph.maintained(graph.cut(graph.reached_from(edges, _first_nation(spark, sf_dir))), edges, added, removed)


registered(
    "reach_maintained",
    REACH.format(edges=f"(SELECT src, dst FROM was WHERE (src, dst) NOT IN (SELECT (src, dst) FROM was WHERE o_orderstatus = 'F') UNION {_MORE})"),
    reach_maintained,
)


def run_counters(spark, sf_dir):
    """What a run over all documents counts on its way: the texts, their lines, and the lines that have a statement's first word."""
    run = progress.Run()
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    docs = run.stage(table(spark, sf_dir, "documents"), "texts", size=size("text"), failed=F.col("text").isNull())
    lines = run.stage(docs.select(F.explode(F.split("text", "\n", -1)).alias("line")), "lines", size=size("line"), failed=F.col("line") == "")
    begun = lines.where(F.col("line").rlike(r"(?i)^(with|do|set|show|table|call|end|start|in|to)( |$)"))
    run.stage(begun, "begun", size=size("line"), failed=F.col("line").endswith(".")).write.format("noop").mode("overwrite").save()
    return run.table(spark)


registered(
    "run_counters",
    r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE regexp_matches(line, '(?i)^(with|do|set|show|table|call|end|start|in|to)( |$)'))
SELECT 'texts' AS stage, count(*) AS n_rows, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE text IS NULL) AS n_failed FROM documents
UNION ALL SELECT 'lines', count(*), CAST(coalesce(sum(strlen(line)), 0) AS BIGINT), count(*) FILTER (WHERE line = '') FROM l
UNION ALL SELECT 'begun', count(*), CAST(coalesce(sum(strlen(line)), 0) AS BIGINT), count(*) FILTER (WHERE line LIKE '%.') FROM b""",
    run_counters,
)
