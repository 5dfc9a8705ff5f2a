"""Queries over change logs: the events table as the history of its users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import batches, changelog, metrics
from palimpsest.sources.scripts import event_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt over all cores by some columns: a table may be one file, and its rows few bytes that become scripts."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"))


LOG = """WITH log AS (
  SELECT user_id AS key, ts AS seq, event_id AS idx,
         CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'ALTER' WHEN 'click' THEN 'ALTER'
              WHEN 'purchase' THEN 'INSERT' ELSE 'DROP' END AS op,
         json_extract_string(props, '$.k') AS attr, value
  FROM events),
h AS (
  SELECT *, row_number() OVER w AS n, lead(op) OVER w AS next_op,
         row_number() OVER (PARTITION BY key ORDER BY seq DESC, idx DESC) AS back,
         max(CASE WHEN op = 'DROP' THEN epoch_us(seq) END) OVER (PARTITION BY key) AS dropped
  FROM log WINDOW w AS (PARTITION BY key ORDER BY seq, idx)),
alive AS (
  SELECT *, n > coalesce(max(CASE WHEN op = 'DROP' THEN n END) OVER (PARTITION BY key), 0) AS living FROM h)
"""

QUERIES, ORACLES = {}, {}


def registered(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, LOG + sql
        return f

    return put


@registered("""SELECT c.key, c.idx, c.attr, c.value, h.op AS last_op
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS k FROM h WHERE op = 'CREATE') c
JOIN h ON h.key = c.key AND h.back = 1 WHERE c.k = 1 AND h.op <> 'DROP'""")
def fold_last_state(spark, sf_dir):
    return changelog.last_state(log(spark, sf_dir))


@registered("""SELECT key, count(*) AS n_events, count_if(op = 'CREATE') AS n_creates, count_if(op = 'ALTER') AS n_alters,
  count_if(op = 'DROP') AS n_drops, count_if(op = 'INSERT') AS n_data_ops, max(CASE WHEN n = 1 THEN op END) AS first_op,
  max(CASE WHEN back = 1 THEN op END) AS last_op,
  CAST(max(CASE op WHEN 'DROP' THEN 3 WHEN 'INSERT' THEN 2 WHEN 'ALTER' THEN 1 ELSE 0 END) AS BIGINT) AS highest_risk,
  count_if(op = 'CREATE') > 1 AS has_conflict
FROM h GROUP BY key""")
def lifecycle_summary(spark, sf_dir):
    return changelog.summary(log(spark, sf_dir))


@registered("""SELECT key, attr, idx, row_number() OVER (PARTITION BY key ORDER BY n) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY key, attr ORDER BY n) AS k FROM h WHERE op = 'ALTER') WHERE k = 1""")
def distinct_alters(spark, sf_dir):
    return changelog.distinct_alters(log(spark, sf_dir))


_REDUNDANCY = """, g AS (
  SELECT key, count(*) AS n_events, max(CASE WHEN n = 1 THEN op END) AS first_op,
         count_if(op = 'ALTER' AND n > 1) AS alters,
         count(DISTINCT CASE WHEN op = 'ALTER' AND n > 1 THEN CAST(seq AS DATE) END) AS files,
         bool_or(op = 'INSERT' AND n > 1) AS data, bool_or(op = 'DROP' AND coalesce(next_op, '') = 'CREATE') AS again,
         count_if(op = 'CREATE') AS creates
  FROM h GROUP BY key),
p AS (
  SELECT *, CASE WHEN first_op = 'CREATE' AND alters > 0 AND NOT data THEN 'CREATE_ALTER' WHEN again THEN 'DROP_CREATE'
                 WHEN creates > 1 THEN 'DUPLICATE' END AS pattern
  FROM g WHERE n_events > 1)
"""


@registered(_REDUNDANCY + """SELECT key, pattern,
  CASE pattern WHEN 'CREATE_ALTER' THEN alters WHEN 'DROP_CREATE' THEN 1 ELSE creates - 1 END AS statements_reduced,
  CASE pattern WHEN 'CREATE_ALTER' THEN files WHEN 'DROP_CREATE' THEN 2 ELSE creates END AS files_affected,
  CASE pattern WHEN 'CREATE_ALTER' THEN alters * 2 WHEN 'DROP_CREATE' THEN 3 ELSE (creates - 1) * 5 END AS lines_reduced
FROM p WHERE pattern IS NOT NULL""")
def redundancy_report(spark, sf_dir):
    return changelog.redundancy(log(spark, sf_dir), F.to_date("seq"))


@registered("""SELECT op, attr, count(*) AS n, count(DISTINCT key) AS n_keys, CAST(grouping(op, attr) AS BIGINT) AS level
FROM log GROUP BY GROUPING SETS ((op), (attr), ())""")
def object_statistics(spark, sf_dir):
    return changelog.statistics(log(spark, sf_dir))


def _grants(spark, sf_dir):
    own = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    op = F.when(F.col("event_type") == "click", "GRANT").otherwise("REVOKE")
    return own.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("grantee"),
        F.get_json_object("props", "$.k").alias("privilege"),
        op.alias("op"),
        F.col("ts").alias("seq"),
        F.col("event_id").alias("idx"),
    )


_GRANTS = """, gr AS (
  SELECT 'u' || user_id AS grantee, json_extract_string(props, '$.k') AS privilege,
         CASE event_type WHEN 'click' THEN 'GRANT' ELSE 'REVOKE' END AS op, ts AS seq, event_id AS idx
  FROM events WHERE event_type IN ('click', 'error')),
held AS (
  SELECT grantee, privilege, idx, k AS n_changes FROM (
    SELECT *, row_number() OVER (PARTITION BY grantee, privilege ORDER BY seq DESC, idx DESC) AS r,
           count(*) OVER (PARTITION BY grantee, privilege) AS k FROM gr)
  WHERE r = 1 AND op = 'GRANT')
"""


@registered(_GRANTS + "SELECT * FROM held")
def permission_fold(spark, sf_dir):
    return changelog.permissions(_grants(spark, sf_dir))


@registered(_GRANTS + """SELECT grantee, string_agg(privilege, ', ' ORDER BY privilege) AS privileges, count(*) AS n,
  'GRANT ' || string_agg(privilege, ', ' ORDER BY privilege) || ' TO ' || grantee AS sql FROM held GROUP BY grantee""")
def permission_statements(spark, sf_dir):
    return changelog.permission_statements(_grants(spark, sf_dir))


@registered("SELECT key, idx, op, attr, value, n - 1 AS n_before FROM alive WHERE living")
def last_drop_segment(spark, sf_dir):
    return changelog.since_last_drop(log(spark, sf_dir)).drop("seq")


@registered("""SELECT key, coalesce(max(CASE WHEN hard THEN idx END), max(CASE WHEN k = 1 THEN idx END)) AS idx,
  max(CASE WHEN hard THEN idx END) IS NULL AS conditional, count(*) AS n_creates
FROM (
  SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY n) AS k,
         value <= 100 AND n = max(CASE WHEN value <= 100 THEN n END) OVER (PARTITION BY key) AS hard
  FROM alive WHERE living AND op = 'CREATE') GROUP BY key""")
def effective_create(spark, sf_dir):
    return changelog.effective_create(log(spark, sf_dir), F.col("value") > 100)


@registered(""", o AS (
  SELECT *, row_number() OVER (PARTITION BY key, attr ORDER BY n) AS k FROM h
  WHERE op IN ('CREATE', 'ALTER', 'DROP') AND attr IS NOT NULL),
m AS (SELECT *, max(CASE WHEN op = 'DROP' THEN n END) OVER (PARTITION BY key, attr) AS d,
             max(CASE WHEN op <> 'DROP' THEN n END) OVER (PARTITION BY key, attr) AS l FROM o),
s AS (
  SELECT key, attr, min(n) AS first, max(CASE WHEN n = l THEN value END) AS definition,
         count_if(op <> 'DROP' AND n > coalesce(d, 0)) AS n_alive, count_if(op <> 'DROP') AS n_defined,
         count_if(op = 'DROP') AS n_drops
  FROM m GROUP BY key, attr)
SELECT key, attr, row_number() OVER (PARTITION BY key ORDER BY first) AS position,
       CASE WHEN n_alive = 0 AND n_defined > 0 THEN 'TRANSIENT' WHEN n_alive = 0 THEN 'DROPPED'
            WHEN n_alive > 1 THEN 'MODIFIED' ELSE 'ADDED' END AS status, definition, n_defined, n_drops FROM s""")
def column_state(spark, sf_dir):
    return changelog.column_state(log(spark, sf_dir))


@registered("""SELECT key, count_if(value > 100) AS n_conditional, max(CASE WHEN k = 1 THEN op END) = 'CREATE' AS should_exist
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS k FROM h WHERE op IN ('CREATE', 'DROP'))
GROUP BY key HAVING count_if(value > 100) >= 2""")
def conditional_final(spark, sf_dir):
    return changelog.conditional_final(log(spark, sf_dir), F.col("value") > 100)


@registered(""", c AS (
  SELECT key, count_if(op = 'DROP' AND next_op = 'CREATE') AS n_cycles, count_if(op = 'CREATE') AS n_creates,
         count_if(op = 'DROP') AS n_drops, max(CASE WHEN op = 'CREATE' THEN n END) AS f FROM h GROUP BY key)
SELECT c.key, n_cycles, n_creates, n_drops, n_creates > 0 AND n_drops > 0 AS transient,
       CASE WHEN n_cycles > 5 THEN 'HIGH' WHEN n_cycles > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity, h.idx AS final_idx
FROM c LEFT JOIN h ON h.key = c.key AND h.n = c.f WHERE n_creates > 1 OR (n_creates > 0 AND n_drops > 0)""")
def drop_create_cycles(spark, sf_dir):
    return changelog.drop_create_cycles(log(spark, sf_dir))


@registered(r"""SELECT base, count(*) AS n_members, min(name) AS first_name, max(name) AS last_name
FROM (SELECT DISTINCT source AS name, regexp_replace(source, '(?:[0-9]+).*$', '') AS base FROM documents)
GROUP BY base HAVING count(*) > 1""")
def version_groups(spark, sf_dir):
    return changelog.version_groups(table(spark, sf_dir, "documents"), "source", "[0-9]+")


_PLAN = """, g AS (
  SELECT key, count(*) AS n, count_if(op = 'CREATE') AS creates, count_if(op = 'ALTER') AS alters,
         count_if(op = 'DROP') AS drops, max(CASE WHEN n = 1 THEN op END) AS first_op,
         max(CASE WHEN back = 1 THEN op END) AS last_op, count_if(op = 'DROP' AND next_op = 'CREATE') AS again,
         count_if(op = 'INSERT') AS data
  FROM (SELECT key, op, n, back, next_op FROM h) GROUP BY key),
r AS (
  SELECT *, CASE WHEN creates >= 2 AND drops >= 2 THEN 'conditional_schema'
                 WHEN creates > 1 AND last_op <> 'DROP' THEN 'multiple_create'
                 WHEN creates = 1 AND first_op = 'CREATE' AND alters > 0 THEN 'create_alter'
                 WHEN again > 0 THEN 'drop_create_cycle' WHEN n > 2 THEN 'transaction_boundary'
                 ELSE 'error_recovery' END AS rule FROM g),
plan AS (
  SELECT key, rule, n AS n_before,
         CASE rule WHEN 'conditional_schema' THEN data + CASE WHEN last_op = 'DROP' THEN 0 ELSE 1 END
                   WHEN 'multiple_create' THEN data + 1 WHEN 'create_alter' THEN n - alters
                   WHEN 'drop_create_cycle' THEN n - 2 * again + 1 ELSE n END AS n_after FROM r)
"""


@registered(_PLAN + "SELECT * FROM plan")
def compaction_plan(spark, sf_dir):
    return changelog.compaction_plan(log(spark, sf_dir), "standard")


@registered(_PLAN + """SELECT count(*) AS n_objects, CAST(sum(n_before) AS BIGINT) AS n_before,
  CAST(sum(n_after) AS BIGINT) AS n_after, count_if(n_after < n_before) AS n_reduced,
  round(100.0 * (sum(n_before) - sum(n_after)) / sum(n_before), 2) AS reduction_pct FROM plan""")
def metrics_report(spark, sf_dir):
    return metrics.reduction(changelog.compaction_plan(log(spark, sf_dir), "standard"))


@registered(_PLAN + """SELECT rule, count(*) AS n_objects, CAST(sum(n_before) AS BIGINT) AS n_before,
  CAST(sum(n_after) AS BIGINT) AS n_after FROM plan GROUP BY rule""")
def operation_breakdown(spark, sf_dir):
    return metrics.by_rule(changelog.compaction_plan(log(spark, sf_dir), "standard"))


@registered(_PLAN + """, t AS (SELECT round(100.0 * (sum(n_before) - sum(n_after)) / sum(n_before), 2) AS r FROM plan)
SELECT 'apply' AS action, r AS reduction_pct FROM t WHERE r >= 35 UNION ALL SELECT 'review', r FROM t WHERE r >= 15
UNION ALL SELECT 'raise_safety_level', r FROM t WHERE r < 15""")
def recommended_actions(spark, sf_dir):
    return metrics.recommendations(metrics_report(spark, sf_dir))


def _batched(spark, sf_dir):
    own = log(spark, sf_dir).withColumn("target", F.col("attr")).withColumn("stream", F.col("key"))
    return batches.in_batches(own, "stream", F.col("op") == "INSERT", "seq", "idx")


_BATCHED = """, st AS (
  SELECT *, key AS stream, attr AS target, op = 'INSERT' AS alone,
         CASE WHEN op = 'INSERT' OR coalesce(lag(op) OVER w = 'INSERT', true) THEN 1 ELSE 0 END AS starts
  FROM log WINDOW w AS (PARTITION BY key ORDER BY seq, idx)),
b AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY stream ORDER BY seq, idx) AS BIGINT) AS batch FROM st),
bs AS (
  SELECT stream, batch, count(*) AS n_changes, bool_or(alone) AS alone, bool_or(op = 'DROP') AS exclusive,
         count(DISTINCT target) AS n_targets FROM b GROUP BY stream, batch)
"""


@registered(_BATCHED + "SELECT * FROM bs")
def txn_batches(spark, sf_dir):
    return batches.batch_summary(_batched(spark, sf_dir), "stream", F.col("op") == "DROP")


@registered(_BATCHED + """, pairs AS (
  SELECT a.stream, a.target, a.idx AS first, z.idx AS second, a.op = 'DROP' AND z.op = 'DROP' AS x,
         (a.value > 50) <> (z.value > 50) AS c, a.batch <> z.batch AS f
  FROM b a JOIN b z ON a.stream = z.stream AND a.target = z.target
   AND ((a.batch = z.batch AND a.idx < z.idx) OR z.batch = a.batch + 1))
SELECT stream, target, first, second, CASE WHEN x THEN 'HIGH' WHEN c THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM pairs WHERE x OR c OR f""")
def lock_conflicts(spark, sf_dir):
    exclusive, concurrent = F.col("op") == "DROP", F.col("value") > 50
    return batches.lock_conflicts(_batched(spark, sf_dir), "stream", exclusive, concurrent, "idx")


@registered(_BATCHED + """SELECT stream, batch, n_changes, n_targets, w AS warning FROM (
  SELECT *, unnest([CASE WHEN n_changes > 5 THEN 'LARGE' END, CASE WHEN exclusive THEN 'EXCLUSIVE' END,
                    CASE WHEN NOT alone AND n_targets > 1 THEN 'MANY_TARGETS' END]) AS w FROM bs) WHERE w IS NOT NULL""")
def batch_warnings(spark, sf_dir):
    return batches.warnings(txn_batches(spark, sf_dir), "stream", 5)


@registered("""SELECT key, idx AS since, k AS n_actions FROM (
  SELECT key || ':' || attr AS key, idx, op, row_number() OVER (PARTITION BY key, attr ORDER BY seq DESC, idx DESC) AS r,
         count(*) OVER (PARTITION BY key, attr) AS k FROM log WHERE op IN ('CREATE', 'ALTER', 'DROP'))
WHERE r = 1 AND op <> 'DROP'""")
def pending_constraints(spark, sf_dir):
    own = log(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("key").cast("string"), "attr"))
    return batches.pending(own, F.col("op").isin("CREATE", "ALTER"), F.col("op") == "DROP", "seq", "idx")
