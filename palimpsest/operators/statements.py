"""Statements of SQL scripts: splitting, classes, objects, locks, and static rules, by patterns in DataFrame functions.

Scripts are data here. There is no parser: what the leading keywords and a few patterns tell is told, and all else fails
closed (class `write`, object type UNKNOWN). Text inside quotes and comments is blanked before patterns are tried, so a
keyword in a string decides nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import name_parts

#: Comments, and text that no pattern may look into: escape strings, strings, quoted names, dollar-quoted bodies. Groups
#: never give characters back, so that texts of any length are scanned in one pass without a stack.
COMMENT = r"--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
STRING = r"(?:(?<![\w$])[Ee]'[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+'|'[^']*+(?:''[^']*+)*+')"
QUOTED_NAME = r'"[^"]*+(?:""[^"]*+)*+"'


def body(group: int) -> str:
    """A dollar-quoted body; its tag is the group of that number in the whole pattern."""
    return rf"(?<![\w$])(\$(?:[A-Za-z_]\w*+)?+\$)(?s:.*?)\{group}"


#: Characters that begin no comment, quote or body: taken in runs, so that alternatives are tried where one may begin only.
PLAIN = r"(?:[^;'\"$/Ee-]|[Ee](?!'))++"
#: A statement with its semicolon.
SCRIPT = rf"(?s)(?:{PLAIN}|{COMMENT}|{STRING}|{QUOTED_NAME}|{body(1)}|[^;])*+;?"


def split(scripts: DataFrame, *keep: str, sql: str = "content") -> DataFrame:
    """keep columns with idx and sql of each statement of a script, semicolons in quotes, bodies and comments respected.
    A null or blank script has none."""
    found = F.regexp_extract_all(F.col(sql), F.lit(SCRIPT), F.lit(0))
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s*;?\s*$", ""))
    # what begins with a letter is no comment, nor a body alone
    real = F.filter(trimmed, lambda x: F.when(x.rlike("^[A-Za-z(]"), True).otherwise(bare(x) != ""))
    return scripts.select(*keep, F.posexplode(real).alias("idx", "sql"))


#: What stands between comments.
_CODE = rf"(?s)((?:{PLAIN}|{STRING}|{QUOTED_NAME}|{body(2)}|(?!--|/\*).)++)|{COMMENT}"


#: White space but single spaces.
SPACES = r"\s{2,}|[^\S ]"


def uncommented(sql: Column) -> Column:
    """sql with a space for each comment; what looks like one inside quotes stays."""
    return F.trim(F.when(sql.rlike(r"--|/\*"), F.regexp_replace(sql, _CODE, "$1 ")).otherwise(sql))


def bare(sql: Column) -> Column:
    """Upper case, comments out, quoted strings and bodies emptied, white space collapsed. Quotes and comments are told apart
    in one pass, so neither hides the other. Quoted names stay."""
    emptied = F.regexp_replace(uncommented(sql), rf"(?s)({QUOTED_NAME})|(?<![\w$])[Ee](')[^'\\]*+(?:(?:''|\\.)[^'\\]*+)*+(')|(')[^']*+(?:''[^']*+)*+(')|{body(6)}", "$1$2$3$4$5$6")
    return F.upper(F.trim(F.regexp_replace(emptied, SPACES, " ")))


def comments(sql: Column) -> Column:
    """The comments of sql, in order."""
    found = F.regexp_extract_all(sql, F.lit(rf"(?s){STRING}|{QUOTED_NAME}|{body(1)}|({COMMENT})"), F.lit(2))
    return F.filter(found, lambda x: x != "")


def is_opaque(sql: Column) -> Column:
    """Patterns can't be trusted with it: comments that nest, quotes that don't end, names in escapes."""
    b = bare(sql)
    left = F.regexp_replace(F.regexp_replace(b, QUOTED_NAME, ""), "''", "")
    return F.exists(comments(sql), lambda c: F.substr(c, F.lit(3)).contains("/*")) | left.rlike("['\"]|/[*]|\\*/") | b.rlike(r'\bU&"')


#: Functions whose call writes.
SIDE_EFFECTS = (
    "setval", "nextval", "lo_creat", "lo_create", "lo_import", "lo_unlink", "pg_advisory_lock", "pg_advisory_lock_shared",
    "pg_advisory_xact_lock", "pg_advisory_xact_lock_shared", "pg_cancel_backend", "pg_terminate_backend", "pg_reload_conf",
    "pg_rotate_logfile", "pg_switch_wal", "pg_create_restore_point", "pg_promote", "pg_create_physical_replication_slot",
    "pg_create_logical_replication_slot", "pg_drop_replication_slot", "pg_replication_origin_create",
    "pg_replication_origin_drop", "pg_logical_emit_message", "pg_stat_reset", "pg_stat_reset_shared",
    "pg_stat_reset_single_table_counters", "pg_stat_reset_single_function_counters", "dblink_exec", "set_config",
)
#: Functions beyond these that write as well.
MORE_SIDE_EFFECTS = (
    "pg_notify", "pg_advisory_unlock", "pg_advisory_unlock_all", "pg_advisory_unlock_shared", "pg_try_advisory_lock",
    "pg_try_advisory_lock_shared", "pg_try_advisory_xact_lock", "pg_try_advisory_xact_lock_shared", "lo_from_bytea", "lo_put",
    "lo_export", "pg_wal_replay_pause", "pg_wal_replay_resume", "pg_import_system_collations", "dblink", "query_to_xml",
)
CALLED = r'(?<![\w$])"?(' + "|".join((*SIDE_EFFECTS, *MORE_SIDE_EFFECTS)).upper() + r')"? ?\('
#: Data that a query changes; UPDATE alone is enough, but for the lock of FOR UPDATE.
CHANGES = r"\b(INSERT INTO|DELETE FROM|MERGE INTO|(?<!\bFOR )(?<!\bFOR NO KEY )UPDATE)\b"
CREATES = r"(?<!\bINSERT )(?<!\bMERGE )\bINTO\b"
#: Leading words by class; what is not listed is a write.
LEADING = (
    ("read_only", r"^(SHOW|FETCH|CLOSE)\b"),
    ("write", r"^(INSERT|UPDATE|DELETE|MERGE|COPY|DO|CALL|EXECUTE)\b"),
    ("ddl", r"^(CREATE|ALTER|DROP|TRUNCATE|COMMENT|GRANT|REVOKE|SECURITY LABEL|REFRESH|IMPORT FOREIGN|REASSIGN OWNED)\b"),
    (
        "maintenance",
        r"^(SET(?! CONSTRAINTS)|RESET|VACUUM|ANALY[SZ]E|CLUSTER|REINDEX|CHECKPOINT|LOCK|BEGIN|START|COMMIT|END|ROLLBACK|ABORT|"
        r"SAVEPOINT|RELEASE|PREPARE TRANSACTION|LISTEN|UNLISTEN|NOTIFY|DISCARD|DEALLOCATE|LOAD)\b",
    ),
)
EXPLAINED = r"^EXPLAIN ?(\([^)]*\) ?)?((ANALY[SZ]E|VERBOSE) )*"


def inner_statement(b: Column) -> Column:
    """What a bare statement runs: that inside EXPLAIN ANALYZE, PREPARE and DECLARE; SHOW for a plain EXPLAIN."""
    analysed = F.regexp_extract(b, EXPLAINED, 0).rlike(r"\bANALY[SZ]E\b")
    ran = F.when(b.rlike(r"^EXPLAIN\b") & ~analysed, F.lit("SHOW")).otherwise(F.regexp_replace(b, EXPLAINED, ""))
    return F.regexp_replace(ran, r"^PREPARE (?!TRANSACTION\b)[^ (]+ ?(\([^)]*\) ?)?AS |^DECLARE .*? CURSOR .*?FOR ", "")


def classified(sql: Column) -> Column:
    """struct(class, reason): read_only, write, ddl or maintenance, what is not known is a write; and why, null if read_only."""

    def judge(r: Column) -> Column:
        run = r["run"]
        verdict = lambda c, why: F.struct(F.lit(c).alias("class"), F.lit(why).cast("string").alias("reason") if why is None or isinstance(why, str) else why.alias("reason"))
        query = run.rlike(r"^\(*(SELECT|WITH|VALUES|TABLE)\b")
        word = F.regexp_extract(run, r"^[A-Z]+", 0)
        cases = [
            (r["opaque"], verdict("write", "quotes or comments can't be told apart")),
            (query & run.rlike(CREATES), verdict("ddl", "the query makes a table")),
            (query & run.rlike(CHANGES), verdict("write", F.concat(F.lit("the query holds "), F.regexp_extract(run, CHANGES, 1)))),
            (query & run.rlike(CALLED), verdict("write", F.concat(F.lit("the query calls "), F.lower(F.regexp_extract(run, CALLED, 1))))),
            (query, verdict("read_only", None)),
        ]
        cases += [(run.rlike(p), verdict(c, None if c == "read_only" else word)) for c, p in LEADING]
        unknown = verdict("write", F.concat(F.lit("unknown: "), word))
        return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(cases), unknown)

    return once(F.struct(inner_statement(bare(sql)).alias("run"), is_opaque(sql).alias("opaque")), judge)


def statement_class(sql: Column) -> Column:
    return classified(sql)["class"]


def class_reason(sql: Column) -> Column:
    """Why a statement is not read_only; null if it is."""
    return classified(sql)["reason"]


def once(value: Column, use) -> Column:
    """use(value), with value worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Longer kinds come before those that they begin with.
KINDS = (
    "MATERIALIZED VIEW", "FOREIGN TABLE", "FOREIGN DATA WRAPPER", "TABLE", "VIEW", "INDEX", "SEQUENCE", "SCHEMA", "TYPE",
    "DOMAIN", "FUNCTION", "PROCEDURE", "EVENT TRIGGER", "TRIGGER", "POLICY", "EXTENSION", "ROLE", "PUBLICATION",
    "SUBSCRIPTION", "RULE", "AGGREGATE", "COLLATION", "DATABASE", "SERVER", "STATISTICS", "OPERATOR CLASS", "OPERATOR FAMILY",
    "TEXT SEARCH CONFIGURATION", "TEXT SEARCH DICTIONARY", "TEXT SEARCH PARSER", "TEXT SEARCH TEMPLATE", "CONVERSION",
    "LANGUAGE", "ACCESS METHOD", "TABLESPACE",
)
KIND = "(" + "|".join(KINDS) + ")"  # a group
HEAD = (
    r"^(?:CREATE|ALTER|DROP) (?:OR REPLACE )?(?:GLOBAL |LOCAL )?(?:TEMPORARY |TEMP |UNLOGGED )?(?:UNIQUE )?(?:RECURSIVE )?"
    r"(?:TRUSTED )?(?:PROCEDURAL )?(?:CONSTRAINT )?" + KIND + r"\b(?: CONCURRENTLY)?(?: IF NOT EXISTS| IF EXISTS)?(?: ONLY)?"
)
#: What a GRANT or REVOKE is on, and what a COMMENT is about.
GRANTED = r"^(?:GRANT|REVOKE) .*? ON (?:" + KIND + r" )?"
COMMENTED = r"^COMMENT ON " + KIND + r" "


def operation(sql: Column) -> Column:
    return operation_of(bare(sql))


def operation_of(b: Column) -> Column:
    """operation() of a bare statement."""
    return F.coalesce(F.nullif(F.regexp_extract(b, r"^(CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|TRUNCATE|GRANT|REVOKE|COMMENT|SELECT|DO)\b", 1), F.lit("")), F.lit("UNKNOWN"))


def object_type(sql: Column) -> Column:
    return once(bare(sql), object_type_of)


def object_type_of(b: Column) -> Column:
    """object_type() of a bare statement."""
    made = F.nullif(F.regexp_extract(b, HEAD, 1), F.lit(""))
    data = F.when(b.rlike(r"^(INSERT|UPDATE|DELETE|TRUNCATE|COPY)\b"), "TABLE")
    on = F.when(b.rlike(r"^(GRANT|REVOKE)\b.* ON (?!ALL )"), F.coalesce(F.nullif(F.regexp_extract(b, GRANTED, 1), F.lit("")), F.lit("TABLE")))
    about = F.nullif(F.regexp_extract(b, COMMENTED, 1), F.lit(""))
    about = F.coalesce(about, F.when(b.rlike(r"^COMMENT ON COLUMN\b"), "COLUMN"), F.when(b.rlike(r"^COMMENT ON CONSTRAINT\b"), "CONSTRAINT"))
    return F.coalesce(F.when(b.rlike(r"^CREATE TYPE \S+ AS ENUM\b"), "ENUM"), made, data, on, about, F.lit("UNKNOWN"))


NAME = r'((?:"(?:[^"]|"")+"|[A-Za-z_][\w$]*)(?:\.(?:"(?:[^"]|"")+"|[A-Za-z_][\w$]*))*)'


def flat(sql: Column) -> Column:
    """Comments out, white space collapsed to single spaces."""
    return F.trim(F.regexp_replace(uncommented(sql), SPACES, " "))


def object_name(sql: Column) -> Column:
    """The name as written; null if none is found. Of a DROP of several objects, see dropped_names()."""

    def named(plain: Column) -> Column:
        ddl = F.regexp_extract(plain, "(?i)" + HEAD + " " + NAME, 2)
        dml = F.regexp_extract(plain, r"(?i)^(?:INSERT INTO|UPDATE|DELETE FROM|TRUNCATE(?: TABLE)?|COPY)(?: ONLY)? " + NAME, 1)
        on = F.when(~plain.rlike(r"(?i)^(GRANT|REVOKE)\b.*? ON ALL "), F.regexp_extract(plain, "(?i)" + GRANTED + NAME, 2))
        about = F.regexp_extract(plain, r"(?i)^COMMENT ON (?:" + "|".join((*KINDS, "COLUMN", "CONSTRAINT")) + ") " + NAME, 1)
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in (ddl, dml, on, about)])

    return once(flat(sql), named)


def dropped_names(sql: Column) -> Column:
    """All names of a DROP."""
    listed = F.regexp_extract(flat(sql), rf"(?i){HEAD} ({NAME}(?: ?, ?{NAME})*)", 2)
    return F.regexp_extract_all(listed, F.lit(NAME), F.lit(1))


def references(sql: Column) -> Column:
    """Names of tables that foreign keys refer to, and that FROM and JOIN read; names of the statement's own WITH are none."""
    plain = F.regexp_replace(uncommented(sql), rf"(?s)({QUOTED_NAME})|{STRING}", "$1")
    found = F.regexp_extract_all(plain, F.lit(rf"(?i)\b(?:REFERENCES|FROM|JOIN)\s+(?:ONLY\s+)?{NAME}(?![\w$.]|\s*\()|\bREFERENCES\s+{NAME}(?![\w$.])"), F.lit(0))
    names = F.transform(found, lambda x: F.regexp_extract(x, rf"(?i)^\w+\s+(?:ONLY\s+)?{NAME}$", 1))
    own = F.transform(F.regexp_extract_all(plain, F.lit(rf"(?i)(?:\bWITH(?:\s+RECURSIVE)?|,)\s+{NAME}(?:\s*\([^()]*\))?\s+AS\s+(?:NOT\s+)?(?:MATERIALIZED\s+)?\("), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(names, lambda x: (x != "") & ~F.array_contains(own, F.lower(x))))


def category(op: Column, kind: Column) -> Column:
    """The phase of a build in which a statement belongs."""
    return (
        F.when(op.isin("INSERT", "UPDATE", "DELETE", "TRUNCATE"), "data")
        .when(op.isin("GRANT", "REVOKE") | (kind == "POLICY"), "security")
        .when(kind.isin("EXTENSION", "SCHEMA", "TYPE", "ENUM", "DOMAIN", "SEQUENCE", "ROLE", "COLLATION"), "foundation")
        .when(kind == "TABLE", "structure")
        .when(kind.isin("FUNCTION", "PROCEDURE", "AGGREGATE", "TRIGGER"), "logic")
        .when(kind == "INDEX", "performance")
        .when(kind.isin("VIEW", "MATERIALIZED VIEW", "RULE"), "views")
        .otherwise("foundation")
    )


def lock_level(sql: Column) -> Column:
    b = bare(sql)
    return (
        F.when(b.rlike(r"\bCONCURRENTLY\b"), "SHARE_UPDATE_EXCLUSIVE")
        .when(b.rlike(r"^CREATE (UNIQUE )?INDEX\b"), "SHARE")
        .when(b.rlike(r"^CREATE (CONSTRAINT )?TRIGGER\b"), "SHARE_ROW_EXCLUSIVE")
        .when(b.rlike(r"^ALTER TYPE\b.*\bADD VALUE\b"), "NONE")
        .when(b.rlike(r"^ALTER TABLE\b.*\b(VALIDATE CONSTRAINT|NOT VALID)"), "SHARE_UPDATE_EXCLUSIVE")
        .when(b.rlike(r"^(ALTER|DROP|TRUNCATE)\b"), "ACCESS_EXCLUSIVE")
        .when(b.rlike(r"^(INSERT|UPDATE|DELETE)\b"), "ROW_EXCLUSIVE")
        .when(b.rlike(r"^SELECT\b"), "ACCESS_SHARE")
        .otherwise("NONE")
    )


def needs_no_transaction(sql: Column) -> Column:
    return bare(sql).rlike(r"\bCONCURRENTLY\b|^VACUUM\b|^(CREATE|DROP) DATABASE\b|^ALTER TYPE\b.*\bADD VALUE\b|^ALTER SYSTEM\b")


def version_gate(sql: Column) -> Column:
    """What version of PostgreSQL a statement asks for; empty if any will do. The first that holds counts."""
    b, kind = bare(sql), object_type(sql)
    return (
        F.when(kind.isin("TYPE", "ENUM") & b.contains("ADD VALUE"), "PG<12: not in a transaction")
        .when(b.contains("GENERATED ALWAYS") | (b.contains("STORED") & b.contains("GENERATED")), "PG>=12")
        .when(b.rlike(r"^CREATE TYPE\b.*\bMULTIRANGE_TYPE_NAME\b"), "PG>=14")
        .when(kind.isin("SUBSCRIPTION", "STATISTICS"), "PG>=10")
        .otherwise("")
    )


def execution_time(sql: Column, version: int = 17) -> Column:
    """UNKNOWN, SLOW, MEDIUM or FAST: how long a statement may take, by the first that holds."""
    b = bare(sql)
    adds = b.rlike(r"\bADD CONSTRAINT\b") & ~b.rlike(r"\bNOT VALID\b")
    defaulted = b.rlike(r"\bADD COLUMN\b") & b.rlike(r"\bDEFAULT\b")
    return (
        F.when(b.rlike(r"^(INSERT|UPDATE|DELETE|COPY|MERGE)\b"), "UNKNOWN")
        .when(b.rlike(r"\bSET NOT NULL\b") | adds, "SLOW")
        .when(defaulted, "SLOW" if version < 11 else "FAST")
        .when(b.rlike(r"^CREATE (UNIQUE )?INDEX\b"), F.when(b.rlike(r"\bCONCURRENTLY\b"), "SLOW").otherwise("MEDIUM"))
        .when(b.rlike(r"\bVACUUM\b"), "SLOW")
        .otherwise("FAST")
    )


def schema_of(name: Column) -> Column:
    """The schema that a name is written with, folded; public if none."""
    parts = name_parts(name)
    return F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).otherwise("public")


def leading_comments(sql: Column) -> Column:
    """The comments above a statement, their marks off."""
    above = F.regexp_extract(sql, rf"(?s)^(?:\s|{COMMENT})*+", 0)
    return F.transform(comments(above), lambda c: F.trim(F.regexp_replace(c, r"(?s)^(?:--|/\*)|\*/$", "")))


def positions(scripts: DataFrame, *keep: str, sql: str = "content") -> DataFrame:
    """keep columns with idx, line, column (both from 1) and offset (from 0) of the first character of each statement's code
    in its script, comments above it passed over."""
    found = F.regexp_extract_all(F.col(sql), F.lit(SCRIPT), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset: int, code: boolean>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        skipped = F.length(F.regexp_extract(x, rf"(?s)^(?:\s|{COMMENT})*+", 0))
        spot = F.struct((state["at"] + skipped).alias("offset"), (bare(F.regexp_replace(x, r"\s*;?\s*$", "")) != "").alias("code"))
        return F.struct((state["at"] + F.length(x)).alias("at"), F.concat(state["out"], F.array(spot)).alias("out"))

    spots = F.filter(F.aggregate(found, start, add)["out"], lambda x: x["code"])
    each = scripts.select(*keep, F.col(sql).alias("__content"), F.posexplode(F.transform(spots, lambda x: x["offset"])).alias("idx", "offset"))
    before = F.substr("__content", F.lit(1), F.col("offset"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return each.select(*keep, "idx", line.cast("long").alias("line"), column.cast("long").alias("column"), F.col("offset").cast("long").alias("offset"))


#: Words before a parenthesis that are no functions.
NO_CALLS = (
    "and any array as by cast check coalesce conflict default exists except filter foreign from greatest group having in index "
    "insert intersect into join key lateral least not nullif on only or over partition policy primary references returning row "
    "select set some table then to union unique using values when where with"
).split()


def called_functions(sql: Column) -> Column:
    """Names, folded, of the functions that a statement calls, each once in order of appearance."""
    plain = F.regexp_replace(uncommented(sql), rf"(?s)({QUOTED_NAME})|{STRING}", "$1")
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![\w$.]){NAME}\s*\("), F.lit(1))
    folded = F.transform(found, lambda x: F.array_join(name_parts(x), "."))
    return F.array_distinct(F.filter(folded, lambda x: ~x.isin(*NO_CALLS)))


def typed_dependencies(sql: Column) -> Column:
    """What a CREATE or ALTER TABLE refers to and adds: REFERENCES:table, CONSTRAINT:name, COLUMN:name (of an ALTER), in order."""
    target = lambda x: F.regexp_extract_all(x, F.lit(rf"(?i)\bREFERENCES {NAME}"), F.lit(1))
    label = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(f"{kind}:"), F.array_join(name_parts(n), ".")))
    one = lambda text, pattern: F.filter(F.array(F.regexp_extract(text, pattern, 1)), lambda n: n != "")

    def of_item(x: Column) -> Column:
        constraint = one(x, rf"(?i)^ADD CONSTRAINT {NAME}")
        column = F.when(~x.rlike(r"(?i)^ADD (CONSTRAINT|PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE)\b"), one(x, rf"(?i)^ADD (?:COLUMN )?(?:IF NOT EXISTS )?{NAME}"))
        return F.concat(label("CONSTRAINT", constraint), label("COLUMN", F.coalesce(column, F.slice(constraint, F.lit(1), F.lit(0)))), label("REFERENCES", target(x)))

    def told(text: Column) -> Column:
        changes = items(F.regexp_replace(text, rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{NAME}(?: ?\*)? ", ""))
        return F.when(text.rlike("(?i)^ALTER TABLE "), F.flatten(F.transform(changes, of_item))).when(text.rlike(r"(?i)^CREATE (\w+ )*TABLE\b"), label("REFERENCES", target(text)))

    return F.array_distinct(F.coalesce(once(flat(sql), told), F.array().cast("array<string>")))


def is_idempotent(sql: Column) -> Column:
    return bare(sql).rlike(r"\bIF (NOT )?EXISTS\b|^CREATE OR REPLACE\b") & ~operation(sql).isin("INSERT", "UPDATE", "DELETE")


def preserved(sql: Column) -> Column:
    """A comment asks for the statement to be left as it is."""
    return sql.rlike(r"--|/\*") & F.exists(comments(sql), lambda c: F.upper(c).rlike(r"\b(IGNORE|NO-MERGE)\b"))


def told(statements: DataFrame, *names: str) -> DataFrame:
    """statements(…, sql) with some of what analysed() tells, worked out once for each row: a filter on it is not tried on the text
    again. names are of operation, object_type, object_name, category and preserved."""
    own = {
        "operation": lambda b, s: operation_of(b), "object_type": lambda b, s: object_type_of(b), "object_name": lambda b, s: object_name(s),
        "category": lambda b, s: once(F.struct(operation_of(b).alias("o"), object_type_of(b).alias("t")), lambda r: category(r["o"], r["t"])), "preserved": lambda b, s: preserved(s),
    }
    s = F.col("sql")
    return statements.select("*", F.inline(F.array(once(bare(s), lambda b: F.struct(*[own[n](b, s).alias(n) for n in names])))))


def analysed(statements: DataFrame) -> DataFrame:
    """statements(…, sql) with what the functions above tell of each."""
    s = F.col("sql")
    return (
        statements.withColumn("operation", operation(s))
        .withColumn("object_type", object_type(s))
        .withColumn("object_name", object_name(s))
        .withColumn("class", statement_class(s))
        .withColumn("reason", class_reason(s))
        .withColumn("category", category(F.col("operation"), F.col("object_type")))
        .withColumn("lock_level", lock_level(s))
        .withColumn("no_transaction", needs_no_transaction(s))
        .withColumn("version_gate", version_gate(s))
        .withColumn("execution_time", execution_time(s))
        .withColumn("idempotent", is_idempotent(s))
        .withColumn("preserved", preserved(s))
        .withColumn("references", references(s))
    )


def is_read_only(classified: DataFrame, *script: str) -> DataFrame:
    """Whether all statements of each script only read."""
    return classified.groupBy(*script).agg(F.bool_and(F.col("class") == "read_only").alias("read_only"))


def _nested(levels: int) -> str:
    inside = rf"(?:[^()'\"]++|{STRING}|{QUOTED_NAME})"
    group = rf"\({inside}*+\)"
    for _ in range(levels):
        group = rf"\((?:{inside}|{group})*+\)"
    return group


def balanced() -> str:
    """What may stand between parentheses that match, up to 32 deep."""
    return rf"(?:[^()'\"]++|{STRING}|{QUOTED_NAME}|{_nested(31)})*+"


#: What stands between commas: quotes and parentheses are passed over, these up to 32 deep (a list that is deeper stays whole).
ITEM = rf"(?s)(?:[^,()'\"]++|{STRING}|{QUOTED_NAME}|{_nested(31)})++"


def items(text: Column) -> Column:
    """The parts of a list at its top level; the whole text as one part where quotes or parentheses don't match."""

    def parts(r: Column) -> Column:
        whole = F.length(F.array_join(r["found"], ",")) >= F.length(F.regexp_replace(r["text"], r"^[\s,]+|[\s,]+$", ""))
        return F.when(whole, r["found"]).otherwise(F.array(r["text"]))

    read = lambda t: F.struct(F.regexp_extract_all(t, F.lit(ITEM), F.lit(0)).alias("found"), t.alias("text"))
    found = once(text, lambda t: once(read(t), parts))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


#: A name in bare text.
BARE_NAME = r'(?:"(?:[^"]|"")+"|[\w$]+)(?:\.(?:"(?:[^"]|"")+"|[\w$]+))*'
_TABLE = rf"^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{BARE_NAME}(?: ?\*)? "
#: Static rules: code, the statements that a rule is about, what must and what must not hold for a violation, what to do
#: instead. Rules of ALTER TABLE look at each of its items, the others at the bare statement.
RULES = (
    ("ban-drop-column", "item", r"^DROP (?!CONSTRAINT\b)", None, "keep the column until nothing reads it"),
    ("ban-drop-table", "statement", r"^DROP (FOREIGN )?TABLE\b", None, "keep the table until nothing reads it"),
    ("ban-rename-column", "item", r"^RENAME (?!TO\b|CONSTRAINT\b)", None, "add a column and copy"),
    ("ban-rename-table", "item", r"^RENAME TO\b", None, "add a view under the new name"),
    ("ban-type-change", "item", rf"^ALTER (COLUMN )?{BARE_NAME} (SET DATA )?TYPE\b", None, "add a column of the new type"),
    ("require-concurrent-index", "statement", r"^(CREATE (UNIQUE )?INDEX|DROP INDEX)\b", r"\bCONCURRENTLY\b", "add CONCURRENTLY"),
    ("block-missing-where", "statement", r"^(DELETE FROM|UPDATE)\b", r"\bWHERE\b", "add WHERE"),
    ("constraint-missing-not-valid", "item", rf"^ADD (CONSTRAINT {BARE_NAME} )?(CHECK|FOREIGN KEY)\b", r"\bNOT VALID\b", "add NOT VALID"),
    ("prefer-text", "column", r"(?:VARCHAR|CHARACTER\s+VARYING)\s*\(\s*\d+\s*\)", "TEXT", "use TEXT"),
    ("prefer-bigint", "column", r"(?:INTEGER|INT4|INT)\b(?!\s*\()", "BIGINT", "use BIGINT"),
)
CODES = tuple(code for code, *_ in RULES)
IGNORE = r"(?i)lint-ignore:?\s*([a-z, -]+)"
IGNORE_NEXT = r"(?i)lint-ignore-next:?\s*([a-z, -]+)"
IGNORE_FILE = r"(?i)lint-ignore-file:?\s*([a-z, -]+)"
IGNORE_ALONE = r"(?i)lint-ignore(?!-next|-file):?\s*([a-z, -]+)"
VIOLATION = "struct<code: string, advice: string, object: string, first: int, past: int, fix: string>"


def enabled_rules(base: list[str] | None = None, enable: list[str] = (), disable: list[str] = ()) -> list[str]:
    """Codes of the rules in force, in order; unknown ones are errors."""
    asked = {*(base or []), *enable, *disable}
    if unknown := sorted(asked - set(CODES)):
        raise ValueError(f"unknown rules {unknown}")
    on = ({*(CODES if base is None else base)} | {*enable}) - {*disable}
    return [code for code in CODES if code in on]


def masked(sql: Column) -> Column:
    """sql of the same length, with blanks for comments and quoted text, and letters for quoted names."""
    tokens = F.regexp_extract_all(sql, F.lit(rf"(?s){COMMENT}|{STRING}|{QUOTED_NAME}|{body(1)}|(?:(?!--|/\*)[^'\"$])++|."), F.lit(0))
    quoted = lambda t: F.when(t.rlike(r"(?s)^(?:--|/\*|[Ee]?'|\$(?:[A-Za-z_]\w*)?\$)"), F.rpad(F.lit(""), F.length(t), " ")).when(
        t.rlike('(?s)^".+"$'), F.rpad(F.lit("x"), F.length(t), "x")
    )
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(quoted(t), t)), "")


def places(text: Column, before: str, what: str) -> Column:
    """array of struct(first, past, text): where `what` stands after `before`, counted from 0."""
    whole, gaps = F.regexp_extract_all(text, F.lit(f"(?is)({before})({what})"), F.lit(0)), F.split(text, f"(?is)(?:{before})(?:{what})", -1)
    none = F.array().cast("array<struct<first: int, past: int, text: string>>")

    def add(state: Column, m: Column) -> Column:
        end = state["end"] + F.length(m["gap"]) + F.length(m["x"])
        head = F.length(F.regexp_extract(m["x"], f"(?is)^({before})({what})$", 1))
        spot = F.struct((end - F.length(m["x"]) + head).alias("first"), end.alias("past"), F.substr(m["x"], head + 1).alias("text"))
        return F.struct(end.alias("end"), F.concat(state["found"], F.array(spot)).alias("found"))

    # each match with what stands before it; the last piece has no match after it
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("x")), lambda m: m["x"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("end"), none.alias("found")), add)["found"]


#: What stands before the type of a new column.
NEW_COLUMN = r"(?:[(,]|\bADD\b(?:\s+COLUMN\b)?(?:\s+IF\s+NOT\s+EXISTS\b)?)\s*(?!ADD\b)[A-Za-z_][\w$]*+\s+"


def found_violations(sql: Column, rules: list[str] | None = None) -> Column:
    """array of the violations of a statement: code, advice, object (of a DROP, each of its objects), and, where there is a
    fix, the text that would replace the characters from first (counted from 0) up to past."""
    read = F.struct(bare(sql).alias("bare"), masked(sql).alias("hidden"), object_name(sql).alias("name"), dropped_names(sql).alias("names"))
    return once(read, lambda r: once(_altered(r["bare"]), lambda items_: _violations(r, items_, enabled_rules(rules))))


def _altered(b: Column) -> Column:
    """The items of a bare ALTER TABLE, none of others."""
    return F.coalesce(F.when(b.rlike(_TABLE), items(F.regexp_replace(b, _TABLE, ""))), F.array().cast("array<string>"))


def _violations(r: Column, changes: Column, on: list[str]) -> Column:
    b, none, nothing = r["bare"], F.array().cast(f"array<{VIOLATION}>"), F.lit(None)
    makes = b.rlike(rf"^CREATE (?:\w+ )*?TABLE\b|{_TABLE}")

    def violation(code: str, advice: str, object_: Column, first: Column = nothing, past: Column = nothing, fix: Column = nothing) -> Column:
        names = ("code", "advice", "object", "first", "past", "fix")
        return F.struct(*[x.alias(n) for n, x in zip(names, (F.lit(code), F.lit(advice), object_, first, past, fix), strict=True)]).cast(VIOLATION)

    def broken(code: str, scope: str, when: str, unless: str | None, advice: str) -> Column:
        if scope == "column":
            spots = F.when(makes, places(r["hidden"], NEW_COLUMN, when))
            return F.transform(spots, lambda x: violation(code, advice, r["name"], x["first"], x["past"], F.lit(unless)))
        if scope == "item":
            hit = lambda x: x.rlike(when) & (~x.rlike(unless) if unless else F.lit(True))
            return F.when(F.exists(changes, hit), F.array(violation(code, advice, r["name"])))
        # a WHERE inside parentheses is not the statement's own
        own = F.regexp_replace(b, _nested(31), "()") if code == "block-missing-where" else b
        hit = b.rlike(when) & (~own.rlike(unless) if unless else F.lit(True))
        each = F.transform(r["names"], lambda x: violation(code, advice, x)) if code == "ban-drop-table" else F.array(violation(code, advice, r["name"]))
        return F.when(hit, each)

    return F.concat(none, *[F.coalesce(broken(*rule), none) for rule in RULES if rule[0] in on])


def violations(statements: DataFrame, *keep: str, rules: list[str] | None = None) -> DataFrame:
    """keep columns, code, advice, object, first, past, fix and ignored of each violation of statements(…, sql). A comment
    `lint-ignore: code` in the statement makes it ignored; see unused_ignores() for those that had no reason, and
    in_scripts() for comments that are about other statements."""
    off = F.col("off") if "off" in statements.columns else ignored_codes(F.col("sql"))
    each = statements.select(*keep, off.alias("__off"), F.explode(found_violations(F.col("sql"), rules)).alias("v"))
    return each.select(*keep, "v.*", F.array_contains("__off", F.col("v.code")).alias("ignored"))


def ignored_codes(sql: Column, pattern: str = IGNORE) -> Column:
    lists = F.regexp_extract_all(F.array_join(comments(sql), "\n"), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.split(F.trim(x), r"\s*,\s*"))))


def in_scripts(statements: DataFrame, script: str, idx: str = "idx") -> DataFrame:
    """statements with `off`, the codes that comments ignore in them: `lint-ignore: …` in the statement, `lint-ignore-next: …`
    above it or in the one before, `lint-ignore-file: …` anywhere in its script."""
    s = F.col("sql")
    above = F.regexp_extract(s, rf"(?s)^(?:\s|{COMMENT})*+", 0)
    below = F.substr(s, F.length(above) + 1)
    before = Window.partitionBy(script).orderBy(idx)
    marked = statements.withColumn("__next", F.lag(ignored_codes(below, IGNORE_NEXT)).over(before))
    whole = statements.select(script, F.explode(ignored_codes(s, IGNORE_FILE)).alias("c")).groupBy(script).agg(F.collect_set("c").alias("__file"))
    none = F.array().cast("array<string>")
    parts = [ignored_codes(s, IGNORE_ALONE), ignored_codes(above, IGNORE_NEXT), F.coalesce("__next", none), F.coalesce("__file", none)]
    return marked.join(whole, script, "left").withColumn("off", F.array_distinct(F.concat(*parts))).drop("__next", "__file")


def unused_ignores(statements: DataFrame, *keep: str) -> DataFrame:
    """keep columns and code of the directives that no violation needed."""
    asked = statements.select(*keep, F.explode(ignored_codes(F.col("sql"))).alias("code"))
    used = violations(statements, *keep).where("ignored").select(*keep, "code")
    return asked.join(used, [*keep, "code"], "left_anti")


def repaired_by(sql: Column, fixes: Column) -> Column:
    """sql with fixes (array of struct(first, past, fix)) put in, from the last to the first; those that lie outside of the
    text, run backwards, or overlap one that was put in are skipped."""
    start = F.struct(sql.alias("text"), F.length(sql).alias("free"))

    def put(state: Column, f: Column) -> Column:
        good = (f["first"] >= 0) & (f["first"] <= f["past"]) & (f["past"] <= state["free"])
        text = F.concat(F.substr(state["text"], F.lit(1), f["first"]), f["fix"], F.substr(state["text"], f["past"] + 1))
        return F.when(good, F.struct(text.alias("text"), f["first"].alias("free"))).otherwise(state)

    ordered = F.sort_array(F.transform(fixes, lambda f: F.struct(f["first"].alias("first"), f["past"].alias("past"), f["fix"].alias("fix"))), asc=False)
    return F.aggregate(ordered, start, put)["text"]


def fixed(sql: Column, rules: list[str] | None = None) -> Column:
    """sql with the fixes of its violations that no comment ignores."""
    off = ignored_codes(sql)
    return repaired_by(sql, F.filter(found_violations(sql, rules), lambda v: v["fix"].isNotNull() & ~F.array_contains(off, v["code"])))


def labelled(column: Column, ladder: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that holds."""
    return reduce(lambda rest, x: F.when(column.rlike(x[1]), x[0]).otherwise(rest), reversed(ladder), F.lit(default))
