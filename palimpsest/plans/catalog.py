"""The catalog that a history leaves, as relations, and the signatures of what is in it.

A Catalog folds the statements of a final state (those of compact(), or scripts that only make things) into one DataFrame
for each kind of catalog row. Catalog queries are DataFrame code over these; signature_lines() joins fifteen kinds of lines,
so that two histories can be compared row by row. A statement that no pattern here knows gives no row.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import ALIASES
from palimpsest.operators import changelog, columns, graph, privileges, signature, statements
from palimpsest.plans import compact

NAME = statements.NAME
#: What a sequence of a column is made from, and the type that the column then has.
SERIALS = {"smallserial": "smallint", "serial2": "smallint", "serial": "integer", "serial4": "integer", "bigserial": "bigint", "serial8": "bigint"}
#: Words that may begin what follows a column's type.
CLAUSE = r"(?:NOT NULL|NULL|DEFAULT|PRIMARY KEY|UNIQUE|REFERENCES|CHECK|GENERATED|COLLATE|CONSTRAINT)\b"
#: Text in which quotes are passed over, up to where what follows matches first.
SKIP = rf"^(?:{statements.STRING}|{statements.QUOTED_NAME}|[^'\"])*?"
ACTION = r"(CASCADE|RESTRICT|NO ACTION|SET NULL|SET DEFAULT)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none or the group is empty."""
    return F.nullif(F.regexp_extract(text, "(?is)" + pattern, group), F.lit(""))


def schema_of(name: Column) -> Column:
    """The schema of a folded name; public where it gives none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1), F.lit("")), F.lit("public"))


def base_of(name: Column) -> Column:
    return F.regexp_extract(name, r"[^.]+$", 0)


def _placed(name: Column, as_: str = "name") -> list[Column]:
    return [schema_of(name).alias("schema"), base_of(name).alias(as_)]


def _latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last statement about each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), changelog.order()).alias("r")).select(*key, "r.*")


def _made(analysed: DataFrame, *kinds: str) -> DataFrame:
    """seq, idx, flat, name of the CREATEs of some kinds, the last one of each name."""
    own = analysed.where((F.col("operation") == "CREATE") & F.col("object_type").isin(*kinds))
    rows = own.select("seq", "idx", "sql", "object_type", statements.flat(F.col("sql")).alias("flat"), columns.folded_name(F.col("object_name")).alias("name"))
    return rows


def _names(text: Column) -> Column:
    """The folded names of a list."""
    return F.transform(statements.items(text), columns.folded_name)


def column_rows(states: DataFrame) -> DataFrame:
    """schema, table, place, name, type, not_null, default, generated, identity of the columns in states (see
    columns.table_states). A serial column is one of its integer type whose default is its sequence's next value."""
    own = states.where("part = 'COLUMN'")
    text = F.col("text")
    written = F.lower(_found(text, rf"^{NAME} (.*?)(?: {CLAUSE}.*)?$", 2))
    serial = F.create_map(*[F.lit(x) for pair in SERIALS.items() for x in pair])
    of_serial = F.element_at(serial, written)
    usual, word = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), F.regexp_extract(written, r"^\w*", 0)
    default = _found(text, rf"{SKIP}(?<! BY)(?<! SET) DEFAULT (.*?)(?: NOT NULL)?$")
    sequence = F.concat(F.lit("nextval('"), F.regexp_replace("key", r"[^.]+$", ""), base_of(F.col("key")), F.lit("_"), F.col("name"), F.lit("_seq'::regclass)"))
    key = F.coalesce(_found(text, rf"{SKIP} (PRIMARY KEY)\b").isNotNull(), F.lit(False))
    identity = F.upper(_found(text, r"\bGENERATED (ALWAYS|BY DEFAULT) AS IDENTITY"))
    numbered = Window.partitionBy("key").orderBy("place")  # a table's columns, as many as a statement lists
    return own.select(
        *_placed(F.col("key"), "table"), F.row_number().over(numbered).cast("long").alias("place"), "name",
        F.when(of_serial.isNotNull(), of_serial).otherwise(F.concat(F.coalesce(F.element_at(usual, word), word), F.substr(written, F.length(word) + 1))).alias("type"),
        (text.rlike("(?i) NOT NULL$") | key | of_serial.isNotNull() | identity.isNotNull()).alias("not_null"),
        F.coalesce(default, F.when(of_serial.isNotNull(), sequence)).alias("default"),
        _found(text, r"\bGENERATED ALWAYS AS (\(.*\)) STORED").alias("generated"), identity.alias("identity"),
    )


def constraint_rows(states: DataFrame) -> DataFrame:
    """schema, table, name, kind, columns, target, target_columns, on_delete, definition of the constraints of tables, those that a
    column's definition holds among them. kind is p, u, f, c or x. One without a name has that which PostgreSQL gives it: the
    table, its columns (none for a primary key, and for a check that stands beside the columns), a word for the kind, and a
    number where that name is taken."""
    inside = statements.balanced()
    text = F.col("text")
    head = rf"^(?:CONSTRAINT {NAME} )?"
    of_table = states.where("part = 'CONSTRAINT'").select("key", "place", F.lit(0).alias("sub"), F.when(F.col("name").rlike("^#|^$"), None).otherwise(F.col("name")).alias("named"), F.regexp_replace("text", "(?i)" + head, "").alias("body"), F.lit(None).cast("string").alias("col"))
    clause = rf"(?is)(?:\bCONSTRAINT {NAME} )?\b(?:PRIMARY KEY|UNIQUE|REFERENCES {NAME}(?: ?\([^)]*\))?(?: ON (?:DELETE|UPDATE) {ACTION})*|CHECK ?\({inside}\))"
    outside = F.when(F.col("part") == "COLUMN", F.regexp_extract_all(text, F.lit(clause), F.lit(0)))
    each = states.where("part = 'COLUMN'").select("key", "place", "name", F.posexplode(outside).alias("sub", "c"))
    of_column = each.select("key", "place", "sub", columns.folded_name(_found(F.col("c"), rf"^CONSTRAINT {NAME} ")).alias("named"), F.regexp_replace("c", "(?i)" + head, "").alias("body"), F.col("name").alias("col"))
    b = F.col("body")
    kind = (
        F.when(b.rlike("(?i)^PRIMARY KEY"), "p").when(b.rlike("(?i)^UNIQUE"), "u").when(b.rlike("(?i)^(FOREIGN KEY|REFERENCES)"), "f")
        .when(b.rlike("(?i)^CHECK"), "c").when(b.rlike("(?i)^EXCLUDE"), "x")
    )
    listed = _names(_found(b, r"^(?:PRIMARY KEY|UNIQUE|FOREIGN KEY) ?\(([^)]*)\)"))
    target = columns.folded_name(_found(b, rf"\bREFERENCES {NAME}"))
    rows = of_table.unionByName(of_column).withColumn("kind", kind).where("kind is not null").select(
        "key", "place", "sub", "named", "kind", F.when(F.col("col").isNotNull(), F.array("col")).otherwise(listed).alias("columns"), target.alias("target"),
        _names(_found(b, rf"\bREFERENCES {NAME} ?\(([^)]*)\)", 2)).alias("target_columns"),
        F.upper(_found(b, rf"\bON DELETE {ACTION}")).alias("on_delete"), b.alias("definition"),
    )
    about = F.when(F.col("kind").isin("u", "f", "c"), F.array_join("columns", "_"))
    word = F.create_map(*[F.lit(x) for x in ("p", "pkey", "u", "key", "f", "fkey", "c", "check", "x", "excl")])
    given = rows.withColumn("plain", F.concat_ws("_", base_of(F.col("key")), F.nullif(about, F.lit("")), F.element_at(word, F.col("kind"))))
    nth = F.row_number().over(Window.partitionBy("key", "plain", F.col("named").isNull()).orderBy("place", "sub")) - 1
    given = given.withColumn("name", F.coalesce("named", F.when(nth == 0, F.col("plain")).otherwise(F.concat("plain", nth.cast("string")))))
    return given.select(*_placed(F.col("key"), "table"), "name", "kind", "columns", "target", "target_columns", "on_delete", "definition")


def index_rows(analysed: DataFrame, constraints: DataFrame) -> DataFrame:
    """schema, table, name, unique, primary, method, columns, predicate of the indexes that statements make, and of those that
    keys of constraints(see above) make."""
    flat = F.col("flat")
    inside = statements.balanced()
    on = rf"\bON (?:ONLY )?{NAME}(?: USING (\w+))? ?\(({inside})\)"
    table = columns.folded_name(_found(flat, on))
    own = _latest(_made(analysed, "INDEX"), "name").select(
        schema_of(table).alias("schema"), base_of(table).alias("table"), base_of(F.col("name")).alias("name"),
        flat.rlike("(?i)^CREATE UNIQUE ").alias("unique"), F.lit(False).alias("primary"), F.lower(F.coalesce(_found(flat, on, 2), F.lit("btree"))).alias("method"),
        F.transform(statements.items(_found(flat, on, 3)), lambda x: F.when(x.rlike(rf"^{NAME}$"), columns.folded_name(x)).otherwise(x)).alias("columns"),
        _found(flat, rf"\)(?:[^()]|\({inside}\))* WHERE (.*)$").alias("predicate"),
    )
    keys = constraints.where("kind in ('p', 'u')")
    made = keys.select("schema", "table", "name", F.lit(True).alias("unique"), (F.col("kind") == "p").alias("primary"), F.lit("btree").alias("method"), "columns", F.lit(None).cast("string").alias("predicate"))
    return own.where("table is not null").unionByName(made)


def view_rows(analysed: DataFrame) -> DataFrame:
    """schema, name, materialized, definition."""
    flat = F.col("flat")
    return _latest(_made(analysed, "VIEW", "MATERIALIZED VIEW"), "name").select(
        *_placed(F.col("name")), (F.col("object_type") == "MATERIALIZED VIEW").alias("materialized"),
        F.regexp_replace(_found(flat, rf"\bVIEW (?:IF NOT EXISTS )?{NAME}[^A-Za-z]*?(?:\([^)]*\) )?(?:WITH \([^)]*\) )?AS (.*)$", 2), r"(?i) WITH (NO )?DATA$", "").alias("definition"),
    )


def routine_rows(analysed: DataFrame) -> DataFrame:
    """schema, name, arguments, kind, returns, language, volatility, security_definer, body of functions and procedures; overloads
    are told apart by the types of their arguments."""
    own = analysed.where((F.col("operation") == "CREATE") & F.col("object_type").isin(*compact.ROUTINES))
    rows = own.select("seq", "idx", "sql", F.lower("object_type").alias("kind"), F.get(compact.routine_names(F.col("sql")), F.lit(0)).alias("full"))
    rows = _latest(rows, "full", "kind")
    body = _found(F.col("sql"), rf"{statements.body(1)}", 0)
    # options stand outside of the body
    options = F.regexp_replace(statements.flat(F.col("sql")), rf"(?s){statements.body(1)}", " ")
    name = F.split_part("full", F.lit("("), F.lit(1))
    returns = _found(options, rf"\) ?RETURNS (.*?)(?: (?:LANGUAGE|AS|IMMUTABLE|STABLE|VOLATILE|STRICT|SECURITY|CALLED|COST|ROWS|PARALLEL|SET|WINDOW|LEAKPROOF)\b.*)?$")
    return rows.select(
        *_placed(name), F.regexp_extract("full", r"(?s)\((.*)\)$", 1).alias("arguments"), "kind", F.lower(F.trim(returns)).alias("returns"),
        F.lower(F.coalesce(_found(options, r"\bLANGUAGE '?(\w+)'?"), F.lit("sql"))).alias("language"),
        F.lower(F.coalesce(_found(options, r"\b(IMMUTABLE|STABLE|VOLATILE)\b"), F.lit("volatile"))).alias("volatility"),
        options.rlike(r"(?i)\bSECURITY DEFINER\b").alias("security_definer"),
        F.trim(F.regexp_replace(F.coalesce(body, _found(F.col("sql"), r"\bAS\s+'(.*)'"), F.lit("")), r"^\$\w*\$|\$\w*\$$", "")).alias("body"),
    )


def trigger_rows(analysed: DataFrame) -> DataFrame:
    """schema, table, name, timing, events, level, routine, condition; events are sorted."""
    flat = F.col("flat")
    shape = rf"TRIGGER {NAME} (BEFORE|AFTER|INSTEAD OF) (.*?) ON {NAME}"
    rows = _made(analysed, "TRIGGER").withColumn("table", columns.folded_name(_found(flat, shape, 4)))
    return _latest(rows.where("table is not null"), "table", "name").select(
        schema_of(F.col("table")).alias("schema"), base_of(F.col("table")).alias("table"), "name", F.upper(_found(flat, shape, 2)).alias("timing"),
        F.array_sort(F.transform(F.split(_found(flat, shape, 3), r"(?i) OR "), lambda e: F.upper(F.regexp_extract(e, r"^\w+", 0)))).alias("events"),
        F.when(flat.rlike(r"(?i)\bFOR (EACH )?ROW\b"), "ROW").otherwise("STATEMENT").alias("level"),
        columns.folded_name(_found(flat, rf"\bEXECUTE (?:FUNCTION|PROCEDURE) {NAME}")).alias("routine"),
        _found(flat, rf"\bWHEN ?\(({statements.balanced()})\) EXECUTE").alias("condition"),
    )


def policy_rows(analysed: DataFrame) -> DataFrame:
    """schema, table, name, permissive, command, roles, using, check; roles are sorted, PUBLIC where none are named."""
    flat = F.col("flat")
    inside = statements.balanced()
    rows = _made(analysed, "POLICY").withColumn("table", columns.folded_name(_found(flat, rf"POLICY {NAME} ON {NAME}", 2)))
    roles = _found(flat, rf" TO ({NAME}(?: ?, ?{NAME})*)(?: USING| WITH CHECK|$)")
    return _latest(rows.where("table is not null"), "table", "name").select(
        schema_of(F.col("table")).alias("schema"), base_of(F.col("table")).alias("table"), "name", (~flat.rlike("(?i) AS RESTRICTIVE ")).alias("permissive"),
        F.upper(F.coalesce(_found(flat, r" FOR (ALL|SELECT|INSERT|UPDATE|DELETE)\b"), F.lit("ALL"))).alias("command"),
        F.when(roles.isNull(), F.array(F.lit("public"))).otherwise(F.array_sort(_names(roles))).alias("roles"),
        _found(flat, rf" USING ?\(({inside})\)").alias("using"), _found(flat, rf" WITH CHECK ?\(({inside})\)").alias("check"),
    )


def sequence_rows(analysed: DataFrame, column_relation: DataFrame) -> DataFrame:
    """schema, name, type, start, increment, minimum, maximum, cycles, owned_by of sequences that statements make and change, the last
    word on each option counting, and of those of serial columns. Options that none gives have PostgreSQL's defaults."""
    own = analysed.where("object_type = 'SEQUENCE' and operation in ('CREATE', 'ALTER')")
    flat = statements.flat(F.col("sql"))
    told = own.select(
        "seq", "idx", columns.folded_name(F.col("object_name")).alias("name"), (F.col("operation") == "CREATE").alias("creates"), F.lower(_found(flat, r" AS (smallint|integer|int|bigint)\b")).alias("type"),
        *[_found(flat, rf" {word} (-?\d+)").cast("long").alias(n) for n, word in (("start", "START(?: WITH)?"), ("increment", "INCREMENT(?: BY)?"), ("minimum", "MINVALUE"), ("maximum", "MAXVALUE"))],
        F.when(flat.rlike(r"(?i) NO CYCLE\b"), False).when(flat.rlike(r"(?i) CYCLE\b"), True).alias("cycles"), F.lower(_found(flat, rf" OWNED BY {NAME}")).alias("owned_by"),
    )
    options = ("type", "start", "increment", "minimum", "maximum", "cycles", "owned_by")
    last = told.groupBy("name").agg(F.bool_or("creates").alias("made"), *[F.max_by(o, F.when(F.col(o).isNotNull(), changelog.order())).alias(o) for o in options]).where("made")
    base = F.when(F.col("type") == "int", "integer").otherwise(F.coalesce("type", F.lit("bigint")))
    most = F.when(F.col("type") == "smallint", 32767).when(F.col("type") == "integer", 2147483647).otherwise(9223372036854775807).cast("long")
    step = F.coalesce("increment", F.lit(1))
    low = F.coalesce("minimum", F.when(step > 0, 1).otherwise(-most - F.when(F.col("type") == "bigint", 0).otherwise(1)))
    high = F.coalesce("maximum", F.when(step > 0, most).otherwise(-1))
    owner = F.when(F.col("owned_by") == "none", None).otherwise(columns.folded_name(F.col("owned_by")))
    typed = last.withColumn("type", base)
    serial = column_relation.where("default like 'nextval(%_seq''::regclass)'").select("schema", "type", F.concat_ws(".", F.when(F.col("schema") != "public", F.col("schema")), "table", "name").alias("owned_by"), F.concat_ws("_", "table", "name", F.lit("seq")).alias("name"))
    shape = ["schema", "name", "type", "start", "increment", "minimum", "maximum", "cycles", "owned_by"]
    one = typed.select(*_placed(F.col("name")), "type", F.coalesce("start", F.when(step > 0, low).otherwise(high)).cast("long").alias("start"), step.cast("long").alias("increment"), low.cast("long").alias("minimum"), high.cast("long").alias("maximum"), F.coalesce("cycles", F.lit(False)).alias("cycles"), owner.alias("owned_by"))
    of_columns = serial.withColumn("maximum", most).select("schema", "name", "type", F.lit(1).cast("long").alias("start"), F.lit(1).cast("long").alias("increment"), F.lit(1).cast("long").alias("minimum"), "maximum", F.lit(False).alias("cycles"), "owned_by")
    return one.select(shape).unionByName(of_columns.select(shape).join(one.select("schema", "name"), ["schema", "name"], "left_anti"))


def type_rows(analysed: DataFrame) -> DataFrame:
    """schema, name, kind, members of types: the values of an enum in order, the attributes of a composite, what a domain or a range is
    made of."""
    flat = F.col("flat")
    enum = flat.rlike(r"(?i)^CREATE TYPE \S+ AS ENUM")
    kind = F.when(F.col("object_type") == "DOMAIN", "domain").when(enum, "enum").when(flat.rlike(r"(?i)^CREATE TYPE \S+ AS RANGE"), "range").when(flat.rlike(r"(?i)^CREATE TYPE \S+ AS ?\("), "composite").otherwise("base")
    values = F.transform(F.regexp_extract_all("sql", F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda v: F.replace(v, F.lit("''"), F.lit("'")))
    listed = statements.items(_found(flat, rf"\(({statements.balanced()})\)$"))
    return _latest(_made(analysed, "TYPE", "ENUM", "DOMAIN"), "name").select(
        *_placed(F.col("name")), kind.alias("kind"),
        F.coalesce(F.when(enum, values).when(F.col("object_type") == "DOMAIN", F.array(_found(flat, rf"^CREATE DOMAIN {NAME} (?:AS )?(.*)$", 2))).otherwise(listed), F.array().cast("array<string>")).alias("members"),
    )


def extension_rows(analysed: DataFrame) -> DataFrame:
    """name, schema, version of extensions: what their CREATE says, or the last ALTER that says something else."""
    own = analysed.where("object_type = 'EXTENSION' and operation in ('CREATE', 'ALTER')")
    flat = statements.flat(F.col("sql"))
    told = own.select(
        "seq", "idx", columns.folded_name(F.col("object_name")).alias("name"), (F.col("operation") == "CREATE").alias("creates"),
        columns.folded_name(_found(flat, rf" SCHEMA {NAME}")).alias("schema"), _found(flat, r" (?:VERSION|UPDATE TO) '?([^' ]+)'?").alias("version"),
    )
    last = lambda o: F.max_by(o, F.when(F.col(o).isNotNull(), changelog.order())).alias(o)
    return told.groupBy("name").agg(F.bool_or("creates").alias("made"), last("schema"), last("version")).where("made").select("name", F.coalesce("schema", F.lit("public")).alias("schema"), "version")


def relation_rows(analysed: DataFrame, states: DataFrame) -> DataFrame:
    """schema, name, kind, row_security, forced of tables, views and materialised views. kind is table, partitioned, foreign, unlogged,
    view or materialized view."""
    flat = F.col("flat")
    rows = _latest(_made(analysed, "TABLE", "FOREIGN TABLE", "VIEW", "MATERIALIZED VIEW"), "name")
    secured = states.where("part = 'SECURITY'").groupBy(F.col("key").alias("name")).agg(F.bool_or(F.col("text").rlike("^ENABLE")).alias("on"), F.bool_or(F.col("text").rlike("^FORCE")).alias("forced"))
    kind = (
        F.when(F.col("object_type") != "TABLE", F.regexp_replace(F.lower("object_type"), "foreign table", "foreign"))
        .when(flat.rlike("(?i) PARTITION BY "), "partitioned").when(flat.rlike("(?i)^CREATE UNLOGGED "), "unlogged").otherwise("table")
    )
    off = F.lit(False)
    return rows.join(secured, "name", "left").select(*_placed(F.col("name")), kind.alias("kind"), F.coalesce("on", off).alias("row_security"), F.coalesce("forced", off).alias("forced"))


def owner_rows(analysed: DataFrame) -> DataFrame:
    """kind, object, owner of what an ALTER gave an owner, the last one."""
    flat = statements.flat(F.col("sql"))
    rows = analysed.where("operation = 'ALTER'").select("seq", "idx", F.lower("object_type").alias("kind"), columns.folded_name(F.col("object_name")).alias("object"), columns.folded_name(_found(flat, rf" OWNER TO {NAME}")).alias("owner"))
    return _latest(rows.where("owner is not null and object is not null"), "kind", "object").select("kind", "object", "owner")


def grant_rows(analysed: DataFrame) -> DataFrame:
    """object, kind, col, privilege, grantee, grantor, grantable of what is held in the end."""
    return privileges.held_in_the_end(graph.cut(compact.right_changes(analysed).withColumn("at", changelog.order())))


def comment_rows(analysed: DataFrame) -> DataFrame:
    """kind, object, comment: the last one on each object, none where that is NULL."""
    said = rf"^COMMENT ON (.*?) ({NAME}(?: ?\([^)]*\))?(?: ON {NAME})?) IS (NULL|E?'.*')$"
    flat = statements.flat(F.col("sql"))
    text = _found(F.trim(F.col("sql")), r"\sIS\s+E?'(.*)'\s*$")
    rows = analysed.where("operation = 'COMMENT'").select("seq", "idx", F.lower(_found(flat, said)).alias("kind"), columns.folded_name(_found(flat, said, 2)).alias("object"), F.replace(text, F.lit("''"), F.lit("'")).alias("comment"))
    return _latest(rows.where("object is not null"), "kind", "object").where("comment is not null").select("kind", "object", "comment")


class Catalog:
    """The relations of analysed(seq, idx, sql, operation, object_type, object_name), the statements of a final state in order, by
    name: catalog["views"]. Each is planned when it is asked for, and what several need is worked out once. Empty statements
    give empty relations; nulls and statements without a name give no rows."""

    MADE_BY = {
        "extensions": lambda c: extension_rows(c.analysed), "relations": lambda c: relation_rows(c.analysed, c.states), "columns": lambda c: c.columns,
        "constraints": lambda c: c.constraints, "indexes": lambda c: index_rows(c.analysed, c.constraints), "views": lambda c: view_rows(c.analysed),
        "routines": lambda c: routine_rows(c.analysed), "triggers": lambda c: trigger_rows(c.analysed), "policies": lambda c: policy_rows(c.analysed),
        "sequences": lambda c: sequence_rows(c.analysed, c.columns), "types": lambda c: type_rows(c.analysed), "owners": lambda c: owner_rows(c.analysed),
        "grants": lambda c: grant_rows(c.analysed), "comments": lambda c: comment_rows(c.analysed),
    }

    def __init__(self, analysed: DataFrame):
        self.analysed = analysed

    def __getitem__(self, name: str) -> DataFrame:
        return self.MADE_BY[name](self)

    @cached_property
    def states(self) -> DataFrame:
        return graph.cut(columns.table_states(columns.column_operations(self.analysed)))

    @cached_property
    def constraints(self) -> DataFrame:
        return graph.cut(constraint_rows(self.states))

    @cached_property
    def columns(self) -> DataFrame:
        own = column_rows(self.states)
        # a primary key of the table makes its columns NOT NULL, too
        keyed = self.constraints.where("kind = 'p'").select("schema", "table", F.explode("columns").alias("name"), F.lit(True).alias("keyed")).distinct()
        both = own.join(keyed, ["schema", "table", "name"], "left")
        return graph.cut(both.withColumn("not_null", F.col("not_null") | F.coalesce("keyed", F.lit(False))).select(own.columns))


def relations(scripts: DataFrame) -> Catalog:
    """The catalog of scripts(seq, content) that only make and change things, each object once."""
    return Catalog(graph.cut(statements.told(statements.split(scripts, "seq"), "operation", "object_type", "object_name")))


def of_history(scripts: DataFrame) -> Catalog:
    """The catalog that a history of scripts(seq, content) leaves."""
    return relations(compact.compact(scripts).select(F.col("position").cast("long").alias("seq"), F.col("sql").alias("content")))


#: The lines of a signature: kind, relation, what identifies a row, what defines it. policy_role has a line for each role.
LINES = (
    ("extension", "extensions", ["name"], ["schema", "version"]),
    ("relation", "relations", ["schema", "name"], ["kind", "row_security", "forced"]),
    ("column", "columns", ["schema", "table", "name"], ["place", "type", "not_null", "default", "generated", "identity"]),
    ("constraint", "constraints", ["schema", "table", "name"], ["kind", "definition"]),
    ("index", "indexes", ["schema", "table", "name"], ["unique", "method", "columns", "predicate"]),
    ("view", "views", ["schema", "name"], ["materialized", "definition"]),
    ("function", "routines", ["schema", "name", "arguments"], ["kind", "returns", "language", "volatility", "security_definer", "body"]),
    ("trigger", "triggers", ["schema", "table", "name"], ["timing", "events", "level", "routine", "condition"]),
    ("policy", "policies", ["schema", "table", "name"], ["permissive", "command", "using", "check"]),
    ("policy_role", "policies", ["schema", "table", "name", "role"], []),
    ("sequence", "sequences", ["schema", "name"], ["type", "start", "increment", "minimum", "maximum", "cycles", "owned_by"]),
    ("type", "types", ["schema", "name"], ["kind", "members"]),
    ("ownership", "owners", ["kind", "object"], ["owner"]),
    ("grant", "grants", ["object", "kind", "col", "privilege", "grantee", "grantor"], ["grantable"]),
    ("comment", "comments", ["kind", "object"], ["comment"]),
)


def signature_lines(catalog: Catalog) -> DataFrame:
    """line of each row of a catalog: kind|what identifies it|sha256: of what defines it. Fifteen kinds; nulls are empty."""

    def text(df: DataFrame, name: str) -> Column:
        own = F.array_join(name, ",") if df.schema[name].dataType.typeName() == "array" else F.col(name).cast("string")
        return F.coalesce(own, F.lit(""))

    def lines(kind: str, relation: str, by: list[str], defined: list[str]) -> DataFrame:
        df = catalog[relation].withColumn("role", F.explode("roles")) if "role" in by else catalog[relation]
        definition = F.concat_ws("|", *[text(df, c) for c in defined]) if defined else F.lit("")
        return df.select(signature.signature_line(kind, F.concat_ws(".", *[text(df, c) for c in by]), definition).alias("line"))

    return reduce(DataFrame.unionByName, [lines(*x) for x in LINES])


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """kind, identifier, status of what differs in signature lines(line) of two catalogs: changed, left_only or right_only."""
    parts = lambda df, n: df.select(F.split_part("line", F.lit("|"), F.lit(1)).alias("kind"), F.regexp_extract("line", r"(?s)^[^|]*\|(.*)\|sha256:\w+$", 1).alias("identifier"), F.regexp_extract("line", r"sha256:\w+$", 0).alias(n))
    both = parts(left, "l").join(parts(right, "r"), ["kind", "identifier"], "full")
    status = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(F.col("l") != F.col("r"), "changed")
    return both.select("kind", "identifier", status.alias("status")).where("status is not null")


def contents(catalog: Catalog) -> DataFrame:
    """schema, kind, n of what each schema holds; a schema without rows is empty."""
    own = {"relations": F.col("kind"), "routines": F.col("kind"), "sequences": F.lit("sequence"), "types": F.lit("type"), "extensions": F.lit("extension")}
    return reduce(DataFrame.unionByName, [catalog[r].select("schema", k.alias("kind")) for r, k in own.items()]).groupBy("schema", "kind").agg(F.count("*").alias("n"))


def constraint_summary(catalog: Catalog) -> DataFrame:
    """schema, table, names, n_keys, n_references, refers_to of each table with constraints; lists are sorted."""
    refers = F.when(F.col("kind") == "f", F.col("target"))
    return catalog["constraints"].groupBy("schema", "table").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count_if(F.col("kind").isin("p", "u")).alias("n_keys"),
        F.count_if(F.col("kind") == "f").alias("n_references"), F.array_join(F.array_sort(F.collect_set(refers)), ",").alias("refers_to"),
    )


def unindexed_references(catalog: Catalog) -> DataFrame:
    """schema, table, name of references whose first column begins no index of their table, so that a change of the target reads
    all of it."""
    first = F.get("columns", F.lit(0))
    begun = catalog["indexes"].where("predicate is null").select("schema", "table", first.alias("first")).distinct()
    return catalog["constraints"].where("kind = 'f'").withColumn("first", first).join(begun, ["schema", "table", "first"], "left_anti").select("schema", "table", "name")


def unguarded_policies(catalog: Catalog) -> DataFrame:
    """schema, table, name of policies on tables whose row security is off: they guard nothing."""
    on = catalog["relations"].where("row_security").select("schema", F.col("name").alias("table"))
    return catalog["policies"].join(on, ["schema", "table"], "left_anti").select("schema", "table", "name")
