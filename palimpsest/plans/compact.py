"""A history of scripts compacted to the scripts of its final state, and what goes with it.

compact() is the whole way: scripts, statements, histories of objects, final forms, order. Every step is a DataFrame; the
only loops are those of graph rounds and of chains of renames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import canonical_type, name_parts, written_name
from palimpsest.operators import changelog, columns, graph, lifetimes, metrics, privileges, relate, signature, statements

#: Phases of a build, in order.
PHASES = ("drops", "foundation", "structure", "references", "logic", "performance", "views", "security", "other", "data")
#: Phases whose objects may refer to each other.
LEVELLED = ("foundation", "structure", "logic", "performance", "views")
#: Kinds that share one space of names.
RELATIONS = ("TABLE", "VIEW", "MATERIALIZED VIEW", "FOREIGN TABLE", "SEQUENCE", "INDEX")
ROUTINES = ("FUNCTION", "PROCEDURE", "AGGREGATE")
#: Kinds whose names are their table's own.
OF_TABLES = ("POLICY", "TRIGGER", "RULE")


def _name(name: Column) -> Column:
    """Folded; a name in public is that without a schema."""
    return columns.folded_name(name)


def _of_table(name: Column, sql: Column) -> Column:
    """name ON table of a policy, trigger or rule."""
    flat = statements.flat(sql)
    to = F.regexp_extract(flat, rf"(?i)^CREATE (?:OR REPLACE )?RULE \S+ AS ON \w+ TO {statements.NAME}", 1)
    on = F.regexp_extract(flat, rf"(?i)\bON\s+(?:ONLY\s+)?{statements.NAME}", 1)
    return F.concat(name, F.lit(" ON "), _name(F.when(to != "", to).otherwise(on)))


def argument_types(listed: Column) -> Column:
    """The types of a routine's arguments, in their usual names: modes, names, defaults and results are left out."""

    def one(item: Column) -> Column:
        own = F.regexp_replace(item, r"(?is)\s*(?:\bDEFAULT\b|=).*$", "")
        own = F.regexp_replace(own, r"(?i)^\s*(?:IN|INOUT|VARIADIC)\s+", "")
        long_type = own.rlike(r"(?i)^(double precision|character varying|bit varying|(time|timestamp)(\s*\(\d+\))? with(out)? time zone)\b")
        named = own.rlike(r'(?s)^("[^"]+"|[\w$]+)\s+\S') & ~long_type
        kind = F.when(named, F.regexp_replace(own, r'(?s)^("[^"]+"|[\w$]+)\s+', "")).otherwise(own)
        return F.concat(canonical_type(kind), F.when(kind.rlike(r"\]\s*$"), "[]").otherwise(""))

    inputs = F.filter(statements.items(listed), lambda x: ~x.rlike(r"(?i)^\s*OUT\s"))
    return F.array_join(F.transform(inputs, one), ",")


def routine_names(sql: Column) -> Column:
    """name(types) of each routine that a CREATE, ALTER or DROP names; without the types where it gives none."""
    inside = lambda x: F.regexp_extract(x, rf"(?s)^{statements.NAME} ?\(({statements.balanced()})\)", 2)
    plain = lambda x: _name(F.regexp_extract(x, rf"^{statements.NAME}", 1))
    typed = lambda x: x.rlike(rf"^{statements.NAME} ?\(")

    def names(flat: Column) -> Column:
        rest = F.regexp_replace(flat, "(?i)" + statements.HEAD + " ", "")
        each = F.when(flat.rlike("(?i)^DROP "), statements.items(rest)).otherwise(F.array(rest))
        return F.transform(each, lambda x: F.when(typed(x), F.concat(plain(x), F.lit("("), argument_types(inside(x)), F.lit(")"))).otherwise(plain(x)))

    return statements.once(statements.flat(sql), names)


def objects(analysed: DataFrame) -> DataFrame:
    """A row for each object that a statement makes, changes or drops, with its key name::TYPE; a DROP of several objects
    has one for each, and overloads of a function are told apart by the types of their arguments. A DROP or ALTER of a
    function without types is about all that have the name. Statements without a name are left out."""
    kind = F.when(F.col("object_type") == "ENUM", "TYPE").otherwise(F.col("object_type"))
    names = F.when(F.col("operation") == "DROP", statements.dropped_names(F.col("sql")))
    names = F.transform(F.coalesce(F.when(F.size(names) > 0, names), F.array("object_name")), _name)
    names = F.when(kind.isin(*ROUTINES), routine_names(F.col("sql"))).when(kind.isin(*OF_TABLES), F.transform(names, lambda n: _of_table(n, F.col("sql")))).otherwise(names)
    each = analysed.where("operation in ('CREATE', 'ALTER', 'DROP') and object_name is not null and object_type != 'UNKNOWN'")
    each = each.withColumn("name", F.explode(names))
    keep = ["seq", "idx", "sql", F.col("operation").alias("op"), "category", "name", kind.alias("kind")]
    keep += [c for c in ("preserved",) if c in analysed.columns]
    rows = each.select(*keep)
    open_ = F.col("kind").isin(*ROUTINES) & ~F.col("name").contains("(")
    known = rows.where(F.col("kind").isin(*ROUTINES) & F.col("name").contains("(")).select("kind", F.col("name").alias("full"), F.split_part("name", F.lit("("), F.lit(1)).alias("name"))
    all_of = rows.where(open_).join(known.distinct(), ["kind", "name"], "left").withColumn("name", F.coalesce("full", "name"))
    return rows.where(~open_).unionByName(all_of.select(rows.columns)).withColumn("key", F.concat_ws("::", "name", "kind"))


def _space(kind: Column) -> Column:
    """The space of names that a kind belongs to."""
    return F.when(kind.isin(*RELATIONS), "RELATION").otherwise(kind)


RENAME = rf"(?i)^ALTER (?:{statements.KIND}) (?:IF EXISTS )?(?:ONLY )?{statements.NAME} RENAME TO {statements.NAME}$"


def renames(analysed: DataFrame) -> DataFrame:
    """seq, idx, space, old, new of the renames of objects that this history made before; names are folded, and a new one is
    in the schema of the old."""
    flat = statements.flat(F.col("sql"))
    old, plain = _name(F.regexp_extract(flat, RENAME, 2)), _name(F.regexp_extract(flat, RENAME, 3))
    schema = F.when(old.contains("."), F.regexp_replace(old, r"[^.]+$", "")).otherwise("")
    found = analysed.where((F.col("operation") == "ALTER") & flat.rlike(RENAME) & ~F.col("preserved"))
    moved = found.select("seq", "idx", _space(F.col("object_type")).alias("space"), old.alias("old"), F.concat(schema, plain).alias("new"))
    made = objects(analysed.where("operation = 'CREATE'")).select(_space(F.col("kind")).alias("space"), F.col("name").alias("made"), F.struct("seq", "idx").alias("made_at"))
    made = made.unionByName(moved.select("space", F.col("new").alias("made"), F.struct("seq", "idx").alias("made_at")))
    first = made.groupBy("space", "made").agg(F.min("made_at").alias("made_at"))
    own = moved.join(first, (moved["space"] == first["space"]) & (moved["old"] == first["made"]))
    return own.where(changelog.order() > F.col("made_at")).select("seq", "idx", moved["space"], "old", "new")


def with_last_names(analysed: DataFrame) -> DataFrame:
    """analysed with every name that a later statement changes replaced by the object's last name: that of the object itself,
    and those after FROM, JOIN, REFERENCES, ON and the like. The renames themselves go."""
    moves = graph.cut(renames(analysed))
    if moves.isEmpty():
        return analysed
    s = F.col("sql")
    head = F.when(F.col("object_name").isNotNull(), F.array(F.struct(_space(F.col("object_type")).alias("space"), F.col("object_name").alias("name"))))
    on = F.nullif(F.regexp_extract(statements.flat(s), rf"(?i)\b(?:ON|OWNED BY)\s+(?:ONLY\s+|TABLE\s+)?{statements.NAME}", 1), F.lit(""))
    relations = F.transform(F.concat("references", F.array_compact(F.array(on))), lambda n: F.struct(F.lit("RELATION").alias("space"), n.alias("name")))
    named = F.array_distinct(F.concat(F.coalesce(head, F.slice(relations, F.lit(1), F.lit(0))), relations))
    mentions = analysed.select("seq", "idx", F.explode(named).alias("m")).select("seq", "idx", "m.space", F.col("m.name").alias("written"), _name(F.col("m.name")).alias("name"))
    m = moves.select(F.col("space").alias("m_space"), "old", "new", F.struct("seq", "idx").alias("moved_at"))
    now = mentions.withColumn("since", changelog.order()).withColumn("last", F.col("name"))
    ids = ["seq", "idx", "space", "written", "name"]
    while True:  # one round for each step of the longest chain of renames
        step = now.join(m, (F.col("space") == F.col("m_space")) & (F.col("last") == F.col("old")) & (F.col("moved_at") > F.col("since")))
        step = graph.cut(step.groupBy(*ids).agg(F.min(F.struct("moved_at", "new")).alias("to")))
        if step.isEmpty():
            break
        now = now.join(step, ids, "left").select(*ids, F.coalesce("to.moved_at", "since").alias("since"), F.coalesce("to.new", "last").alias("last"))
        now = graph.cut(now)
    swaps = now.where("last != name").groupBy("seq", "idx").agg(F.collect_set(F.struct("written", written_name(F.col("last")).alias("last"))).alias("swaps"))
    words = r"(\b(?:FROM|JOIN|INTO|UPDATE|ONLY|REFERENCES|ON|COPY|TRUNCATE|OWNED BY|IF EXISTS|IF NOT EXISTS|" + "|".join(statements.KINDS) + r")\s+)"

    def swap(sql: Column, x: Column) -> Column:
        literal = F.regexp_replace(x["written"], r"([.$])", r"\\$1")
        return F.regexp_replace(sql, F.concat(F.lit("(?i)" + words), literal, F.lit(r"(?![\w$.])")), F.concat(F.lit("$1"), F.regexp_replace(x["last"], r"\$", r"\\\$")))

    gone = moves.select("seq", "idx")
    left = analysed.join(gone, ["seq", "idx"], "left_anti").join(swaps, ["seq", "idx"], "left")
    told = left.withColumn("sql", F.when(F.col("swaps").isNotNull(), F.aggregate("swaps", s, swap)).otherwise(s)).drop("swaps")
    return graph.cut(statements.analysed(told.select("seq", "idx", "sql")))


def enum_types(own: DataFrame) -> DataFrame:
    """key, sql of each enum: its CREATE with the values that later statements add, in the place that they name.

    A value after, or before, another is put next to it, values without an anchor come last. Values are placed in rounds:
    each round places those whose anchors are placed, so there are as many as the longest chain of anchors. A place is a
    path of numbers; the anchor's path is the beginning of the value's, and later statements stand nearer to their anchor.
    Operations up to the type's last DROP don't count.
    """
    value = r"'((?:[^']|'')*)'"
    drops = own.where("op = 'DROP'").groupBy("key").agg(F.max(changelog.order()).alias("dropped"))
    own = own.join(drops, "key", "left").where(F.col("dropped").isNull() | (changelog.order() > F.col("dropped"))).drop("dropped")
    made = own.where("op = 'CREATE'").select("key", F.posexplode(F.regexp_extract_all("sql", F.lit(value), F.lit(1))).alias("n", "value"))
    first = made.select("key", "value", F.array((F.col("n") + 1).cast("double"), F.lit(0.0)).alias("path"))
    added = own.where("op = 'ALTER'").select(
        "key",
        F.regexp_extract("sql", rf"(?is)ADD VALUE\s+(?:IF NOT EXISTS\s+)?{value}", 1).alias("value"),
        F.upper(F.regexp_extract("sql", rf"(?is)\b(BEFORE|AFTER)\s+{value}\s*$", 1)).alias("side"),
        F.regexp_extract("sql", rf"(?is)\b(?:BEFORE|AFTER)\s+{value}\s*$", 1).alias("anchor"),
        F.row_number().over(Window.partitionBy("key").orderBy("seq", "idx")).alias("n"),
    ).where("value != ''")
    plain = added.where("side = ''").select("key", "value", F.array(1e6 + F.col("n").cast("double"), F.lit(0.0)).alias("path"))
    # a value that is there already stays where it is
    once = lambda rows: rows.groupBy("key", "value").agg(F.min("path").alias("path"))
    one = graph.cut(once(first.unionByName(plain)))
    # of several statements that add a value, the first counts
    waiting = added.where("side != ''").groupBy("key", "value").agg(F.min_by(F.struct("side", "anchor", "n"), "n").alias("a")).select("key", "value", "a.*")
    waiting = graph.cut(waiting.join(one, ["key", "value"], "left_anti"))
    # a path ends in 0, the place of the value itself: before it lie negative numbers, after it positive ones
    step = F.when(F.col("side") == "AFTER", 1.0 / (F.col("n") + 1)).otherwise(-1.0 / (F.col("n") + 1))
    while not waiting.isEmpty():
        anchors = one.select("key", F.col("value").alias("anchor"), "path")
        path = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(step, F.lit(0.0)))
        placed = graph.cut(waiting.join(anchors, ["key", "anchor"]).select("key", "value", path.alias("path")))
        if placed.isEmpty():  # an anchor that no statement makes: its values come last, none is lost
            placed = graph.cut(waiting.select("key", "value", F.array(2e6 + F.col("n").cast("double"), F.lit(0.0)).alias("path")))
        one = graph.cut(one.unionByName(placed))
        waiting = graph.cut(waiting.join(placed, ["key", "value"], "left_anti"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda v: F.concat(F.lit("'"), v["value"], F.lit("'"))), ", ")
    return one.groupBy("key").agg(listed.alias("v")).select(
        "key", F.concat(F.lit("CREATE TYPE "), F.split_part("key", F.lit("::"), F.lit(1)), F.lit(" AS ENUM ("), F.col("v"), F.lit(")")).alias("sql")
    )


#: A GRANT or REVOKE: its privileges, objects, roles, and what follows.
RIGHTS = (
    r"(?is)^(GRANT|REVOKE)\s+(GRANT\s+OPTION\s+FOR\s+|ADMIN\s+OPTION\s+FOR\s+)?(.+?)\s+(?:ON\s+(.+?)\s+)?(?:TO|FROM)\s+(.+?)"
    r"(\s+WITH\s+(?:GRANT|ADMIN)\s+OPTION)?(?:\s+GRANTED\s+BY\s+(\S+))?(?:\s+(?:CASCADE|RESTRICT))?$"
)


def right_changes(analysed: DataFrame) -> DataFrame:
    """seq, idx, and the columns that privileges.holdings() reads, of the GRANTs and REVOKEs: a row for each object, column,
    privilege and role. A role that is granted is a right of kind ROLE on no object."""
    own = analysed.where("operation in ('GRANT', 'REVOKE')").select("seq", "idx", statements.flat(F.col("sql")).alias("p")).where(F.col("p").rlike(RIGHTS))
    part = lambda g: F.regexp_extract("p", RIGHTS, g)
    kinds = "|".join(sorted((*privileges.ALL_OF, "ALL [A-Z]+ IN SCHEMA"), key=len, reverse=True))
    named = own.select(
        "seq", "idx", F.upper(part(1)).alias("op"), ((part(2) != "") | (part(6) != "")).alias("option"), _name(part(7)).alias("grantor"),
        F.explode(statements.items(part(3))).alias("item"), F.regexp_extract(part(4), rf"(?i)^({kinds})\s", 1).alias("word"), part(4).alias("on"), part(5).alias("roles"),
    )
    bare = F.trim(F.substr("on", F.length("word") + 1))
    targets = F.when(F.col("on") == "", F.array(F.lit(""))).otherwise(statements.items(bare))
    each = named.withColumn("target", F.explode(targets)).withColumn("grantee", F.explode(statements.items(F.col("roles"))))
    columns_ = F.regexp_extract("item", r"(?s)\((.*)\)$", 1)
    each = each.withColumn("col", F.explode(F.when(columns_ == "", F.array(F.lit(""))).otherwise(statements.items(columns_))))
    wide = F.regexp_extract(F.upper("word"), "^ALL ([A-Z]+)S IN SCHEMA", 1)
    kind = F.when(F.col("on") == "", "ROLE").when(wide != "", wide).when(F.col("word") != "", F.upper("word")).otherwise("TABLE")
    # a table may be written with its kind or without
    word = F.when(F.upper("word") == "TABLE", "").otherwise(F.upper("word"))
    routine = F.concat(_name(F.regexp_extract("target", r"^[^(]+", 0)), F.regexp_extract("target", r"(?s)\(.*$", 0))
    target = F.when(kind.isin("FUNCTION", "PROCEDURE", "ROUTINE") & (wide == ""), routine).otherwise(_name(F.col("target")))
    privilege = F.upper(F.trim(F.regexp_replace("item", r"(?s)\s*\(.*$", "")))
    return each.select(
        "seq", "idx", "op", "option", "grantor", F.trim(F.concat_ws(" ", F.nullif(word, F.lit("")), F.nullif(target, F.lit("")))).alias("object"), kind.alias("kind"),
        F.when(F.col("col") == "", "").otherwise(_name(F.col("col"))).alias("col"), privilege.alias("privilege"), F.regexp_replace("grantee", "(?i)^GROUP ", "").alias("grantee"),
    )


def right_statements(changes: DataFrame) -> DataFrame:
    """key, sql of the GRANTs of what right_changes() leave, one for each object, grantee, grantor and option, and of the REVOKEs of
    what they take without having given it."""
    rows = graph.cut(changes.withColumn("at", changelog.order()))
    rights = privileges.held_in_the_end(rows).withColumn("verb", F.lit("GRANT"))
    taken = privileges.never_granted(rows).withColumn("grantable", F.lit(False)).withColumn("verb", F.lit("REVOKE"))
    cell = ["verb", "object", "kind", "grantee", "grantor", "grantable"]
    columned = rights.unionByName(taken).groupBy(*cell, "privilege").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    whole = F.array_contains("cols", "")
    text = F.when(whole, F.col("privilege")).otherwise(F.concat("privilege", F.lit(" ("), F.array_join(F.transform("cols", lambda c: written_name(c)), ", "), F.lit(")")))
    listed = columned.groupBy(*cell).agg(F.array_sort(F.collect_list(text)).alias("texts"))
    everything = privileges.all_of(F.col("kind"), F.lit(""))
    named = F.when((F.size("texts") == F.size(everything)) & (F.size("texts") > 1) & F.forall("texts", lambda x: F.array_contains(everything, x)), F.lit("ALL")).otherwise(F.array_join("texts", ", "))
    target = F.when(F.col("kind") == "TABLE", F.when(F.col("object").rlike("^ALL "), F.col("object")).otherwise(written_name(F.col("object")))).otherwise(F.col("object"))
    on = F.when(F.col("object") == "", "").otherwise(F.concat(F.lit(" ON "), target))
    option = F.when(F.col("grantable"), F.when(F.col("kind") == "ROLE", " WITH ADMIN OPTION").otherwise(" WITH GRANT OPTION")).otherwise("")
    by = F.when(F.col("grantor") == "", "").otherwise(F.concat(F.lit(" GRANTED BY "), written_name(F.col("grantor"))))
    to = F.when(F.col("verb") == "GRANT", " TO ").otherwise(" FROM ")
    return listed.select(F.concat_ws("::", "object", "grantee").alias("key"), F.concat("verb", F.lit(" "), named, on, to, "grantee", option, by).alias("sql"))


def grants(analysed: DataFrame) -> DataFrame:
    """key, sql of the rights that all GRANTs and REVOKEs of a history leave."""
    return right_statements(right_changes(analysed))


def mentioned(rows: DataFrame) -> DataFrame:
    """key, space, name, role of what each of rows(key, kind, sql, …) depends on, with the rows' other columns but sql: names of
    relations, routines, types and schemas, folded, whether there is such a thing or not.

    role says what goes if a DROP of it cascades: `whole` the object, `auto` the object with or without CASCADE, UNREFER, UNTYPE
    and UNDEFAULT a reference, a column, a default of the table; `order` nothing, though the object must be built after it.
    """
    s, kind = F.col("sql"), F.col("kind")
    none = F.array().cast("array<string>")
    flat = statements.flat(s)
    routine = kind.isin(*ROUTINES)
    # a body is text to the server, read when it is made if its language is SQL
    bodiless = F.when(routine, F.regexp_replace(s, rf"(?s){statements.body(1)}", "''")).otherwise(s)
    read = F.when(routine & ~flat.rlike(r"(?i)\bLANGUAGE '?sql\b"), bodiless).otherwise(s)
    one = lambda pattern: F.filter(F.array(F.regexp_extract(flat, pattern, 1)), lambda x: x != "")
    all_of = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    on = F.when(kind.isin("INDEX", *OF_TABLES), F.array(F.regexp_extract(F.col("key"), " ON (.*)::", 1), F.regexp_extract(flat, rf"(?i)\bON\s+(?:ONLY\s+)?{statements.NAME}", 1)))
    heirs = F.concat(one(rf"(?i)\bPARTITION OF {statements.NAME}"), F.flatten(F.transform(one(r"(?i)\bINHERITS ?\(([^()]*)\)"), lambda x: F.split(x, " ?, ?"))))
    owner = F.transform(one(rf"(?i)\bOWNED BY {statements.NAME}"), lambda x: F.regexp_replace(x, r'\.(?:"[^"]*"|[^."]+)$', ""))
    sequences = all_of(statements.uncommented(s), r"(?i)\bnextval\s*\(\s*'([^']+)'")
    refers = F.when(kind == "TABLE", all_of(flat, rf"(?i)\bREFERENCES {statements.NAME}"))
    table = kind == "TABLE"
    whole = F.when(table, "UNDEFAULT").when(routine, "order").otherwise("whole")
    tokens = F.array_distinct(all_of(F.regexp_replace(statements.uncommented(bodiless), rf"(?s)({statements.QUOTED_NAME})|{statements.STRING}", "$1"), rf"(?<![\w$.]){statements.NAME}"))
    schema = F.filter(F.array(F.regexp_extract(F.col("key"), r"^([^.(]+)\.", 1)), lambda x: x != "")
    label = lambda names, space, role: F.transform(
        F.coalesce(names, none), lambda n: F.struct(F.lit(space).alias("space"), n.alias("name"), (role if isinstance(role, Column) else F.lit(role)).alias("role"))
    )
    found = F.concat(
        label(F.when(on.isNotNull(), F.filter(on, lambda x: x != "")), "RELATION", "auto"),
        label(heirs, "RELATION", "whole"), label(owner, "RELATION", "auto"), label(refers, "RELATION", "UNREFER"),
        label(sequences, "RELATION", whole), label(F.when(~table, statements.references(read)), "RELATION", F.when(routine, "order").otherwise("whole")),
        label(statements.called_functions(read), "ROUTINE", whole),
        label(F.when(kind.isin("TABLE", "TYPE", "DOMAIN", "VIEW", "MATERIALIZED VIEW", "INDEX", *ROUTINES), tokens), "TYPE", F.when(table, "UNTYPE").otherwise("whole")),
        label(schema, "SCHEMA", "whole"),
    )
    each = rows.select("*", F.explode(found).alias("m")).select(*[c for c in rows.columns if c != "sql"], "m.space", _name(F.col("m.name")).alias("name"), "m.role")
    return each.distinct()


def edges_of(rows: DataFrame, things: DataFrame) -> DataFrame:
    """src, dst, role, and the columns of rows(key, kind, sql, …) beside these, of each mention of one of things(key, kind)."""
    plain = F.split_part("key", F.lit("::"), F.lit(1))
    space = F.when(F.col("kind").isin(*RELATIONS), "RELATION").when(F.col("kind").isin(*ROUTINES), "ROUTINE").when(F.col("kind").isin("TYPE", "DOMAIN"), "TYPE").otherwise(F.col("kind"))
    targets = things.select(F.col("key").alias("dst"), space.alias("space"), F.when(F.col("kind").isin(*ROUTINES), F.split_part(plain, F.lit("("), F.lit(1))).otherwise(plain).alias("name"))
    met = mentioned(rows).join(targets.distinct(), ["space", "name"])
    return met.where("key != dst").select(F.col("key").alias("src"), *[c for c in rows.columns if c not in ("key", "kind", "sql")], "dst", "role").distinct()


def barriers(analysed: DataFrame, tables: DataFrame) -> DataFrame:
    """key, barrier of the tables(key, dropped) some of whose data a later change would break: the place of the first data statement
    that a column's DROP, RENAME or change of type, or a constraint, comes after.

    The history of such a table is compacted piece by piece: what comes before the barrier is folded into the CREATE, the data and
    the changes behind it follow in their order.
    """
    data = analysed.where("operation in ('INSERT', 'UPDATE', 'DELETE', 'TRUNCATE')").select(_name(F.col("object_name")).alias("key"), changelog.order().alias("put"))
    changes = columns.column_operations(analysed.where("operation = 'ALTER'")).where("op in ('DROP', 'RENAME', 'TYPE', 'ADD_CONSTRAINT', 'SET_NOT_NULL')")
    last = changes.groupBy("key").agg(F.max(changelog.order()).alias("last"))
    broken = data.join(last, "key").where("put < last").join(tables, "key").where("dropped is null or put > dropped")
    return broken.groupBy("key").agg(F.min("put").alias("barrier"))


def with_cascades(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own (see objects) with a DROP of its own for each object that a DROP of another takes along; and key, seq, idx, op, name of
    what goes from tables that stay: UNREFER, UNTYPE and UNDEFAULT of a name.

    DROP ... CASCADE takes what depends on the object at that moment, and so on; a DROP of a table its indexes, policies,
    triggers, rules and owned sequences in any case.
    """
    at = changelog.order()
    by_key = Window.partitionBy("key").orderBy("seq", "idx")
    made = own.where("op in ('CREATE', 'DROP')").withColumn("last", F.lag("op").over(by_key))
    # IF NOT EXISTS makes nothing where the object is there
    again = (F.col("op") == "CREATE") & F.col("sql").rlike(r"(?i)\bIF\s+NOT\s+EXISTS\b") & (F.coalesce("last", F.lit("")) == "CREATE")
    alive = graph.cut(lifetimes.lives(made.where(~again).select(F.col("key").alias("node"), at.alias("at"), "op")))
    rows = own.where("op in ('CREATE', 'ALTER')").select("key", "kind", "sql", at.alias("since"))
    each = graph.cut(edges_of(rows, own.select("key", "kind").distinct()))
    every = graph.cut(lifetimes.held(each, alive).join(each, ["src", "dst", "since"]))
    dropped = own.where("op = 'DROP'").select(F.col("key").alias("node"), at.alias("at"), F.upper("sql").rlike(r"\bCASCADE\s*$").alias("cascades"))
    taken = lifetimes.cascades(every.where("role in ('whole', 'auto')"), dropped.where("cascades"))
    auto = lifetimes.cascades(every.where("role = 'auto'"), dropped.select("node", "at").unionByName(taken.select("node", "at")))
    gone = graph.cut(taken.unionByName(auto).groupBy("node").agg(F.collect_set("at").alias("ats")).select(F.col("node").alias("key"), F.explode("ats").alias("gone_at")))
    about = own.groupBy("key", "name", "kind").agg(F.first("category").alias("category"))
    more = gone.join(about, "key").select(
        F.col("gone_at.seq").alias("seq"), F.col("gone_at.idx").alias("idx"), F.lit("").alias("sql"), F.lit("DROP").alias("op"), "category", "name", "kind",
        *([F.lit(False).alias("preserved")] if "preserved" in own.columns else []), "key",
    )
    ended = dropped.where("cascades").select("node", "at").unionByName(gone.select(F.col("key").alias("node"), F.col("gone_at").alias("at"))).distinct()
    parts = every.where("role in ('UNREFER', 'UNTYPE', 'UNDEFAULT')").join(ended.withColumnRenamed("node", "dst"), "dst")
    parts = parts.where((F.col("since") < F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    name = F.split_part("dst", F.lit("::"), F.lit(1))
    parts = parts.select(F.col("src").alias("key"), F.col("at.seq").alias("seq"), F.col("at.idx").alias("idx"), F.col("role").alias("op"), F.split_part(name, F.lit("("), F.lit(1)).alias("name")).distinct()
    return own.unionByName(more.select(own.columns)), parts


def object_states(own: DataFrame) -> DataFrame:
    """key, name, kind, category and what became of each object: first_op, last_op, dropped (the order of its last DROP),
    made (of the first CREATE after that), n_creates (after that), verbatim (a comment asks to keep a statement of it, or it
    is a table that no list of columns made)."""
    create = F.col("op") == "CREATE"
    drops = own.groupBy("key").agg(F.max(F.when(F.col("op") == "DROP", changelog.order())).alias("dropped"), F.min(F.when(create, changelog.order())).alias("first_made"))
    marked = own.join(drops, "key").withColumn("now", F.col("dropped").isNull() | (changelog.order() > F.col("dropped")))
    odd = create & (F.col("kind") == "TABLE") & ~columns.can_be_folded(F.col("sql"))
    lone = F.col("op").isin("DROP") & (F.col("first_made").isNull() | (changelog.order() < F.col("first_made")))
    return marked.groupBy("key", "name", "kind").agg(
        F.max_by("op", changelog.order()).alias("last_op"),
        F.max("dropped").alias("dropped"),
        F.min(F.when(F.col("now") & create, changelog.order())).alias("made"),
        F.max(F.when(F.col("now") & create, changelog.order())).alias("made_last"),
        F.max_by("category", F.when(create, changelog.order())).alias("made_category"),
        F.coalesce(F.bool_or(F.col("now") & (F.col("preserved") | odd)), F.lit(False)).alias("verbatim"),
        # a DROP of what the history did not make
        F.max_by("sql", F.when(lone, changelog.order())).alias("lone_drop"),
    )


def _step(seq: Column, idx: Column) -> Column:
    return F.struct(seq.cast("long").alias("seq"), idx.cast("long").alias("idx"))


def _at(phase: str | Column, key: Column | str, sql: Column | str, step: Column | None = None) -> list[Column]:
    """Columns of a statement of the result: its phase and key, its place among the statements of the key, its text."""
    first = _step(F.lit(0), F.lit(0))
    phase = F.lit(phase) if isinstance(phase, str) else phase
    key, sql = (F.col(x) if isinstance(x, str) else x for x in (key, sql))
    return [phase.alias("category"), key.alias("key"), (first if step is None else step).alias("step"), sql.alias("sql")]


def indexes_of_columns(rows: DataFrame, operations: DataFrame) -> DataFrame:
    """rows(key, kind, op, on_table, seq, idx, sql, …) less the indexes that name a column which their table dropped later,
    and with the later names of renamed columns in the others."""
    changes = operations.where("op in ('DROP', 'RENAME')").select(
        F.col("key").alias("on_table"), F.struct("seq", "idx", "sub").alias("changed_at"), "op", "column", F.when(F.col("op") == "RENAME", written_name(_name(F.col("arg")))).alias("new")
    )
    literal = F.regexp_replace("column", r"([.$])", r"\\$1")
    made = rows.where("kind = 'INDEX' and op = 'CREATE'").select("key", "seq", "idx", "on_table", "sql")
    later = made.join(changes.withColumnRenamed("op", "change"), "on_table").where(F.struct("seq", "idx") < F.struct("changed_at.seq", "changed_at.idx"))
    each = later.groupBy("key", "seq", "idx").agg(F.array_sort(F.collect_list(F.struct("changed_at", "change", literal.alias("old"), "new"))).alias("changes"))
    word = lambda c: F.concat(F.lit("(?i)(?<![\\w$.'])\"?"), c["old"], F.lit("\"?(?![\\w$.'(])"))

    def follow(state: Column, c: Column) -> Column:
        hit = F.regexp_like(state["tail"], word(c))
        return F.struct(
            F.when(c["change"] == "RENAME", F.regexp_replace(state["tail"], word(c), F.coalesce(c["new"], F.lit("")))).otherwise(state["tail"]).alias("tail"),
            (state["gone"] | ((c["change"] == "DROP") & hit)).alias("gone"),
        )

    both = rows.join(each, ["key", "seq", "idx"], "left")
    tail = F.regexp_extract("sql", rf"(?is)\bON\s+(?:ONLY\s+)?{statements.NAME}(.*)$", 2)
    start = F.struct(tail.alias("tail"), F.lit(False).alias("gone"))
    followed = both.withColumn("f", F.when(F.col("changes").isNotNull(), F.aggregate("changes", start, follow)))
    text = F.concat(F.substr("sql", F.lit(1), F.length("sql") - F.length(tail)), F.col("f.tail"))
    # an index goes with all that is about it
    gone = followed.where("f.gone").select("key").distinct()
    kept = followed.withColumn("sql", F.when(F.col("f").isNotNull(), text).otherwise(F.col("sql"))).drop("f", "changes")
    return kept.join(gone, "key", "left_anti")


def comments_of_columns(rows: DataFrame, operations: DataFrame) -> DataFrame:
    """rows(seq, idx, sql, object_type, object_name, c, …) less the comments on columns that their table c dropped later, and with the
    last names of renamed columns in the others."""
    changes = operations.where("op in ('DROP', 'RENAME')").select(
        F.col("key").alias("c"), F.struct(F.col("seq"), F.col("idx"), F.col("sub")).alias("at"), "op", F.col("column").alias("old"), F.when(F.col("op") == "RENAME", _name(F.col("arg"))).alias("new")
    )
    own = rows.where("operation = 'COMMENT' and object_type = 'COLUMN'").select("seq", "idx", "c", F.regexp_extract(_name(F.col("object_name")), r"[^.]+$", 0).alias("named"))
    later = own.join(changes, "c").where(F.struct("seq", "idx") < F.struct("at.seq", "at.idx"))
    each = later.groupBy("seq", "idx", "named").agg(F.array_sort(F.collect_list(F.struct("at", "op", "old", "new"))).alias("changes"))
    follow = lambda name, x: F.when(name == x["old"], x["new"]).otherwise(name)  # noqa: E731  a dropped column has no name
    last = each.select("seq", "idx", F.aggregate("changes", F.col("named"), follow).alias("last"), F.lit(True).alias("followed"))
    both = rows.join(last, ["seq", "idx"], "left").where("followed is null or last is not null")
    text = F.concat(F.lit("COMMENT ON COLUMN "), written_name(F.col("c")), F.lit("."), written_name(F.col("last")), F.regexp_extract("sql", r"(?is)\bON\s+COLUMN\s+\S+(\s.*)$", 1))
    return both.withColumn("sql", F.when(F.col("followed"), text).otherwise(F.col("sql"))).drop("last", "followed")


def compact(scripts: DataFrame) -> DataFrame:
    """position, category, key, sql: the statements that build the final state of scripts(seq, content), in order.

    Objects dropped in the end are gone, with what is built on dropped tables (indexes, policies, triggers) and the indexes
    on dropped columns. Tables are folded column by column; of other objects the last CREATE stays, with the ALTERs that
    follow the first; enums have the values added to them; grants are what is left of them. Names that change are the last
    ones throughout. References on a cycle become ALTERs after all tables. Data statements of tables that are still there
    stay, in order.

    What the history did not make is left to the statements about it: ALTERs stay verbatim, and a DROP comes first. An
    object stays as it is, with all its statements in order, if a comment of one asks for it (`ignore` or `no-merge`), or if
    no list of columns made the table. Statements that no pattern knows stay verbatim.
    """
    # what several steps read is checkpointed, so plans stay short
    analysed = with_last_names(graph.cut(statements.analysed(statements.split(scripts, "seq"))))
    own, parts_gone = with_cascades(graph.cut(objects(analysed)))
    own = graph.cut(own)
    states = graph.cut(object_states(own))
    dead = states.where("kind = 'TABLE' and last_op = 'DROP'").select(F.col("name").alias("on_table"))
    on_table = _name(F.regexp_extract(statements.flat(F.col("sql")), rf"(?i)\bON\s+(?:ONLY\s+)?{statements.NAME}", 1))
    on_table = F.when((F.col("op") == "CREATE") & F.col("kind").isin("INDEX", "POLICY", "TRIGGER", "RULE"), on_table)
    alive = own.join(states.where("last_op != 'DROP'").drop("name", "kind"), "key").withColumn("on_table", on_table)
    alive = alive.where(F.col("dropped").isNull() | (changelog.order() > F.col("dropped")))
    orphans = alive.where("on_table is not null").join(dead, "on_table", "left_semi").select("key").distinct()
    alive = graph.cut(alive.join(orphans, "key", "left_anti"))

    folded = states.where("kind = 'TABLE' and last_op != 'DROP' and made is not null and not verbatim").select(F.col("name").alias("key"), "dropped")
    folded = folded.join(graph.cut(barriers(analysed, folded)), "key", "left")
    gone = parts_gone.select(
        F.regexp_replace("key", "::TABLE$", "").alias("key"), "seq", "idx", F.lit(0).alias("sub"), F.lit(False).alias("starts"), F.lit(False).alias("conditional"),
        F.lit(None).cast("struct<before: string, after: string>").alias("beside"), "op", F.col("name").alias("column"), F.lit("").alias("arg"),
    )
    operations = columns.column_operations(analysed).unionByName(gone).join(folded, "key")
    operations = graph.cut(operations.where(F.col("dropped").isNull() | (changelog.order() > F.col("dropped"))).drop("dropped"))
    # what comes after data that later changes would break stays as it is, behind the data
    first_piece = operations.where(F.col("barrier").isNull() | (changelog.order() < F.col("barrier")))
    operations = operations.drop("barrier")
    tables = graph.cut(columns.table_states(first_piece.drop("barrier")))
    fks = columns.foreign_keys(tables)
    edges = fks.select(F.col("key").alias("src"), F.col("target").alias("dst")).join(folded.select(F.col("key").alias("dst")), "dst", "left_semi")
    cyclic = graph.cycle_edges(edges).select(F.col("src").alias("key"), F.col("dst").alias("target"))
    late = fks.join(cyclic, ["key", "target"], "left_semi").select("key", "place")

    made = columns.create_table(tables, late).select(*_at("structure", F.concat(F.col("key"), F.lit("::TABLE")), "sql"))
    deferred = columns.deferred_references(tables, late).select(*_at("references", F.concat_ws("::", "key", F.format_string("%06d", "place")), "sql"))
    altered = F.concat(F.lit("ALTER TABLE "), written_name(F.col("key")), F.lit(" "), F.col("text"))
    beside = tables.where("part in ('SECURITY', 'OTHER')").select(
        *_at(F.when(F.col("part") == "SECURITY", "security").otherwise("references"), F.concat_ws("::", "key", F.lit("0"), F.format_string("%06d", "place")), altered)
    )
    is_enum = F.col("sql").rlike(r"(?is)^\s*CREATE\s+TYPE\s+\S+\s+AS\s+ENUM\b") & (F.col("kind") == "TYPE")
    enum_keys = alive.where(is_enum & (F.col("op") == "CREATE") & ~F.col("verbatim")).select("key").distinct()
    enums = enum_types(own.join(enum_keys, "key", "left_semi")).select(*_at("foundation", "key", "sql"))
    adds_value = F.col("sql").rlike(r"(?is)\bADD\s+VALUE\b") & (F.col("op") == "ALTER")
    is_table = F.col("kind") == "TABLE"

    rest = alive.join(enum_keys.withColumn("enum", F.lit(True)), "key", "left")
    rest = rest.where(~(F.coalesce("enum", F.lit(False)) & ((F.col("op") == "CREATE") | adds_value)))
    at = changelog.order()
    whole = F.col("verbatim") | F.col("made").isNull()
    latest = (F.col("op") == "CREATE") & (at == F.col("made_last"))
    rest = rest.join(folded.where("barrier is not null").select(F.concat("key", F.lit("::TABLE")).alias("key"), "barrier"), "key", "left")
    behind = F.coalesce((F.col("op") == "ALTER") & (at > F.col("barrier")), F.lit(False))
    rest = rest.where(F.when(whole | behind, True).otherwise(~is_table & (latest | ((F.col("op") == "ALTER") & (at > F.col("made"))))))
    rest = indexes_of_columns(rest, operations)
    phase = F.when(behind, "structure").when(is_table & (F.col("op") == "ALTER"), "references").otherwise(F.coalesce("made_category", "category"))
    # a statement that a comment asks to keep keeps the comment
    verbatim = F.when(F.col("preserved"), F.trim("sql")).otherwise(columns.plain(F.col("sql")))
    rest = rest.select(*_at(phase, "key", verbatim, _step(F.col("seq"), F.col("idx")))).distinct()
    lone = states.where("lone_drop is not null")
    of_table = F.array_join(F.transform(F.split("name", " ON "), written_name), " ON ")
    target = F.when(F.col("kind").isin(*ROUTINES), F.col("name")).when(F.col("kind").isin(*OF_TABLES), of_table).otherwise(written_name(F.col("name")))
    cascade = F.when(F.upper("lone_drop").rlike(r"\bCASCADE\s*$"), " CASCADE").otherwise("")
    lone = lone.select(*_at("drops", "key", F.concat(F.lit("DROP "), F.col("kind"), F.when(F.upper("lone_drop").contains("IF EXISTS"), " IF EXISTS ").otherwise(" "), target, cascade)))

    ordered_key = F.format_string("%018d:%09d", F.col("seq").cast("long"), F.col("idx").cast("long"))
    data = analysed.where("operation in ('INSERT', 'UPDATE', 'DELETE', 'TRUNCATE')").withColumn("t", _name(F.col("object_name")))
    data = data.join(dead.select(F.col("on_table").alias("t")), "t", "left_anti").join(folded.withColumnRenamed("key", "t"), "t", "left")
    data = data.where(F.col("dropped").isNull() | (at > F.col("dropped")))
    # data of a table with a barrier stand among its statements, those of others come last
    among = F.col("barrier").isNotNull()
    data = data.select(*_at(F.when(among, "structure").otherwise("data"), F.when(among, F.concat("t", F.lit("::TABLE"))).otherwise(ordered_key), verbatim, F.when(among, _step(F.col("seq"), F.col("idx"))).otherwise(_step(F.lit(0), F.lit(0)))))
    known = F.col("operation").isin("INSERT", "UPDATE", "DELETE", "TRUNCATE") | (
        F.col("operation").isin("CREATE", "ALTER", "DROP") & F.col("object_name").isNotNull() & (F.col("object_type") != "UNKNOWN")
    )
    kept = F.col("preserved") & F.col("operation").isin("GRANT", "REVOKE")
    known |= F.col("operation").isin("GRANT", "REVOKE") & ~F.col("preserved")
    dropped = dead.select(F.col("on_table").alias("c"))
    other = analysed.where(~known & ~(F.col("class") == "read_only"))
    about = F.when((F.col("operation") == "COMMENT") & F.col("object_type").isin("TABLE", "COLUMN"), _name(F.col("object_name")))
    about = F.when(F.col("object_type") == "COLUMN", F.regexp_replace(about, r"\.[^.]+$", "")).otherwise(about)
    other = comments_of_columns(other.withColumn("c", about).join(dropped, "c", "left_anti"), operations).select(*_at(F.when(kept, "security").otherwise("other"), ordered_key, verbatim))
    # rights go with their object, and a new one of the name has none of them
    rights = right_changes(analysed.where("not preserved"))
    named = F.when(F.col("kind").isin(*ROUTINES), F.regexp_replace("object", r"^\w+ ", "")).otherwise(F.element_at(F.split("object", " "), -1))
    ends = states.where("dropped is not null").select(F.col("name").alias("n"), F.when(F.col("kind").isin(*RELATIONS), "TABLE").otherwise(F.col("kind")).alias("k"), F.col("dropped").alias("gone_at"))
    ends = ends.groupBy("n", "k").agg(F.max("gone_at").alias("gone_at"))
    left = rights.withColumn("n", named).withColumn("k", F.when(F.col("kind") == "SEQUENCE", "TABLE").otherwise(F.col("kind"))).join(ends, ["n", "k"], "left")
    left = left.where(F.col("gone_at").isNull() | (changelog.order() > F.col("gone_at"))).drop("n", "k", "gone_at")
    given = right_statements(left).select(*_at("security", F.concat(F.lit("~"), F.col("key")), "sql"))
    return ordered(reduce(DataFrame.unionByName, [lone, made, deferred, beside, enums, rest, data, other, given]))


def ordered(final: DataFrame) -> DataFrame:
    """position, category, key, sql of final(category, key, step, sql): one order of all objects in which each comes after what it
    depends on. Phases break ties: what an object of an earlier phase needs is pulled forward into that phase, whose objects
    are in levels, then in the order of their own phases, keys and steps. Objects on a cycle come one after another.

    Rows are sorted by ranges, and numbered from the sizes of the ranges, so no task holds them all."""
    rows = graph.cut(final)
    phase = F.array_position(F.array(*map(F.lit, PHASES)), F.col("category"))
    kind = F.split_part("key", F.lit("::"), F.lit(2))
    named = graph.cut(rows.where(F.col("category").isin(*LEVELLED)).select("key", kind.alias("kind"), "sql", phase.alias("phase")))
    edges = edges_of(named.select("key", "kind", "sql"), named.select("key", "kind").distinct())
    place = graph.phased_order(named.select(F.col("key").alias("node"), "phase"), edges.select("src", "dst"))
    place = place.select(F.col("node").alias("key"), F.col("phase").alias("at_phase"), "level")
    placed = rows.join(place, "key", "left").withColumn("levelled", F.col("category").isin(*LEVELLED))
    first = F.when(F.col("levelled"), F.coalesce("at_phase", phase)).otherwise(phase)
    # what lies on a cycle has no level
    placed = placed.withColumn("level", F.when(F.col("levelled"), F.coalesce("level", F.lit(1 << 40))).otherwise(0)).withColumn("own", phase).withColumn("phase", first)
    by = ["phase", "level", "own", "key", "step", "sql"]
    spread = placed.repartitionByRange(*by).sortWithinPartitions(*by)
    marked = graph.cut(spread.select("category", "key", "sql", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    # a row for each range of rows
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return marked.join(offsets, "part").select((F.col("offset") + F.col("id") - F.col("first") + 1).cast("int").alias("position"), "category", "key", "sql")


def analyze(scripts: DataFrame, level: str = "standard") -> DataFrame:
    """The compaction plan of the objects of scripts, with the redundancy found."""
    told = graph.cut(statements.told(statements.split(scripts, "seq"), "operation", "object_type", "object_name", "category", "preserved"))
    own = objects(told).withColumn("attr", F.lit(None).cast("string")).withColumn("value", F.lit(0.0))
    # what follows each change is looked up once for both
    own = graph.cut(changelog.with_next(graph.cut(own)))
    plan = changelog.compaction_plan(own, level)
    return plan.join(changelog.redundancy(own, F.col("seq")), "key", "left")


def report(scripts: DataFrame, level: str = "standard") -> DataFrame:
    return metrics.reduction(analyze(scripts, level))


def lint(scripts: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """seq, idx, code, advice of the violations that no comment lets pass."""
    return statements.violations(statements.split(scripts, "seq"), "seq", "idx", rules=rules).where("not ignored").drop("ignored")


def catalog_lines(scripts: DataFrame) -> DataFrame:
    """line: a signature of each final object, so two histories can be compared."""
    final = compact(scripts).where("category != 'data'")
    kind = F.coalesce(F.nullif(F.split_part("key", F.lit("::"), F.lit(2)), F.lit("")), F.col("category"))
    digest = F.substring(F.sha2(F.encode(signature.normalized(F.col("sql")), "UTF-8"), 256), 1, 32)
    return final.select(F.concat_ws("|", F.lower(kind), F.split_part("key", F.lit("::"), F.lit(1)), F.concat(F.lit("sha256:"), digest)).alias("line"))


def equivalence(left: DataFrame, right: DataFrame, most: int = 250) -> DataFrame:
    """The differences of the final states of two histories; none if they are equivalent."""
    lines = (graph.cut(catalog_lines(scripts)) for scripts in (left, right))
    return relate.difference(*lines, ("left", "right"), most)
