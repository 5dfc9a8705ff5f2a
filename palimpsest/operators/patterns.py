"""More that patterns tell about statements: references to other schemas, dynamic code, positions, inverse statements,
publications, extensions, vendors. All are Column functions or DataFrame queries over statement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import name_parts
from palimpsest.operators.statements import NAME, balanced, bare, flat, items, object_name, object_type, once, operation

#: Objects of other schemas that scripts of hosted platforms refer to.
FOREIGN = ("storage.buckets", "storage.objects", "auth.jwt()", "auth.uid()", "auth.role()", "auth.users")


def foreign_references(sql: Column) -> Column:
    """The foreign objects named, in order of the list."""
    low = F.lower(sql)
    return F.array_compact(F.array(*[F.when(low.contains(x), F.lit(x)) for x in FOREIGN]))


def auth_pattern(sql: Column) -> Column:
    """By the first that holds: claims of a token, policies on storage, row security, session functions, none."""
    low = F.lower(sql)
    return (
        F.when(low.rlike(r"auth\.jwt\(\)|request\.jwt"), "jwt")
        .when(low.rlike(r"create\s+policy") & low.contains("storage.objects"), "storage_policy")
        .when(low.rlike(r"create\s+policy|row\s+level\s+security"), "row_security")
        .when(low.rlike(r"\bcurrent_setting\(|\bsession_user\b|\bcurrent_user\b|auth\.uid\(\)"), "session")
        .otherwise("none")
    )


def is_dynamic(sql: Column) -> Column:
    return F.lower(sql).rlike(r"\bexecute\s+(format\s*\(|concat\s*\(|')|\bforeach\b|\barray\[")


def block_statements(sql: Column) -> Column:
    """The DDL statements inside the body of a procedural block."""
    body = F.regexp_extract(sql, r"(?s)(\$[A-Za-z_]*\$)(.*)\1", 2)
    parts = F.transform(F.split(F.regexp_replace(body, r"(?is)\bBEGIN\b|\bEND\b\s*;?", ";"), ";"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(parts, lambda x: F.upper(x).rlike(r"^(CREATE|ALTER|DROP) "))


def nested_types(sql: Column) -> Column:
    """Names of enums that a block makes."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(rf"(?i)\bCREATE\s+TYPE\s+{NAME}\s+AS\s+ENUM"), F.lit(1)))


def line_of(content: Column, offset: Column) -> Column:
    """The line, counted from 1, of an offset counted from 0."""
    before = F.substr(content, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def comment_target(sql: Column) -> Column:
    """kind:name of what a COMMENT is about; of a column, table:name; empty for other statements."""
    kind = F.lower(F.regexp_extract(sql, r"(?i)^\s*COMMENT\s+ON\s+(\w+)", 1))
    name = F.regexp_extract(sql, rf"(?i)^\s*COMMENT\s+ON\s+\w+\s+{NAME}", 1)
    of_column = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.when(kind == "", "").when(kind == "column", F.concat(F.lit("table:"), of_column)).otherwise(F.concat_ws(":", kind, name))


def naming_warnings(statements: DataFrame, *keep: str) -> DataFrame:
    """keep columns and warning: names that are long, reserved, or lack the usual mark of their kind."""
    plain = F.element_at(name_parts(F.col("object_name")), -1)
    kind = F.col("object_type")
    found = F.array(
        F.when(F.length("object_name") > 63, F.lit("LONG_NAME")),
        F.when(plain.isin("user", "order", "table", "group", "select", "all"), F.lit("RESERVED_WORD")),
        F.when((kind == "INDEX") & ~plain.rlike(r"^(idx|ix|uq|pk)_|_(idx|key|pkey)$"), F.lit("INDEX_NAME")),
        F.when((kind == "FUNCTION") & (F.length(plain) < 3), F.lit("SHORT_FUNCTION_NAME")),
    )
    own = statements.where("object_name is not null and operation = 'CREATE'")
    return own.select(*keep, F.explode(F.array_compact(found)).alias("warning"))


#: Structural warnings: code, what must hold, what must not (of the bare statement).
STRUCTURE = (
    ("DATA_LOSS", r"^(DROP TABLE|DROP SCHEMA|TRUNCATE|DELETE FROM)\b|^ALTER TABLE\b.*\bDROP (COLUMN )?(?!CONSTRAINT|DEFAULT|NOT NULL|IDENTITY|EXPRESSION)", None),
    ("TYPE_CONVERSION", r"^ALTER TABLE\b.*\bALTER (COLUMN )?\S+ (SET DATA )?TYPE\b", None),
    ("UNIQUE_INDEX", r"^CREATE UNIQUE INDEX\b", None),
    ("BLOCKING_INDEX", r"^CREATE (UNIQUE )?INDEX\b", r"\bCONCURRENTLY\b"),
    ("NOT_NULL_WITHOUT_DEFAULT", r"^ALTER TABLE\b.*\bADD (COLUMN )?.*\bNOT NULL\b", r"\bDEFAULT\b|\bGENERATED\b"),
    ("GENERATED_COLUMN", r"\bGENERATED ALWAYS AS ?\(", None),
    ("VECTOR_TYPE", r"\bVECTOR ?\(\d+\)", None),
)


def structural_warnings(statements: DataFrame, *keep: str) -> DataFrame:
    """keep columns and warning of each case of STRUCTURE that a statement is."""

    def found(b: Column) -> Column:
        hits = [b.rlike(p) & (~b.rlike(q) if q else F.lit(True)) for _, p, q in STRUCTURE]
        return F.array_compact(F.array(*[F.when(hit, F.lit(code)) for (code, *_), hit in zip(STRUCTURE, hits, strict=True)]))

    return statements.select(*keep, F.explode(once(bare(F.col("sql")), found)).alias("warning"))


def publication_targets(statements: DataFrame) -> DataFrame:
    """seq, idx, publication, table of the ALTER PUBLICATION … ADD TABLE statements that are the first of their kind."""
    pattern = rf"(?is)^\s*ALTER\s+PUBLICATION\s+{NAME}\s+ADD\s+TABLE\s+(?:ONLY\s+)?{NAME}"
    part = lambda g: F.array_join(name_parts(F.regexp_extract("sql", pattern, g)), ".")
    own = statements.where(F.col("sql").rlike(pattern)).select("seq", "idx", part(1).alias("publication"), part(2).alias("target"))
    full = F.when(F.col("target").contains("."), F.col("target")).otherwise(F.concat(F.lit("public."), F.col("target")))
    firsts = own.withColumn("target", full).groupBy("publication", "target").agg(F.min(F.struct("seq", "idx")).alias("at"))
    return firsts.select("at.seq", "at.idx", "publication", "target")


#: Extensions that others need: (extension, what it needs).
EXTENSION_NEEDS = (
    ("earthdistance", "cube"), ("postgis_raster", "postgis"), ("postgis_topology", "postgis"), ("postgis_sfcgal", "postgis"),
    ("postgis_tiger_geocoder", "postgis"), ("postgis_tiger_geocoder", "fuzzystrmatch"), ("address_standardizer_data_us", "address_standardizer"),
)
#: What tells that an extension is used: calls of its functions, and its own operators.
EXTENSION_SIGNS = (
    ("postgis", r"(?i)(?<![\w$])(st_[a-z0-9]+|postgis_version) ?\("),
    ("uuid-ossp", r"(?i)(?<![\w$])uuid_generate_v(1|1mc|3|4|5) ?\("),
    ("cube", r"(?i)(?<![\w$])cube(_(distance|dim|ll_coord|ur_coord|is_point|enlarge))? ?\("),
    ("earthdistance", r"(?i)(?<![\w$])(earth|earth_distance|earth_box|ll_to_earth) ?\("),
    ("pg_trgm", r"(?i)(?<![\w$])((strict_)?(word_)?similarity|show_trgm|show_limit|set_limit) ?\(|<<?%|%>>?"),
    ("pg_stat_statements", r"(?i)(?<![\w$])pg_stat_statements"),
    ("btree_gin", r"(?i)(?<![\w$])gin_(extract_value|extract_query|consistent)[a-z0-9_]* ?\("),
)


#: Extensions in the order in which they are made.
EXTENSION_ORDER = ("cube", "earthdistance", "postgis", "uuid-ossp", "pg_trgm", "pg_stat_statements", "btree_gin", "pgcrypto")


def extensions(statements: DataFrame) -> DataFrame:
    """name, place of the distinct extensions that statements make: those of EXTENSION_ORDER as there, then the others by
    name, what others need before them."""
    name = F.regexp_extract("sql", r'(?is)^\s*CREATE\s+EXTENSION\s+(?:IF\s+NOT\s+EXISTS\s+)?"?([\w-]+)"?', 1)
    own = statements.select(F.lower(name).alias("name")).where("name != ''").distinct()
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EXTENSION_ORDER)), F.col("name")), F.lit(0)), F.lit(999))
    needs = F.col("name").isin([x for x, _ in EXTENSION_NEEDS])
    # a script's extensions are few
    return own.select("name", F.row_number().over(Window.orderBy(rank, needs, "name")).alias("place"))


def used_extensions(statements: DataFrame) -> DataFrame:
    """name, made, used of the extensions that statements make or use, and of those that these need."""
    b = F.lower(bare(F.col("sql")))
    signs = F.array_compact(F.array(*[F.when(b.rlike(p), F.lit(x)) for x, p in EXTENSION_SIGNS]))
    name = F.lower(F.regexp_extract("sql", r'(?is)^\s*CREATE\s+EXTENSION\s+(?:IF\s+NOT\s+EXISTS\s+)?"?([\w-]+)"?', 1))
    named = statements.select(F.explode(F.concat(
        F.transform(signs, lambda x: F.struct(x.alias("name"), F.lit(False).alias("made"), F.lit(True).alias("used"))),
        F.filter(F.array(F.struct(name.alias("name"), F.lit(True).alias("made"), F.lit(False).alias("used"))), lambda x: x["name"] != ""),
    )).alias("x")).select("x.*")
    needs = F.create_map(*[F.lit(y) for x in sorted({x for x, _ in EXTENSION_NEEDS}) for y in (x, ",".join(n for e, n in EXTENSION_NEEDS if e == x))])
    wanted = F.split(F.coalesce(F.try_element_at(needs, F.col("name")), F.lit("")), ",")
    needed = named.select(F.explode(wanted).alias("name"), F.lit(False).alias("made"), F.lit(True).alias("used")).where("name != ''")
    return named.unionByName(needed).groupBy("name").agg(F.max("made").alias("made"), F.max("used").alias("used"))


#: What undoes an item of an ALTER TABLE: pattern, and the item that undoes it.
UNDONE = (
    (rf"^ADD CONSTRAINT {NAME}.*$", "DROP CONSTRAINT IF EXISTS $1"),
    (rf"^RENAME COLUMN {NAME} TO {NAME}$", "RENAME COLUMN $2 TO $1"),
    (rf"^RENAME CONSTRAINT {NAME} TO {NAME}$", "RENAME CONSTRAINT $2 TO $1"),
    (rf"^ADD (?:COLUMN )?(?:IF NOT EXISTS )?{NAME}\b.*$", "DROP COLUMN IF EXISTS $1"),
    (rf"^RENAME (?!TO\b){NAME} TO {NAME}$", "RENAME COLUMN $2 TO $1"),
    (rf"^ALTER (?:COLUMN )?{NAME} SET NOT NULL$", "ALTER COLUMN $1 DROP NOT NULL"),
    (rf"^ALTER (?:COLUMN )?{NAME} DROP NOT NULL$", "ALTER COLUMN $1 SET NOT NULL"),
    (rf"^ALTER (?:COLUMN )?{NAME} SET DEFAULT\b.*$", "ALTER COLUMN $1 DROP DEFAULT"),
    (r"^ENABLE ROW LEVEL SECURITY$", "DISABLE ROW LEVEL SECURITY"),
    (r"^DISABLE ROW LEVEL SECURITY$", "ENABLE ROW LEVEL SECURITY"),
    (r"^FORCE ROW LEVEL SECURITY$", "NO FORCE ROW LEVEL SECURITY"),
    (r"^NO FORCE ROW LEVEL SECURITY$", "FORCE ROW LEVEL SECURITY"),
)
#: Constraints without a name, which no text can drop.
UNNAMED = r"(?is)^ADD (?:PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE)\b"


def inverse(sql: Column) -> Column:
    """The statement that undoes one; null for those that need none, a comment where it can't be undone. Items of an ALTER
    TABLE are undone from the last to the first, all or none; of inserted rows a template to delete them is given. A CREATE that
    may have replaced or met what was there can't be undone. Policies, triggers and rules are dropped from their table,
    routines by their arguments."""
    kind, name, op = object_type(sql), object_name(sql), operation(sql)
    table = F.concat(F.lit("ALTER TABLE "), name)
    lost = F.concat(F.lit("-- can't be undone: "), flat(sql))
    conditional = bare(sql).rlike(r"^CREATE OR REPLACE\b|^CREATE [A-Z ]*\bIF NOT EXISTS\b")
    to = F.regexp_extract(flat(sql), rf"(?i)^CREATE RULE \S+ AS ON \w+ TO {NAME}", 1)
    on = F.concat(F.lit(" ON "), F.when(to != "", to).otherwise(F.regexp_extract(flat(sql), rf"(?i)\bON (?:ONLY )?{NAME}", 1)))
    listed = F.regexp_extract(flat(sql), rf"(?is)^CREATE (?:FUNCTION|PROCEDURE|AGGREGATE) {NAME} ?\(({balanced()})\)", 2)
    arguments = F.array_join(F.transform(items(listed), lambda x: F.regexp_replace(x, r"(?is)\s*(?:\bDEFAULT\b|=).*$", "")), ", ")
    after = F.when(kind.isin("POLICY", "TRIGGER", "RULE"), on).when(kind.isin("FUNCTION", "PROCEDURE", "AGGREGATE"), F.concat(F.lit("("), arguments, F.lit(")"))).otherwise("")
    dropped = F.concat(F.lit("DROP "), F.when(kind == "ENUM", "TYPE").otherwise(kind), F.lit(" IF EXISTS "), name, after)

    def undone(x: Column) -> Column:
        cases = [F.when(x.rlike("(?is)" + p), F.regexp_replace(x, "(?is)" + p, y)) for p, y in UNDONE]
        return F.when(~x.rlike(UNNAMED), F.coalesce(*cases))

    def altered(text: Column) -> Column:
        renamed = F.regexp_extract(text, rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{NAME} RENAME TO {NAME}$", 2)
        each = F.transform(items(F.regexp_replace(text, rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{NAME}(?: ?\*)? ", "")), undone)
        whole = F.when(~F.exists(each, lambda x: x.isNull()), F.concat(table, F.lit(" "), F.array_join(F.reverse(each), ", ")))
        return F.when(renamed != "", F.concat(F.lit("ALTER TABLE "), renamed, F.lit(" RENAME TO "), name)).otherwise(whole)

    return (
        F.when(op == "CREATE", F.when((kind == "UNKNOWN") | conditional, lost).otherwise(dropped))
        .when((op == "ALTER") & (kind == "TABLE"), F.coalesce(once(flat(sql), altered), lost))
        .when(op == "INSERT", F.concat(F.lit("-- DELETE FROM "), name, F.lit(" WHERE <the rows of this INSERT>")))
        .when(op.isin("GRANT", "REVOKE", "COMMENT", "SELECT"), F.lit(None).cast("string"))
        .otherwise(lost)
    )


def rollback(statements: DataFrame) -> DataFrame:
    """seq, idx, sql, seconds, checksum: what undoes statements(seq, idx, sql), to be run from the last to the first, with
    a rough duration: 1, and 2 more for DROP TABLE, 5 for ALTER TABLE, 10 for DELETE."""
    undo = statements.select("seq", "idx", inverse(F.col("sql")).alias("sql")).where("sql is not null")
    extra = F.when(F.col("sql").startswith("DROP TABLE"), 2).when(F.col("sql").startswith("ALTER TABLE"), 5).when(F.col("sql").startswith("DELETE"), 10)
    return undo.select("seq", "idx", "sql", (F.coalesce(extra, F.lit(0)) + 1).cast("long").alias("seconds"), F.sha2("sql", 256).alias("checksum"))


def volatility(body: Column) -> Column:
    """VOLATILE if a function's body changes or draws something, STABLE if it reads, else IMMUTABLE."""
    b = bare(body)
    return (
        F.when(b.rlike(r"\b(INSERT|UPDATE|DELETE|TRUNCATE|CREATE|ALTER|DROP|NEXTVAL|SETVAL|RANDOM|GEN_RANDOM_UUID|CLOCK_TIMESTAMP)\b"), "VOLATILE")
        .when(b.rlike(r"\b(CURRENT_SETTING|CURRENT_USER|SESSION_USER|NOW|CURRENT_TIMESTAMP|CURRENT_DATE|SELECT|FROM|PERFORM)\b"), "STABLE")
        .when(b != "", "IMMUTABLE")
        .otherwise("STABLE")
    )


def resolved(names: DataFrame, catalog: DataFrame, path: list[str]) -> DataFrame:
    """name, schema of names(name): the first schema of the path that has the object, null if none has; a two-part name is
    looked up in its own schema. catalog(schema, object)."""
    parts = name_parts(F.col("name"))
    own = names.select("name", F.element_at(parts, -1).alias("object"), F.when(F.size(parts) > 1, parts[0]).alias("given")).distinct()
    rank = F.nullif(F.array_position(F.array(*map(F.lit, path)), F.col("schema")), F.lit(0))
    found = own.join(catalog.select("schema", "object").distinct(), "object").withColumn("rank", F.when(F.col("given").isNull(), rank).when(F.col("given") == F.col("schema"), 1))
    best = found.where("rank is not null").groupBy("name").agg(F.min_by("schema", "rank").alias("schema"))
    return own.select("name").distinct().join(best, "name", "left")


def matches_glob(path: Column, glob: str) -> Column:
    """** passes over folders, * and ? stay within one."""
    marks = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, i = "", 0
    while i < len(glob):
        mark = next((m for m in marks if glob.startswith(m, i)), None)
        out += marks[mark] if mark else ("\\" if glob[i] in r".+()[]{}^$|\\" else "") + glob[i]
        i += len(mark or glob[i])
    return path.rlike(f"^{out}$")


#: Vendors with their priorities and those that they exclude.
VENDORS = (
    ("clerk", 95, ("supabase",)),
    ("supabase", 90, ()),
    ("prisma", 75, ("drizzle", "typeorm")),
    ("drizzle", 75, ("prisma", "typeorm")),
)
#: What the scripts of each vendor hold, by its documents: helpers and claims of its tokens; its schemas, functions and
#: publication; its table of migrations, comments and types; its table, comments and identity columns.
VENDOR_SIGNS = {
    "clerk": r"(?s)auth\.jwt\(\).*'o'\s*->>\s*'id'|(clerk_user_id|clerk_is_admin|clerk_organization_id|current_organization_id|current_organization_role)\(\)",
    "supabase": r"auth\.uid\(\)|auth\.users|storage\.(objects|buckets)|supabase_realtime|CREATE EXTENSION IF NOT EXISTS pgjwt|CREATE SCHEMA IF NOT EXISTS (storage|auth)\b",
    "prisma": r"(?i)_prisma_migrations|-- (?-i:CreateTable|CreateIndex|CreateEnum|AlterTable|AddForeignKey|DropTable)\b|default nextval\([^)]*_seq'::regclass\)|varchar\(191\)",
    "drizzle": r"(?i)__drizzle_migrations|-- (?-i:drizzle-kit|Drizzle)|generated (always|by default) as identity|--> statement-breakpoint",
}
#: A token's own claims, which alone may be another vendor's.
CLAIMS = r"(?s)auth\.jwt\(\).*->>\s*'(sub|email)'"
VENDOR_FILES = {"prisma": r"(?i)[0-9]{14}_[a-z_]+", "drizzle": r"(?i)drizzle/[0-9]{14}_|snapshot\.json"}


def vendor_signs(sql: Column, vendor: str) -> Column:
    """Whether a statement has signs of a vendor; a comment that there is no auth.uid() any more is none."""
    own = F.replace(sql, F.lit("No legacy auth.uid()"), F.lit(""))
    claims = own.rlike(CLAIMS) & ~own.rlike(r"auth\.uid\(\)|auth\.users|storage\.(objects|buckets)")
    return own.rlike(VENDOR_SIGNS[vendor]) | (claims if vendor == "clerk" else F.lit(False))


def vendors(statements: DataFrame) -> DataFrame:
    """vendor, priority of those of whom statements(sql, and filename if there is one) have signs, but for those that another
    of higher priority, or of the same and earlier by name order of the table, excludes."""
    named = "filename" in statements.columns

    def seen(v: str) -> Column:
        hit = vendor_signs(F.col("sql"), v)
        if named and v in VENDOR_FILES:
            hit |= F.coalesce(F.col("filename").rlike(VENDOR_FILES[v]), F.lit(False))
        return F.coalesce(F.bool_or(hit), F.lit(False)).alias(v)

    hits = statements.agg(*[seen(v) for v, *_ in VENDORS])
    rows = F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(n).alias("priority"), on.alias("on")) for (v, n, _), on in zip(VENDORS, _allowed(F.col), strict=True)])
    return hits.select(F.inline(rows)).where("on").select("vendor", "priority")


def _allowed(seen) -> list[Column]:
    """Of each vendor, whether it is seen and no one before it that is allowed excludes it."""
    allowed: list[Column] = []
    for v, *_ in VENDORS:
        before = [allowed[k] for k, (_, _, out) in enumerate(VENDORS[: len(allowed)]) if v in out]
        on = seen(v)
        for x in before:
            on = on & ~x
        allowed.append(on)
    return allowed


def exclusions(asked: DataFrame, *keep: str) -> DataFrame:
    """keep columns, vendor, priority, active, excluded_by of each vendor of asked(…, vendors): whether one that comes before it, and
    is active itself, excludes it. Names that are no vendors, and null lists, give no rows."""
    seen = lambda v: F.coalesce(F.array_contains("vendors", v), F.lit(False))
    allowed, rows = _allowed(seen), []
    for i, (v, priority, _) in enumerate(VENDORS):
        by = [F.when(allowed[k], F.lit(w)) for k, (w, _, out) in enumerate(VENDORS[:i]) if v in out]
        winner = F.coalesce(*by) if by else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(v).alias("vendor"), F.lit(priority).alias("priority"), allowed[i].alias("active"), winner.alias("excluded_by"), seen(v).alias("asked")))
    return asked.select(*keep, F.inline(F.array(*rows))).where("asked").drop("asked")


def compatibility(spark: SparkSession, names: list[str]) -> DataFrame:
    """vendor, priority, active, excluded_by of the vendors named; unknown ones are errors."""
    known = [v for v, *_ in VENDORS]
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown vendors {unknown}")
    rows, active = [], []
    for v, n, _ in VENDORS:
        if v in names:
            winner = next((w for w, _, out in VENDORS if w in active and v in out), None)
            active += [v] if winner is None else []
            rows.append((v, n, winner is None, winner))
    return spark.createDataFrame(rows, "vendor string, priority int, active boolean, excluded_by string")
