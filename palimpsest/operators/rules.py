"""Rules of compaction as rows, and tests that single rules make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import name_parts
from palimpsest.operators import changelog, columns, statements
from palimpsest.operators.statements import bare, flat

#: Names, categories, priorities and tags of the built-in rules.
RULES = (
    ("multiple_create_consolidation", "table_ops", 100, ("safe", "standard")),
    ("separate_alter", "table_ops", 95, ("safe", "standard", "execution-order")),
    ("create_alter_consolidation", "table_ops", 90, ("safe", "standard")),
    ("drop_create_cycle", "table_ops", 85, ("safe", "optimization")),
    ("function_deduplication", "function_ops", 80, ("safe", "deduplication")),
    ("publication_deduplication", "optimization", 80, ("safe", "replication")),
    ("enum_deduplication", "table_ops", 75, ("safe", "types")),
    ("column_evolution", "table_ops", 65, ("standard", "schema")),
    ("advanced_column_lifecycle", "table_ops", 60, ("standard", "schema", "column-evolution")),
    ("rls_consolidation", "security", 96, ("safe", "security", "rls")),
    ("do_block_enum_type", "table_ops", 55, ("safe", "types", "do_block")),
    ("external_dependency_filter", "optimization", 50, ("standard", "dependencies")),
    ("conditional_schema", "table_ops", 45, ("safe", "schema")),
    ("transaction_boundary", "optimization", 40, ("safe", "transactions")),
    ("error_recovery", "optimization", 30, ("safe", "recovery")),
)
SCHEMA = "name string, category string, priority int, provider string, tags array<string>, enabled boolean"


def rule_table(spark: SparkSession, more: tuple[tuple, ...] = (), disabled: tuple[str, ...] = ()) -> DataFrame:
    """name, category, priority, provider, tags, enabled of the built-in rules and of more(name, category, priority, tags,
    provider). A name that is there already, or a disabled one that is not, is an error."""
    rows = [(n, c, p, "core", list(t), n not in disabled) for n, c, p, t in RULES]
    rows += [(n, c, p, by, list(t), n not in disabled) for n, c, p, t, by in more]
    names = [r[0] for r in rows]
    if len(set(names)) < len(names) or set(disabled) - set(names):
        raise ValueError("a rule is registered twice, or a disabled one is unknown")
    return spark.createDataFrame(rows, SCHEMA)


def with_tag(rules: DataFrame, tag: str) -> DataFrame:
    return rules.where(F.array_contains("tags", tag))


def rule_counts(rules: DataFrame) -> DataFrame:
    """category, provider, n, n_enabled; totals of each and of all in rows with nulls, told apart by `level` (grouping_id)."""
    c = F.col
    return rules.groupingSets([[c("category")], [c("provider")], []], c("category"), c("provider")).agg(
        F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"), F.grouping_id().cast("long").alias("level")
    )


def rules_of(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """key, and the columns of rules, of each key of settings(key, disabled): what is in force for it. disabled is an array of names; a
    null one disables nothing. rules is a table of rules, a few rows."""
    off = F.coalesce(F.array_contains("disabled", F.col("name")), F.lit(False))
    return settings.join(F.broadcast(rules)).withColumn("enabled", F.col("enabled") & ~off).drop("disabled")


def counts_of(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """key, category, n, n_enabled of the rules in force for each key of settings."""
    return rules_of(settings, rules).groupBy("key", "category").agg(F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"))


#: What an ALTER TABLE holds that can't be part of a CREATE.
SEPARATE = (
    r"\b(NO )?FORCE ROW LEVEL SECURITY\b|\b(EN|DIS)ABLE ROW LEVEL SECURITY\b|\bALTER COLUMN\b|\bDROP COLUMN\b|\bRENAME COLUMN\b|"
    r"\bRENAME TO\b|\bOWNER TO\b|\bSET SCHEMA\b|\b(DROP|VALIDATE|ALTER) CONSTRAINT\b|\b(NO )?INHERIT\b|\b(RE)?SET \("
)


def must_be_separate(sql: Column) -> Column:
    """Whether an ALTER can't be merged into the CREATE before it."""
    return bare(sql).rlike(SEPARATE)


def separated(log: DataFrame) -> DataFrame:
    """key, n_creates, n_merged, n_separate of a log(key, op, value) of CREATEs and ALTERs: how many ALTERs a CREATE can take
    in, and how many stay statements of their own."""
    alter = F.col("op") == "ALTER"
    apart = must_be_separate(F.col("value"))
    return log.groupBy("key").agg(
        F.count_if(F.col("op") == "CREATE").alias("n_creates"), F.count_if(alter & ~apart).alias("n_merged"), F.count_if(alter & apart).alias("n_separate")
    )


#: Statements that a compaction must not have made.
DANGEROUS = r"\bDROP DATABASE\b|\bDROP SCHEMA\b|\bTRUNCATE\b"


def checked_result(sql: Column) -> Column:
    """struct(sql, error): with a semicolon at its end; error is EMPTY or DANGEROUS, else null."""
    own = F.trim(sql)
    error = F.when(F.coalesce(own, F.lit("")) == "", "EMPTY").when(bare(own).rlike(DANGEROUS), "DANGEROUS")
    return F.struct(F.when(own.endswith(";") | (own == ""), own).otherwise(F.concat(own, F.lit(";"))).alias("sql"), error.alias("error"))


def can_be_compacted(log: DataFrame) -> DataFrame:
    """key, ok of a log(key, seq, idx, op): no data operation but as the last change, and no DROP."""
    last = log.groupBy("key").agg(F.max(changelog.order()).alias("last"), F.max(F.when(F.col("op") == "INSERT", changelog.order())).alias("n"), F.min(F.when(F.col("op") == "INSERT", changelog.order())).alias("data"), F.count_if(F.col("op") == "DROP").alias("drops"))
    early = F.coalesce(F.col("data") < F.col("last"), F.lit(False))
    return last.select("key", (~early & (F.col("drops") == 0)).alias("ok"))


def same_policy_logic(policies: DataFrame, by: str) -> DataFrame:
    """by, n, same of policies(by, sql): whether all USING texts are equal, and all WITH CHECK texts, where there are any."""
    inside = lambda word: F.nullif(F.trim(F.regexp_extract(flat(F.col("sql")), rf"(?is)\b{word} ?\(({statements.balanced()})\)", 1)), F.lit(""))
    own = policies.select(by, inside("USING").alias("u"), inside("WITH CHECK").alias("c"))
    return own.groupBy(by).agg(F.count("*").alias("n"), ((F.count_distinct("u") <= 1) & (F.count_distinct("c") <= 1)).alias("same"))


def function_name(sql: Column) -> Column:
    """The name, without its schema and quotes, of the function that a statement makes; null for others."""
    found = F.nullif(F.regexp_extract(flat(sql), rf"(?i)^CREATE (?:OR REPLACE )?FUNCTION {statements.NAME}", 1), F.lit(""))
    return F.when(found.isNotNull(), F.element_at(name_parts(found), -1))


def same_function(rows: DataFrame, by: str) -> DataFrame:
    """by, same of rows(by, sql): whether two or more statements make functions of one name, whatever their arguments."""
    own = rows.select(by, function_name(F.col("sql")).alias("f"))
    return own.groupBy(by).agg(((F.count("*") >= 2) & (F.count_distinct("f") == 1) & (F.count("f") == F.count("*"))).alias("same"))


def without_external(dependencies: DataFrame, external: list[str]) -> DataFrame:
    """dependencies(dependency, …) whose schema is none of the external ones."""
    plain = F.regexp_replace("dependency", "^[a-z]+:", "")
    schema = F.when(plain.contains("."), F.lower(F.substring_index(plain, ".", 1)))
    return dependencies.where(F.coalesce(~schema.isin([x.lower() for x in external]), F.lit(True)))


def applied_alters(made: DataFrame, alters: DataFrame) -> DataFrame:
    """id, applied of alters(id, seq, idx, sql): whether the CREATE TABLEs made(seq, idx, sql) already have what each ALTER
    TABLE does: added columns and named constraints are there, dropped ones are not. Other changes are never applied, nor
    those of tables that are not made here."""
    there = columns.column_operations(statements.analysed(made)).where("op in ('ADD', 'ADD_CONSTRAINT') and column != ''")
    own = there.select("key", F.when(F.col("op") == "ADD", "COLUMN").otherwise("CONSTRAINT").alias("what"), F.col("column").alias("name")).distinct().withColumn("there", F.lit(True))
    tables = there.select("key").distinct().withColumn("known", F.lit(True))
    done = columns.column_operations(statements.analysed(alters.select("id", "seq", "idx", "sql")))
    what = F.when(F.col("op").isin("ADD", "DROP"), "COLUMN").when(F.col("op").isin("ADD_CONSTRAINT", "DROP_CONSTRAINT"), "CONSTRAINT")
    asked = done.select("seq", "idx", "key", what.alias("what"), F.col("column").alias("name"), F.col("op").startswith("ADD").alias("adds"))
    met = asked.join(own, ["key", "what", "name"], "left").join(tables, "key", "left")
    ok = F.col("known") & F.col("what").isNotNull() & (F.col("name") != "") & (F.col("adds") == F.coalesce("there", F.lit(False)))
    each = met.groupBy("seq", "idx").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("applied"))
    return alters.select("id", "seq", "idx").join(each, ["seq", "idx"], "left").select("id", F.coalesce("applied", F.lit(False)).alias("applied"))


def without_lost_functions(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """rows(sql, …) without statements about functions that alive(name) lacks: GRANTs, REVOKEs, COMMENTs and ALTERs of a
    function, and triggers that run one."""
    s = flat(F.col("sql"))
    about = [rf"(?i)^(?:GRANT|REVOKE) .*? ON (?:FUNCTION|PROCEDURE) {statements.NAME}", rf"(?i)^COMMENT ON FUNCTION {statements.NAME}", rf"(?i)^ALTER FUNCTION {statements.NAME}", rf"(?i)\bEXECUTE (?:FUNCTION|PROCEDURE) {statements.NAME}"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in about])
    plain = F.when(found.isNotNull(), F.element_at(name_parts(found), -1))
    known = alive.select(F.element_at(name_parts(F.col("name")), -1).alias("__f")).distinct().withColumn("__there", F.lit(True))
    marked = rows.withColumn("__f", plain).join(known, "__f", "left")
    return marked.where(F.col("__f").isNull() | F.col("__there")).drop("__f", "__there")


def likely_renames(gone: DataFrame, final: DataFrame) -> DataFrame:
    """key, old, new: for each column of gone(key, name) the column of final(key, name) whose name holds the other as a part
    between underscores or at either end; of several the closest in length, then the first. Off unless called: a guess.

    Names meet by their parts, so a table's columns are not compared all with all."""
    parts = lambda c: F.explode(F.filter(F.split(c, "_"), lambda x: x != ""))
    a = gone.select("key", F.col("name").alias("old"), parts(F.col("name")).alias("part"))
    b = final.select("key", F.col("name").alias("new"), parts(F.col("name")).alias("part"))
    pairs = a.join(b, ["key", "part"]).select("key", "old", "new").distinct().where("old != new and (contains(new, old) or contains(old, new))")
    near = F.struct(F.abs(F.length("new") - F.length("old")).alias("d"), "new")
    return pairs.groupBy("key", "old").agg(F.min(near).alias("best")).select("key", "old", F.col("best.new").alias("new"))


def first_holding(cases: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first case that holds."""
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(cases), F.lit(default))
