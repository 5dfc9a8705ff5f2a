"""Keyed, ordered change logs: folds, final states and compaction of object histories.

A change log has the columns key, seq, idx, op, attr, value: one row for each change of an object, ordered by (seq, idx)
within its key. Operations are CREATE, ALTER, DROP and INSERT (a data operation); GRANT and REVOKE for permissions.

Folds are grouped aggregates of the kind that combine before the shuffle (min_by, max_by, conditional counts) wherever the
history itself is not the result, so a key with very many changes costs no memory in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import slices

CREATE, ALTER, DROP, DATA, GRANT, REVOKE = "CREATE", "ALTER", "DROP", "INSERT", "GRANT", "REVOKE"


def order() -> Column:
    return F.struct("seq", "idx")


def history() -> Window:
    return Window.partitionBy("key").orderBy("seq", "idx")


def is_op(op: str) -> Column:
    return F.col("op") == op


def count_ops(op: str) -> Column:
    return F.count_if(is_op(op))


def risk(op: Column) -> Column:
    """How much a change can lose: 3 for DROP, 2 for data, 1 for ALTER, 0 for CREATE."""
    return F.when(op == DROP, 3).when(op == DATA, 2).when(op == ALTER, 1).otherwise(0)


def with_next(log: DataFrame) -> DataFrame:
    """log with next_op, the operation that follows within the key, and is_first. A key with very many changes is spread over
    slices of the order. A log that has both is left as it is."""
    if {"next_op", "is_first"} <= set(log.columns):
        return log
    own = slices.sliced(log, "seq")
    w = slices.within(["key"]).orderBy("seq", "idx")
    over = slices.across(["key"])
    edges = {"__after": F.lead("__first").over(over), "__begins": F.lag(F.lit(True)).over(over).isNull()}
    own = slices.carried(own, ["key"], {"__first": F.min_by("op", order())}, edges)
    ends = F.lead(F.lit(True)).over(w).isNull()
    marked = own.withColumn("next_op", F.when(ends, F.col("__after")).otherwise(F.lead("op").over(w)))
    return marked.withColumn("is_first", F.col("__begins") & (F.row_number().over(w) == 1)).drop("__after", "__begins", slices.SLICE)


def first_seen(log: DataFrame) -> DataFrame:
    """Each change once: rows that repeat key, seq, idx and op are one."""
    return log.dropDuplicates(["key", "seq", "idx", "op"])


def summary(log: DataFrame) -> DataFrame:
    """Counts by operation, first and last operation, highest risk and conflict (more than one CREATE) of each key."""
    return log.groupBy("key").agg(
        F.count("*").alias("n_events"),
        count_ops(CREATE).alias("n_creates"),
        count_ops(ALTER).alias("n_alters"),
        count_ops(DROP).alias("n_drops"),
        count_ops(DATA).alias("n_data_ops"),
        F.min_by("op", order()).alias("first_op"),
        F.max_by("op", order()).alias("last_op"),
        F.max(risk(F.col("op"))).cast("long").alias("highest_risk"),
        (count_ops(CREATE) > 1).alias("has_conflict"),
    )


def last_state(log: DataFrame) -> DataFrame:
    """The last CREATE of each key that has one and whose last change is not a DROP."""
    made = F.when(is_op(CREATE), order())
    return (
        log.groupBy("key")
        .agg(
            F.max_by("op", order()).alias("last_op"),
            F.max_by(F.struct("idx", "attr", "value"), made).alias("s"),
            F.max(made).alias("at"),
        )
        .where((F.col("last_op") != DROP) & F.col("at").isNotNull())
        .select("key", "s.idx", "s.attr", "s.value", "last_op")
    )


def distinct_alters(log: DataFrame) -> DataFrame:
    """The first ALTER of each attribute of a key, with its place among the key's attributes in order of appearance."""
    firsts = log.where(is_op(ALTER)).groupBy("key", "attr").agg(F.min(order()).alias("at"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    return firsts.select("key", "attr", F.col("at.idx").alias("idx"), place.cast("long").alias("place"))


def redundancy(log: DataFrame, file: Column) -> DataFrame:
    """What can be compacted for each key, by the first pattern that holds, with the statements, files and lines saved.

    CREATE_ALTER: the history begins with CREATE, has ALTERs, and no data operation after its start. DROP_CREATE: a DROP
    is followed by a CREATE. DUPLICATE: several CREATEs. `file` is what the change came in.
    """
    step, later = with_next(log), ~F.col("is_first")
    keys = step.withColumn("file", file).groupBy("key").agg(
        F.count("*").alias("n_events"),
        F.min_by("op", order()).alias("first_op"),
        F.count_if(is_op(ALTER) & later).alias("alters"),
        F.count_distinct(F.when(is_op(ALTER) & later, F.col("file"))).alias("files"),
        F.max(is_op(DATA) & later).alias("data"),
        F.max(is_op(DROP) & (F.coalesce("next_op", F.lit("")) == CREATE)).alias("again"),
        count_ops(CREATE).alias("creates"),
    )
    evolves = (F.col("first_op") == CREATE) & (F.col("alters") > 0) & ~F.col("data")
    pattern = F.when(evolves, "CREATE_ALTER").when(F.col("again"), "DROP_CREATE").when(F.col("creates") > 1, "DUPLICATE")
    found = keys.where("n_events > 1").withColumn("pattern", pattern).where("pattern is not null")

    def by_pattern(alter, again, many) -> Column:
        p = F.col("pattern")
        return F.when(p == "CREATE_ALTER", alter).when(p == "DROP_CREATE", again).otherwise(many).cast("long")

    alters, creates = F.col("alters"), F.col("creates")
    return found.select(
        "key",
        "pattern",
        by_pattern(alters, F.lit(1), creates - 1).alias("statements_reduced"),
        by_pattern(F.col("files"), F.lit(2), creates).alias("files_affected"),
        by_pattern(alters * 2, F.lit(3), (creates - 1) * 5).alias("lines_reduced"),
    )


def ranked(found: DataFrame) -> DataFrame:
    """redundancy() in order of what is saved: most statements first, then by key."""
    return found.orderBy(F.col("statements_reduced").desc(), "key")


def data_statistics(log: DataFrame, operation: str = "attr") -> DataFrame:
    """operation, n, n_keys of the data operations of a log by a column that tells their kind; all in a row with a null."""
    c = F.col(operation)
    return log.where(is_op(DATA)).groupingSets([[c], []], c).agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.grouping_id().cast("long").alias("level")
    )


def last_creates(log: DataFrame) -> DataFrame:
    """key, idx, n_duplicates: the last CREATE of each key, and how many earlier ones it makes superfluous."""
    own = log.where(is_op(CREATE)).groupBy("key").agg(F.max_by("idx", order()).alias("idx"), F.count("*").alias("n"))
    return own.select("key", "idx", (F.col("n") - 1).alias("n_duplicates"))


def statistics(log: DataFrame) -> DataFrame:
    """Counts by operation, by attribute, and in all: one row for each, told apart by `level` (grouping_id)."""
    return log.groupingSets([[F.col("op")], [F.col("attr")], []], F.col("op"), F.col("attr")).agg(
        F.count("*").alias("n"),
        F.count_distinct("key").alias("n_keys"),
        F.grouping_id().cast("long").alias("level"),
    )


def permissions(grants: DataFrame) -> DataFrame:
    """grantee, privilege of grants(grantee, privilege, op, seq, idx) whose last change is GRANT."""
    last = grants.groupBy("grantee", "privilege").agg(
        F.max_by("op", order()).alias("last"), F.max(order()).alias("at"), F.count("*").alias("n_changes")
    )
    return last.where(F.col("last") == GRANT).select("grantee", "privilege", F.col("at.idx").alias("idx"), "n_changes")


def permission_statements(grants: DataFrame) -> DataFrame:
    """One GRANT text for each grantee with what it still has."""
    held = permissions(grants).groupBy("grantee").agg(
        F.array_join(F.array_sort(F.collect_list("privilege")), ", ").alias("privileges"), F.count("*").alias("n")
    )
    return held.select("grantee", "privileges", "n", F.format_string("GRANT %s TO %s", "privileges", "grantee").alias("sql"))


def since_last_drop(log: DataFrame) -> DataFrame:
    """The changes of each key after its last DROP (all of them if it has none), with `n_before` earlier ones."""
    own = slices.sliced(log, "seq")
    everywhere = Window.partitionBy("key")
    carry = {"dropped": F.max("__drop").over(everywhere), "__before": F.coalesce(F.sum("__n").over(slices.earlier(["key"])), F.lit(0))}
    marked = slices.carried(own, ["key"], {"__drop": F.max(F.when(is_op(DROP), order())), "__n": F.count("*")}, carry)
    marked = marked.withColumn("n_before", F.col("__before") + F.row_number().over(slices.within(["key"]).orderBy("seq", "idx")) - 1)
    alive = marked.where(F.col("dropped").isNull() | (order() > F.col("dropped")))
    return alive.drop("dropped", "__before", slices.SLICE)


def effective_create(log: DataFrame, conditional: Column) -> DataFrame:
    """The CREATE that counts after a key's last DROP: the last unconditional one, else the first conditional one."""
    alive = since_last_drop(log).where(is_op(CREATE)).withColumn("cond", conditional)
    agg = alive.groupBy("key").agg(
        F.max_by("idx", F.when(~F.col("cond"), order())).alias("hard"),
        F.min_by("idx", order()).alias("first"),
        F.count("*").alias("n_creates"),
    )
    return agg.select("key", F.coalesce("hard", "first").alias("idx"), F.col("hard").isNull().alias("conditional"), "n_creates")


def column_state(log: DataFrame) -> DataFrame:
    """State of each attribute (column) of a key, folded in order.

    CREATE and ALTER define it, DROP drops it, data operations leave it. status: TRANSIENT if it was defined and dropped
    in this history, DROPPED if it was only dropped, MODIFIED if defined more than once since the last DROP, else ADDED.
    position is its place by first appearance, definition the last one.
    """
    own = log.where(F.col("op").isin(CREATE, ALTER, DROP) & F.col("attr").isNotNull())
    w = Window.partitionBy("key", "attr")
    dropped = F.max(F.when(is_op(DROP), order())).over(w)
    marked = own.withColumn("dropped", dropped).withColumn(
        "alive", ~is_op(DROP) & (F.col("dropped").isNull() | (order() > F.col("dropped")))
    )
    states = marked.groupBy("key", "attr").agg(
        F.min(order()).alias("first"),
        F.max_by("value", F.when(~is_op(DROP), order())).alias("definition"),
        F.count_if("alive").alias("n_alive"),
        F.count_if(~is_op(DROP)).alias("n_defined"),
        count_ops(DROP).alias("n_drops"),
    )
    status = (
        F.when((F.col("n_alive") == 0) & (F.col("n_defined") > 0), "TRANSIENT")
        .when(F.col("n_alive") == 0, "DROPPED")
        .when(F.col("n_alive") > 1, "MODIFIED")
        .otherwise("ADDED")
    )
    place = F.row_number().over(Window.partitionBy("key").orderBy("first"))
    return states.select(
        "key", "attr", place.cast("long").alias("position"), status.alias("status"), "definition", "n_defined", "n_drops"
    )


def conditional_final(log: DataFrame, conditional: Column) -> DataFrame:
    """Whether each key with two or more conditional changes should exist in the end: its last CREATE or DROP decides."""
    own = log.where(F.col("op").isin(CREATE, DROP)).withColumn("cond", conditional)
    last = own.groupBy("key").agg(F.count_if("cond").alias("n_conditional"), F.max_by("op", order()).alias("last"))
    return last.where("n_conditional >= 2").select("key", "n_conditional", (F.col("last") == CREATE).alias("should_exist"))


def drop_create_cycles(log: DataFrame) -> DataFrame:
    """Keys that are dropped and made again: n_cycles of adjacent DROP and CREATE, whether the object is transient
    (created and dropped), severity, and the CREATE that replaces them all."""
    keys = with_next(log).groupBy("key").agg(
        F.count_if(is_op(DROP) & (F.col("next_op") == CREATE)).alias("n_cycles"),
        count_ops(CREATE).alias("n_creates"),
        count_ops(DROP).alias("n_drops"),
        F.max_by("idx", F.when(is_op(CREATE), order())).alias("final_idx"),
    )
    transient = (F.col("n_creates") > 0) & (F.col("n_drops") > 0)
    severity = F.when(F.col("n_cycles") > 5, "HIGH").when(F.col("n_cycles") > 0, "MEDIUM").otherwise("LOW")
    cyclic = (F.col("n_creates") > 1) | transient
    return keys.where(cyclic).select(
        "key", "n_cycles", "n_creates", "n_drops", transient.alias("transient"), severity.alias("severity"), "final_idx"
    )


def version_groups(names: DataFrame, name: str, version: str) -> DataFrame:
    """Names that differ only by what follows `version` (a pattern): base, number of members, first and last name."""
    base = F.regexp_replace(name, f"(?:{version}).*$", "")
    groups = names.select(F.col(name).alias("name"), base.alias("base")).distinct().groupBy("base").agg(
        F.count("*").alias("n_members"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )
    return groups.where("n_members > 1")


#: Rules in the order in which they are tried, with the lowest safety level at which they are. Those that look at kinds of
#: objects or at statements hold only in logs with the columns kind and sql.
LEVELS = ("paranoid", "conservative", "standard", "aggressive")
LADDER = (
    ("do_block_enum_type", "paranoid"),
    ("enum_deduplication", "paranoid"),
    ("publication_deduplication", "paranoid"),
    ("conditional_schema", "conservative"),
    ("multiple_create", "conservative"),
    ("create_alter", "conservative"),
    ("column_evolution", "conservative"),
    ("drop_create_cycle", "standard"),
    ("rls_consolidation", "standard"),
    ("transaction_boundary", "standard"),
    ("function_deduplication", "aggressive"),
    ("error_recovery", "paranoid"),
)


def ladder(level: str, overrides: dict[str, bool] | None = None) -> list[str]:
    """Names of the rules tried at a safety level, in order. Overrides switch rules on or off; the last rule, which always
    holds, can't be switched off. Unknown levels and rules are errors."""
    if level not in LEVELS:
        raise ValueError(f"unknown safety level {level!r}")
    names = [name for name, _ in LADDER]
    if unknown := sorted(set(overrides or {}) - set(names)):
        raise ValueError(f"unknown rules {unknown}")
    on = {name: LEVELS.index(lowest) <= LEVELS.index(level) for name, lowest in LADDER} | (overrides or {})
    return [name for name in names if on[name] or name == "error_recovery"]


def compaction_plan(log: DataFrame, level: str, overrides: dict[str, bool] | None = None) -> DataFrame:
    """The first rule of the ladder that holds for each key, and how many statements it leaves of how many."""
    kinds = F.col("kind") if "kind" in log.columns else F.lit("")
    text = F.upper("sql") if "sql" in log.columns else F.lit("")
    keys = with_next(log.withColumn("__kind", kinds).withColumn("__sql", text)).groupBy("key").agg(
        F.max("__kind").alias("kind"),
        F.count_distinct("__sql").alias("texts"),
        F.count_if(F.col("__sql").contains("DO $")).alias("blocks"),
        F.count_if(F.col("__sql").rlike(r"\bROW LEVEL SECURITY\b")).alias("secured"),
        F.count_if(F.col("__sql").rlike(r"\b(ADD|DROP|RENAME|ALTER) COLUMN\b")).alias("columns"),
        F.count("*").alias("n"),
        count_ops(CREATE).alias("creates"),
        count_ops(ALTER).alias("alters"),
        count_ops(DROP).alias("drops"),
        F.min_by("op", order()).alias("first_op"),
        F.max_by("op", order()).alias("last_op"),
        F.count_if(is_op(DROP) & (F.col("next_op") == CREATE)).alias("again"),
        count_ops(DATA).alias("data"),
    )
    c = F.col
    holds = {
        "do_block_enum_type": (c("kind") == "TYPE") & (c("blocks") > 0),
        "enum_deduplication": (c("kind") == "TYPE") & (c("creates") > 1) & (c("drops") == 0),
        "publication_deduplication": (c("kind") == "PUBLICATION") & (c("texts") < c("n")),
        "column_evolution": (c("kind") == "TABLE") & (c("creates") == 0) & (c("columns") > 1),
        "rls_consolidation": (c("kind") == "TABLE") & (c("secured") > 1),
        "function_deduplication": c("kind").isin("FUNCTION", "PROCEDURE") & (c("creates") > 1),
        "conditional_schema": (c("creates") >= 2) & (c("drops") >= 2),
        "multiple_create": (c("creates") > 1) & (c("last_op") != DROP),
        "create_alter": (c("creates") == 1) & (c("first_op") == CREATE) & (c("alters") > 0),
        "drop_create_cycle": c("again") > 0,
        "transaction_boundary": c("n") > 2,
        "error_recovery": F.lit(True),
    }
    left = {
        "enum_deduplication": c("n") - c("creates") + 1,
        "publication_deduplication": c("texts"),
        "rls_consolidation": c("n") - c("secured") + 1,
        "function_deduplication": c("n") - c("creates") + 1,
        "conditional_schema": c("data") + F.when(c("last_op") == DROP, 0).otherwise(1),
        "multiple_create": c("data") + 1,
        "create_alter": c("n") - c("alters"),
        "drop_create_cycle": c("n") - 2 * c("again") + 1,
    }
    rules = ladder(level, overrides)
    rule = F.coalesce(*[F.when(holds[r], F.lit(r)) for r in rules])
    remain = F.coalesce(*[F.when(c("rule") == r, left[r].cast("long")) for r in rules if r in left], c("n"))
    return keys.withColumn("rule", rule).select("key", "rule", c("n").alias("n_before"), remain.alias("n_after"))
