"""Who holds which right in the end: grants and revocations folded over (object, column, privilege, grantee, grantor).

ALL is the top of a kind's privileges and is taken apart before the fold. A holding is an interval from its GRANT to the REVOKE that
ends it, and so is a grant option. What a role has granted by its option ends when the role holds the option from nobody any more:
intervals are cut by the islands of their grantor's option, round by round, until none changes, so a REVOKE reaches along chains of
any length. Only aggregates and windows by a single right are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import lifetimes
from palimpsest.operators.graph import cut

#: The privileges of each kind of object, and those of single columns.
ALL_OF = {
    "TABLE": "SELECT INSERT UPDATE DELETE TRUNCATE REFERENCES TRIGGER", "SEQUENCE": "USAGE SELECT UPDATE", "FUNCTION": "EXECUTE",
    "PROCEDURE": "EXECUTE", "ROUTINE": "EXECUTE", "SCHEMA": "CREATE USAGE", "DATABASE": "CREATE CONNECT TEMPORARY", "TYPE": "USAGE",
    "DOMAIN": "USAGE", "LANGUAGE": "USAGE", "FOREIGN SERVER": "USAGE", "FOREIGN DATA WRAPPER": "USAGE", "TABLESPACE": "CREATE",
}
OF_COLUMNS = "SELECT INSERT UPDATE REFERENCES"
RIGHT = ["object", "kind", "col", "privilege"]
CELL = [*RIGHT, "grantee", "grantor"]


def all_of(kind: Column, col: Column) -> Column:
    """The privileges that ALL stands for; of a kind that is not listed, ALL itself."""
    known = F.create_map(*[F.lit(x) for k, v in ALL_OF.items() for x in (k, v)])
    listed = F.split(F.when(col != "", F.lit(OF_COLUMNS)).otherwise(F.coalesce(F.element_at(known, kind), F.lit("ALL"))), " ")
    return listed


def taken_apart(changes: DataFrame) -> DataFrame:
    """changes with a row for each privilege that ALL stands for. A REVOKE of a privilege on a whole object is one on each of its
    columns that the privilege was ever granted on, too."""
    kind, col = F.col("kind"), F.coalesce("col", F.lit(""))
    each = F.when(F.upper("privilege").isin("ALL", "ALL PRIVILEGES") & (kind != "ROLE"), all_of(kind, col)).otherwise(F.array("privilege"))
    names = ["object", "kind", "grantee", "grantor", "at", "op", "option"]
    rows = cut(changes.select(*names, col.alias("col"), F.explode(each).alias("privilege")))
    columns = rows.where("col != '' and op = 'GRANT'").select("object", "kind", "privilege", "grantee", "grantor", F.col("col").alias("c")).distinct()
    wide = rows.where("col = '' and op = 'REVOKE'").join(columns, ["object", "kind", "privilege", "grantee", "grantor"]).withColumn("col", F.col("c"))
    return rows.unionByName(wide.select(rows.columns)).distinct()


def _intervals(rows: DataFrame, begins: Column, ends: Column) -> DataFrame:
    """CELL, made, ended: an interval for each row that begins one, up to the first row after it that ends it. Those of one cell
    overlap where it was begun again: each stands on what its grantor could grant at its own time."""
    op = F.when(begins, "CREATE").when(ends, "DROP")
    alive = lifetimes.lives(rows.select(F.struct(*CELL).alias("node"), "at", op.alias("op")).where("op is not null"))
    by = Window.partitionBy("node").orderBy("made")
    fresh = F.coalesce(F.lag("ended").over(by) != F.col("made"), F.lit(True)).cast("int")
    runs = alive.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    last = F.max_by("ended", "made").over(Window.partitionBy("node", "run"))
    return runs.select("node.*", "made", last.alias("ended"))


def _islands(options: DataFrame) -> DataFrame:
    """RIGHT, role, since, until: when a role holds the option of a right, from whomever."""
    by = Window.partitionBy(*RIGHT, "grantee").orderBy("made")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # an interval that has not ended covers all that follow
    open_ = F.coalesce(F.bool_or(F.col("ended").isNull()).over(before), F.lit(False))
    fresh = ~open_ & F.coalesce(F.max("ended").over(before) < F.col("made"), F.lit(True))
    runs = options.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by))
    until = F.when(F.bool_or(F.col("ended").isNull()), F.lit(None)).otherwise(F.max("ended"))
    return runs.groupBy(*RIGHT, "grantee", "run").agg(F.min("made").alias("since"), until.alias("until")).drop("run").withColumnRenamed("grantee", "role")


def _supported(intervals: DataFrame, islands: DataFrame) -> DataFrame:
    """intervals as far as their grantors may grant: those of the owner (an empty grantor) whole, the others up to the end of the
    grantor's option at the time, and none where there was no option."""
    own = islands.select(*RIGHT, F.col("role").alias("grantor"), "since", "until")
    met = intervals.where("grantor != ''").join(own, [*RIGHT, "grantor"])
    met = met.where((F.col("since") < F.col("made")) & (F.col("until").isNull() | (F.col("made") < F.col("until"))))
    met = met.select(*CELL, "made", F.least("ended", "until").alias("ended"))
    return intervals.where("grantor = ''").select(*CELL, "made", "ended").unionByName(met)


def holdings(changes: DataFrame) -> DataFrame:
    """object, kind, col, privilege, grantee, grantor, made, ended, grantable: what each GRANT of a right was good for, of
    changes(object, kind, col, privilege, grantee, grantor, at, op, option). ended is null if the right is held in the end, and
    grantable says whether its option is held in the end. A GRANT by a role that could not grant at the time is good for nothing.

    op is GRANT or REVOKE; option says WITH GRANT OPTION, or GRANT OPTION FOR. A null or empty col is the whole object; an empty
    grantor the owner, who may always grant. A REVOKE takes along what was granted by the option that it ends, unless the role
    holds it from another grantor too. `at` orders the changes; a GRANT and a REVOKE of one cell at one moment are a GRANT.
    """
    rows = cut(taken_apart(changes.withColumn("grantor", F.coalesce("grantor", F.lit(""))).withColumn("option", F.coalesce("option", F.lit(False)))))
    grants, revokes = F.col("op") == "GRANT", F.col("op") == "REVOKE"
    held = cut(_intervals(rows, grants, revokes & ~F.col("option")))
    options = cut(_intervals(rows, grants & F.col("option"), revokes))
    size = lambda df: df.agg(F.count("*"), F.count("ended"), F.sum(F.xxhash64("ended").cast("decimal(38,0)"))).first()
    now = size(options)
    while True:
        options = cut(_supported(options, _islands(options)))
        before, now = now, size(options)
        if now == before:
            break
    last = options.where("ended is null").select(*CELL, F.lit(True).alias("grantable")).distinct()
    kept = _supported(held, _islands(options)).join(last, CELL, "left")
    return kept.withColumn("grantable", F.coalesce("grantable", F.lit(False)) & F.col("ended").isNull())


def held_in_the_end(changes: DataFrame) -> DataFrame:
    """object, kind, col, privilege, grantee, grantor, grantable of the rights that are held after all changes."""
    return holdings(changes).where("ended is null").select(*CELL, "grantable").distinct()


def never_granted(changes: DataFrame) -> DataFrame:
    """object, kind, col, privilege, grantee, grantor of the rights that are revoked in the end and were revoked before this history
    granted them: those that something beside it may have given, which a REVOKE must go on taking."""
    rows = taken_apart(changes.withColumn("grantor", F.coalesce("grantor", F.lit(""))).withColumn("option", F.coalesce("option", F.lit(False)))).where("not (op = 'REVOKE' and option)")
    ends = rows.groupBy(*CELL).agg(F.min_by("op", "at").alias("first"), F.max_by("op", "at").alias("last"))
    return ends.where("first = 'REVOKE' and last = 'REVOKE'").select(*CELL)
