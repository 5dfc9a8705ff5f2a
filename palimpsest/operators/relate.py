"""Joins between changes and objects: as-of, range, dangling references, duplicates, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import slices


def _carried_forward(rows: DataFrame, key: str, value: Column, upto: int, name: str, *order: str) -> DataFrame:
    """rows with `name`: the last value that is not null of the key's rows before, up to the own row if upto is 0. A key with
    very many rows is spread over slices of the order."""
    own = slices.sliced(rows, order[0]).withColumn("__value", value)
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order)))
    own = slices.carried(own, [key], {"__last": last}, {"__earlier": F.last("__last", ignorenulls=True).over(slices.earlier([key]))})
    w = slices.within([key]).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    seen = F.coalesce(F.last("__value", ignorenulls=True).over(w), F.col("__earlier"))
    return own.withColumn(name, seen).drop("__value", "__earlier", slices.SLICE)


def prior(log: DataFrame, key: str, is_source: Column, value: str, *order: str) -> DataFrame:
    """log with `prior`: the value of the latest source row of its key before it, without a join of rows with rows."""
    return _carried_forward(log, key, F.when(is_source, F.col(value)), -1, "prior", *order)


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, *, tie: str) -> DataFrame:
    """left with `asof`, the value of the latest right row of its key at or before its time, and `asof_at`.

    Both sides go once through one exchange and one sort: they are stacked, and the last right row seen is carried forward.
    Unlike a range join, no pairs are made. tie orders right rows of one time.
    """
    r = right.select(
        F.col(key).alias("k"), F.col(at).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("o"),
        F.struct(F.col(value).alias("v"), F.col(at).alias("at")).alias("r"), F.lit(None).alias("l"),
    )
    l = left.select(
        F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), F.lit(None).alias("o"),
        F.lit(None).alias("r"), F.struct(*left.columns).alias("l"),
    )
    both = r.withColumn("l", F.lit(None).cast(l.schema["l"].dataType)).unionByName(
        l.withColumn("o", F.lit(None).cast(r.schema["o"].dataType)).withColumn("r", F.lit(None).cast(r.schema["r"].dataType))
    )
    seen = _carried_forward(both, "k", F.col("r"), 0, "seen", "t", "side", "o").where("side = 1")
    return seen.select("l.*", F.col("seen.v").alias("asof"), F.col("seen.at").alias("asof_at"))


def between_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """points joined with the ranges that hold them (low <= point <= high), by bins of a width near the ranges' length:
    a range offers itself to each bin that it touches, a point to its own, so the join is an equi join."""
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__bin").where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def dangling(references: DataFrame, objects: DataFrame, reference: str, key: str) -> DataFrame:
    """References to objects that are not there; null references point nowhere and are left out."""
    known = objects.select(F.col(key).alias("__known")).distinct()
    return references.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("__known"), "left_anti")


def first_of(rows: DataFrame, same: list[Column], *order: str) -> DataFrame:
    """The first row of each group of equal ones, with the size of the group: an aggregate that combines before the shuffle,
    so a text that very many rows share is no burden to a task."""
    keys = [x.alias(f"__k{i}") for i, x in enumerate(same)]
    whole = F.struct(*[rows[f"`{c}`"] for c in rows.columns])
    keyed = rows.select(*keys, whole.alias("__row"), F.struct(*order).alias("__at"))
    firsts = keyed.groupBy(*[f"__k{i}" for i in range(len(same))]).agg(F.min_by("__row", "__at").alias("__row"), F.count("*").alias("n_copies"))
    return firsts.select("__row.*", "n_copies")


def same_sets(rows: DataFrame, owner: str, value: str) -> DataFrame:
    """Owners with the same set of values: the first by name is primary, the others refer to it."""
    sets = rows.groupBy(owner).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("members"))
    w = Window.partitionBy("members")
    ranked = sets.withColumn("primary", F.min(owner).over(w)).withColumn("n_owners", F.count("*").over(w))
    return ranked.where("n_owners > 1").select(owner, "primary", "n_owners")


def difference(left: DataFrame, right: DataFrame, labels: tuple[str, str], most: int) -> DataFrame:
    """Lines (one column, `line`) in one of two sets only, in order, at most so many, and a last row that counts the rest."""
    a, b = left.select("line").distinct(), right.select("line").distinct()
    only = a.join(b, "line", "left_anti").withColumn("side", F.lit(labels[0]))
    only = only.unionByName(b.join(a, "line", "left_anti").withColumn("side", F.lit(labels[1])))
    shown = only.orderBy("line", "side").limit(most)
    rest = only.agg(F.count("*").alias("n")).where(F.col("n") > most)
    more = rest.select(F.format_string("... %d more", F.col("n") - most).alias("line"), F.lit("").alias("side"))
    return shown.select("line", "side").unionByName(more.select("line", "side"))


def compared(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full comparison by key: same, changed, left_only or right_only; null values equal each other."""
    a = left.select(F.col(key).alias("k"), F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(F.col(key).alias("k"), F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    both = a.join(b, "k", "full_outer")
    status = (
        F.when(F.col("in_right").isNull(), "left_only")
        .when(F.col("in_left").isNull(), "right_only")
        .when(F.col("left_value").eqNullSafe(F.col("right_value")), "same")
        .otherwise("changed")
    )
    return both.select(F.col("k").alias(key), "left_value", "right_value", status.alias("status"))


def matched_dependencies(dependencies: DataFrame, provisions: DataFrame) -> DataFrame:
    """dependency, provision of dependencies(dependency) and provisions(provision) that fit: schema:, extension:, function:
    and type: ones are alike in full; a type without its prefix fits type:name; column:table.column fits its table; other
    names fit without their schema. Each way is a key, so they meet in equi joins."""
    d = F.col("dependency")
    typed = d.rlike("^(schema|extension|function|type):")
    bare = lambda c: F.when(c.contains("."), F.substring_index(c, ".", -1)).otherwise(c)
    column = F.regexp_extract(d, r"^column:([^.:]+)", 1)
    full = lambda c: F.concat(F.lit("full:"), c)
    asked = F.when(typed, F.array(full(d))).when(d.startswith("column:"), F.array(full(column))).otherwise(
        F.array(F.concat(F.lit("type:"), d), F.concat(F.lit("name:"), bare(d)))
    )
    p = F.col("provision")
    is_type = p.startswith("type:")
    offered = F.array_compact(F.array(full(p), F.when(is_type, p), F.when(~p.rlike("^(schema|extension|function|type|column):"), F.concat(F.lit("name:"), bare(p)))))
    left = dependencies.select("dependency").distinct().withColumn("k", F.explode(asked))
    right = provisions.select("provision").distinct().withColumn("k", F.explode(offered))
    return left.join(right, "k").select("dependency", "provision").distinct()


def missing_columns(made: DataFrame, there: DataFrame) -> DataFrame:
    """table, column, made_type, there_type, status of the columns of made(table, column, type) and there(table, column, type)
    that differ: missing (made, not there), extra (there, in a table that was made) or type."""
    a = made.select("table", "column", F.col("type").alias("made_type"), F.lit(True).alias("a"))
    b = there.join(made.select("table").distinct(), "table", "left_semi").select("table", "column", F.col("type").alias("there_type"), F.lit(True).alias("b"))
    both = a.join(b, ["table", "column"], "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("made_type").eqNullSafe(F.col("there_type")), "type")
    return both.select("table", "column", "made_type", "there_type", status.alias("status")).where("status is not null")


def missing_constraints(made: DataFrame, there: DataFrame) -> DataFrame:
    """table, name, status: named constraints of made(table, name) that are not among there(table, name, kind), and a row
    NO_PRIMARY_KEY for each table that is there without one."""
    gone = made.where("name is not null").join(there.select("table", "name").distinct(), ["table", "name"], "left_anti")
    keys = there.groupBy("table").agg(F.bool_or(F.coalesce(F.col("kind") == "PRIMARY KEY", F.lit(False))).alias("keyed"))
    bare = keys.where("not keyed").select("table", F.lit(None).cast("string").alias("name"), F.lit("NO_PRIMARY_KEY").alias("status"))
    return gone.select("table", "name", F.lit("missing").alias("status")).unionByName(bare)


def missing_objects(made: DataFrame, catalog: DataFrame, path: list[str]) -> DataFrame:
    """kind, name of made(kind, name) that no schema of the path holds in catalog(kind, schema, object); a name with a schema
    is looked up in its own only."""
    own = made.select("kind", "name").distinct()
    known = catalog.select("kind", "schema", "object").distinct()
    plain, schema = F.substring_index("name", ".", -1), F.when(F.col("name").contains("."), F.substring_index("name", ".", 1))
    asked = own.withColumn("schema", F.explode(F.when(schema.isNotNull(), F.array(schema)).otherwise(F.array(*map(F.lit, path))))).withColumn("object", plain)
    there = asked.join(known, ["kind", "schema", "object"], "left_semi").select("kind", "name").distinct()
    return own.join(there, ["kind", "name"], "left_anti")


def places(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows with `place`, counted from 1 within each value of `by` in the given order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def dangling_names(references: DataFrame, objects: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """references(name, …) to which none of objects(name) answers: neither by the whole name, nor as public.name, nor, where
    one of the two has no schema, by the name alone. Names that match one of the excluded patterns are passed over."""
    n = F.col("name")
    plain, qualified = F.substring_index(n, ".", -1), n.contains(".")
    asked = F.when(qualified, F.array(F.concat(F.lit("full:"), n), F.concat(F.lit("bare:"), plain))).otherwise(F.array(F.concat(F.lit("any:"), plain)))
    offered = F.when(qualified, F.array(F.concat(F.lit("full:"), n), F.concat(F.lit("any:"), plain))).otherwise(
        F.array(F.concat(F.lit("full:public."), n), F.concat(F.lit("bare:"), plain), F.concat(F.lit("any:"), plain))
    )
    own = references.where(n.isNotNull())
    for pattern in excluded:
        own = own.where(~n.rlike(pattern))
    keys = objects.where(n.isNotNull()).select(F.explode(offered).alias("__key")).distinct()
    met = own.select("name", F.explode(asked).alias("__key")).join(keys, "__key", "left_semi").select("name").distinct()
    return own.join(met, "name", "left_anti")


def found_on_path(names: DataFrame, catalog: DataFrame, path: list[str]) -> DataFrame:
    """name, schema, place of every object of catalog(schema, object) with a name of names(name), in the order of the path."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, path)), F.col("schema")), F.lit(0))
    own = catalog.select("schema", F.col("object").alias("name")).distinct().withColumn("place", place).where("place is not null")
    return names.select("name").distinct().join(own, "name")


SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")


def is_system_function(name: Column, schema: Column) -> Column:
    """Whether a function is the server's own: by its schema, or, without one, by a name that begins with pg_."""
    return F.coalesce(F.lower(schema).isin(*SYSTEM_SCHEMAS), F.lower(name).startswith("pg_"))


def snapshot_difference(left: DataFrame, right: DataFrame, most: int = 250) -> DataFrame:
    """difference() of two catalog snapshots(contract_version, postgresql_version, line). Snapshots of different versions are
    not compared: a row for each version that differs stands instead."""
    kinds = ("contract_version", "postgresql_version")
    versions = lambda s, side: s.agg(*[F.max(k).alias(k) for k in kinds]).select(F.explode(F.array(*[F.concat_ws("=", F.lit(k), k) for k in kinds])).alias("line"), F.lit(side).alias("side"))
    a, b = versions(left, "left"), versions(right, "right")
    odd = a.join(b.select("line"), "line", "left_anti").unionByName(b.join(a.select("line"), "line", "left_anti"))
    # versions are two rows: those that differ, if there are any, stand instead of all lines
    lines = difference(left.where("line is not null"), right.where("line is not null"), ("left", "right"), most)
    both = odd.withColumn("__rank", F.lit(0)).unionByName(lines.withColumn("__rank", F.lit(1)))
    first = both.withColumn("__first", F.min("__rank").over(Window.partitionBy()))  # at most `most` rows and the versions
    return first.where("__rank = __first").select("line", "side")


def near_copies(rows: DataFrame, name: str, *same: str) -> DataFrame:
    """same, name, n_near, primary of the distinct rows(name, same…): how many other names with equal values of `same` are one edit or
    none but case away, and the first of these and the own one by order. Null names have none, and null values equal each other.

    Names within one edit share a variant: the name itself, or it less one character. So rows meet by equal variants alone, and a
    variant is that of few distinct names (its length times the characters that names are made of); pairs are then confirmed.
    """
    own = rows.where(F.col(name).isNotNull()).select(*same, F.col(name).alias("name")).distinct().withColumn("low", F.lower("name"))
    by = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256) if same else F.lit("")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))), lambda i: F.concat(F.substr("low", F.lit(1), i - 1), F.substr("low", i + 1)))
    variants = own.select(by.alias("by"), "name", "low", F.explode(F.array_distinct(F.concat(F.array("low"), cuts))).alias("variant"))
    other = variants.select("by", "variant", F.col("name").alias("near"), F.col("low").alias("near_low"))
    met = variants.join(other, ["by", "variant"]).where((F.col("name") != F.col("near")) & (F.levenshtein("low", "near_low") <= 1))
    found = met.select("by", "name", "near").distinct().groupBy("by", "name").agg(F.count("*").alias("n_near"), F.min("near").alias("first"))
    both = own.withColumn("by", by).join(found, ["by", "name"], "left")
    return both.select(*same, "name", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.least("name", "first").alias("primary"))
