"""Texts made or changed for scripts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import cast_kind, is_lossy, quoted_if_needed


def duration_text(ms: Column) -> Column:
    """N/A of nothing, else milliseconds, seconds with two places (halves up), or minutes and seconds."""
    minutes = F.concat(F.floor(ms / 60000).cast("string"), F.lit("m"), F.floor((ms % 60000) / 1000).cast("string"), F.lit("s"))
    return (
        F.when(F.coalesce(ms, F.lit(0)) == 0, "N/A").when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.format_string("%d.%02d", F.floor((ms + 5) / 1000), F.floor((ms + 5) % 1000 / 10)), F.lit("s"))).otherwise(minutes)
    )


def type_conversion(source: Column, target: Column, column: Column) -> Column:
    """struct(sql, reverse, reversible, lossy): how a column's type is changed, {table} standing for its table, and how that
    is undone. sql is null where there is no cast, reverse where it can't be undone without loss or an explicit cast."""
    kind, back = cast_kind(source, target), cast_kind(target, source)
    lossy = is_lossy(source, target)
    change = lambda to: F.concat(F.lit("ALTER TABLE {table} ALTER COLUMN "), column, F.lit(" TYPE "), to)
    using = F.concat(F.lit(" USING "), column, F.lit("::"), target)
    sql = F.when(kind == "explicit", F.concat(change(target), using)).when(kind != "impossible", change(target))
    reversible = kind.isin("none", "implicit", "assignment") & ~lossy & back.isin("none", "implicit", "assignment")
    return F.struct(sql.alias("sql"), F.when(reversible, change(source)).alias("reverse"), reversible.alias("reversible"), lossy.alias("lossy"))


def create_index(name: Column, table: Column, parts: Column, *, unique: Column, method: Column, where: Column) -> Column:
    """CREATE INDEX of parts (array of struct(column, expression, order)) of a table, which is written as it is. The method is
    named unless it is null; where may be null."""
    part = lambda p: F.coalesce(p["expression"], F.concat_ws(" ", quoted_if_needed(p["column"]), p["order"]))
    return F.concat(
        F.when(unique, "CREATE UNIQUE INDEX ").otherwise("CREATE INDEX "), quoted_if_needed(name), F.lit(" ON "), table,
        F.coalesce(F.concat(F.lit(" USING "), F.lower(method)), F.lit("")),
        F.lit(" ("), F.array_join(F.transform(parts, part), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" WHERE "), where), F.lit("")),
    )


def whole_word_replaced(text: Column, word: Column, other: Column) -> Column:
    """text with every occurrence of word that no letter, digit or underscore touches replaced."""
    literal = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    safe = F.regexp_replace(other, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit(r"(?<!\w)"), literal(word), F.lit(r"(?!\w)")), safe)


def word_count(text: Column, word: Column) -> Column:
    """How many times whole_word_replaced would replace."""
    pattern = F.concat(F.lit(r"(?<!\w)\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.size(F.regexp_extract_all(text, pattern, F.lit(0))).cast("long")


def names_replaced(text: Column, names: Column) -> Column:
    """text with each name of a map(old, new) replaced where it stands as a whole word, in the order of the old names."""
    entries = F.array_sort(F.map_entries(names))
    return F.aggregate(entries, text, lambda t, e: whole_word_replaced(t, e["key"], e["value"]))


def counted_in_characters(sql: Column) -> Column:
    """length( as char_length(, where it is a name of its own."""
    return F.regexp_replace(sql, r"(?i)(?<![\w.$])length(?=\s*\()", "char_length")


def repaired_drop_policy(sql: Column) -> Column:
    """DROP POLICY a.b.c ON … as DROP POLICY c ON …: a policy's name has no schema."""
    return F.regexp_replace(sql, r'(?i)\b(DROP\s+POLICY\s+(?:IF\s+EXISTS\s+)?)(?:(?:"[^"]*"|[\w$]+)\s*\.\s*)+("[^"]*"|[\w$]+)(\s+ON\b)', "$1$2$3")


def terminated(script: Column) -> Column:
    """script with a semicolon at the end of lines that are whole statements without one: they begin with a statement's word
    and do not go on (an open parenthesis at their end, a comma or a closing one next, a dollar-quoted body, a function)."""
    lines = F.split(script, "\n", -1)

    def one(line: Column, i: Column) -> Column:
        own, after = F.trim(line), F.trim(F.coalesce(F.get(lines, i + 1), F.lit("")))
        begins = own.rlike(r"(?i)^(CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|GRANT|REVOKE)\s")
        goes_on = own.rlike(r"[;(]$") | line.contains("$$") | after.rlike(r"^[,)]") | own.rlike(r"(?i)^(CREATE|ALTER)\s.*FUNCTION")
        return F.when(begins & ~goes_on, F.concat(line, F.lit(";"))).otherwise(line)

    return F.array_join(F.transform(lines, one), "\n")


def marked_volatility(sql: Column, kind: Column) -> Column:
    """A CREATE FUNCTION with the word for its volatility after its language, unless it has one; other statements as they
    are, and all where kind is null."""
    is_function = sql.rlike(r"(?is)^\s*CREATE\s+(OR\s+REPLACE\s+)?FUNCTION\b")
    has_one = sql.rlike(r"(?is)\b(VOLATILE|STABLE|IMMUTABLE)\b")
    with_word = F.regexp_replace(sql, F.lit(r"(?i)\bLANGUAGE\s+(\w+)"), F.concat(F.lit("LANGUAGE $1 "), kind))
    return F.when(is_function & ~has_one & kind.isNotNull(), with_word).otherwise(sql)
