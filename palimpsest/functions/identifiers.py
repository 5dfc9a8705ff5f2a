"""Identifiers and types of a schema, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 63


def folded(name: Column) -> Column:
    """Unquoted names fold to lower case and quoted ones lose their quotes; both are cut to 63 characters."""
    quoted = name.startswith('"') & name.endswith('"') & (F.length(name) > 1)
    inner = F.replace(F.substr(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))
    return F.substring(F.when(quoted, inner).otherwise(F.lower(name)), 1, LONGEST)


def name_parts(name: Column) -> Column:
    """The parts of a dotted name, quotes respected: a."b.c" has two."""
    return F.transform(F.regexp_extract_all(name, F.lit(r'"(?:[^"]|"")*"|[^."]+'), F.lit(0)), folded)


def same_name(a: Column, b: Column) -> Column:
    return folded(a) == folded(b)


def is_valid(name: Column) -> Column:
    return name.rlike(r"^[a-z_][a-z0-9_$]*$") & (F.length(name) <= LONGEST)


def repaired(name: Column) -> Column:
    """A valid name near an invalid one."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_$]+", "_")
    begun = F.when(plain.rlike("^[0-9$]"), F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.substring(F.when(begun == "", "_").otherwise(begun), 1, LONGEST)


#: The reserved words of PostgreSQL, which are names only in quotes.
RESERVED = (
    "all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create "
    "current_catalog current_date current_role current_time current_timestamp current_user default deferrable desc distinct "
    "do else end except false fetch for foreign from grant group having in initially intersect into lateral leading limit "
    "localtime localtimestamp not null offset on only or order placing primary references returning select session_user some "
    "symmetric system_user table then to trailing true union unique user using variadic when where window with"
).split()
#: Of these, the words that became reserved in a later version than 12, with that version.
RESERVED_SINCE = {"system_user": 16}
#: Contexts with words that may stand as names elsewhere.
CONTEXT_WORDS = {
    "ddl": "add alter cascade comment database drop extension function if index owner policy rename restrict schema sequence trigger type view".split(),
    "dml": "conflict copy delete insert merge nothing overriding returning set truncate update values".split(),
    "function": "called cost immutable language leakproof parallel returns rows security stable strict support volatile".split(),
    "constraint": "action deferred enforced exclude generated identity immediate key match no partial simple stored valid".split(),
}


def is_keyword(word: Column, version: int = 17) -> Column:
    """Whether a word, in any case, is reserved in a version of PostgreSQL."""
    return F.lower(F.trim(word)).isin([w for w in RESERVED if RESERVED_SINCE.get(w, 0) <= version])


def is_keyword_in(word: Column, context: str, version: int = 17) -> Column:
    """Whether a word is reserved, or a word of the context's own: ddl, dml, function or constraint. Others are errors."""
    if context not in CONTEXT_WORDS:
        raise ValueError(f"unknown context {context!r}")
    return is_keyword(word, version) | F.lower(F.trim(word)).isin(CONTEXT_WORDS[context])


def quoted_if_needed(name: Column) -> Column:
    return F.when(is_valid(name) & ~is_keyword(name), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def written_name(name: Column) -> Column:
    """A folded, dotted name as it is written in a script, its parts quoted where they must be."""
    return F.array_join(F.transform(F.split(name, r"\."), quoted_if_needed), ".")


#: Other names of types.
ALIASES = {
    "int": "integer", "int4": "integer", "int2": "smallint", "int8": "bigint", "float4": "real",
    "float8": "double precision", "bool": "boolean", "varchar": "character varying", "char": "character",
    "timestamp": "timestamp without time zone",
}
#: Conversions by source type that need no cast, and those that an assignment makes.
IMPLICIT = {
    "smallint": ("integer", "bigint", "numeric", "real", "double precision"),
    "integer": ("bigint", "numeric", "real", "double precision"),
    "bigint": ("numeric", "real", "double precision"),
    "real": ("double precision",),
    "numeric": ("real", "double precision"),
    "character": ("character varying", "text"),
    "character varying": ("text",),
    "date": ("timestamp without time zone",),
    "timestamp without time zone": ("timestamp with time zone",),
}
ASSIGNMENT = {
    "bigint": ("integer", "smallint"),
    "integer": ("smallint",),
    "double precision": ("real", "numeric"),
    "real": ("numeric",),
    "text": ("character varying", "character"),
    "character varying": ("character",),
    "timestamp with time zone": ("timestamp without time zone", "date"),
    "timestamp without time zone": ("date",),
}
#: Conversions that may lose data, and families within which an explicit cast exists.
LOSSY = {
    "bigint": ("integer", "smallint"),
    "integer": ("smallint",),
    "double precision": ("real",),
    "numeric": ("integer", "smallint", "bigint"),
    "text": ("character varying", "character"),
    "timestamp with time zone": ("timestamp without time zone",),
    "timestamp without time zone": ("date",),
}
NUMBERS = ("smallint", "integer", "bigint", "numeric", "real", "double precision")
TIMES = ("date", "timestamp without time zone", "timestamp with time zone", "time without time zone", "time with time zone")
TEXTS = ("text", "character varying")
#: Bytes of a value, -1 if they vary.
SIZES = {
    "boolean": 1, "smallint": 2, "integer": 4, "bigint": 8, "real": 4, "double precision": 8, "date": 4, "uuid": 16,
    "timestamp without time zone": 8, "timestamp with time zone": 8, "time without time zone": 8,
    "time with time zone": 12, "interval": 16, "numeric": -1, "text": -1, "character varying": -1, "character": -1,
}


def canonical_type(name: Column) -> Column:
    """Lower case, precision and array marks off, aliases resolved."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s*\([^)]*\)|(\s*\[\s*[0-9]*\s*\])+$", ""))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(alias, plain), plain)


def array_dimensions(name: Column) -> Column:
    return F.size(F.regexp_extract_all(name, F.lit(r"\[\s*[0-9]*\s*\]"), F.lit(0))).cast("long")


def element_type(name: Column) -> Column:
    """struct(element, dimensions): an array's element type in its usual name; of other types, itself and 0."""
    return F.struct(canonical_type(name).alias("element"), array_dimensions(name).alias("dimensions"))


def type_size(name: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in SIZES.items() for x in pair])
    return F.when(array_dimensions(name) > 0, -1).otherwise(F.coalesce(F.try_element_at(sizes, canonical_type(name)), F.lit(-1))).cast("long")


def _in(table: dict[str, tuple[str, ...]], a: Column, b: Column) -> Column:
    pairs = [f"{x}>{y}" for x, ys in table.items() for y in ys]
    return F.concat_ws(">", a, b).isin(pairs)


def cast_kind(source: Column, target: Column) -> Column:
    """none, implicit, assignment, explicit or impossible; arrays go by their elements."""
    a, b = canonical_type(source), canonical_type(target)
    explicit = b.isin(*TEXTS) | (a.isin(*TEXTS) & b.isin(*SIZES)) | (a.isin(*NUMBERS) & b.isin(*NUMBERS)) | (a.isin(*TIMES) & b.isin(*TIMES))
    json = a.isin("json", "jsonb") & b.isin("json", "jsonb")
    kind = (
        F.when(a == b, "none").when(_in(IMPLICIT, a, b), "implicit").when(_in(ASSIGNMENT, a, b), "assignment")
        .when(explicit | json, "explicit").otherwise("impossible")
    )
    return F.when(array_dimensions(source) == array_dimensions(target), kind).when(b.isin(*TEXTS) & (array_dimensions(target) == 0), "explicit").otherwise("impossible")


def is_lossy(source: Column, target: Column) -> Column:
    return _in(LOSSY, canonical_type(source), canonical_type(target))


def type_table(spark: SparkSession) -> DataFrame:
    """name, size of the types above."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("long").alias("size")) for n, s in SIZES.items()])
    return spark.range(1).select(F.inline(rows))
