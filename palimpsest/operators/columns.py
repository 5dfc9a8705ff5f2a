"""Tables as histories of column operations: what each statement does to columns, and the fold to a final table.

Operations are told by patterns in DataFrame functions. The fold keeps a state that renames move about, so it runs in a
small Python function that reads the operations of its partition's tables one after the other, in order; it holds the state of
one table, not its history.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identifiers import RESERVED, name_parts, quoted_if_needed, written_name
from palimpsest.operators.statements import NAME, bare, body, flat, items, object_name, once, uncommented

CONSTRAINT = r"(?i)^(CONSTRAINT|PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE|LIKE)\b"
#: A CREATE TABLE that lists its columns, and what may follow the list.
LISTED = rf"(?is)^CREATE\s+((?:UNLOGGED|TEMP|TEMPORARY|GLOBAL|LOCAL)\s+)*TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\("
SUFFIX = r"(?is)\)\s*((?:WITH|WITHOUT|PARTITION BY|INHERITS|TABLESPACE|ON COMMIT|USING)\b[^)]*(?:\([^)]*\)[^)]*)*)?$"


def plain(sql: Column) -> Column:
    """Comments out, ends trimmed; quoted text untouched."""
    return F.regexp_replace(uncommented(sql), r"^\s+|\s+$", "")


def squeezed(sql: Column) -> Column:
    """Comments out, white space collapsed, but not within quotes."""
    # what stands between white space, quoted text in one
    words = rf"(?s)(?:[^\s'\"$]++|'[^']*+(?:''[^']*+)*+'|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|{body(1)}|['\"$])++"
    return F.array_join(F.regexp_extract_all(plain(sql), F.lit(words), F.lit(0)), " ")


def created_items(text: Column) -> Column:
    """The items of a squeezed CREATE TABLE."""
    return items(F.regexp_replace(F.regexp_replace(text, SUFFIX, ""), r"(?s)^[^(]*\(", ""))


def altered_items(text: Column) -> Column:
    """The items of a squeezed ALTER TABLE."""
    head = rf"(?is)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{NAME}(?:\s*\*)?\s*"
    return items(F.regexp_replace(text, head, ""))


def can_be_folded(sql: Column) -> Column:
    """A CREATE TABLE with a list of columns; not AS, PARTITION OF or OF a type."""
    return flat(sql).rlike(LISTED)


def _op(op: str, column: Column, arg: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), column.alias("column"), arg.alias("arg"))


#: What an ALTER TABLE item does: operation, pattern, group of the column or constraint, group of the argument.
ACTIONS = (
    ("ADD_CONSTRAINT", rf"^ADD (CONSTRAINT {NAME} .*|(?:PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE)\b.*)$", 2, 1),
    ("ADD", rf"^ADD (?:COLUMN )?(?:IF NOT EXISTS )?{NAME} (.*)$", 1, 2),
    ("DROP_CONSTRAINT", rf"^DROP CONSTRAINT (?:IF EXISTS )?{NAME}", 1, 0),
    ("DROP", rf"^DROP (?:COLUMN )?(?:IF EXISTS )?{NAME}", 1, 0),
    ("RENAME_TABLE", rf"^RENAME TO {NAME}$", 1, 1),
    ("RENAME", rf"^RENAME (?:COLUMN )?{NAME} TO {NAME}$", 1, 2),
    ("TYPE", rf"^ALTER (?:COLUMN )?{NAME} (?:SET DATA )?TYPE (.*?)(?: USING .*)?$", 1, 2),
    ("SET_DEFAULT", rf"^ALTER (?:COLUMN )?{NAME} SET DEFAULT (.*)$", 1, 2),
    ("DROP_DEFAULT", rf"^ALTER (?:COLUMN )?{NAME} DROP DEFAULT$", 1, 0),
    ("SET_NOT_NULL", rf"^ALTER (?:COLUMN )?{NAME} SET NOT NULL$", 1, 0),
    ("DROP_NOT_NULL", rf"^ALTER (?:COLUMN )?{NAME} DROP NOT NULL$", 1, 0),
    ("VALIDATE", rf"^VALIDATE CONSTRAINT {NAME}$", 1, 0),
    ("ROW_SECURITY", r"^((?:NO )?(?:ENABLE|DISABLE|FORCE) ROW LEVEL SECURITY)$", 1, 1),
)


def folded_name(name: Column) -> Column:
    """A dotted name, folded; public is the schema of names without one."""
    return F.regexp_replace(F.array_join(name_parts(name), "."), r"^public\.(?=.)", "")


_folded = folded_name


def column_operations(statements: DataFrame) -> DataFrame:
    """key, seq, idx, sub, op, column, arg of statements(seq, idx, sql, operation, object_type): each column and constraint
    of a CREATE TABLE and each item of an ALTER TABLE; OTHER for items that no pattern knows."""
    own = statements.where("object_type = 'TABLE' and operation in ('CREATE', 'ALTER')")
    creates = F.col("operation") == "CREATE"

    def told(text: Column) -> Column:
        listed = F.when(creates, created_items(text)).otherwise(altered_items(text))
        return F.struct(listed.alias("items"), F.when(creates, F.regexp_extract(text, SUFFIX, 1)).alias("after"))

    def headed(head: Column) -> Column:
        before = F.regexp_extract(head, r"^CREATE ((?:UNLOGGED |TEMP |TEMPORARY |GLOBAL |LOCAL )*)TABLE", 1)
        return F.struct(head.rlike(r"^CREATE [A-Z ]*TABLE IF NOT EXISTS\b").alias("conditional"), before.alias("before"))

    # each is worked out once for a statement
    head = F.when(creates, once(bare(F.col("sql")), headed))
    read = own.select(_folded(object_name(F.col("sql"))).alias("key"), "seq", "idx", "operation", once(squeezed(F.col("sql")), told).alias("t"), head.alias("h"))
    each = read.select(
        "key", "seq", "idx", "operation", F.coalesce("h.conditional", F.lit(False)).alias("conditional"),
        F.when(creates, F.struct("h.before", "t.after")).alias("beside"), F.posexplode("t.items").alias("sub", "item"),
    )
    item = F.col("item")
    group = lambda p, g: F.regexp_extract(item, "(?is)" + p, g)
    made = (
        F.when(item.rlike(CONSTRAINT), _op("ADD_CONSTRAINT", _folded(group(rf"^CONSTRAINT {NAME}", 1)), item))
        .otherwise(_op("ADD", _folded(group(rf"^{NAME}", 1)), group(rf"^{NAME}\s*(.*)$", 2)))
    )
    known = [F.when(item.rlike("(?is)" + p), _op(op, _folded(group(p, c)), group(p, a) if a else F.lit(""))) for op, p, c, a in ACTIONS]
    changed = F.coalesce(*known, _op("OTHER", F.lit(""), item))
    done = each.withColumn("o", F.when(F.col("operation") == "CREATE", made).otherwise(changed))
    starts = (F.col("operation") == "CREATE") & (F.col("sub") == 0)
    return done.select("key", "seq", "idx", "sub", starts.alias("starts"), "conditional", "beside", "o.op", "o.column", "o.arg")


#: Words that begin a clause of a column's definition, where they stand outside of parentheses.
CLAUSES = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "GENERATED", "COLLATE", "CONSTRAINT"}
SCAN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\w+|[^\s\w]")


@lru_cache(4096)
def column_parts(definition: str) -> dict:
    """type, default, not_null and the rest of a column's definition."""
    depth, last, cuts = 0, "", []
    for m in SCAN.finditer(definition):
        word = m[0].upper()
        depth += (word in "([") - (word in ")]")
        # SET NULL, BY DEFAULT, DEFAULT NULL and NOT NULL are one each
        if depth == 0 and word in CLAUSES and last not in ("SET", "BY", "DEFAULT") and (last, word) != ("NOT", "NULL"):
            cuts.append(m.start())
        last = word
    kind, *clauses = (definition[i:j].strip() for i, j in zip([0, *cuts], [*cuts, len(definition)], strict=True))
    found = {"type": kind, "default": None, "not_null": False, "rest": ""}
    rest: list[str] = []
    for clause in clauses:
        word = " ".join(clause.upper().split())
        if word in ("NOT NULL", "NULL") or word.startswith("DEFAULT"):
            if rest and re.fullmatch(r"(?i)CONSTRAINT\s+\S+", rest[-1]):  # a name for what is no constraint of its own here
                rest.pop()
            found |= {"default": clause[7:].strip()} if word.startswith("DEFAULT") else {"not_null": word == "NOT NULL"}
        else:
            rest.append(clause)
    return found | {"rest": " ".join(rest)}


PLAIN_NAME = re.compile(r"[a-z_][a-z0-9_$]*")
TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_][\w$]*")


def quoted(name: str) -> str:
    return name if PLAIN_NAME.fullmatch(name) and name not in RESERVED else '"' + name.replace('"', '""') + '"'


def folded(name: str) -> str:
    return name[1:-1].replace('""', '"') if name.startswith('"') else name.lower()


def names_in(text: str) -> set[str]:
    """Names, folded, that stand in text outside of strings; function calls don't count."""
    return {folded(m[0]) for m in TOKEN.finditer(text) if m[0][0] != "'" and text[m.end() : m.end() + 1] != "("}


def renamed_in(text: str, old: str, new: str) -> str:
    """text with another name for a column, outside of strings; what follows REFERENCES is another table's."""

    def swap(m: re.Match) -> str:
        call = text[m.end() : m.end() + 1] == "("
        return quoted(new) if m[0][0] != "'" and not call and folded(m[0]) == old else m[0]

    own, mark, other = re.split(r"(\bREFERENCES\b)", text, maxsplit=1, flags=re.I) if re.search(r"\bREFERENCES\b", text, re.I) else (text, "", "")
    text = own
    return TOKEN.sub(swap, own) + mark + other


def own_names(constraint: str) -> set[str]:
    """Columns of its own table that a constraint may be about."""
    return names_in(re.split(r"\bREFERENCES\b", constraint, maxsplit=1, flags=re.I)[0])


def column_text(name: str, c: dict) -> str:
    parts = [quoted(name), c["type"], c["rest"], f"DEFAULT {c['default']}" if c["default"] else "", "NOT NULL" if c["not_null"] else ""]
    return " ".join(p for p in parts if p)


DOTTED = re.compile(r'(?:"(?:[^"]|"")*"|[A-Za-z_][\w$]*)(?:\.(?:"(?:[^"]|"")*"|[A-Za-z_][\w$]*))*')
#: A reference with its actions, a function's name or a sequence's, and the column that a change is about.
REFERRING = re.compile(
    rf"(?i)\s*(?:\bCONSTRAINT\s+\S+\s+)?\bREFERENCES\s+({DOTTED.pattern})(?:\s*\([^)]*\))?"
    r"(?:\s*\b(?:ON (?:DELETE|UPDATE) (?:CASCADE|RESTRICT|NO ACTION|SET NULL|SET DEFAULT)|MATCH (?:FULL|SIMPLE|PARTIAL)|(?:NOT )?DEFERRABLE|INITIALLY (?:DEFERRED|IMMEDIATE)))*"
)
USED = re.compile(rf"({DOTTED.pattern})\s*\(|'([^']*)'(?=\s*(?:::|\)))")
ABOUT_COLUMN = re.compile(r'(?i)ALTER\s+(?:COLUMN\s+)?("(?:[^"]|"")*"|[A-Za-z_][\w$]*)\s')


def folded_dotted(name: str) -> str:
    whole = ".".join(folded(x) for x in re.findall(r'"(?:[^"]|"")*"|[^."]+', name))
    return whole.removeprefix("public.")


def targets(text: str) -> set[str]:
    """Tables that a constraint refers to."""
    return {folded_dotted(m[1]) for m in REFERRING.finditer(text)}


class Operation(NamedTuple):
    key: str
    seq: object
    idx: object
    starts: bool
    conditional: bool
    before: str
    after: str
    op: str
    column: str
    arg: str


def folded_table(rows: Iterable[Operation]) -> list[tuple]:
    """part, name, text, status, was: the final table of one key's operations in order. Its columns and constraints, each with its
    text, status (ADDED, MODIFIED or RENAMED) and former name, SECURITY and OTHER for what stands beside the CREATE, and BEFORE and
    AFTER for what stands around the list.

    Constraints follow their columns: they are renamed with them, and go with a dropped one. What the fold can't place (a
    change of a column or constraint that it doesn't know) is kept as an item of its own. A CREATE IF NOT EXISTS of a table
    that is there changes nothing.
    """
    columns: dict[str, dict] = {}
    constraints: dict[str, str] = {}
    other: list[str] = []
    enabled = forced = False
    before = after = ""
    skipped = None
    for r in rows:
        op, name, arg = r.op, r.column, r.arg
        if r.starts:
            if r.conditional and columns:
                skipped = (r.seq, r.idx)
            else:
                columns, constraints, other, enabled, forced, skipped = {}, {}, [], False, False, None
                before, after = r.before, r.after
        if skipped == (r.seq, r.idx):
            continue
        changes = op in ("TYPE", "SET_DEFAULT", "DROP_DEFAULT", "SET_NOT_NULL", "DROP_NOT_NULL")
        if op == "ADD":
            columns.setdefault(name, column_parts(arg) | {"status": "ADDED", "was": None})
        elif op == "DROP":
            columns.pop(name, None)
            other = [text for text in other if not (m := ABOUT_COLUMN.match(text)) or folded(m[1]) != name]
            constraints = {k: text for k, text in constraints.items() if name not in own_names(text) - {k}}
        elif op == "RENAME" and name in columns:
            new = folded(arg)
            moved = columns[name] | {"status": "RENAMED", "was": columns[name]["was"] or name}
            columns = {new if k == name else k: moved if k == name else v for k, v in columns.items()}
            for c in columns.values():
                c["rest"] = renamed_in(c["rest"], name, new)
            constraints = {k: _renamed_constraint(text, name, new) for k, text in constraints.items()}
            other = [renamed_in(text, name, new) for text in other]
        elif changes and name in columns:
            change = {
                "TYPE": {"type": arg}, "SET_DEFAULT": {"default": arg}, "DROP_DEFAULT": {"default": None},
                "SET_NOT_NULL": {"not_null": True}, "DROP_NOT_NULL": {"not_null": False},
            }[op]
            columns[name] |= change | ({"status": "MODIFIED"} if columns[name]["status"] == "ADDED" else {})
        elif changes or op == "RENAME":
            done = {"TYPE": f"TYPE {arg}", "SET_DEFAULT": f"SET DEFAULT {arg}", "RENAME": arg}.get(op, op.replace("_", " "))
            other.append(f"RENAME COLUMN {quoted(name)} TO {done}" if op == "RENAME" else f"ALTER COLUMN {quoted(name)} {done}")
        elif op == "ADD_CONSTRAINT":
            constraints[name or f"#{len(constraints)}"] = arg
        elif op == "DROP_CONSTRAINT" and name in constraints:
            del constraints[name]
        elif op == "DROP_CONSTRAINT":  # the table's own name for one without a name
            other.append(f"DROP CONSTRAINT IF EXISTS {quoted(name)}")
        elif op == "VALIDATE" and name in constraints:
            constraints[name] = re.sub(r"\s+NOT VALID$", "", constraints[name], flags=re.I)
        elif op == "VALIDATE":
            other.append(f"VALIDATE CONSTRAINT {quoted(name)}")
        elif op == "ROW_SECURITY":
            word = arg.upper().split()[0]
            enabled = word == "ENABLE" if word in ("ENABLE", "DISABLE") else enabled
            forced = word == "FORCE" if word in ("FORCE", "NO") else forced
        elif op == "OTHER":
            other.append(arg)
        elif op == "UNREFER":
            constraints = {k: text for k, text in constraints.items() if name not in targets(text)}
            for c in columns.values():
                c["rest"] = REFERRING.sub(lambda m: "" if folded_dotted(m[1]) == name else m[0], c["rest"]).strip()  # noqa: B023
        elif op == "UNTYPE":
            gone = {k for k, c in columns.items() if (m := DOTTED.match(c["type"])) and folded_dotted(m[0]) == name}
            columns = {k: c for k, c in columns.items() if k not in gone}
            constraints = {k: text for k, text in constraints.items() if not gone & (own_names(text) - {k})}
        elif op == "UNDEFAULT":
            for c in columns.values():
                if c["default"] and name in {folded_dotted(m[1] or m[2]) for m in USED.finditer(c["default"])}:
                    c["default"] = None
    security = ["ENABLE ROW LEVEL SECURITY"] * enabled + ["FORCE ROW LEVEL SECURITY"] * forced
    out = [("COLUMN", n, column_text(n, c), c["status"], c["was"]) for n, c in columns.items()]
    out += [("CONSTRAINT", n, text, "ADDED", None) for n, text in constraints.items()]
    out += [(part, "", text, "ADDED", None) for part, text in (("BEFORE", before), ("AFTER", after)) if text]
    return out + [("OTHER", "", text, "ADDED", None) for text in other] + [("SECURITY", "", text, "ADDED", None) for text in security]


def _renamed_constraint(text: str, old: str, new: str) -> str:
    """A constraint's own name stays when a column of that name gets another."""
    head = re.match(rf"(?i)CONSTRAINT\s+(?:\"(?:[^\"]|\"\")*\"|[\w$]+)\s+", text)
    at = head.end() if head else 0
    return text[:at] + renamed_in(text[at:], old, new)


STATE = pa.schema([("key", pa.string()), ("place", pa.int64()), *[(n, pa.string()) for n in ("part", "name", "text", "status", "was")]])


def _folded_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of the tables whose operations come one table after the other, each in order."""
    listed = lambda column: column.to_numpy(zero_copy_only=False).tolist()
    rows = (r for batch in batches for r in map(Operation, *(listed(batch.column(n)) for n in Operation._fields)))
    out = []
    for key, own in groupby(rows, lambda r: r.key):
        out += [(key, i, *x) for i, x in enumerate(folded_table(own))]
        if len(out) >= 10000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STATE, strict=True)], schema=STATE)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STATE, strict=True)], schema=STATE)


def table_states(operations: DataFrame) -> DataFrame:
    """key, place, part, name, text, status, was: the parts of the final form of every table."""
    schema = "key string, place long, part string, name string, text string, status string, was string"
    flat_ = operations.select("key", "seq", "idx", "sub", "starts", "conditional", "beside.before", "beside.after", "op", "column", "arg")
    dealt = flat_.repartition("key").sortWithinPartitions("key", "seq", "idx", "sub")
    return dealt.select(*Operation._fields).mapInArrow(_folded_tables, schema)


def foreign_keys(states: DataFrame) -> DataFrame:
    """key, place, target of the parts of tables that refer to a table."""
    target = F.regexp_extract("text", rf"(?i)\bREFERENCES {NAME}", 1)
    return states.where("part in ('COLUMN', 'CONSTRAINT')").withColumn("t", target).where("t != ''").select(
        "key", "place", _folded(F.col("t")).alias("target")
    )


def create_table(states: DataFrame, deferred: DataFrame) -> DataFrame:
    """key, sql of each table, without the references of deferred(key, place)."""
    late = deferred.withColumn("late", F.lit(True))
    own = states.where("part in ('COLUMN', 'CONSTRAINT', 'BEFORE', 'AFTER')").join(late, ["key", "place"], "left")
    text = F.when(F.col("late"), F.when(F.col("part") == "COLUMN", _without_reference(F.col("text")))).otherwise(F.col("text"))
    listed = F.when(F.col("part").isin("COLUMN", "CONSTRAINT") & text.isNotNull(), F.struct("place", text.alias("text")))
    around = lambda part: F.coalesce(F.max(F.when(F.col("part") == part, F.col("text"))), F.lit(""))
    made = own.groupBy("key").agg(F.array_sort(F.collect_list(listed)).alias("parts"), around("BEFORE").alias("before"), around("AFTER").alias("after"))
    body = F.array_join(F.transform("parts", lambda p: p["text"]), ", ")
    after = F.when(F.col("after") == "", "").otherwise(F.concat(F.lit(" "), F.col("after")))
    return made.select("key", F.concat(F.lit("CREATE "), F.col("before"), F.lit("TABLE "), written_name(F.col("key")), F.lit(" ("), body, F.lit(")"), after).alias("sql"))


REFERENCE = rf"(?i)\s*\bREFERENCES {NAME}(?:\s*\([^)]*\))?(?:\s+ON (?:DELETE|UPDATE) (?:CASCADE|RESTRICT|NO ACTION|SET NULL|SET DEFAULT))*"


def _without_reference(text: Column) -> Column:
    return F.regexp_replace(text, REFERENCE, "")


def deferred_references(states: DataFrame, deferred: DataFrame) -> DataFrame:
    """key, place, sql: an ALTER TABLE for each reference that was left out of its CREATE."""
    own = states.join(deferred, ["key", "place"])
    of_column = F.concat(F.lit("FOREIGN KEY ("), quoted_if_needed(F.col("name")), F.lit(") "), F.trim(F.regexp_extract("text", REFERENCE, 0)))
    added = F.when(F.col("part") == "COLUMN", of_column).otherwise(F.col("text"))
    return own.select("key", "place", F.concat(F.lit("ALTER TABLE "), written_name(F.col("key")), F.lit(" ADD "), added).alias("sql"))
