import pytest
from pyspark.sql import functions as F

from palimpsest.functions import identifiers as ids
from palimpsest.operators import graph, metrics, signature, statements
from palimpsest.sources import scripts


def values(spark, texts, make):
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, x string")
    return [r["y"] for r in own.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scripts_are_read_split_and_analysed(spark, tmp_path):
    (tmp_path / "001_create.sql").write_text(
        """-- first; comment
CREATE TABLE users (id serial PRIMARY KEY, note text DEFAULT 'a;b', org int REFERENCES orgs(id));
/* block; */ CREATE FUNCTION f() RETURNS int AS $body$ BEGIN RETURN 1; END; $body$ LANGUAGE plpgsql;
"""
    )
    (tmp_path / "002_more.sql").write_text("INSERT INTO users (note) VALUES ('x; y'); DROP TABLE IF EXISTS a, \"B c\", s.d;")
    (tmp_path / "003_empty.sql").write_text("")
    (tmp_path / "notes.sql").write_text("SELECT 1;")
    files = scripts.read_scripts(spark, str(tmp_path))
    assert sorted((r["seq"], r["filename"]) for r in files.collect()) == [(1, "001_create.sql"), (2, "002_more.sql")]
    from palimpsest.streaming.lifecycle import run_available

    run_available(scripts.stream_scripts(spark, str(tmp_path), 1), "arrived", str(tmp_path / "cp"), "append")
    assert sorted(map(tuple, spark.table("arrived").collect())) == sorted(map(tuple, files.collect()))
    rows = statements.analysed(statements.split(files, "seq", "filename")).orderBy("seq", "idx").collect()
    assert [(r["seq"], r["idx"], r["operation"], r["object_type"], r["object_name"]) for r in rows] == [
        (1, 0, "CREATE", "TABLE", "users"), (1, 1, "CREATE", "FUNCTION", "f"),
        (2, 0, "INSERT", "TABLE", "users"), (2, 1, "DROP", "TABLE", "a"),
    ]
    assert rows[0]["references"] == ["orgs"] and rows[0]["category"] == "structure"
    assert values(spark, [rows[3]["sql"]], statements.dropped_names) == [["a", '"B c"', "s.d"]]
    log = scripts.statement_log(statements.analysed(statements.split(files, "seq")))
    assert {r["key"] for r in log.collect()} == {"users::TABLE", "f::FUNCTION", "a::TABLE"}
    seen = {r["filename"]: r for r in metrics.evidence(statements.analysed(statements.split(files, "filename")), "filename").collect()}
    assert seen["001_create.sql"]["safe"] and not seen["002_more.sql"]["safe"]


def test_statement_classes(spark):
    cases = {
        "SELECT 1": "read_only", "select 'delete from t'": "read_only", "WITH a AS (SELECT 1) SELECT * FROM a": "read_only",
        "WITH a AS (DELETE FROM t RETURNING *) SELECT * FROM a": "write", "SELECT * INTO u FROM t": "ddl", "SELECT nextval('s')": "write",
        "EXPLAIN DELETE FROM t": "read_only", "EXPLAIN ANALYZE DELETE FROM t": "write", "EXPLAIN (ANALYZE, VERBOSE) SELECT 1": "read_only",
        "-- c\nINSERT INTO t VALUES (1)": "write", "COPY t TO STDOUT": "write", "DO $$ BEGIN END $$": "write", "TRUNCATE t": "ddl",
        "ALTER TABLE t ADD c int": "ddl", "VACUUM t": "maintenance", "SET x = 1": "maintenance", "SHOW x": "read_only", "FROBNICATE": "write",
    }
    assert dict(zip(cases, values(spark, list(cases), statements.statement_class))) == cases
    scripts_ = spark.createDataFrame([(1, "SELECT 1; SELECT 2"), (2, "SELECT 1; DELETE FROM t"), (3, " ;; -- x")], "f long, content string")
    classified = statements.split(scripts_, "f").withColumn("class", statements.statement_class(F.col("sql")))
    assert {r["f"]: r["read_only"] for r in statements.is_read_only(classified, "f").collect()} == {1: True, 2: False}


def test_lint_cases(spark):
    cases = [
        ("ALTER TABLE t DROP COLUMN a", ["ban-drop-column"]), ("ALTER TABLE t RENAME COLUMN a TO b", ["ban-rename-column"]),
        ("ALTER TABLE t ALTER COLUMN a TYPE bigint", ["ban-type-change"]), ("DELETE FROM t", ["block-missing-where"]),
        ("DELETE FROM t WHERE 'a' = b", []), ("CREATE UNIQUE INDEX CONCURRENTLY i ON t (a)", []), ("DROP INDEX i", ["require-concurrent-index"]),
        ("ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0)", ["constraint-missing-not-valid"]),
        ("ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID", []), ("CREATE TABLE t (a varchar(20), b int)", ["prefer-bigint", "prefer-text"]),
        ("CREATE TABLE t (a text, b bigint)", []), ("ALTER TABLE t RENAME TO u", ["ban-rename-table"]), ("DROP TABLE t", ["ban-drop-table"]),
    ]
    own = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i long, sql string")
    found = {}
    for r in statements.violations(own, "i").collect():
        found.setdefault(r["i"], []).append(r["code"])
    assert [sorted(found.get(i, [])) for i in range(len(cases))] == [sorted(c) for _, c in cases]
    noted = spark.createDataFrame([(1, "-- lint-ignore: ban-drop-table, prefer-text\nDROP TABLE t")], "i long, sql string")
    assert statements.violations(noted, "i").first()["ignored"]
    assert [r["code"] for r in statements.unused_ignores(noted, "i").collect()] == ["prefer-text"]
    assert statements.enabled_rules([], ["prefer-text"]) == ["prefer-text"] and "prefer-text" not in statements.enabled_rules(disable=["prefer-text"])
    with pytest.raises(ValueError):
        statements.enabled_rules(["no-such-rule"])


def test_identifiers_and_types(spark):
    assert values(spark, ["Abc", '"Abc"', '"a""b"', "X" * 70], ids.folded) == ["abc", "Abc", 'a"b', "x" * 63]
    assert values(spark, ['Public."b.C".d'], ids.name_parts) == [["public", "b.C", "d"]]
    assert values(spark, ["9 lives!", "", "Ok"], ids.repaired) == ["_9_lives_", "_", "ok"]
    assert values(spark, ["ok", "Not Ok"], ids.quoted_if_needed) == ["ok", '"Not Ok"']
    assert values(spark, ["VARCHAR(20)", "int4[][]", "numeric(10, 2)", "Timestamp"], ids.canonical_type) == [
        "character varying", "integer", "numeric", "timestamp without time zone",
    ]
    assert values(spark, ["int[]", "int", "text"], ids.type_size) == [-1, 4, -1]
    kinds = values(spark, ["int>bigint", "bigint>int", "int>text", "boolean>date", "int[]>bigint[]", "int>int[]", "int[]>text", "jsonb>json"],
                   lambda x: ids.cast_kind(F.split_part(x, F.lit(">"), F.lit(1)), F.split_part(x, F.lit(">"), F.lit(2))))
    assert kinds == ["implicit", "assignment", "explicit", "impossible", "implicit", "impossible", "explicit", "explicit"]


def test_signatures(spark):
    same = values(spark, ["CREATE  TABLE t(a,b) ;", "create table T ( a , b );"], signature.normalized)
    assert same[0] == same[1] == "create table t ( a , b )"
    a, b = (spark.createDataFrame([(x,) for x in t], "line string") for t in (["b", " a ", ""], ["a", "b"]))
    assert signature.fingerprint(a).first() == signature.fingerprint(b).first()
    c = spark.range(5000).select(F.col("id").cast("string").alias("line"))
    assert signature.bucketed_fingerprint(c).first() == signature.bucketed_fingerprint(c.repartition(7)).first()
    assert signature.bucketed_fingerprint(c).first() != signature.bucketed_fingerprint(c.where("id != 7")).first()


def test_graphs(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("b", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdwxyz"], "node string")
    levels = {r["node"]: r["level"] for r in graph.levels(nodes, edges).collect()}
    assert levels == {"a": 0, "b": 1, "c": 2, "d": 0, "w": None, "x": None, "y": None, "z": None}
    reach = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(edges).collect()}
    assert reach["c", "a"] == 1 and reach["x", "x"] == 3 and reach["w", "y"] == 2 and ("d", "d") not in reach
    assert {(r["src"], r["dst"], r["component"]) for r in graph.cycle_edges(edges).collect()} == {("x", "y", "x"), ("y", "z", "x"), ("z", "x", "x")}
    left = graph.without_cycles(graph.clean(edges), F.when(F.col("src") == "y", 1).otherwise(2))
    assert ("y", "z") not in {tuple(r) for r in left.select("src", "dst").collect()} and graph.cycle_edges(left).count() == 0
    order = graph.build_order(nodes, left, "node").orderBy("cyclic", "level", "rank").collect()
    spots = spark.createDataFrame([(r["node"], i) for i, r in enumerate(order)], "node string, position long")
    assert graph.out_of_order(spots, left).count() == 0 and len(order) == 8
    assert graph.induced(edges, nodes.where("node in ('a', 'b')")).distinct().count() == 1


def test_snapshots(spark, tmp_path):
    lines = spark.createDataFrame([("b|2",), ("a|1",)], "line string")
    scripts.write_snapshot(lines, str(tmp_path / "s"), "1", "16")
    got = scripts.read_snapshot(spark, str(tmp_path / "s")).collect()
    assert [(r["contract_version"], r["line"]) for r in got] == [("1", "a|1"), ("1", "b|2")]
