"""The catalog as relations: single definitions by hand, histories, and the registered queries against their SQL."""

import duckdb
import pytest

from palimpsest.plans import catalog, catalog_queries

SCRIPT = """
CREATE TABLE s.t (id serial PRIMARY KEY, a int DEFAULT 'x DEFAULT y' NOT NULL, b varchar(10) UNIQUE CHECK (b > 'a'),
  c bigint REFERENCES public.p (id) ON DELETE CASCADE, g int GENERATED ALWAYS AS (a * 2) STORED, k int GENERATED BY DEFAULT AS IDENTITY,
  CONSTRAINT low CHECK (a > (1)), UNIQUE (a, b), CHECK (a < 9), CHECK (a <> 5));
CREATE UNIQUE INDEX i ON s.t USING gin (lower(b), a) WHERE a > 3;
CREATE TRIGGER g BEFORE UPDATE OF a OR INSERT ON s.t FOR EACH ROW WHEN (NEW.a > 1) EXECUTE FUNCTION s.f();
CREATE POLICY p ON s.t FOR SELECT TO r, app USING (id = (1)) WITH CHECK (true); CREATE POLICY p ON u AS RESTRICTIVE USING (true);
CREATE SEQUENCE q START 5 INCREMENT BY -2; ALTER SEQUENCE q CYCLE OWNED BY s.t.id;
CREATE TYPE s.e AS ENUM ('a', 'it''s'); CREATE DOMAIN d AS text CHECK (VALUE <> ''); CREATE TYPE cc AS (x int, y numeric(3,2));
COMMENT ON COLUMN s.t.a IS 'x'; COMMENT ON COLUMN s.t.a IS NULL; COMMENT ON TABLE s.t IS 'it''s;'; what is this
"""


def scripts(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, content string")


def rows(df, *names):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*names).collect()), key=str)


def test_relations_by_hand(spark):
    c = catalog.relations(scripts(spark, SCRIPT, None, ""))
    assert [x[1:] for x in rows(c["columns"], "place", "name", "type", "not_null", "default", "generated", "identity")] == [
        ("id", "integer", True, "nextval('s.t_id_seq'::regclass)", None, None), ("a", "integer", True, "'x DEFAULT y'", None, None),
        ("b", "character varying(10)", False, None, None, None), ("c", "bigint", False, None, None, None),
        ("g", "integer", False, None, "(a * 2)", None), ("k", "integer", True, None, None, "BY DEFAULT"),
    ]
    assert rows(c["constraints"], "name", "kind", "columns", "on_delete") == [
        ("low", "c", (), None), ("t_a_b_key", "u", ("a", "b"), None), ("t_b_check", "c", ("b",), None), ("t_b_key", "u", ("b",), None),
        ("t_c_fkey", "f", ("c",), "CASCADE"), ("t_check", "c", (), None), ("t_check1", "c", (), None), ("t_pkey", "p", ("id",), None),
    ]
    assert ("i", "gin", ("lower(b)", "a"), "a > 3") in rows(c["indexes"].where("not primary and predicate is not null"), "name", "method", "columns", "predicate")
    assert rows(c["triggers"], "events", "routine", "condition") == [(("INSERT", "UPDATE"), "s.f", "NEW.a > 1")]
    assert rows(c["policies"], "table", "permissive", "roles", "using") == [("t", True, ("app", "r"), "id = (1)"), ("u", False, ("public",), "true")]
    assert rows(c["sequences"].where("name = 'q'"), "start", "increment", "maximum", "cycles", "owned_by") == [(5, -2, -1, True, "s.t.id")]
    assert rows(c["types"], "name", "kind", "members") == [
        ("cc", "composite", ("x int", "y numeric(3,2)")), ("d", "domain", ("text CHECK (VALUE <> '')",)), ("e", "enum", ("a", "it's"))
    ]
    assert rows(c["comments"], "object", "comment") == [("s.t", "it's;")]


def test_nothing_gives_empty_relations(spark):
    c = catalog.relations(scripts(spark, None, "", "-- only this", "SELECT 1"))
    assert all(c[name].count() == 0 for name in catalog.Catalog.MADE_BY) and catalog.signature_lines(c).count() == 0


def test_histories_with_one_end_have_one_catalog(spark):
    one = scripts(spark, "CREATE TABLE t (a int, b text); ALTER TABLE t RENAME COLUMN a TO c; ALTER TABLE t ADD d int DEFAULT 3", "CREATE TABLE gone (x int); DROP TABLE gone")
    two = scripts(spark, "CREATE TABLE t (c int, b text, d int DEFAULT 3)")
    three = scripts(spark, "CREATE TABLE t (c bigint, b text, d int DEFAULT 3); CREATE VIEW v AS SELECT 1")
    first, same, other = (catalog.signature_lines(catalog.of_history(x)) for x in (one, two, three))
    assert catalog.differences(first, same).count() == 0
    assert rows(catalog.differences(first, other), "kind", "identifier", "status") == [("column", "public.t.c", "changed"), ("relation", "public.v", "right_only"), ("view", "public.v", "right_only")]


@pytest.fixture(scope="module")
def suppliers(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS s_suppkey, 'S' || i AS s_name, CAST(i % 3 AS INTEGER) AS s_nationkey, i * 1.7 - 20 AS s_acctbal FROM range(1, 32) t(i)) TO '{folder}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [n for n in catalog_queries.QUERIES if n.startswith("catalog_")])
def test_queries_equal_their_sql(spark, suppliers, name):
    folder, con = suppliers
    got = catalog_queries.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog_queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, rows(got, *columns))) == sorted(map(str, want))
