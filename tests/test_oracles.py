"""Queries over scripts against their SQL, on small tables made here."""

import json

import duckdb
import pytest

from palimpsest.plans import catalogue, shapes

#: Queries of whole histories take longest; those of single statements share one session and little data.
SLOW = {"compact_order", "history_equivalence", "edges_without_cycles", "schema_evidence", "cycles_in_rings"}
NAMES = [n for n in shapes.QUERIES if n not in SLOW]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    made = {
        "orders": "SELECT i AS o_orderkey, i % 7 AS o_custkey, TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * i AS o_orderdate FROM range(1, 66) t(i)",
        "customer": "SELECT i AS c_custkey, CAST(i % 25 AS INTEGER) AS c_nationkey FROM range(1, 121) t(i)",
        "part": "SELECT i AS p_partkey, 'b' || (i % 4) AS p_brand, CAST(i % 9 AS INTEGER) AS p_size, 'x' AS p_type FROM range(1, 61) t(i)",
        "supplier": "SELECT i AS s_suppkey, CAST(i % 25 AS INTEGER) AS s_nationkey FROM range(1, 27) t(i)",
        "nation": "SELECT CAST(i AS INTEGER) AS n_nationkey, 'n' || i AS n_name, CAST(i % 5 AS INTEGER) AS n_regionkey FROM range(0, 25) t(i)",
        "lineitem": "SELECT i // 3 AS l_orderkey, CAST(i % 3 AS INTEGER) AS l_linenumber, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(0, 90) t(i)",
        "documents": "SELECT i AS doc_id, CASE WHEN i % 9 > 0 THEN 'a' || chr(10) || repeat('x' || chr(10), CAST(i AS INTEGER)) END AS text FROM range(0, 40) t(i)",
        "events": """SELECT i AS event_id, TIMESTAMP '2020-01-01' + INTERVAL 1 HOUR * (i * 7 % 97) AS ts, i % 11 AS user_id,
            ['signup', 'view', 'click', 'purchase', 'error'][1 + CAST(i * 13 % 5 AS INTEGER)] AS event_type, i * 0.5 AS value, '{"k": "' || (i % 3) || '"}' AS props FROM range(0, 200) t(i)""",
    }
    for name, sql in made.items():
        path = folder / f"{name}.parquet"
        con.execute(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return str(folder), con


def plain(value):
    if hasattr(value, "is_integer") and value.is_integer():
        return str(int(value))
    return json.dumps(value) if isinstance(value, list) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    folder, con = tables
    got = catalogue.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()])
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows
