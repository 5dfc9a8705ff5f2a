import __spark_entry__ as entry


def test_every_query_has_a_known_name_and_oracle():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {n for n in queries if not n.startswith("op") and n != "pipeline"} <= set(oracles) | {"operation_breakdown"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
