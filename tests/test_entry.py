import sys

import __spark_entry__ as E
from tessera import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 4 and "median" in df.columns


def test_every_query_is_a_callable_and_sql_names_are_queries():
    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert len(catalog.queries()) > 80


def test_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert E.queries().keys() == catalog.queries().keys() and E.oracle_sql().keys() == catalog.oracle_sql().keys()
