import importlib
import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_names_and_columns():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_core_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v
    for module in ("messages", "trees", "diffs", "reviews", "events", "search", "code", "context"):
        plans = importlib.import_module(f"codesift.plans.{module}")
        for name, query in plans.QUERIES.items():
            df = query(spark, SMALL)
            columns = sorted(df.columns)
            got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
            if name in plans.SQL:
                found = con.sql(plans.SQL[name])
                assert sorted(found.columns) == columns, name
                at = [found.columns.index(c) for c in columns]
                assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr), name
