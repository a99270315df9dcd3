import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["degree", "adjacency", "delete_arcs", "cap_arc_cov", "gfa_lines", "reverse_complement", "overlap_lengths", "flip_ids", "symmetrise"]


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert all(callable(f) for f in queries.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = db.sql(entry.oracle_sql()[name])
    names = list(want.columns)
    assert sorted(names) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
