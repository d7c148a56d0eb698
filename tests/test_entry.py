"""The registered queries: names, SQL, and results against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


@needs_data
@pytest.mark.parametrize("name", ["scan_filter_topk", "meta_typed_matrix", "thread_list", "adjacent_dedup", "knn_l2", "best_chunk_per_entry", "fts_boolean", "hybrid_rrf", "grep_count", "retention_delete"])
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = c.sql(E.oracle_sql()[name])
    df = E.queries()[name](spark, SF)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall() if hasattr(want, "fetchall") else want.limit(10**9).fetchall())


@needs_data
def test_flagship(spark):
    assert E.entry(spark).count() > 0
