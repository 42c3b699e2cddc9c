"""Registered queries: names, SQL twins, and a few of them end to end."""

import duckdb
import pytest

import __spark_entry__ as entry
from siftwell.plans import load
from siftwell.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"chunk_chars", "build_cells", "ivf_search", "lsh_search"}


def test_every_query_has_sql_but_the_listed_ones():
    load()
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["knn_topk", "chunk_greedy", "ttl_reuse", "metric_batches", "stream_metric_windows"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall())))
    df = entry.queries()[name](spark, FOLDER)
    got = sorted(str(tuple(r[c] for c in sorted(names))) for r in df.collect())
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
