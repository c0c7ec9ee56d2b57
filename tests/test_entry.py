"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from landgraph.plans import catalog

TABLES = "/root/testdata/sf0.001"
SAMPLE = ["rook_edges_mean", "laplacian", "set_at", "components", "lcp_single", "resistance_all", "rsp_to_targets", "total_windows", "connectivity_lcp", "sensitivity_quality", "one_hot_block_mean", "percentile_select"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries()) and len(catalog.queries()) >= 45


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_and_sql_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    df = catalog.queries()[name](spark, TABLES)
    result = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in result.description]
    order = [names.index(c) for c in df.columns]
    key = lambda row: tuple((v is None, v or 0) for v in row)
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=key)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 576
