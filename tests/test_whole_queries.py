"""Queries that stand beside one whose SQL covers a part of the table."""

import os

import pytest

from landgraph.plans import catalog

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


def agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    got = sorted(map(tuple, catalog.queries()[name](spark, TABLES).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    return got, con


def test_components_of_all_events(spark):
    got, con = agree(spark, "components_bipartite_whole")
    assert len(got) == sum(con.execute("SELECT count(DISTINCT user_id), count(DISTINCT event_type) FROM events").fetchone())


def test_search_by_joins_of_the_whole_raster(spark):
    got, _ = agree(spark, "lcp_by_joins_whole")
    assert len(got) == 3 * 24 * 24


def test_the_flow_between_nations_is_summed_once(spark):
    """What is made of it reads the stored sums, however often, and no table of lines again."""
    files = catalog.trade(spark, TABLES).inputFiles()
    assert files and not any("lineitem" in f for f in files)
