"""Driver contract: entry runs, every oracle has a query, names are aliased."""
from tests.conftest import SF_SMALL

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "block_scope" in df.columns


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_core_queries_match_oracle_small(spark):
    import duckdb
    from tools.oracle_check import TABLES, norm
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ["f1_eligible_flows", "a1_dst_aggregates", "j1_with_dst_aggregates", "w3_priority_sample",
                 "w7_ttl_counter", "st1_admit", "st3_block_episodes", "l2_source_ranking", "m14_auc"]:
        a = norm(q[name](spark, SF_SMALL).toPandas())
        b = norm(con.execute(o[name]).fetchdf())
        assert a.equals(b), name
