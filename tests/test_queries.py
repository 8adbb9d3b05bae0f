"""A spread of registered queries beside their oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
import check

D = "/root/testdata/sf0.001"
KEYS = ["gate_funnel", "funnel_verdict", "tx_labels", "pairs_expand", "cover_rank", "slot_folds", "classifier_summary", "selectivity", "budget_threshold", "oof_priors",
        "candidate_routes", "later_arbs", "race_matrix", "gap_attribution", "latency_spans", "base_cycle_flag", "three_hop_cycles", "stream_counters_1s", "vocabulary", "write_parts"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, con, key):
    df = entry_module.queries()[key](spark, D)
    cur = con.execute(entry_module.oracle_sql()[key])
    assert check.compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall()) is None


@pytest.mark.parametrize("key", ["tx_labels", "selectivity", "key_dictionary", "unknown_groups", "feed_race_summary"])
def test_order_statistics_queries(spark, con, key):
    test_query_equals_oracle(spark, con, key)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 11
