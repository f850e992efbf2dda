"""Registered Spark queries against their DuckDB twins (sf0.001).

A representative subset runs by default; SHOPLENS_FULL_ORACLE=1 runs all.
"""

import os

import pytest

from paths import SF001
from oracle_check import run

SUBSET = ["clean_events", "product_table", "user_table", "interaction_table", "train_table",
          "popularity_score", "topn_plus_other", "price_histogram", "join_sentiment",
          "correct_spelling", "search_result", "recommend_topn", "split_random", "factorize_ids",
          "job_monthly_incremental"]


def test_registry_has_twins():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 170


@pytest.mark.parametrize("name", SUBSET if not os.environ.get("SHOPLENS_FULL_ORACLE") else [None])
def test_oracle(spark, name):
    res = run([name] if name else None, SF001, spark=spark, verbose=False)
    bad = {k: v for k, v in res.items() if v}
    assert not bad, bad


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["user_id", "product_id", "interaction_score"]
    assert df.count() > 0
