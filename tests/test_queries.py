"""A few registered queries of each area against their SQL at the smallest scale.

``python tests/oracle_check.py`` runs all of them.
"""

import pytest

import __spark_entry__ as entry
from oracle_check import difference, oracle

CHECKED = ["w01_lag_return", "w09_ema_deviation", "w21_paired_correlation", "c08_pct_rank", "t05_relevance", "f04_fold_summary",
           "a01_column_profile", "a18_label_check", "e17_score_runs", "d03_group_returns", "u02_hysteresis_sets", "j08_calendar_adjacency"]


@pytest.fixture(scope="module")
def sql(folder):
    return oracle(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, folder, sql, name):
    left = entry.queries()[name](spark, folder).toPandas()
    assert not difference(left, sql.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
