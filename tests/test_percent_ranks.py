"""Ranks of many columns as arrays against the windows."""

import pandas as pd

from crosstide.functions import rank_kernel
from crosstide.operators import cross
from crosstide.plans.registry import QUERIES
from crosstide.schema import DATE, KEYS
from crosstide.sources.panel import bars

COLUMNS = {"close": "r_close", "vol": "r_vol", "flag_limit_up": "r_flag", "void": "r_void"}


def test_many_ranks_equal_the_windows(spark, folder, monkeypatch):
    panel = bars(spark, folder).filter(f"{DATE} < 19950301").selectExpr("*", "CASE WHEN vol > 20 THEN NULL ELSE vol END AS void").cache()
    frame = lambda df: df.toPandas().sort_values(KEYS).reset_index(drop=True)
    found = cross.percent_ranks(panel, COLUMNS)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    found = frame(found)
    assert found.r_void.isna().any() and found.r_close.notna().any()
    monkeypatch.setattr(rank_kernel, "CELL_LIMIT", 0)
    pd.testing.assert_frame_equal(found, frame(cross.percent_ranks(panel, COLUMNS)), check_exact=True)


def test_rank_queries_sort_no_row_per_column(spark, folder):
    for name in ("c08_pct_rank", "c09_rank_view"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "rank(" not in plan, name
