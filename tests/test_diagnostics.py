"""Turnover diagnostics from whole dates against the sliced way."""

import numpy as np
import pandas as pd
import pytest

from crosstide.functions.groups import GroupSizes
from crosstide.operators import evaluate as E
from crosstide.schema import LABEL
from helpers import dates, predictions


@pytest.mark.parametrize("policy", [E.OFFICIAL.adjusted(5, 10), E.PROVISIONAL])
def test_whole_dates_equal_the_sliced_way(spark, policy):
    rng, rows = np.random.default_rng(3), []
    for j, d in enumerate(dates(8)):
        for i in range(4 if j == 4 else 47):  # one date is too thin and breaks the chain
            pred = None if rng.random() < 0.1 else float(rng.integers(0, 12))
            rows.append((f"{i:06d}.SZ", d, pred, None if rng.random() < 0.3 else float(rng.normal()), float(rng.random() < 0.1)))
    df = predictions(spark, rows)
    found = E.diagnostics(df, policy)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    runs = df.selectExpr("*", "'x' AS model").union(df.selectExpr("*", "'thin' AS model").filter("ts_code < '000005'"))
    for left, right in ((found, E.diagnostics(df, policy, sizes=GroupSizes(2, 10**9, 1))),
                        (E.diagnostics(runs, policy, ["model"]), E.diagnostics(runs, policy, ["model"], GroupSizes(2, 10**9, 1)))):
        a, b = left.toPandas(), right.toPandas()
        assert len(a) == 1 and 0 < a.missing_top_fraction[0] < 1 and a.turnover_gap[0] != 0
        pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False)
