"""The full view from narrow rows against the wide way, and its ranks."""

import pandas as pd

from crosstide import catalog
from crosstide.functions import rank_kernel
from crosstide.operators import features as V
from crosstide.schema import DATE, KEYS, LABEL
from crosstide.sources.panel import bars


def frame(df):
    return df.toPandas()[[*KEYS, *catalog.FULL]].sort_values(KEYS).reset_index(drop=True)


def test_narrow_rows_give_the_wide_view_and_its_ranks(spark, folder, monkeypatch):
    panel = bars(spark, folder, labelled=True).filter(f"{DATE} < 19930101").cache()
    df = V.full_rows(panel, keep=[LABEL])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_ranks" in plan  # ranks come back to the sources, and the wide map is above every shuffle
    assert plan.index("MapInArrow") < plan.index("Exchange hashpartitioning")
    found, ranked = frame(df), frame(V.ranked_view(panel))
    monkeypatch.setattr(rank_kernel, "CELL_LIMIT", 0)
    pd.testing.assert_frame_equal(found, frame(V.full_rows(panel, keep=[LABEL])), check_dtype=False, rtol=1e-9)
    pd.testing.assert_frame_equal(ranked, frame(V.ranked_view(panel)), check_dtype=False, rtol=1e-9)


def test_only_what_dates_need_is_moved(spark, folder):
    """Ranks come back alone and meet the rows of their entity there; wide rows would need no such step."""
    panel = bars(spark, folder, labelled=True).filter(f"{DATE} < 19930101").cache()
    plan = V.full_rows(panel, keep=[LABEL])._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan
