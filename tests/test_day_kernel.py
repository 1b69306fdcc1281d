"""Daily scores and grids as array work, against the ways that cut dates into slices."""

import numpy as np
import pandas as pd

from crosstide.operators import day_kernel
from crosstide.operators import evaluate as E
from crosstide.operators import turnover as U
from crosstide.functions.groups import LIMIT_SETTING, GroupSizes
from crosstide.schema import DATE, KEYS
from helpers import dates, predictions

POLICY = E.OFFICIAL.adjusted(5, 10)


def rows(entities=37, n=9, seed=5):
    """Predictions with ties, missing labels, flags, and a date with too few tradable rows."""
    rng, out = np.random.default_rng(seed), []
    for t, day in enumerate(dates(n)):
        for i in range(entities):
            flag = 1.0 if t == 4 and i > 6 else float(rng.random() < 0.1)
            out.append((f"{i:06d}.SZ", day, float(rng.integers(0, 9)) / 4, None if rng.random() < 0.1 else float(rng.normal()), flag))
    return out


def same(a, b, order):
    a, b = (x[sorted(x.columns)].sort_values(order).reset_index(drop=True) for x in (a, b))
    assert len(a) and list(a.columns) == list(b.columns)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)


def test_grid_scores_never_copy_rows_and_equal_the_sliced_way(spark):
    df, alphas, exits = predictions(spark, rows()), [1.0, 0.4], [0.1, 0.25, 0.3]
    grid = U.control_grid(df, alphas, exits, min_pool=10)
    assert grid.dated.count() == df.count()  # one row a row, not one a point
    found, placed = U.controlled_scores(df, alphas, exits, POLICY, min_pool=10).toPandas(), grid.predictions().toPandas()
    spark.conf.set(LIMIT_SETTING, "5")
    try:
        assert U.control_grid(df, alphas, exits, min_pool=10) is None
        slow, slow_rows = U.controlled_scores(df, alphas, exits, POLICY, min_pool=10).toPandas(), U.controlled_predictions(df, alphas, exits, min_pool=10).toPandas()
    finally:
        spark.conf.unset(LIMIT_SETTING)
    same(found, slow[list(found.columns)], ["alpha", "exit_fraction"])
    same(placed, slow_rows[list(placed.columns)], ["alpha", "exit_fraction", *KEYS])


def test_scores_of_both_policies_equal_the_parts(spark):
    df = predictions(spark, [r if i % 11 else (r[0], r[1], None, *r[3:]) for i, r in enumerate(rows())])
    for policy in (POLICY, E.PROVISIONAL):
        parts = E.score(df, policy, sizes=GroupSizes(9, 37, 5)).toPandas()
        found = E.score(df, policy).toPandas()
        pd.testing.assert_frame_equal(found, parts[list(found.columns)], check_dtype=False, rtol=1e-9)


def test_groups_cross_batches():
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({DATE: pa.array(v, pa.int32())}) for v in ([1, 1], [], [1, 2], [3], [3, 3, 4])]
    assert [t.column(DATE).to_pylist() for t in day_kernel.whole_groups(batches, [DATE])] == [[1, 1, 1], [2], [3, 3, 3], [4]]
