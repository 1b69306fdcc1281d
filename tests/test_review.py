"""Recomputation checks on a panel whose values are not made the same way twice."""

import numpy as np
import pandas as pd
import pyarrow as pa

from crosstide import catalog
from crosstide.operators import review
from crosstide.operators.review import prefix_differences
from helpers import dates, panel, walk


def test_prefix_reads_one_panel(spark):
    def shaken(batches):
        rng = np.random.default_rng()
        for b in batches:
            amount = b.column("amount").to_numpy(zero_copy_only=False) * (1 + rng.random(len(b)) * 1e-9)
            yield b.set_column(b.schema.get_field_index("amount"), "amount", pa.array(amount))

    df = panel(spark, pd.concat([walk(), walk("000002.SZ", seed=7)]))
    found = prefix_differences(df.mapInArrow(shaken, df.schema), dates(85)[60], ["amtchg_1", "ret_5"]).toPandas()
    assert set(found.cells) == {120} and not found.differences.any()


def test_a_wide_prefix_check_moves_no_features_and_finds_a_look_ahead(spark, monkeypatch):
    frame = pd.concat([walk(f"{k:06d}.SZ", 85, k) for k in range(4)], ignore_index=True)
    df, names, cut = panel(spark, frame), list(catalog.ENTITY_FEATURES), int(frame.trade_date[50])
    found = review.prefix_differences(df, cut, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert {(r.feature, r.cells, r.differences) for r in found.collect()} == {(n, 200, 0) for n in names}
    real = review.feature_batches

    def ahead(batches, names):  # ret_1 of the next row: a look ahead, which the cut panel cannot see on its last date
        for batch, values in real(batches, names):
            yield batch, lambda n: np.append(values(n)[1:], np.nan) if n == "ret_1" else values(n)
    monkeypatch.setattr(review, "feature_batches", ahead)
    assert {r.feature: r.differences for r in review.prefix_differences(df.coalesce(1), cut, names, placed=True).collect()}["ret_1"] >= 1
