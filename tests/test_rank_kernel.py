"""Ranks and rank correlations of many columns at once, against pandas and against the sliced way for large groups."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crosstide.functions import rank_kernel as K
from crosstide.functions.groups import GroupSizes
from crosstide.operators import residual as D
from crosstide.operators.features import all_ranked


def values(n=80, k=9, seed=1):
    x = np.round(np.random.default_rng(seed).normal(size=(n, k)), 1)  # many ties
    x[np.random.default_rng(seed + 1).random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 1.0, np.nan
    x[:12, 5] = np.nan
    x[:12, 6] = np.nan
    return x


def test_ranks_are_average_tie_ranks():
    x = values()
    np.testing.assert_array_equal(K.ranks(x), pd.DataFrame(x).rank().to_numpy())
    assert K.ranks(x[:0]).shape == (0, 9) and (K.ranks(x[:1])[0, ~np.isnan(x[0])] == 1).all()


def test_correlations_use_the_rows_of_each_column():
    x, y = values(), np.round(np.random.default_rng(7).normal(size=(80, 2)), 1)
    used, own, among = K.correlations(x, y)
    for c in range(9):
        rows = ~np.isnan(x[:, c])
        assert used[c] == rows.sum()
        frame = pd.DataFrame({"x": x[rows, c], "a": y[rows, 0], "b": y[rows, 1]}).rank()
        expected = [frame.x.corr(frame.a), frame.x.corr(frame.b), frame.a.corr(frame.b)] if rows.sum() > 1 else [np.nan] * 3
        if rows.sum() and frame.x.nunique() == 1:
            expected[:2] = [np.nan, np.nan]
        np.testing.assert_allclose([*own[c], *among[c]], expected, atol=1e-12)


def table(spark):
    rng, rows = np.random.default_rng(3), []
    for day in (20200101, 20200102, 20200103):
        x, p, y = values(60, 9, day % 97)[:, :4], rng.permutation(60), np.round(rng.normal(size=60), 1)
        for i in range(60):
            rows.append((f"c{i}", day, "F1", None if i == 5 else float(y[i]), float(p[i] + 1) / 60, *[None if np.isnan(v) else float(v) for v in x[i]]))
    return spark.createDataFrame(rows, "ts_code string, trade_date int, fold string, residual double, pred_rank double, f0 double, f1 double, f2 double, f3 double")


def test_both_ways_give_the_same_correlations(spark):
    df, names = table(spark), ["f0", "f1", "f2", "f3"]
    ask = lambda sizes: {(r.trade_date, r.region, r.feature): r for r in D.region_rank_correlations(
        df, names, ["residual", "pred_rank"], ["fold", "trade_date"], ["ts_code"], 3, sizes).collect()}
    one, sliced = ask(GroupSizes(3, 60)), ask(GroupSizes(3, 1 << 30, 10))
    assert set(one) == set(sliced) and {r for _, r, _ in one} == {"full", "top20", "middle60"} and len(one) > 25
    for key, r in one.items():
        assert r.pair_rows == sliced[key].pair_rows
        for c in ("ic_residual", "ic_pred_rank", "ic_residual_pred_rank"):
            a, b = r[c], sliced[key][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (key, c, a, b)


def test_every_column_is_ranked_but_the_market_ones(spark):
    df = table(spark).select("ts_code", "trade_date", F.col("f0").alias("kmid"), F.col("f1").alias("madev_5"), F.col("f3").alias("market_breadth_up"))
    names = ["kmid", "madev_5", "market_breadth_up"]
    both = [sorted(map(tuple, all_ranked(df, sizes, names).collect())) for sizes in (GroupSizes(3, 60), GroupSizes(3, 1 << 30, 10))]
    assert both[0] == both[1]
    frame = df.toPandas()
    frame["r"] = frame.groupby("trade_date").kmid.rank(pct=True)
    wanted = {(a, b): (r, m) for a, b, r, m in zip(frame.ts_code, frame.trade_date, frame.r, frame.market_breadth_up, strict=True)}
    for code, day, kmid, _, market in both[0]:
        r, m = wanted[code, day]
        assert (kmid is None and np.isnan(r)) or abs(kmid - r) < 1e-12
        assert (market is None and np.isnan(m)) or market == m
