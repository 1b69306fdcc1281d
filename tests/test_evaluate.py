import numpy as np
import pandas as pd
import pytest

from crosstide.functions.groups import GroupSizes
from crosstide.operators import compare, evaluate as E
from crosstide.operators.compare import membership_runs, persistence
from crosstide.operators.residual import column_rank_correlations, partial_correlation
from crosstide.schema import DATE, ENTITY, KEYS, LABEL
from helpers import dates, predictions

PLANS = [None, GroupSizes(2, 10**9, 1)]


def days(n_codes, n_dates=2, pred=lambda i, j: float(i), label=lambda i, j: float(i) / 100, flag=lambda i, j: 0.0):
    return [(f"{i:06d}.SZ", d, pred(i, j), label(i, j), flag(i, j)) for j, d in enumerate(dates(n_dates)) for i in range(n_codes)]


@pytest.mark.parametrize("sizes", PLANS)
def test_top_sizes_of_101_rows(spark, sizes):
    df = predictions(spark, days(101))
    official = E.daily_turnover(df, E.OFFICIAL, sizes=sizes).first()["turnover_top_rows"]
    provisional = E.daily_turnover(df, E.PROVISIONAL, sizes=sizes).first()["turnover_top_rows"]
    assert (official, provisional) == (10, 11)


@pytest.mark.parametrize("sizes", PLANS)
def test_missing_prediction_voids_only_the_official_ic(spark, sizes):
    df = predictions(spark, days(101, pred=lambda i, j: None if i == 3 else float(i)))
    assert E.score(df, E.OFFICIAL, sizes=sizes).first()["ic_mean"] is None
    assert np.isclose(E.score(df, E.PROVISIONAL, sizes=sizes).first()["ic_mean"], 1.0)


@pytest.mark.parametrize("sizes", PLANS)
def test_thin_middle_date_is_not_bridged(spark, sizes):
    rows = [r for r in days(101, 3) if r[1] != dates(3)[1] or r[0] < "000050.SZ"]
    out = E.daily_turnover(predictions(spark, rows), E.OFFICIAL, sizes=sizes).orderBy(DATE).toPandas()
    assert list(out[DATE]) == [dates(3)[0], dates(3)[2]] and out.turnover.isna().all()


def test_constant_prediction_has_no_ic(spark):
    df = predictions(spark, days(40, pred=lambda i, j: 1.0))
    assert E.daily_ic(df, E.OFFICIAL).toPandas().rank_ic.isna().all()


def test_excess_and_ties_are_cut_by_code(spark):
    df = predictions(spark, days(100, 1, pred=lambda i, j: 0.0))
    row = E.daily_returns(df, E.OFFICIAL).first()
    assert np.isclose(row["top_return"], np.mean(np.arange(10)) / 100)
    assert np.isclose(row["top_excess"], (np.mean(np.arange(10)) - 49.5) / 100)


def test_limit_up_rows_are_left_out(spark):
    df = predictions(spark, days(110, 1, flag=lambda i, j: float(i >= 105)))
    assert E.daily_returns(df, E.OFFICIAL).first()["return_rows"] == 105


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=(2, 60, 2)), 1)
    df = predictions(spark, days(60, 2, pred=lambda i, j: float(values[j, i, 0]), label=lambda i, j: float(values[j, i, 1])))
    out = E.daily_ic(df, E.OFFICIAL).orderBy(DATE).toPandas().rank_ic
    expected = [pd.Series(values[j, :, 0]).rank().corr(pd.Series(values[j, :, 1]).rank()) for j in range(2)]
    np.testing.assert_allclose(out, expected, rtol=1e-12)


def test_membership_of_reversed_models(spark):
    rows = [(*r[:2], r[3], r[4], r[2], -r[2]) for r in days(20, 1)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, y_ret_1d double, flag_limit_up double, pred_a double, pred_b double")
    overlap = compare.daily_overlap(compare.with_membership(df)).first()
    assert (overlap["common"], overlap["union_rows"], overlap["jaccard"]) == (0, 4, 0.0)
    assert np.isclose(compare.daily_correlation(df).first()["prediction_spearman"], -1.0)


def test_persistence_runs(spark):
    ds = dates(5)
    tops = spark.createDataFrame([("000001.SZ", d, None) for d in (ds[0], ds[1], ds[3])] + [("000002.SZ", d, None) for d in ds],
                                 "ts_code string, trade_date int, y_ret_1d double")
    calendar = spark.createDataFrame([(d, i + 1) for i, d in enumerate(ds)], "trade_date int, day int")
    found = membership_runs(tops, calendar)
    assert sorted(r["run_days"] for r in found.collect()) == [1, 2, 5]
    row = persistence(found, calendar).first()
    assert (row["entities"], row["runs"], row["longest_run"], row["entities_full"]) == (2, 3, 5, 1)


def test_partial_correlation_equals_rank_residualisation(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=80)
    x, y = p + rng.normal(size=80), 0.5 * p + rng.normal(size=80)
    rows = [(f"{i:06d}.SZ", 20200101, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, p))]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, f double, y double, p double")
    out = column_rank_correlations(df, ["f"], ["y", "p"], [DATE], [ENTITY], 5)
    value = out.withColumn("v", partial_correlation("ic_y", "ic_p", "ic_y_p")).first()["v"]
    rx, ry, rp = (pd.Series(v).rank().to_numpy() for v in (x, y, p))
    rest = lambda a: a - np.polyval(np.polyfit(rp, a, 1), rp)
    assert np.isclose(value, np.corrcoef(rest(rx), rest(ry))[0, 1], rtol=1e-9)


def test_rounding_noise_does_not_decide_between_equal_scores(spark):
    from crosstide.operators.selection import select_grid_point, select_weight

    third = 0.1 + 0.2  # 0.30000000000000004
    rows = [("m", f, a, x, w, t) for f, (w1, w2) in {"F1": (third, 0.3), "F2": (0.6, 0.6)}.items() for a, x, w, t in ((0.5, 0.15, w1, 0.4), (0.8, 0.15, w2, 0.2), (0.8, 0.1, w2, 0.2))]
    scores = spark.createDataFrame(rows, "model string, fold string, alpha double, exit_fraction double, final_score double, mean_turnover double")
    found = select_grid_point(scores, ["model"]).first()
    assert (found.alpha, found.exit_fraction) == (0.8, 0.1)  # the first point is ahead by noise only and turns over more
    found = select_weight(scores.withColumn("weight", scores.alpha)).first()
    assert found.weight == 0.8


@pytest.mark.parametrize("policy", [E.OFFICIAL.adjusted(5, 10), E.PROVISIONAL.adjusted(5, 10)])
def test_daily_metrics_of_arrays_equal_the_windows(spark, policy):
    rng = np.random.default_rng(5)
    sizes = {d: n for d, n in zip(dates(6), (60, 3, 41, 12, 60, 30))}
    rows = [(c, d, None if i % 7 == j > 2 else p, None if i % 5 == j else y, f) for j, (d, n) in enumerate(sizes.items()) for i, (c, _, p, y, f) in enumerate(
        days(n, 1, lambda i, j: float(np.round(rng.normal(), 1)), lambda i, j: float(rng.normal()), lambda i, j: float(rng.random() < 0.2)))]
    df = predictions(spark, rows)
    found = E.daily_metrics(df, policy)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    slow = E.daily_metrics(df, policy, sizes=PLANS[1])
    assert found.dtypes == slow.dtypes
    frame = lambda x: x.toPandas().sort_values(DATE).reset_index(drop=True)
    pd.testing.assert_frame_equal(frame(found), frame(slow))
    assert (frame(found).turnover_top_rows == 0).any() and frame(found).rank_ic.notna().any()
