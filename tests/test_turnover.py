import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.functions.groups import LIMIT_SETTING, GroupSizes
from crosstide.operators import selection as L
from crosstide.operators import turnover as U
from crosstide.schema import DATE, ENTITY, KEYS
from helpers import dates, predictions


def market(n_codes=40, n_dates=12, seed=5, thin=(6,)):
    rng = np.random.default_rng(seed)
    rows = []
    for j, date in enumerate(dates(n_dates)):
        for i in range(8 if j in thin else n_codes):
            rows.append((f"{i:06d}.SZ", date, float(np.round(rng.normal(), 1)), float(rng.normal()), float(i == j)))
    return rows


def restated(frame, alpha, exit_fraction, minimum):
    """Scalar restatement: smoothing, then keep members inside the band, then fill from the top."""
    frame = frame.sort_values([ENTITY, DATE]).copy()
    frame["rank"] = frame.groupby(DATE)["pred"].rank(method="average", pct=True)
    last, smooth = {}, []
    for code, x in zip(frame[ENTITY], frame["rank"]):
        last[code] = x if code not in last else alpha * x + (1 - alpha) * last[code]
        smooth.append(last[code])
    frame["smooth"] = smooth
    previous, found = set(), {}
    for date, day in frame.groupby(DATE):
        pool = day[day.flag_limit_up == 0].sort_values(["smooth", ENTITY], ascending=[False, True])[ENTITY].tolist()
        if len(pool) < minimum:
            previous = set()
            continue
        k = max(len(pool) // 10, 1)
        band = pool[:max(int(len(pool) * exit_fraction), k)]
        chosen = [c for c in band if c in previous][:k]
        chosen += [c for c in pool if c not in chosen][:k - len(chosen)]
        previous = set(chosen)
        found[date] = previous
    return found


@pytest.mark.parametrize("limit", [None, "1"])
def test_sets_equal_restatement(spark, limit):
    rows = market()
    df = predictions(spark, rows)
    ranked = U.daily_rank(df)
    smooth = U.causal_ema(ranked, [0.3]).join(df.select(*KEYS, "flag_limit_up"), KEYS)
    band = U.exit_band(smooth, [0.25], ["alpha"], 10)
    if limit:
        spark.conf.set(LIMIT_SETTING, limit)
    try:
        out = U.hysteresis_sets(band, ["alpha"]).toPandas()
    finally:
        spark.conf.unset(LIMIT_SETTING)
    frame = pd.DataFrame(rows, columns=[ENTITY, DATE, "pred", "y", "flag_limit_up"])
    expected = restated(frame, 0.3, 0.25, 10)
    assert {d: set(g[ENTITY]) for d, g in out.groupby(DATE)} == expected


def test_oversized_runs_keep_members_over_dates_they_lack(spark):
    """Two runs with different calendars and several stretches give the same sets date by date as in one task."""
    first, second = market(thin=(3, 8)), [r for r in market(seed=9, thin=(5,)) if r[1] not in dates(12)[2:4]]
    df = predictions(spark, first).withColumn("model", F.lit("a")).unionByName(predictions(spark, second).withColumn("model", F.lit("b")))
    smooth = U.causal_ema(U.daily_rank(df, ["model"]), [0.3, 1.0], ["model"], keep=["flag_limit_up"])
    band = U.exit_band(smooth, [0.1, 0.25], ["model", "alpha"], 10)
    plain = U.hysteresis_sets(band, ["model", "alpha"]).toPandas()
    spark.conf.set(LIMIT_SETTING, "1")
    try:
        cut = U.hysteresis_sets(band, ["model", "alpha"]).toPandas()
        empty = U.hysteresis_sets(band.filter("false"), ["model", "alpha"], 2).count()
    finally:
        spark.conf.unset(LIMIT_SETTING)
    order = ["model", "alpha", "exit_fraction", *KEYS]
    assert len(plain) and not empty
    pd.testing.assert_frame_equal(*(x[order].sort_values(order).reset_index(drop=True) for x in (plain, cut)), check_dtype=False)


def test_control_is_causal_and_unique(spark):
    rows = market()
    cut = dates(12)[8]
    other = [(c, d, p if d < cut else -p, y, f) for c, d, p, y, f in rows]
    a, b = (U.controlled_predictions(predictions(spark, r), [0.3], [0.25], min_pool=10).toPandas() for r in (rows, other))
    key = [*KEYS, "pred"]
    pd.testing.assert_frame_equal(*(x[x[DATE] < cut][key].sort_values(KEYS).reset_index(drop=True) for x in (a, b)))
    assert not a.duplicated([DATE, "pred"]).any()
    top = a[a.selected].groupby(DATE).size()
    pool = a[a.flag_limit_up == 0].groupby(DATE).size()
    assert (top == (pool[top.index] // 10).clip(lower=1)).all()


def test_prior_state_continues_a_run(spark):
    rows = market(thin=())
    df = U.daily_rank(predictions(spark, rows))
    cut = dates(12)[5]
    whole = U.causal_ema(df, [0.3]).filter(F.col(DATE) >= cut).orderBy(*KEYS).toPandas()
    first = U.causal_ema(df.filter(F.col(DATE) < cut), [0.3])
    last = first.groupBy(ENTITY).agg(F.max_by("smooth", DATE).alias("smooth"))
    rest = U.causal_ema(df.filter(F.col(DATE) >= cut), [0.3], prior=last).orderBy(*KEYS).toPandas()
    pd.testing.assert_frame_equal(whole, rest, check_exact=True)


def test_missing_rank_is_refused(spark):
    df = predictions(spark, [("000001.SZ", 20200101, None, 0.1, 0.0)]).withColumn("rank", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="rank in every row"):
        U.causal_ema(df, [0.3]).collect()
    with pytest.raises(ValueError):
        U.causal_ema(df, [0.0])


def scores(spark):
    rows = [(a, e, f, s, t) for a, e, s, t in [(0.3, 0.2, 0.5, 0.4), (0.5, 0.2, 0.5, 0.4), (0.5, 0.3, 0.5, 0.4), (0.1, 0.1, 0.4, 0.1)]
            for f in ("F1", "F2")]
    return spark.createDataFrame(rows, "alpha double, exit_fraction double, fold string, final_score double, mean_turnover double")


def test_selection_tie_breaks(spark):
    best = L.select_grid_point(scores(spark)).first()
    assert (best.alpha, best.exit_fraction) == (0.5, 0.2)
    with pytest.raises(ValueError):
        L.require_folds(scores(spark), ["F1", "F3"])
