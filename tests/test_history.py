import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.operators.ema import ewm_means
from crosstide.operators.features import basic_view, full_view
from crosstide.operators.history import history_features
from crosstide.schema import DATE, ENTITY, KEYS
from helpers import collected, panel, walk


def test_catalog_contract():
    assert len(catalog.FULL) == len(set(catalog.FULL)) == 147
    assert len(catalog.ENTITY_FEATURES) == 113 and len(catalog.DATE_FEATURES) == 34
    assert len(catalog.BASIC) == len(set(catalog.BASIC)) == 40
    assert len(catalog.rank_view_columns()) == 15
    kept = [len(catalog.without_categories(c)) for c in (["market"], ["market", "relative"])]
    assert kept == [137, 129]
    with pytest.raises(ValueError):
        catalog.without_categories(["nothing"])


def test_missing_close_keeps_its_lag_slot(spark):
    frame = walk(n=20)
    frame.loc[4, "close"] = np.nan
    out = collected(history_features(panel(spark, frame), ["ret_1", "ret_5", "madev_5", "stdret_5"]))
    assert list(np.flatnonzero(out.ret_1.isna())) == [0, 4, 5]
    assert list(np.flatnonzero(out.madev_5.isna())) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert list(np.flatnonzero(out.stdret_5.isna())) == list(range(11))[:10] + [] or out.stdret_5.isna()[4:10].all()
    assert out.stdret_5.notna()[10:].all()
    assert np.isclose(out.ret_5[5], frame.close[5] / frame.close[0] - 1)


def test_absent_market_day_uses_previous_row(spark):
    frame = walk(n=10).drop(index=4).reset_index(drop=True)
    out = collected(history_features(panel(spark, frame), ["ret_1"]))
    assert np.isclose(out.ret_1[4], frame.close[4] / frame.close[3] - 1)


def test_flat_prices_and_zero_volume(spark):
    frame = walk(n=25)
    for c in ("open", "high", "low", "close"):
        frame[c] = 0.1
    frame["vol"] = 0.0
    names = ["volratio_5", "stdret_5", "kmid2", "kup2", "slope_5", "rsq_5", "corr_ret_dlogvol_5"]
    out = collected(history_features(panel(spark, frame), names)).iloc[-1]
    assert (out[["volratio_5", "stdret_5", "kmid2", "kup2", "slope_5"]] == 0).all()
    assert pd.isna(out.rsq_5) and pd.isna(out.corr_ret_dlogvol_5)


def test_nonpositive_price_blanks_log_columns_only_in_window(spark):
    frame = walk(n=30)
    frame.loc[10, "low"] = -1.0
    out = collected(history_features(panel(spark, frame), ["parkinson_5", "gkvol_5"]))
    assert out.parkinson_5[10:15].isna().all() and out.parkinson_5[15:].notna().all()
    assert out.gkvol_5[10:15].isna().all()


def test_future_rows_do_not_change_the_past(spark):
    frame = walk(n=90)
    later = frame.copy()
    later.loc[70:, ["open", "high", "low", "close", "vol", "amount"]] *= 100
    names = [n for n in catalog.ENTITY_FEATURES]
    a, b = (collected(history_features(panel(spark, f), names)).iloc[:70] for f in (frame, later))
    pd.testing.assert_frame_equal(a, b)


def test_entities_are_isolated(spark):
    one, two = walk("000001.SZ"), walk("000002.SZ", seed=7, scale=1.7)
    alone = collected(basic_view(panel(spark, one)))
    both = collected(basic_view(panel(spark, pd.concat([one, two]))).filter(F.col(ENTITY) == "000001.SZ"))
    pd.testing.assert_frame_equal(alone, both)


def test_partitioning_does_not_matter(spark):
    df = panel(spark, pd.concat([walk("000001.SZ"), walk("000002.SZ", seed=7)]))
    a = collected(full_view(df))
    b = collected(full_view(df.repartition(5, F.rand(3))))
    assert list(a.columns) == [*KEYS, *catalog.FULL]
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


@pytest.mark.parametrize("missing", [[], [0, 1, 30, 31, 32, 33, 60], list(range(20, 55))])
def test_ema_equals_pandas(spark, missing):
    frame = walk(n=140)
    frame.loc[missing, "close"] = np.nan
    out = collected(ewm_means(panel(spark, frame), "close", [5, 20, 60]))
    for span in (5, 20, 60):
        expected = frame.close.ewm(span=span, adjust=False, ignore_na=False).mean()
        expected = expected.where(frame.close.notna())
        found = out[f"_ema_{span}"].where(frame.close.notna())
        np.testing.assert_allclose(found, expected, rtol=1e-10, equal_nan=True)


def test_long_ema_stays_finite(spark):
    frame = walk(n=4000, seed=3)
    out = collected(ewm_means(panel(spark, frame), "close", [5, 60]))
    for span in (5, 60):
        np.testing.assert_allclose(out[f"_ema_{span}"], frame.close.ewm(span=span, adjust=False).mean(), rtol=1e-9)


def test_rows_since_event_is_capped(spark):
    frame = walk(n=80)
    frame["flag_limit_up"] = 0.0
    frame.loc[3, "flag_limit_up"] = 1.0
    out = collected(history_features(panel(spark, frame), ["days_since_limit_up"])).days_since_limit_up
    assert list(out[:6]) == [61, 61, 61, 0, 1, 2] and out.iloc[-1] == 61


def test_scalar_restatement_of_window_columns(spark):
    frame = walk(n=85)
    names = ["slope_20", "rsq_20", "downvol_10", "atr_5", "corr_ret_dlogamt_5", "illiq_5", "rsv_20", "logvol_std_5"]
    out = collected(history_features(panel(spark, frame), names)).iloc[-1]
    c, ret = frame.close.to_numpy(), frame.close.pct_change().to_numpy()
    x = np.arange(20) - 9.5
    y = c[-20:]
    slope = (x @ (y - y.mean())) / (x @ x)
    prev = np.roll(c, 1)
    tr = np.maximum.reduce([frame.high - frame.low, abs(frame.high - prev), abs(frame.low - prev)])
    damt = np.diff(np.log1p(frame.amount))
    expected = {
        "slope_20": slope / c[-1], "rsq_20": np.corrcoef(x, y)[0, 1] ** 2,
        "downvol_10": np.sqrt(np.mean(np.minimum(ret[-10:], 0) ** 2)), "atr_5": tr[-5:].mean() / c[-1],
        "corr_ret_dlogamt_5": np.corrcoef(ret[-5:], damt[-5:])[0, 1],
        "illiq_5": np.mean(np.log1p(1e8 * abs(ret[-5:]) / frame.amount.to_numpy()[-5:])),
        "rsv_20": (c[-1] - frame.low[-20:].min()) / (frame.high[-20:].max() - frame.low[-20:].min()),
        "logvol_std_5": np.std(np.log1p(frame.vol[-5:])),
    }
    for name, value in expected.items():
        assert np.isclose(out[name], value, rtol=1e-8), name


def test_large_value_leaves_no_trace(spark):
    """Rows past a window are bit for bit the same with and without a spike in an early row."""
    from crosstide.operators.history import history_features
    names = ["stdret_5", "stdret_20", "madev_20", "volratio_20", "amtratio_5", "corr_ret_dlogvol_20", "logvol_std_20", "atr_14", "gkvol_20"]
    names = [n for n in names if n in catalog.CATEGORY]
    plain = walk(n=85)
    spiked = plain.copy()
    spiked.loc[3, ["open", "high", "low", "close"]] *= 1e5
    spiked.loc[3, "amount"] = 1e16
    a, b = (history_features(panel(spark, f), names, keep=KEYS).orderBy(*KEYS).toPandas() for f in (plain, spiked))
    assert len(names) >= 5
    pd.testing.assert_frame_equal(a.iloc[30:], b.iloc[30:], check_exact=True)
    direct = plain["close"].pct_change().rolling(5).std(ddof=0)
    np.testing.assert_allclose(b["stdret_5"].iloc[30:], direct.iloc[30:], rtol=1e-9)


def test_wide_views_equal_the_frames_column_by_column(spark):
    """Array work against sliding frames, with gaps, flat stretches, spikes, non-positive values and batches that cut entities."""
    one, two, three = walk("000001.SZ", n=200), walk("000002.SZ", seed=7, scale=1.7, n=90), walk("000003.SZ", seed=9, n=5)
    one.loc[[30, 31, 90], ["close", "high"]] = np.nan
    one.loc[60:125, ["open", "high", "low", "close"]] = 10.0
    one.loc[150, ["open", "high", "low", "close"]] *= 1e6
    one.loc[[20, 140], "vol"] = np.nan
    one.loc[22:40, "vol"] = 500.0
    two.loc[10, "low"], two.loc[11, "close"], two.loc[12, "vol"], two.loc[13, "amount"] = -1.0, 0.0, -5.0, 0.0
    two.loc[40, "flag_limit_up"] = np.nan
    df = panel(spark, pd.concat([one, two, three])).withColumn("note", F.concat(F.lit("n"), F.col(DATE).cast("string")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "47")
    try:
        wide = collected(history_features(df, catalog.ENTITY_FEATURES, keep=[*KEYS, "note"], wide=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    narrow = collected(history_features(df, catalog.ENTITY_FEATURES, keep=[*KEYS, "note"], wide=False))
    assert list(wide.columns) == list(narrow.columns) and len(wide) == 295
    for n in catalog.ENTITY_FEATURES:
        a, b = wide[n].to_numpy(float), narrow[n].to_numpy(float)
        np.testing.assert_array_equal(np.isnan(a), np.isnan(b), err_msg=n)
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9, err_msg=n)


def test_a_spike_leaves_no_trace_in_wide_views(spark):
    plain = walk(n=150)
    spiked = plain.copy()
    spiked.loc[3, ["open", "high", "low", "close"]] *= 1e5
    spiked.loc[3, "amount"] = 1e16
    names = [n for n in catalog.ENTITY_FEATURES if not n.startswith("emadev_")]
    a, b = (collected(history_features(panel(spark, f), names)) for f in (plain, spiked))
    pd.testing.assert_frame_equal(a.iloc[70:], b.iloc[70:], check_exact=True)


def test_same_date_arrays_equal_the_windows(spark):
    from crosstide.operators.cross import cross_features

    frames = [walk(f"{k:06d}.SZ", n=60 + k, seed=k, scale=1 + k % 3) for k in range(9)]
    frames[2].loc[10:30, "close"] = np.nan
    frames[3]["close"] = 5.0
    df = panel(spark, pd.concat(frames))
    rows = history_features(df, catalog.ENTITY_FEATURES, keep=[*KEYS]).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        a = collected(cross_features(rows, df, arrays=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    b = collected(cross_features(rows, df, arrays=False))
    assert len(a) == len(b) == sum(map(len, frames))
    for n in catalog.DATE_FEATURES:
        x, y = a[n].to_numpy(float), b[n].to_numpy(float)
        np.testing.assert_array_equal(np.isnan(x), np.isnan(y), err_msg=n)
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-11, err_msg=n)
