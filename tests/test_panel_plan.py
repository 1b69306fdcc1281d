"""Bars and the windows over them: one exchange and one sort, or reduced bars first for large suppliers."""

import pandas as pd

from crosstide.functions.groups import LIMIT_SETTING
from crosstide.operators.history import history_features
from crosstide.plans.registry import QUERIES
from crosstide.schema import KEYS
from crosstide.sources import panel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_and_their_windows_need_one_exchange_and_one_sort(spark, folder):
    found = plan(history_features(panel.bars(spark, folder), ["ret_1", "madev_5"], placed=True))
    assert found.count("Exchange") == 1 and found.count("Sort [") == 1


def test_large_suppliers_are_reduced_first(spark, folder, monkeypatch):
    frame = lambda df: df.toPandas().sort_values(KEYS).reset_index(drop=True)
    for grain in ("day", "month"):
        together = frame(panel.bars(spark, folder, grain, labelled=True))
        monkeypatch.setattr(panel, "_LINES", {})
        spark.conf.set(LIMIT_SETTING, 3)
        try:
            apart = panel.bars(spark, folder, grain, labelled=True)
            assert plan(apart).count("Exchange") == 2
        finally:
            spark.conf.unset(LIMIT_SETTING)
            monkeypatch.setattr(panel, "_LINES", {})
        pd.testing.assert_frame_equal(together, frame(apart), rtol=1e-12)


def test_long_codes_keep_all_digits(spark):
    keys = spark.createDataFrame([(1,), (999_999,), (1_000_000,), (-5,), (None,)], "k long")
    assert [r.c for r in keys.select(panel.entity_code("k", ".SZ").alias("c")).collect()] == [
        r.c for r in keys.selectExpr("format_string('%06d.SZ', k) AS c").collect()]


def test_long_frames_are_arrays(spark, folder):
    assert "Window" not in plan(QUERIES["w05_return_std"](spark, folder))
