import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import models as M
from crosstide.operators.history import history_features
from crosstide.schema import DATE, ENTITY, KEYS, SOURCES
from crosstide.streaming import panel_stream as T
from helpers import collected, panel, walk


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ [0.5, -1.0, 0.2] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    bundle = M.fit_bundle(df, ["a", "b", "c"], M.ridge(df, "y"))
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + M.RIDGE_ALPHA * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(bundle.stages[-1].coefficients.toArray(), expected, rtol=1e-8)


def test_bundle_guards_feature_order(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 3), float(i * 2)) for i in range(30)], "a double, b double, y double")
    bundle = M.fit_bundle(df, ["a", "b"], M.ridge(df, "y"))
    M.save_bundle(bundle, ["a", "b"], str(tmp_path / "m"), spark)
    loaded = M.load_bundle(spark, str(tmp_path / "m"), ["a", "b"])
    assert M.score_rows(loaded, df, ["a"]).count() == 30
    with pytest.raises(ValueError):
        M.load_bundle(spark, str(tmp_path / "m"), ["b", "a"])


def test_extension_keeps_the_prefix(spark):
    frozen = spark.createDataFrame([("a", 1, 0.5)], "ts_code string, trade_date int, pred double")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "ts_code string, trade_date int")
    out = M.extend_predictions(frozen, rows, lambda fresh: fresh.withColumn("pred", F.lit(9.0)))
    assert sorted(r["pred"] for r in out.collect()) == [0.5, 9.0]
    assert M.prefix_changes(frozen, out).count() == 0
    assert M.prefix_changes(frozen, out.withColumn("pred", F.col("pred") + 1)).count() == 1


def arrivals(spark, frame, cuts, path):
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        panel(spark, frame.iloc[a:b]).coalesce(1).write.mode("append").parquet(path)


def test_streamed_features_equal_batch_with_long_gaps(spark, tmp_path):
    frame = walk(n=220, seed=11)
    frame.loc[60:150, ["open", "high", "low", "close"]] = np.nan
    names = ["ret_60", "stdret_60", "madev_5", "emadev_5", "emadev_60", "days_since_limit_up", "limit_up_count_60", "illiq_60"]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals(spark, frame, [0, 50, 100, 145, 160, 220], path)
    stream = T.feature_stream(T.stream_of(spark, path, panel(spark, frame).schema, 1), names)
    T.run_to_end(stream.writeStream.outputMode("append").format("parquet").option("path", out), str(tmp_path / "state"))
    found = collected(spark.read.parquet(out).select(*KEYS, *names))
    expected = collected(history_features(panel(spark, frame), names))
    pd.testing.assert_frame_equal(found, expected, rtol=1e-9, check_dtype=False)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    frame = walk(n=30)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals(spark, frame, [0, 20], path)
    panel(spark, pd.concat([frame.iloc[5:7], frame.iloc[20:30], frame.iloc[25:26]])).coalesce(1).write.mode("append").parquet(path)
    schema = panel(spark, frame).schema
    features = T.feature_stream(T.stream_of(spark, path, schema, 1), ["ret_1"])
    T.run_to_end(features.writeStream.outputMode("append").format("parquet").option("path", out), str(tmp_path / "state"))
    found = spark.read.parquet(out).orderBy(DATE).toPandas()
    assert len(found) == 30 and found.late_rows.iloc[-1] == 3
    pd.testing.assert_series_equal(found.ret_1, collected(history_features(panel(spark, frame), ["ret_1"])).ret_1)
    ranked = T.causal_ema_stream(T.stream_of(spark, path, schema, 1).withColumn("rank", F.col("close")), 0.3)
    ema = str(tmp_path / "ema")
    T.run_to_end(ranked.writeStream.outputMode("append").format("parquet").option("path", ema), str(tmp_path / "state2"))
    rows = spark.read.parquet(ema).orderBy(DATE).toPandas()
    expected = frame.close.ewm(alpha=0.3, adjust=False).mean()
    np.testing.assert_allclose(rows.smooth, expected, rtol=1e-12)
    assert rows.late_rows.iloc[-1] == 3


def test_profile_counts_late_rows(spark, tmp_path):
    frame = walk(n=30)
    frame.loc[25, "amount"], frame.loc[26, "amount"] = np.nan, 0.0
    path = str(tmp_path / "in")
    arrivals(spark, frame, [0, 20, 28], path)
    panel(spark, pd.concat([frame.iloc[5:7], frame.iloc[28:30], frame.iloc[27:28]])).coalesce(1).write.mode("append").parquet(path)
    sink = T.ProfileStream("amount", str(tmp_path / "out"), str(tmp_path / "late"))
    T.run_to_end(T.stream_of(spark, path, panel(spark, frame).schema, 1).writeStream.foreachBatch(sink), str(tmp_path / "state"))
    found = sink.profile(spark).orderBy(DATE).toPandas()
    assert found.rows.tolist() == [1] * 27 + [2, 1, 1]  # the 28th day came twice within the delay
    assert found.late_rows.tolist() == [0] * 5 + [1, 1] + [0] * 23
    assert found.missing.sum() == 1 and found.zero.sum() == 1 and found.finite_max[29] == frame.amount[29]
    assert [spark.read.parquet(str(tmp_path / "late" / f"batch={b}")).first()["late_rows"] for b in range(3)] == [0, 0, 2]
