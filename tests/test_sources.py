import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.functions.guards import max_of, ratio
from crosstide.operators import quality as Q
from crosstide.schema import DATE, ENTITY, KEYS, LABEL, SOURCES
from crosstide.sources import files
from helpers import panel, predictions, walk

HEADER = ",".join([*KEYS, *SOURCES, LABEL])


def write(tmp_path, *lines):
    path = tmp_path / "panel.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_csv_tokens(spark, tmp_path):
    path = write(tmp_path, HEADER, "000001.SZ,20200101,1.5,NaN,,NULL,10,20,0,1,0.25", "000001.SZ,20200102,inf,1,1,1,nan,NA,0,0,null")
    rows = files.read_panel_csv(spark, path, True).orderBy(DATE).collect()
    assert (rows[0]["open"], rows[0]["high"], rows[0]["low"], rows[0]["close"], rows[0][LABEL]) == (1.5, None, None, None, 0.25)
    assert rows[1]["open"] is None and rows[1]["vol"] is None and rows[1][LABEL] is None


def test_strict_csv_refuses_bad_input(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_panel_csv(spark, write(tmp_path, HEADER.replace("open", "Open"), "a"), True)
    path = write(tmp_path, HEADER, "000001.SZ,20200101,oops,1,1,1,1,1,0,0,0")
    with pytest.raises(Exception):
        files.read_panel_csv(spark, path, True).collect()


def test_prediction_text_is_exact(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"{i:06d}.SZ", 20200101, float(v), None if i % 5 == 0 else float(v / 3), 0.0) for i, v in enumerate(rng.normal(size=200))]
    df = predictions(spark, rows)
    path = str(tmp_path / "p")
    files.write_predictions_csv(df, path)
    assert sorted(map(tuple, files.read_predictions_csv(spark, path).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception):
        files.write_predictions_csv(df, path)


def test_feature_sink_refuses_overwrite_and_prunes(spark, tmp_path):
    df = panel(spark, walk(n=300)).withColumn("split", F.lit("train"))
    path = str(tmp_path / "f")
    files.write_features(df, path)
    with pytest.raises(Exception):
        files.write_features(df, path)
    part = files.read_features(spark, path, ["vol"], 20200601, 20201231)
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(trade_date,20200601)" in plan.replace(" ", "")
    assert "close" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_submission_checks(spark):
    df = predictions(spark, [("a", 20200101, 1.0, 0.1, 0.0), ("b", 20200101, 2.0, 0.1, 0.0)])
    assert files.submission(df, df).count() == 2
    for bad in (df.union(df), df.limit(1), df.withColumn("pred", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            files.submission(bad, df)


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(50)], "a int, b double")
    same = files.fingerprint(df.repartition(7), ["a", "b"]).first()
    assert files.fingerprint(df, ["a", "b"]).first() == same
    assert files.fingerprint(df.withColumn("b", F.col("b") + 1), ["a", "b"]).first() != same


def test_guards(spark):
    df = spark.createDataFrame([(1.0, None, 0.0)], "a double, b double, z double")
    row = df.select(max_of("a", "b").alias("m"), ratio("a", "z").alias("r")).first()
    assert row["m"] is None and row["r"] is None


def test_audit_of_a_bad_panel(spark):
    frame = walk(n=4)
    frame.loc[0, ["open", "high", "low", "close"]] = np.nan
    frame.loc[1, "vol"] = -1.0
    frame.loc[2, "flag_limit_up"] = 2.0
    frame.loc[3, "low"] = frame.high[3] + 1
    df = panel(spark, frame)
    profile = {r["column_name"]: r for r in Q.column_profile(df, SOURCES).collect()}
    assert profile["vol"]["negative"] == 1 and profile["open"]["missing"] == 1
    checks = {r["rule"]: r["violations"] for r in Q.price_order_checks(df).collect()}
    assert checks == {"high_below_open_or_close": 0, "low_above_open_or_close": 1, "high_below_low": 1}
    assert Q.flag_counts(df, ["flag_limit_up"]).filter("NOT in_domain").first()["rows"] == 1
    with pytest.raises(ValueError):
        Q.require_unique(df.union(df))
