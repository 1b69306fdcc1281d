"""Ranks, positions and quantiles: the sliced form must equal the windowed one on skewed groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.functions.groups import (GroupSizes, average_ranks, group_quantiles, measure, with_positions)
from crosstide.operators import cross, evaluate, turnover
from crosstide.operators.quality import key_order_breaks
from crosstide.plans import runs as P
from crosstide.plans.registry import date_sizes
from crosstide.schema import DATE, ENTITY, KEYS

SPLIT = GroupSizes(3, 10**9, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows, and one value most rows of that date."""
    rng = np.random.default_rng(1)
    n = 3000
    date = np.where(rng.random(n) < 0.7, 20200101, 20200102 + rng.integers(0, 3, n))
    x = np.where(rng.random(n) < 0.5, 0.0, np.round(rng.normal(size=n), 2))
    rows = [(f"{i:06d}.SZ", int(d), None if rng.random() < 0.1 else float(v), float(rng.normal())) for i, (d, v) in enumerate(zip(date, x))]
    return spark.createDataFrame(rows, "ts_code string, trade_date int, x double, z double")


def test_measure(skewed):
    sizes = measure(skewed, [DATE])
    assert sizes.groups == 4 and sizes.fits and not GroupSizes(1, 10, 9).fits


@pytest.mark.parametrize("sizes", [None, SPLIT])
def test_percent_ranks_equal_pandas(skewed, sizes):
    out = average_ranks(skewed, {"x": "rx", "z": "rz"}, [DATE], KEYS, sizes).toPandas()
    for c in ("x", "z"):
        expected = out.groupby(DATE)[c].rank(method="average", pct=True)
        np.testing.assert_array_equal(out[f"r{c}"], expected)


def test_many_columns_are_ranked_as_rows(spark, skewed):
    wide = skewed.withColumns({f"c{i}": F.col("z") * (i + 1) for i in range(45)})
    out = average_ranks(wide, {f"c{i}": f"r{i}" for i in range(45)}, [DATE], KEYS).toPandas()
    expected = out.groupby(DATE)["z"].rank(method="average", pct=True)
    np.testing.assert_array_equal(out["r0"], expected)
    np.testing.assert_array_equal(out["r44"], expected)


@pytest.mark.parametrize("sizes", [None, SPLIT])
def test_positions(skewed, sizes):
    order = [F.col("x").desc_nulls_last(), F.col(ENTITY).asc()]
    out = with_positions(skewed, [DATE], order, sizes).toPandas()
    ordered = out.sort_values([DATE, "x", ENTITY], ascending=[True, False, True], na_position="last")
    assert (ordered.groupby(DATE).cumcount() == ordered["_before"]).all()
    assert (out["_total"] == out.groupby(DATE)[ENTITY].transform("size")).all()


@pytest.mark.parametrize("by", [[DATE], []])
def test_quantiles(skewed, by):
    points = [0, .01, .25, .5, .75, .99, 1]
    a = group_quantiles(skewed, by, "x", points).toPandas()
    b = group_quantiles(skewed, by, "x", points, SPLIT).toPandas()
    frame = skewed.toPandas()
    for out in (a, b):
        for _, row in out.iterrows():
            values = frame if not by else frame[frame[DATE] == row[DATE]]
            np.testing.assert_allclose(row["quantiles"], np.nanquantile(values.x, points), rtol=1e-12, atol=1e-12)


def test_date_medians_both_ways(skewed):
    a = cross.date_medians(skewed, ["x", "z"]).orderBy(DATE).toPandas()
    b = cross.date_medians(skewed, ["x", "z"], SPLIT).orderBy(DATE).toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_scores_do_not_depend_on_the_plan(spark, folder):
    df = P.runs(spark, folder)
    policy = evaluate.OFFICIAL.adjusted(3, 4)
    a = evaluate.score(df, policy, P.RUN, date_sizes(spark, folder)).orderBy(*P.RUN).toPandas()
    b = evaluate.score(df, policy, P.RUN, SPLIT).orderBy(*P.RUN).toPandas()
    assert sorted(a) == sorted(b)
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], rtol=1e-9)


def test_cross_features_do_not_depend_on_the_plan(spark, folder):
    from crosstide.operators.features import full_view
    from crosstide.sources.panel import bars
    df = bars(spark, folder).filter(F.col(DATE) < 19960101)
    a = full_view(df).orderBy(*KEYS).toPandas()
    b = full_view(df, SPLIT).orderBy(*KEYS).toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_key_order_breaks(spark):
    rows = [(i, i if i not in (5, 9) else 0) for i in range(20)]
    df = spark.createDataFrame(rows, "_position long, k int").withColumn("_file", F.lit("f"))
    out = key_order_breaks(df, ["k"]).first()
    assert (out["rows"], out["breaks"]) == (20, 2)
