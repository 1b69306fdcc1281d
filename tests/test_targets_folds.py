import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import folds, prepare, targets
from crosstide.operators.folds import Fold
from crosstide.schema import DATE, ENTITY, KEYS, LABEL


def labelled(spark, rows):
    return spark.createDataFrame(rows, "ts_code string, trade_date int, y_ret_1d double")


def one_date(spark, values):
    return labelled(spark, [(f"{i:06d}.SZ", 20200101, v) for i, v in enumerate(values)])


def test_ties_and_missing_labels(spark):
    out = targets.with_label_rank(one_date(spark, [1.0, 1.0, None])).toPandas()
    assert list(out.label_rank) == [.75, .75]


@pytest.mark.parametrize("target, expected", [
    (targets.decile, [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]),
    (targets.relevance, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]),
    (targets.top_decile, [0] * 9 + [1]),
])
def test_classes_of_ten_rows(spark, target, expected):
    out = targets.with_label_rank(one_date(spark, [float(i) for i in range(10)]))
    assert [r["t"] for r in out.orderBy(ENTITY).select(target("label_rank").alias("t")).collect()] == expected


def test_equal_labels_share_a_class(spark):
    out = targets.with_label_rank(one_date(spark, [0.0] * 5 + [1.0] * 5))
    assert out.select(targets.relevance("label_rank").alias("t")).distinct().count() == 2


def test_stretch_and_median(spark):
    df = one_date(spark, [float(i) for i in range(20)])
    out = targets.with_label_rank(df).orderBy(ENTITY).select(targets.stretched_rank("label_rank").alias("t")).toPandas().t
    u = np.arange(1, 21) / 20
    np.testing.assert_allclose(out, np.where(u <= .9, u, .9 + 10 * (u - .9)) - .5)
    relative = targets.relative_target(df).orderBy(ENTITY).toPandas().target
    np.testing.assert_allclose(relative, np.arange(20) - 9.5)


FOLD = [Fold.of("F1", "2019-01-01", "2019-12-31", "2020-01-01", "2020-12-31")]


def test_purge_comes_before_the_label_filter(spark):
    rows = [("a", 20191227, 0.1), ("a", 20191230, 0.2), ("a", 20191231, None), ("a", 20200102, 0.3), ("a", 20200103, None)]
    out = folds.fold_rows(labelled(spark, rows), FOLD).orderBy(DATE).toPandas()
    assert list(out[DATE]) == [20191227, 20191230, 20200102, 20200103]
    row = folds.fold_summary(labelled(spark, rows), FOLD).first()
    assert (row["purge_date"], row["purge_rows"], row["train_rows"], row["valid_rows"]) == (20191231, 1, 2, 2)


def test_overlapping_fold_is_refused(spark):
    rows = [("a", d, 0.1) for d in (20191230, 20191231, 20200102)]
    bad = [Fold.of("F1", "2019-01-01", "2020-01-05", "2020-01-01", "2020-12-31")]
    with pytest.raises(ValueError):
        folds.check_folds(folds.fold_summary(labelled(spark, rows), bad))
    folds.check_folds(folds.fold_summary(labelled(spark, rows), FOLD))


def test_statistics_come_from_training_rows(spark):
    rows = [("F1", "train", 1.0, None), ("F1", "train", 3.0, None), ("F1", "train", None, None), ("F1", "valid", 100.0, 5.0), ("F1", "valid", None, 5.0)]
    df = spark.createDataFrame(rows, "fold string, role string, x double, e double")
    kept = {r["feature"]: r["kept"] for r in prepare.kept_features(df, ["x", "e"]).collect()}
    assert kept == {"x": True, "e": False}
    filled = prepare.imputed(df, ["x"], prepare.median_table(df, ["x"]))
    out = prepare.standardized(filled, ["x"], prepare.train_moments(filled, ["x"])).filter("role = 'valid'").toPandas().x
    std = np.std([1, 3, 2])
    np.testing.assert_allclose(sorted(out), sorted([0.0, 98 / std]))
