"""Spark ML baselines on prepared fold rows, frozen bundles, and batch scoring."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from crosstide.functions.blocks import kept_schema, mapped
from crosstide.functions.groups import pinned
from crosstide.operators.prepare import imputed, kept_features, median_table, standardized, train_moments
from crosstide.schema import KEYS

RIDGE_ALPHA = 10.0


def assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="features")


def prepared(rows, features):
    """Imputed and scaled rows, and per fold the features that have training values."""
    kept = {}
    for r in kept_features(rows, features).filter("kept").select("fold", "feature").toLocalIterator():
        kept.setdefault(r["fold"], set()).add(r["feature"])
    # One small row per fold each, written once: every fit and score reads them again.
    filled = imputed(rows, features, pinned(median_table(rows, features)))
    return standardized(filled, features, pinned(train_moments(filled, features))), kept


def ridge(train, target):
    """Least squares with an L2 penalty of alpha on the sum of squares.

    Spark scales the penalty by the label's std over the row count, so the setting undoes that.
    """
    row = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    return LinearRegression(labelCol=target, featuresCol="features", predictionCol="pred", solver="normal",
                            standardization=False, elasticNetParam=0.0, regParam=RIDGE_ALPHA * (row["s"] or 0.0) / row["n"])


def boosted_regressor(target, rounds=20, depth=5, seed=2026):
    return GBTRegressor(labelCol=target, featuresCol="features", predictionCol="pred", maxIter=rounds, maxDepth=depth, seed=seed)


def boosted_classifier(target, rounds=20, depth=5, seed=2026):
    return GBTClassifier(labelCol=target, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)


def fit_bundle(train, features, estimator):
    return Pipeline(stages=[assembler(features), estimator]).fit(train)


def score_rows(bundle, rows, keep):
    """Predictions of a fitted bundle; a classifier gives its positive probability."""
    out = bundle.transform(rows)
    if "probability" in out.columns:
        out = out.withColumn("pred", vector_to_array("probability")[1])
    return out.select(*keep, "pred")


def score_with(rows, load, features, keep):
    """Batch scoring with any object that has ``predict(frame)``; ``load`` runs once per task."""
    if hasattr(rows, "mapped"):
        def score(parts):
            model = load()
            for batch, cells in parts:
                pred = np.asarray(model.predict(pd.DataFrame(cells, columns=list(features))), float)
                yield batch.append_column("pred", pa.array(pred, from_pandas=True))
        return mapped(rows, features, keep, score, kept_schema(rows, keep).add("pred", "double"))

    def run(batches):
        model = load()
        for frame in batches:
            yield frame[list(keep)].assign(pred=model.predict(frame[list(features)]))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keep) + ", pred double"
    return rows.select(*dict.fromkeys([*keep, *features])).mapInPandas(run, schema)


def validation_predictions(rows, features, make_estimator, target, keep):
    """Fit on each fold's training rows and score its validation rows.

    Fitting reads the rows several times: pass a stored table or ``pinned`` rows.
    """
    return fold_predictions(*prepared(rows, features), features, make_estimator, target, keep)


def fold_predictions(ready, kept, features, make_estimator, target, keep):
    """As above, from prepared rows: sets of features can share one preparation."""
    parts = []
    for fold in sorted(kept):
        names = [f for f in features if f in kept[fold]]
        mine = ready.filter(F.col("fold") == fold)
        train = mine.filter((F.col("role") == "train") & F.col(target).isNotNull())
        estimator = make_estimator(train)
        parts.append(score_rows(fit_bundle(train, names, estimator), mine.filter("role = 'valid'"), keep))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def save_bundle(bundle, features, path, spark):
    """Frozen model with its feature order beside it."""
    bundle.write().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(list(features)), len(features))], "features string, feature_count int").write.json(f"{path}/contract")


def load_bundle(spark, path, features):
    """The stored model, after checking feature order and count."""
    row = spark.read.schema("features string, feature_count int").json(f"{path}/contract").first()
    stored = json.loads(row["features"])
    if stored != list(features) or row["feature_count"] != len(features):
        raise ValueError("the stored model expects other features or another order")
    return PipelineModel.load(f"{path}/model")


def extend_predictions(frozen, candidates, score, keys=KEYS):
    """Score only keys without a frozen prediction and append them; the prefix stays as it is."""
    fresh = score(candidates.join(frozen.select(*keys), list(keys), "left_anti"))
    return frozen.select(*keys, "pred").unionByName(fresh.select(*keys, "pred"))


def prefix_changes(frozen, extended, keys=KEYS):
    """Rows of the frozen table that are missing or different in the extended one."""
    other = extended.select(*keys, F.col("pred").alias("_pred"), F.lit(True).alias("_there"))
    joined = frozen.join(other, list(keys), "left")
    return joined.filter(F.col("_there").isNull() | ~F.col("pred").eqNullSafe(F.col("_pred")))

