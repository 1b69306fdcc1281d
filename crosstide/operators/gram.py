"""Linear fits from sufficient statistics: one scan serves every fold, feature subset and penalty.

Per fold the training rows give a Gram matrix of the imputed features, their sums and cross products with the target. Values are
shifted by the fold's training median, so a missing value (filled with the median) is zero. Each task adds up its own matrices; their
cells are summed by (fold, row, column), so nothing but fixed-size tables is shuffled or collected: folds x features squared, whatever
the number of rows. Means, population deviations, scaled matrices of any subset and ridge coefficients follow from these numbers.
"""

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from crosstide.functions.blocks import in_role, kept_schema, mapped
from crosstide.operators.models import RIDGE_ALPHA

BLOCK_ROWS = 4096


def median_arrays(medians, features):
    """{fold: training medians in feature order}; NaN for a feature without training values. One row per fold and feature."""
    places, found = {f: i for i, f in enumerate(features)}, {}
    for r in medians.collect():
        if r["feature"] in places:
            found.setdefault(r["fold"], np.full(len(features), np.nan))[places[r["feature"]]] = np.nan if r["median"] is None else r["median"]
    return found


def shifted(values, median):
    """Imputed values minus the training medians; a feature without any training value is zero."""
    out = values - median
    out[np.isnan(out)] = 0.0
    return out


@dataclass(frozen=True)
class Statistics:
    """Counts, sums and cross products of one fold; the last row and column are the target, the one before is the constant."""
    features: tuple
    median: np.ndarray
    gram: np.ndarray

    @property
    def n(self):
        return self.gram[-2, -2]

    def mean(self):
        return self.gram[-2, :-2] / self.n

    def deviation(self):
        """Population standard deviation; 1 for a constant feature, which is only centred."""
        mean = self.mean()
        spread = np.sqrt(np.maximum(np.diag(self.gram)[:-2] / self.n - mean * mean, 0))
        scale = np.maximum(np.abs(mean), np.sqrt(np.diag(self.gram)[:-2] / self.n))
        return np.where(spread <= 1e-9 * scale, 1.0, spread)

    def kept(self):
        """Places of the features that have a training value."""
        return np.flatnonzero(~np.isnan(self.median))

    def ridge(self, names=None, alpha=RIDGE_ALPHA):
        """Coefficients in scaled units over all features (zero outside the subset) and the intercept."""
        wanted = set(self.features if names is None else names)
        use = np.array([i for i in self.kept() if self.features[i] in wanted], int)
        mean, scale, weights = self.mean(), self.deviation(), np.zeros(len(self.features))
        target = self.gram[-2, -1] / self.n
        if len(use):
            cross = (self.gram[np.ix_(use, use)] - self.n * np.outer(mean[use], mean[use])) / np.outer(scale[use], scale[use])
            against = (self.gram[use, -1] - self.n * mean[use] * target) / scale[use]
            weights[use] = np.linalg.solve(cross + alpha * np.eye(len(use)), against)
        return weights, target


def fold_statistics(rows, features, target, medians):
    """{fold: Statistics} of the training rows with a target."""
    features, k = tuple(features), len(features)
    names = sorted(medians)

    def run(parts):
        sums = {}
        for batch, values in parts:
            known = np.flatnonzero(batch.column(target).is_valid().to_numpy(zero_copy_only=False))
            folds, y = batch.column("fold").to_numpy(zero_copy_only=False)[known], batch.column(target).cast(pa.float64()).to_numpy(zero_copy_only=False)[known]
            values = values if len(known) == len(values) else values[known]
            for fold in np.unique(folds):
                mine = np.flatnonzero(folds == fold)
                total = sums.setdefault(fold, np.zeros((k + 2, k + 2)))
                for a in range(0, len(mine), BLOCK_ROWS):
                    part = mine[a:a + BLOCK_ROWS]
                    z = np.column_stack([shifted(values[part], medians[fold]), np.ones(len(part)), y[part]])
                    total += z.T @ z
        for fold, total in sums.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([fold] * (k + 2), pa.string()), "i": pa.array(np.arange(k + 2), pa.int32()), "cells": pa.array(list(total), pa.list_(pa.float64()))})

    cells = mapped(in_role(rows, "train"), features, ["fold", target], run, "fold string, i int, cells array<double>").select("fold", "i", F.posexplode("cells").alias("j", "v"))
    grams = {f: np.zeros((k + 2, k + 2)) for f in names}
    for r in cells.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():  # folds x (features + 2) squared
        grams[r["fold"]][r["i"], r["j"]] = r["v"]
    return {f: Statistics(features, medians[f], g) for f, g in grams.items() if g[k, k] > 0}


def predicted(rows, statistics, models, keep):
    """Validation rows scored by every model: one row per model, fold and row.

    ``models`` maps a name to {fold: (weights, intercept)}; all models share one pass over the rows.
    """
    names = list(models)
    parts = {}
    for fold, s in statistics.items():
        weights = np.stack([models[m][fold][0] for m in names], axis=1) / s.deviation()[:, None]
        parts[fold] = s.median, weights, np.array([models[m][fold][1] for m in names]) - s.mean() @ weights
    features = next(iter(statistics.values())).features
    schema = kept_schema(rows, keep).add("model", "string").add("pred", "double")

    def run(blocks):
        for batch, values in blocks:
            known = np.isin(batch.column("fold").to_numpy(zero_copy_only=False), list(parts))
            if not known.all():
                batch, values = batch.filter(pa.array(known)), values[known]
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            found = np.zeros((len(batch), len(names)))
            for fold in np.unique(folds):
                mine = folds == fold
                median, weights, constant = parts[fold]
                found[mine] = shifted(values[mine], median) @ weights + constant
            for m, name in enumerate(names):
                out = batch.select(list(keep)).append_column("model", pa.array([name] * len(batch), pa.string()))
                yield out.append_column("pred", pa.array(np.ascontiguousarray(found[:, m])))

    return mapped(in_role(rows, "valid"), features, list(keep), run, schema)


def save_bundle(path, spark, statistics, models):
    """A frozen linear bundle: one JSON row per fold with feature order, medians, means, deviations and each model's coefficients."""
    rows = []
    for fold, s in statistics.items():
        fitted = {m: {"weights": models[m][fold][0].tolist(), "intercept": float(models[m][fold][1])} for m in models}
        rows.append((fold, len(s.features), json.dumps({"features": s.features, "median": [None if np.isnan(x) else x for x in s.median.tolist()], "mean": s.mean().tolist(), "deviation": s.deviation().tolist(), "models": fitted})))
    spark.createDataFrame(rows, "fold string, feature_count int, bundle string").coalesce(1).write.json(path)


@dataclass(frozen=True)
class Frozen:
    """A loaded fold of a bundle, enough to score rows."""
    features: tuple
    median: np.ndarray
    _mean: np.ndarray
    _deviation: np.ndarray

    def mean(self):
        return self._mean

    def deviation(self):
        return self._deviation


def load_bundle(path, spark, features):
    """({fold: Frozen}, models) after checking feature order and count."""
    statistics, models = {}, {}
    for r in spark.read.schema("fold string, feature_count int, bundle string").json(path).collect():  # one row per fold
        said = json.loads(r["bundle"])
        if said["features"] != list(features) or r["feature_count"] != len(features):
            raise ValueError("the stored model expects other features or another order")
        number = lambda name: np.array([np.nan if x is None else x for x in said[name]], float)
        statistics[r["fold"]] = Frozen(tuple(features), number("median"), number("mean"), number("deviation"))
        for m, fit in said["models"].items():
            models.setdefault(m, {})[r["fold"]] = np.array(fit["weights"]), fit["intercept"]
    return statistics, models
