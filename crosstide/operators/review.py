"""Recomputation checks of built features."""

from itertools import tee

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from crosstide.functions.groups import pinned
from crosstide.functions.guards import all_present, count_true, ratio
from crosstide.operators.history import WIDE, history_features, trailing
from crosstide.operators.history_kernel import feature_batches, sorted_rows
from crosstide.schema import DATE, ENTITY, KEYS, SOURCES

REVIEW_ROWS = 6


def review_rows(panel, chosen):
    """Chosen rows with the last six closes and features recomputed from that list alone."""
    history = F.collect_list(F.struct(DATE, "close")).over(trailing(REVIEW_ROWS))
    rows = panel.withColumn("history", history).filter(chosen)
    closes = F.col("history")["close"]
    whole = (F.size("history") == REVIEW_ROWS) & F.forall(closes, lambda x: x.isNotNull())
    last = closes[REVIEW_ROWS - 1]
    mean5 = F.aggregate(F.slice(closes, 2, 5), F.lit(0.0), lambda a, x: a + x) / 5
    checks = {"ret_1": ratio(last, closes[REVIEW_ROWS - 2]) - 1, "ret_5": ratio(last, closes[0]) - 1, "madev_5": ratio(last, mean5) - 1}
    return rows.select(*KEYS, "history", F.size("history").cast("long").alias("history_rows"),
                       *[F.when(whole, c).alias(n) for n, c in checks.items()])


def prefix_differences(panel, before, names, placed=False):
    """Per feature: compared cells and cells where a panel cut at a date disagrees with the full one.

    Both read one panel: sums of a derived panel may end in another last digit each time they are made. Views of many columns are made twice
    in the task that holds the entity, from all of its rows and from those before the date, and compared there. ``placed`` says that each entity
    already lies in one partition."""
    if len(names) > WIDE:
        return _compared_in_place(panel, before, list(names), placed)
    panel = pinned(panel.select(*KEYS, *SOURCES))
    full = history_features(panel, names).filter(F.col(DATE) < before)
    cut = history_features(panel.filter(F.col(DATE) < before), names)
    cut = cut.select(*KEYS, *[F.col(n).alias(f"_{n}") for n in names])
    both = full.join(cut, KEYS, "full")
    parts = [F.struct(F.lit(n).alias("feature"), F.count(F.lit(1)).alias("cells"),
                      count_true(~F.col(n).eqNullSafe(F.col(f"_{n}"))).alias("differences")) for n in names]
    return both.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")


def _compared_in_place(panel, before, names, placed):
    def early(batch):
        return batch.filter(pc.fill_null(pc.less(batch.column(DATE), before), False))

    def run(batches):
        cells, differences = 0, np.zeros(len(names), np.int64)
        first, second = tee(batches)
        cut = feature_batches((early(b) for b in second), names)
        for batch, values in feature_batches(first, names):
            mine = pc.fill_null(pc.less(batch.column(DATE), before), False).to_numpy(zero_copy_only=False)
            if not mine.any():
                continue
            part, again = next(cut)
            lone = part.column(ENTITY).is_null().to_numpy(zero_copy_only=False)  # no key to compare by: a cell of its own on either side
            cells += len(part) + int(lone.sum())
            for i, n in enumerate(names):
                a, b = values(n)[mine], again(n)
                gone = np.isnan(a), np.isnan(b)
                differences[i] += ((a != b) & ~(gone[0] & gone[1]) & ~lone).sum() + (lone & ~gone[0]).sum() + (lone & ~gone[1]).sum()
        yield pa.RecordBatch.from_pydict({"cells": pa.array([cells], pa.int64()), "differences": pa.array([differences.tolist()], pa.list_(pa.int64()))})

    found = sorted_rows(panel, [], placed=placed).mapInArrow(run, "cells long, differences array<long>")
    found = found.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.array(*[F.coalesce(F.sum(F.col("differences")[i]), F.lit(0)) for i in range(len(names))]).alias("_d"))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_place") + 1)
    return found.select("cells", F.posexplode("_d").alias("_place", "differences")).select(feature.alias("feature"), "cells", "differences")
