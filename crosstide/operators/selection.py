"""Choosing among scored candidates, comparing experiments, and decision flags.

The inputs are score tables: one row per experiment, fold and grid point.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.guards import count_true, ratio, strict_mean

# Metrics where a smaller value is better.
LOWER_IS_BETTER = ("mean_turnover", "diagnostic_turnover", "missing_top_fraction", "turnover_gap")
SCORE_WEIGHTS = {"ic_mean": 0.4, "annual_excess": 0.3, "mean_turnover": -0.3}
# Scores are compared at this many decimals, so that the order of a sum's terms cannot decide between equal candidates.
COMPARED_DECIMALS = 9


def compared(column):
    """The value by which candidates are ordered; -0 and 0 are one value."""
    return F.round(F.col(column) if isinstance(column, str) else column, COMPARED_DECIMALS) + F.lit(0.0)


def require_folds(scores, folds):
    """Rows of the declared folds, after checking that each of them is present."""
    chosen = scores.filter(F.col("fold").isin(*folds))
    found = {r["fold"] for r in chosen.select("fold").distinct().take(len(folds) + 1)}
    if found != set(folds):
        raise ValueError(f"selection folds {sorted(folds)} incomplete: {sorted(found)}")
    return chosen


def candidates(scores, by):
    """Mean and worst score and mean turnover of each candidate."""
    return scores.groupBy(*by).agg(F.avg("final_score").alias("mean_score"), F.min("final_score").alias("worst_score"),
                                   F.avg("mean_turnover").alias("mean_turnover"))


def best(found, *tie_breaks):
    """The winner: highest mean, then worst score, then lowest turnover, then the given order."""
    return found.orderBy(*preference(), *tie_breaks).limit(1)


def preference():
    return [compared("mean_score").desc(), compared("worst_score").desc(), compared("mean_turnover").asc()]


def select_grid_point(scores, by=()):
    """One winner for each value of ``by`` (for instance each model)."""
    found = candidates(scores, [*by, "alpha", "exit_fraction"])
    if not by:
        return best(found, F.desc("alpha"), F.asc("exit_fraction"))
    order = Window.partitionBy(*by).orderBy(*preference(), F.desc("alpha"), F.asc("exit_fraction"))
    return found.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def blend(df, a, b, weight, out="pred"):
    """Weighted mean of two daily ranks."""
    w = F.col(weight) if isinstance(weight, str) else F.lit(float(weight))
    return df.withColumn(out, w * F.col(a) + (1 - w) * F.col(b))


def select_weight(scores):
    return best(candidates(scores, ["weight"]), F.abs(F.col("weight") - 0.5))


def select_feature_set(scores, baseline, counts):
    """Best feature set among those whose score never falls below the baseline's."""
    table = with_deltas(scores, baseline, "feature_set", ["final_score"])
    found = table.groupBy("feature_set").agg(
        F.min("delta_final_score").alias("worst_delta"), F.avg("final_score").alias("mean_score"),
        F.min("final_score").alias("worst_score"))
    found = found.join(F.broadcast(counts), "feature_set")
    found = found.withColumn("eligible", (F.col("feature_set") == baseline) | (compared("worst_delta") >= 0))
    chosen = found.filter("eligible").orderBy(*preference()[:2], F.asc("feature_count")).limit(1)
    return found.join(F.broadcast(chosen.select("feature_set", F.lit(True).alias("selected"))), "feature_set", "left").fillna(
        {"selected": False})


def grid_boundary(selected, alphas, exits):
    """Whether the selected point lies on the edge of the grid."""
    a, e = F.col("alpha"), F.col("exit_fraction")
    return selected.withColumns({"alpha_on_boundary": a.isin(min(alphas), max(alphas)),
                                 "exit_on_boundary": e.isin(min(exits), max(exits))})


def with_deltas(scores, baseline, column, metrics, on=("fold",)):
    """Add ``delta_<metric>`` against the baseline experiment on the same fold."""
    base = scores.filter(F.col(column) == baseline).select(*on, *[F.col(m).alias(f"_base_{m}") for m in metrics])
    out = scores.join(base, list(on))
    return out.withColumns({f"delta_{m}": F.col(m) - F.col(f"_base_{m}") for m in metrics}).drop(*[f"_base_{m}" for m in metrics])


def contributions():
    """Parts of a score difference, from delta columns."""
    names = {"ic_mean": "ic_contribution", "annual_excess": "excess_contribution", "mean_turnover": "turnover_contribution"}
    return {names[m]: F.col(f"delta_{m}") * w for m, w in SCORE_WEIGHTS.items()}


def paired_differences(scores, pairs, column="model"):
    """Score difference of declared pairs per fold, plus the mean row of each pair."""
    spark, metrics = scores.sparkSession, [*SCORE_WEIGHTS, "final_score"]
    listed = F.broadcast(spark.createDataFrame([(a, b) for a, b in pairs], "left_name string, right_name string"))
    side = lambda s: scores.select(F.col(column).alias(f"{s}_name"), "fold", *[F.col(m).alias(f"_{s}_{m}") for m in metrics])
    both = side("left").join(listed, "left_name").join(side("right"), ["right_name", "fold"])
    both = both.withColumns({f"delta_{m}": F.col(f"_right_{m}") - F.col(f"_left_{m}") for m in metrics})
    both = both.withColumns(contributions()).withColumn("comparison", F.concat("right_name", F.lit(" - "), "left_name"))
    values = ["delta_final_score", *contributions()]
    rows = both.select("comparison", "fold", *values)
    mean = rows.groupBy("comparison").agg(*[F.avg(v).alias(v) for v in values]).select("comparison", F.lit("Mean").alias("fold"), *values)
    return rows.unionByName(mean)


def metric_rows(scores, metrics, keep):
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return scores.select(*keep, cells.alias("_c")).select(*keep, "_c.*")


def stability(scores, metrics, by=("model",)):
    """Mean, worst value with its fold, population std and number of defined folds per metric.

    Everything but the count is undefined as soon as one fold is.
    """
    rows = metric_rows(scores, metrics, [*by, "fold"])
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    badness = F.when(lower, -F.col("value")).otherwise(F.col("value"))
    complete = F.count("value") == F.count(F.lit(1))
    worst = F.min(F.struct(badness.alias("b"), "fold", "value"))
    out = rows.groupBy(*by, "metric").agg(
        strict_mean("value").alias("mean"), F.when(complete, worst).alias("_w"),
        F.when(complete, F.stddev_pop("value")).alias("std"), F.count("value").alias("finite_folds"))
    return out.withColumns({"worst": F.col("_w.value"), "worst_fold": F.col("_w.fold")}).drop("_w")


def retention(scores, baseline, column="model"):
    """Candidate means over or minus the baseline's means."""
    metrics = ["ic_mean", "annual_excess", "mean_turnover", "diagnostic_turnover", "final_score"]
    means = scores.groupBy(column).agg(*[F.avg(m).alias(m) for m in metrics])
    base = means.filter(F.col(column) == baseline).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    both = means.crossJoin(F.broadcast(base))
    return both.select(column, ratio("ic_mean", "_ic_mean").alias("ic_retention"),
                       ratio("annual_excess", "_annual_excess").alias("excess_retention"),
                       (F.col("_mean_turnover") - F.col("mean_turnover")).alias("turnover_reduction"),
                       (F.col("_diagnostic_turnover") - F.col("diagnostic_turnover")).alias("diagnostic_reduction"),
                       (F.col("final_score") - F.col("_final_score")).alias("score_improvement"))


def improved(metric):
    d = compared(f"delta_{metric}")
    return d < 0 if metric in LOWER_IS_BETTER else d > 0


def decision_checks(deltas, by="model", ic_tolerance=0.005, score_threshold=0.25):
    """Improved-fold counts and the checks that gate a candidate; differences and means are compared at ``COMPARED_DECIMALS``."""
    counts = {f"improved_{m}": count_true(improved(m)) for m in ("ic_mean", "annual_excess", "mean_turnover", "final_score")}
    out = deltas.groupBy(by).agg(*[c.alias(n) for n, c in counts.items()], compared(F.avg("delta_ic_mean")).alias("_ic"),
                                 compared(F.avg("final_score")).alias("_score"), compared(F.avg("delta_annual_excess")).alias("_excess"))
    out = out.withColumns({
        "excess_improves_2_of_3": F.col("improved_annual_excess") >= 2,
        "score_improves_2_of_3": F.col("improved_final_score") >= 2,
        "ic_stable": F.abs(F.col("_ic")) <= ic_tolerance,
        "score_above_threshold": F.col("_score") >= score_threshold,
        "ic_or_excess_gain": ((F.col("_ic") > 0) & (F.col("improved_ic_mean") >= 2))
        | ((F.col("_excess") > 0) & (F.col("improved_annual_excess") >= 2))})
    checks = ["excess_improves_2_of_3", "score_improves_2_of_3", "ic_stable", "score_above_threshold"]
    passed = F.col(checks[0])
    for c in checks[1:]:
        passed = passed & F.col(c)
    return out.withColumn("accepted", passed).drop("_ic", "_score", "_excess")


def classify_families(deltas, by="model"):
    """Whether dropping a family always hurts, always helps, or neither."""
    d = F.col("delta_final_score")
    verdict = (F.when(F.max(d) < 0, "retain").when(F.min(d) > 0, "deletion_candidate").otherwise("unstable_retain_for_now"))
    return deltas.groupBy(by).agg(verdict.alias("verdict"), F.min(d).alias("lowest"), F.max(d).alias("highest"))


def replay_parity(left, right, keys, metrics, tolerance):
    """Pairs of equal keys with the largest absolute difference and whether it is within tolerance."""
    renamed = right.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    diffs = [F.abs(F.col(m) - F.col(f"_{m}")) for m in metrics]
    both = left.join(renamed, list(keys), "full")
    present = F.lit(True)
    for m in metrics:
        present = present & F.col(m).isNotNull() & F.col(f"_{m}").isNotNull()
    gap = F.when(present, F.greatest(*diffs) if len(diffs) > 1 else diffs[0])
    return both.select(*keys, gap.alias("largest_difference"), F.coalesce(gap <= tolerance, F.lit(False)).alias("within"))


def metric_surface(scores, exits, metric="final_score", by=()):
    """Mean metric by alpha (rows) and exit fraction (columns), for each value of ``by``."""
    named = scores.withColumn("exit_name", F.concat(
        F.lit("exit_"), F.lpad(F.round(F.col("exit_fraction") * 1000).cast("int").cast("string"), 3, "0")))
    names = [f"exit_{round(e * 1000):03d}" for e in exits]
    return named.groupBy(*by, "alpha").pivot("exit_name", names).agg(F.avg(metric))
