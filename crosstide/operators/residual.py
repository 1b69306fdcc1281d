"""Rank correlation of many columns with a residual, and partial rank correlation."""

from pyspark.sql import functions as F

from crosstide.functions import rank_kernel
from crosstide.functions.groups import average_ranks, pinned, sizes_of
from crosstide.functions.guards import all_present, count_true, rank_correlation, ratio
from crosstide.operators import study_kernel
from crosstide.operators.cross import date_columns, percent_ranks
from crosstide.operators.targets import residual_rank
from crosstide.schema import DATE, KEYS

# Bounds (above, up to) of the prediction rank.
REGIONS = {"full": (None, None), "top20": (0.8, None), "middle60": (0.2, 0.8)}
MEANINGFUL_IC = 0.01


def with_regions(df, rank="pred_rank"):
    """One copy of a row per prediction-rank region that holds it."""
    r = F.col(rank)
    tags = F.array(F.lit("full"), F.when(r > 0.8, "top20"), F.when((r > 0.2) & (r <= 0.8), "middle60"))
    return df.withColumn("region", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def long_features(df, features, keep):
    """One row per row and feature with a present value."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
    return df.select(*keep, cells.alias("_c")).select(*keep, "_c.*").filter(F.col("value").isNotNull())


def column_rank_correlations(df, features, against, by, keys, minimum_rows, sizes=None):
    """Spearman correlation of every feature with every column of ``against`` inside each group.

    Each pair uses the rows where the feature and all compared columns are present; with the
    features as rows, one ranking serves them all.
    """
    ready = df.filter(all_present(*against))
    long = long_features(ready, features, [*dict.fromkeys([*by, *keys]), *against])
    group = [*by, "feature"]
    columns = {"value": "_value_rank", **{a: f"_{a}_rank" for a in against}}
    ranked = average_ranks(long, columns, group, [*dict.fromkeys([*by, *keys]), "feature"], sizes, percent=False)
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("pair_rows"), *[
        rank_correlation("_value_rank", f"_{a}_rank").alias(f"ic_{a}") for a in against], *[
        rank_correlation(f"_{a}_rank", f"_{b}_rank").alias(f"ic_{a}_{b}") for i, a in enumerate(against) for b in against[i + 1:]
    ]).filter(F.col("pair_rows") >= minimum_rows)


def region_rank_correlations(df, features, against, by, keys, minimum_rows, sizes=None, rank="pred_rank"):
    """The same per region of the prediction rank, for any number of features.

    One exchange on ``by``; the features stay columns and are ranked together in one task a group. Groups beyond the kernel's cell limit
    turn features into rows, region by region, which the sliced ranks handle at any size. Features are compared as 32-bit floats.
    """
    sizes = sizes_of(df, by, sizes)
    if rank_kernel.fits(sizes, len(features)):
        return rank_kernel.region_correlations(df, list(features), list(against), list(by), REGIONS, rank, minimum_rows)
    narrow = df.withColumns({f: F.col(f).cast("float").cast("double") for f in features})
    return column_rank_correlations(with_regions(narrow, rank), features, against, [*by, "region"], keys, minimum_rows, sizes)


def study(df, against, run, sizes, minimum_rows):
    """Region correlations of all studied columns, for rows that hold the trailing features, label, ``pred`` and the market's amount ratio.

    Dates whose cells fit a task are one exchange; else every column is made by the ways for dates of any size."""
    by = [*run, DATE]
    if rank_kernel.fits(sizes, len(study_kernel.STUDIED)):
        return study_kernel.region_correlations(df, list(against), by, REGIONS, minimum_rows)
    held = pinned(df)
    full = percent_ranks(date_columns(held, sizes), study_kernel.VIEW, sizes)
    rows = residual_rank(full, sizes, run)
    return region_rank_correlations(rows, study_kernel.STUDIED, against, by, KEYS[:1], minimum_rows, sizes)


def partial_correlation(xy, xp, yp):
    """Correlation of x and y with p held fixed, from the three pairwise ones."""
    x, y, p = F.col(xy), F.col(xp), F.col(yp)
    rest = (1 - y * y) * (1 - p * p)
    return ratio(x - y * p, F.sqrt(F.when(rest > 0, rest)))


def fold_means(daily, value, by=("region", "feature")):
    """Mean over defined days and their number, per fold."""
    return daily.groupBy("fold", *by).agg(F.avg(value).alias("mean_ic"), F.count(value).alias("finite_days"),
                                          F.countDistinct(DATE).alias("days"))


def fold_table_wide(means, folds, by=("region", "feature"), value="mean_ic"):
    return means.groupBy(*by).pivot("fold", list(folds)).agg(F.first(value))


def stability_flags(wide, folds):
    """Same sign in every fold, and at least two folds with a meaningful size."""
    cols = [F.col(f) for f in folds]
    every = lambda test: F.aggregate(F.array(*[F.coalesce(test(c), F.lit(False)) for c in cols]), F.lit(True), lambda a, b: a & b)
    large = sum((F.coalesce(F.abs(c) >= MEANINGFUL_IC, F.lit(False)).cast("int") for c in cols[1:]),
                F.coalesce(F.abs(cols[0]) >= MEANINGFUL_IC, F.lit(False)).cast("int"))
    present = F.array_compact(F.array(*cols))
    n = F.size(present)
    mean = ratio(F.aggregate(present, F.lit(0.0), lambda a, b: a + b), n)
    ordered = F.array_sort(present)
    middle = F.when(n > 0, (F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
                            + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2)
    out = wide.withColumns({"mean_residual_ic": mean, "median_residual_ic": middle,
                            "same_direction": every(lambda c: F.signum(c) > 0) | every(lambda c: F.signum(c) < 0),
                            "two_folds_meaningful": large >= 2})
    return out.withColumn("stable_meaningful", F.col("same_direction") & F.col("two_folds_meaningful"))


def family_summary(flagged, folds, by=("region", "family"), top=5):
    """Means, medians and counts per family; a family is at most the feature catalog's size."""
    mean = F.col("mean_residual_ic")
    best = F.collect_list(F.when(F.col("stable_meaningful"), F.struct((-F.abs(mean)).alias("k"), "feature")))
    names = F.transform(F.slice(F.array_sort(best), 1, top), lambda s: s["feature"])
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("feature_count"),
        *[F.avg(f).alias(f"{f}_mean") for f in folds], *[F.median(f).alias(f"{f}_median") for f in folds],
        F.avg(mean).alias("mean_residual_ic"), F.median(mean).alias("median_residual_ic"),
        F.avg(F.abs(mean)).alias("mean_absolute_ic"),
        count_true(F.col("same_direction")).alias("same_direction_count"),
        count_true(F.col("stable_meaningful")).alias("stable_count"),
        F.array_join(names, ", ").alias("stable_features"))
