"""Two models side by side: correlation, shared top sets, returns by membership, persistence."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.groups import average_ranks, group_quantiles, with_positions
from crosstide.functions.guards import count_true, rank_correlation, ratio
from crosstide.operators.evaluate import tradable
from crosstide.schema import DATE, ENTITY, KEYS, LABEL

GROUPS = ("common_top", "a_only", "b_only", "neither")


def daily_correlation(df, run=(), sizes=None, a="pred_a", b="pred_b"):
    """Spearman correlation of two predictions per date."""
    ranked = average_ranks(df, {a: "_a", b: "_b"}, [*run, DATE], [*run, *KEYS], sizes, percent=False)
    return ranked.groupBy(*run, DATE).agg(rank_correlation("_a", "_b").alias("prediction_spearman"))


def daily_summary(daily, value, run=(), sizes=None):
    """Mean, median, population std, 10 % and 90 % quantiles and number of defined days."""
    used = daily.filter(F.col(value).isNotNull())
    moments = used.groupBy(*run).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("days"))
    q = group_quantiles(used, list(run), value, [0.5, 0.1, 0.9], sizes).select(
        *run, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("median", "p10", "p90"))])
    return moments.join(q, list(run)) if run else moments.crossJoin(F.broadcast(q))


def with_membership(df, run=(), sizes=None, a="pred_a", b="pred_b"):
    """Tradable rows with ``in_a`` and ``in_b``: whether each model's top set holds the row."""
    by = [*run, DATE]
    rows = df.filter(tradable())
    for side, pred in (("a", a), ("b", b)):
        rows = with_positions(rows, by, [F.col(pred).desc_nulls_last(), F.col(ENTITY).asc()], sizes, before=f"_at_{side}", total="pool")
        rows = rows.withColumn(f"in_{side}", F.col(f"_at_{side}") < F.greatest(F.floor(F.col("pool") / 10), F.lit(1)))
        rows = rows.drop(f"_at_{side}") if side == "b" else rows.drop(f"_at_{side}", "pool")
    group = (F.when(F.col("in_a") & F.col("in_b"), GROUPS[0]).when(F.col("in_a"), GROUPS[1])
             .when(F.col("in_b"), GROUPS[2]).otherwise(GROUPS[3]))
    return rows.withColumn("membership", group)


def daily_overlap(members, run=()):
    both, either = F.col("in_a") & F.col("in_b"), F.col("in_a") | F.col("in_b")
    days = members.groupBy(*run, DATE).agg(count_true(both).alias("common"), count_true(either).alias("union_rows"),
                                           count_true(F.col("in_a")).alias("top_size"))
    days = days.withColumns({"jaccard": ratio("common", "union_rows"), "overlap": ratio("common", "top_size")})
    return days.withColumns({"exclusive_union": 1 - F.col("jaccard"), "exclusive_per_model": 1 - F.col("overlap")})


def returns_by_membership(members, run=()):
    """Mean return and mean excess over the day's labelled pool, per membership group."""
    days = members.filter(F.col(LABEL).isNotNull()).groupBy(*run, DATE, "membership").agg(
        F.sum(LABEL).alias("_sum"), F.count(LABEL).alias("_n"))
    day = Window.partitionBy(*run, DATE)
    market = ratio(F.sum("_sum").over(day), F.sum("_n").over(day))
    days = days.withColumn("_excess", F.col("_sum") - F.col("_n") * market)
    return days.groupBy(*run, "membership").agg(
        F.sum("_n").alias("rows"), ratio(F.sum("_sum"), F.sum("_n")).alias("mean_return"),
        ratio(F.sum("_excess"), F.sum("_n")).alias("mean_excess"))


def missing_by_membership(members, run=()):
    missing = count_true(F.col(LABEL).isNull())
    return members.filter(F.col("membership") != GROUPS[3]).groupBy(*run, "membership").agg(
        missing.alias("missing_rows"), F.count(F.lit(1)).alias("rows"), ratio(missing, F.count(F.lit(1))).alias("fraction"))


def membership_runs(tops, days, run=()):
    """Runs of consecutive market dates on which an entity sits unlabelled in the top set."""
    gone = tops.filter(F.col(LABEL).isNull()).select(*run, *KEYS).join(days.select(*run, DATE, "day"), [*run, DATE])
    order = Window.partitionBy(*run, ENTITY).orderBy("day")
    islands = gone.withColumn("_island", F.col("day") - F.row_number().over(order))
    return islands.groupBy(*run, ENTITY, "_island").agg(
        F.min(DATE).alias("start"), F.max(DATE).alias("end"), F.count(F.lit(1)).alias("run_days")).drop("_island")


def persistence(found, days, run=()):
    """Run counts and how many entities reach 20, 60 or all dates."""
    longest = found.groupBy(*run, ENTITY).agg(F.max("run_days").alias("longest"), F.count(F.lit(1)).alias("_runs"))
    full = days.groupBy(*run).agg(F.count(F.lit(1)).alias("_dates"))
    joined = longest.join(full, list(run)) if run else longest.crossJoin(F.broadcast(full))
    return joined.groupBy(*run).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("_runs").alias("runs"), F.max("longest").alias("longest_run"),
        count_true(F.col("longest") >= 20).alias("entities_ge20"), count_true(F.col("longest") >= 60).alias("entities_ge60"),
        count_true(F.col("longest") == F.col("_dates")).alias("entities_full"))


def duplicate_share(tops, run=()):
    """Share of unlabelled top rows whose prediction also occurs on another such row of the date."""
    gone = tops.filter(F.col(LABEL).isNull())
    values = gone.groupBy(*run, DATE, "pred").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy(*run).agg(
        F.sum("n").alias("missing_top_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        ratio(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)), F.sum("n")).alias("duplicate_fraction"))
