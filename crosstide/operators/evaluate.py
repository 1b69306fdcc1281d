"""Prediction scoring: daily rank correlation, top-group return, top-set turnover, final score.

Two policies exist.  ``OFFICIAL`` means are strict (one undefined day makes the result
undefined) and top sets hold floor(n/10) rows; ``PROVISIONAL`` skips undefined days and cuts ten
near-equal groups.  ``run`` names the columns that tell runs apart (experiment, fold, ...): all
runs are scored in one pass.
"""

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.groups import average_ranks, measure, with_positions
from crosstide.functions.guards import count_true, rank_correlation, ratio, strict_mean
from crosstide.operators import day_kernel
from crosstide.schema import DATE, ENTITY, KEYS, LABEL

DAYS_PER_YEAR = 252


@dataclass(frozen=True)
class Policy:
    strict: bool
    min_ic_rows: int
    min_pool: int

    def adjusted(self, min_ic_rows, min_pool):
        """The same rules at other row thresholds, for thinner panels."""
        return Policy(self.strict, min_ic_rows, min_pool)

    def top(self, n):
        return F.greatest(F.floor(n / 10), F.lit(1)) if self.strict else F.ceil(n / 10)

    def mean(self, c):
        return strict_mean(c) if self.strict else F.avg(c)


OFFICIAL = Policy(True, 30, 100)
PROVISIONAL = Policy(False, 2, 10)


def tradable():
    return F.coalesce(F.col("flag_limit_up") == 0, F.lit(False))


def by_prediction():
    return [F.col("pred").desc_nulls_last(), F.col(ENTITY).asc()]


def daily_ic(df, policy, run=(), sizes=None):
    """Spearman correlation of prediction and label per date."""
    by = [*run, DATE]
    used = df.filter(F.col(LABEL).isNotNull())
    if not policy.strict:
        used = used.filter(F.col("pred").isNotNull())
    ranked = average_ranks(used, {"pred": "_p", LABEL: "_y"}, by, [*run, *KEYS], sizes, percent=False)
    days = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("ic_rows"), F.count("pred").alias("_preds"),
                                   rank_correlation("_p", "_y").alias("rank_ic"))
    days = days.withColumn("rank_ic", F.when((F.col("ic_rows") >= policy.min_ic_rows)
                                             & (F.col("_preds") == F.col("ic_rows")), F.col("rank_ic"))).drop("_preds")
    return days.filter(F.col("ic_rows") >= policy.min_ic_rows) if policy.strict else days


def ranked_pool(df, policy, run=(), sizes=None, labelled=True):
    """Tradable rows with ``place`` (1 = highest prediction), pool size ``pool`` and top size."""
    pool = df.filter(tradable())
    if labelled:
        pool = pool.filter(F.col(LABEL).isNotNull())
    if not policy.strict:
        pool = pool.filter(F.col("pred").isNotNull())
    placed = with_positions(pool, [*run, DATE], by_prediction(), sizes, before="place", total="pool")
    placed = placed.filter(F.col("pool") >= policy.min_pool)
    return placed.withColumns({"place": F.col("place") + 1, "top_size": policy.top(F.col("pool")).cast("long")})


def daily_returns(df, policy, run=(), sizes=None):
    """Mean label of the top and bottom groups and of the whole pool, per date."""
    placed = ranked_pool(df, policy, run, sizes)
    # The last of ten near-equal groups is floor-sized, as is the official bottom group.
    bottom = F.greatest(F.floor(F.col("pool") / 10), F.lit(1))
    mean = lambda test: F.avg(F.when(test, F.col(LABEL)))
    days = placed.groupBy(*run, DATE).agg(
        F.count(F.lit(1)).alias("return_rows"), F.max("top_size").alias("return_top_rows"),
        mean(F.col("place") <= F.col("top_size")).alias("top_return"),
        mean(F.col("place") > F.col("pool") - bottom).alias("bottom_return"),
        F.avg(LABEL).alias("market_return"))
    return days.withColumns({"top_excess": F.col("top_return") - F.col("market_return"),
                             "spread": F.col("top_return") - F.col("bottom_return")})


def top_rows(df, policy, run=(), sizes=None, labelled=False):
    """The top set as rows (date, entity)."""
    placed = ranked_pool(df, policy, run, sizes, labelled)
    return placed.filter(F.col("place") <= F.col("top_size"))


def calendar(df, run=()):
    """Observed dates with their index and predecessor; one row per (run, date)."""
    dates = df.select(*run, DATE).distinct()
    order = Window.partitionBy(*run).orderBy(DATE)
    return dates.withColumns({"day": F.row_number().over(order), "previous_date": F.lag(DATE).over(order)})


def set_turnover(tops, days, run=(), count=None):
    """Jaccard distance to the previous date's set, per date with a set.

    A member is kept when the same entity's last membership is the previous observed date, so no
    set is ever collected.  Dates without a set break the chain.  ``count`` names a column whose
    present values are counted per set.
    """
    member = Window.partitionBy(*run, ENTITY).orderBy(DATE)
    extra = [] if count is None else [count]
    tops = tops.select(*run, *KEYS, *extra).join(days, [*run, DATE])
    tops = tops.withColumn("_kept", F.lag(DATE).over(member) == F.col("previous_date"))
    counted = [F.count(c).alias("counted") for c in extra]
    sets = tops.groupBy(*run, DATE).agg(F.count(F.lit(1)).alias("_size"), count_true(F.col("_kept")).alias("_both"), *counted)
    chain = Window.partitionBy(*run).orderBy(DATE)
    sets = days.join(sets, [*run, DATE], "left").withColumn("_before", F.lag("_size").over(chain))
    union = F.col("_size") + F.col("_before") - F.col("_both")
    return sets.filter(F.col("_size").isNotNull()).select(
        *run, DATE, F.col("_size").alias("turnover_top_rows"), (1 - ratio("_both", union)).alias("turnover"), *["counted" for _ in extra])


def daily_turnover(df, policy, run=(), sizes=None, labelled=False):
    return set_turnover(top_rows(df, policy, run, sizes, labelled), calendar(df, run), run)


_COUNTED = ("rows", "predictions", "missing_predictions", "labels", "return_eligible_rows", "turnover_eligible_rows")


def daily_metrics(df, policy, run=(), sizes=None):
    """One row per date with every count and metric."""
    sizes = sizes or measure(df, [*run, DATE])
    by = [*run, DATE]
    if day_kernel.fits(sizes):
        days, size = day_kernel.daily_scores(df, policy, run, counts=True), F.size("tops")
        days = days.withColumns({
            "ic_rows": F.when(F.col("_counted"), F.col("ic_rows")).otherwise(0), "top_excess": F.col("top_return") - F.col("market_return"),
            "spread": F.col("top_return") - F.col("bottom_return"), "turnover_top_rows": F.when(F.col("tops").isNotNull(), size).otherwise(0).cast("long")})
        return with_turnover(days, run).select(*by, *_COUNTED, "ic_rows", "rank_ic", "return_top_rows", "top_return", "bottom_return", "top_excess",
                                               "spread", "turnover_top_rows", "turnover")
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("pred").alias("predictions"),
        (F.count(F.lit(1)) - F.count("pred")).alias("missing_predictions"), F.count(LABEL).alias("labels"),
        count_true(F.col("pred").isNotNull() & F.col(LABEL).isNotNull() & tradable()).alias("return_eligible_rows"),
        count_true(F.col("pred").isNotNull() & tradable()).alias("turnover_eligible_rows"))
    parts = [daily_ic(df, policy, run, sizes),
             daily_returns(df, policy, run, sizes).drop("market_return", "return_rows"),
             daily_turnover(df, policy, run, sizes)]
    for part in parts:
        counts = counts.join(part, by, "left")
    tops = {"return_top_rows": 0, "turnover_top_rows": 0, "ic_rows": 0}
    return counts.fillna(tops)


def ic_summary(ic, policy, run=()):
    """Mean, spread and sign of the daily correlations."""
    x = F.col("rank_ic")
    spread = F.stddev_samp(x) if policy.strict else F.stddev_pop(x)
    if policy.strict:
        spread = F.when(F.count(x) == F.count(F.lit(1)), spread)
    positive = F.coalesce((x > 0).cast("double"), F.lit(0.0)) if policy.strict else F.when(x.isNotNull(), (x > 0).cast("double"))
    out = ic.groupBy(*run).agg(policy.mean(x).alias("ic_mean"), spread.alias("ic_std"),
                               F.avg(positive).alias("ic_positive_ratio"))
    icir = F.when(F.col("ic_std") > 0, ratio("ic_mean", "ic_std"))
    return out.withColumn("icir", F.coalesce(icir, F.lit(0.0)) if policy.strict else icir)


def return_summary(returns, policy, run=()):
    year = lambda c, name: (policy.mean(F.col(c)) * DAYS_PER_YEAR).alias(name)
    return returns.groupBy(*run).agg(year("top_excess", "annual_excess"), year("top_return", "top1_annual_ret"),
                                     year("spread", "annual_spread"))


def turnover_summary(turnover, run=(), out="mean_turnover"):
    """Mean turnover; with counted sets also the number of labelled members."""
    counted = [F.sum("counted").alias("labelled_top_rows")] if "counted" in turnover.columns else []
    return turnover.groupBy(*run).agg(F.avg("turnover").alias(out), *counted)


def final_score():
    return F.col("ic_mean") * 0.4 + F.col("annual_excess") * 0.3 + (1 - F.col("mean_turnover")) * 0.3


def with_turnover(days, run=(), sets="tops", out="turnover"):
    """Jaccard distance of each date's set to the one of the date before; a date without a set breaks the chain."""
    before = F.lag(sets).over(Window.partitionBy(*run).orderBy(DATE))
    days = days.withColumn("_before", before)
    both = F.size(F.array_intersect(sets, "_before"))
    union = F.size(sets) + F.size("_before") - both
    return days.withColumn(out, F.when(F.col(sets).isNotNull() & F.col("_before").isNotNull(), 1 - ratio(both, union))).drop("_before", sets)


def summed(days, policy, run=()):
    """The score rows of daily rows with their top sets, in one aggregate."""
    days = with_turnover(days, run)
    days = days.withColumns({"top_excess": F.col("top_return") - F.col("market_return"), "spread": F.col("top_return") - F.col("bottom_return")})
    x, counted = F.col("rank_ic"), F.col("_counted")
    sd = F.stddev_samp(x) if policy.strict else F.stddev_pop(x)
    share = F.avg(F.when(counted, F.coalesce((x > 0).cast("double"), F.lit(0.0)))) if policy.strict else F.avg((x > 0).cast("double"))
    whole = (F.count(x) == count_true(counted)) if policy.strict else F.lit(True)
    year = lambda c: F.avg(c) * DAYS_PER_YEAR
    out = days.groupBy(*run).agg(
        F.when(whole, F.avg(x)).alias("ic_mean"), F.when(whole, sd).alias("ic_std"), share.alias("ic_positive_ratio"),
        year("top_excess").alias("annual_excess"), year("top_return").alias("top1_annual_ret"), F.avg("turnover").alias("mean_turnover"))
    icir = F.when(F.col("ic_std") > 0, ratio("ic_mean", "ic_std"))
    out = out.withColumn("icir", F.coalesce(icir, F.lit(0.0)) if policy.strict else icir)
    return out.select(*run, "ic_mean", "ic_std", "ic_positive_ratio", "icir", "annual_excess", "top1_annual_ret", "mean_turnover").withColumn(
        "final_score", final_score())


def score(df, policy, run=(), sizes=None):
    """One score row per run."""
    sizes = sizes or measure(df, [*run, DATE])
    if day_kernel.fits(sizes):
        return summed(day_kernel.daily_scores(df, policy, run), policy, run)
    parts = [ic_summary(daily_ic(df, policy, run, sizes), policy, run),
             return_summary(daily_returns(df, policy, run, sizes), policy, run).drop("annual_spread"),
             turnover_summary(daily_turnover(df, policy, run, sizes), run)]
    if run:
        parts = [df.select(*run).distinct(), *parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(run), "left") if run else out.crossJoin(F.broadcast(part))
    return out.withColumn("final_score", final_score())


def diagnostics(df, policy, run=(), sizes=None):
    """Turnover without unlabelled rows, its gap to the official one, unlabelled share of the top."""
    sizes = sizes or measure(df, [*run, DATE])
    if day_kernel.fits(sizes):
        days = day_kernel.daily_sets(df, policy, run).withColumn("_labelled", F.col("labelled_tops").isNotNull())
        days = with_turnover(with_turnover(days, run), run, "labelled_tops", "_turnover")
        out = days.groupBy(*run).agg(
            F.avg("turnover").alias("mean_turnover"), F.avg("_turnover").alias("diagnostic_turnover"), F.sum("top_rows").alias("top_rows"),
            ratio(F.sum("missing"), F.sum("top_rows")).alias("missing_top_fraction"), count_true(F.col("_labelled")).alias("_sets"))
        out = out.filter((F.col("top_rows") > 0) & (F.col("_sets") > 0)).drop("_sets") if run else out.drop("_sets")
        return out.withColumn("turnover_gap", F.col("diagnostic_turnover") - F.col("mean_turnover"))
    official = turnover_summary(daily_turnover(df, policy, run, sizes), run)
    labelled = turnover_summary(daily_turnover(df, policy, run, sizes, labelled=True), run, "diagnostic_turnover")
    missing = top_rows(df, policy, run, sizes).groupBy(*run).agg(
        F.count(F.lit(1)).alias("top_rows"), F.avg(F.col(LABEL).isNull().cast("double")).alias("missing_top_fraction"))
    out = official.join(labelled, list(run)).join(missing, list(run)) if run else (
        official.crossJoin(F.broadcast(labelled)).crossJoin(F.broadcast(missing)))
    return out.withColumn("turnover_gap", F.col("diagnostic_turnover") - F.col("mean_turnover"))


def tie_diagnostics(df, policy, run=(), sizes=None, labelled=False):
    """Largest tie and the tie at the cut-off of each date's top set."""
    by = [*run, DATE]
    placed = ranked_pool(df, policy, run, sizes, labelled)
    top = F.col("place") <= F.col("top_size")
    values = placed.groupBy(*by, "pred").agg(
        F.count(F.lit(1)).alias("_ties"), count_true(top).alias("_inside"), F.max("pool").alias("_pool"),
        F.max("top_size").alias("_top"), count_true(F.col(LABEL).isNull()).alias("_missing"),
        count_true(top & F.col(LABEL).isNull()).alias("_missing_top"))
    # The cut-off value is the lowest one with a row inside; its row carries the tie.
    cut = F.min_by(F.struct("_ties", "_inside"), F.when(F.col("_inside") > 0, F.col("pred")))
    days = values.groupBy(*by).agg(
        F.max("_pool").alias("eligible_rows"), F.max("_top").alias("top_rows"),
        F.sum("_missing").alias("missing_eligible"), F.sum("_missing_top").alias("missing_top"),
        F.max("_ties").alias("largest_tie"), cut.alias("_cut"))
    return days.select(*by, "eligible_rows", "top_rows", "missing_eligible", "missing_top", "largest_tie",
                       F.col("_cut._ties").alias("cutoff_tie"), F.col("_cut._inside").alias("cutoff_inside"),
                       (F.col("_cut._inside") < F.col("_cut._ties")).alias("boundary_splits_tie"))
