"""Training targets from same-date ranks and medians of the label."""

from pyspark.sql import functions as F

from crosstide.functions.groups import average_ranks, group_quantiles, measure, small_side
from crosstide.schema import DATE, KEYS, LABEL

STRETCH_FROM, STRETCH_BY = 0.9, 10.0


def with_label_rank(df, sizes=None, by=(), label=LABEL, out="label_rank"):
    """Percentile rank of the label among rows that have one; rows without are dropped."""
    labelled = df.filter(F.col(label).isNotNull())
    return average_ranks(labelled, {label: out}, [*by, DATE], [*by, *KEYS], sizes)


def rank_target(u):
    return F.col(u) - 0.5


def decile(u):
    return F.least(F.floor(F.col(u) * 10), F.lit(9)).cast("int")


def relevance(u):
    return F.greatest(F.least(F.ceil(F.col(u) * 10) - 1, F.lit(9)), F.lit(0)).cast("int")


def stretched_rank(u):
    u = F.col(u)
    return F.when(u <= STRETCH_FROM, u).otherwise(STRETCH_FROM + (u - STRETCH_FROM) * STRETCH_BY) - 0.5


def top_decile(u):
    return (F.col(u) > STRETCH_FROM).cast("int")


def relative_target(df, sizes=None, label=LABEL, out="target"):
    """Label minus its same-date median."""
    from crosstide.operators.cross import relative_features
    labelled = df.filter(F.col(label).isNotNull())
    return relative_features(labelled, {out: label}, sizes)


def group_sizes(df, by=(), label=LABEL):
    """Rows per ranking group (date)."""
    return df.filter(F.col(label).isNotNull()).groupBy(*by, DATE).agg(F.count(F.lit(1)).alias("group_rows"))


def residual_rank(df, sizes=None, by=(), pred="pred", label=LABEL):
    """rank(label) - rank(prediction) among rows that have both."""
    both = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    ranked = average_ranks(both, {label: "label_rank", pred: "pred_rank"}, [*by, DATE], [*by, *KEYS], sizes)
    return ranked.withColumn("residual", F.col("label_rank") - F.col("pred_rank"))


def distribution(df, value, by=(), points=(0, .01, .25, .5, .75, .99, 1), sizes=None):
    """Count, mean, population std and exact quantiles of a column."""
    moments = df.groupBy(*by).agg(F.count(value).alias("present"), F.avg(value).alias("mean"),
                                  F.stddev_pop(value).alias("std"))
    found = group_quantiles(df, by, value, points, sizes)
    names = ["min", *[f"p{round(p * 100):02d}" for p in points[1:-1]], "max"]
    found = found.select(*by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])
    return moments.join(F.broadcast(found) if not by else found, list(by)) if by else moments.crossJoin(F.broadcast(found))
