"""Pluggable per-group transforms: by name for built-in aggregates, by function for the rest."""

from pyspark.sql import functions as F

NAMED = {
    "mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_pop, "nunique": F.count_distinct,
}


def group_transform(df, column, operation, by, out):
    """Group value on every row; ``operation`` is a name or a function from column to aggregate.

    The aggregate is made once per group and joined back, so a group may have any size.
    """
    call = NAMED[operation] if isinstance(operation, str) else operation
    values = df.groupBy(*by).agg(call(column).alias(out))
    return df.join(values, list(by))


def group_apply(df, function, by, schema):
    """Custom pandas code per group, for groups that one task can hold."""
    return df.groupBy(*by).applyInPandas(function, schema)
