"""Scalar guards: one place for every missing-value rule of the panel.

A value that is NaN or infinite counts as missing and is NULL everywhere after ingest.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(c):
    return F.col(c) if isinstance(c, str) else c


def finite(c):
    """The value, or NULL where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a, b):
    """a / b, NULL for a zero divisor."""
    return F.try_divide(col(a), col(b))


def all_present(*cols):
    return reduce(lambda x, y: x & y, [col(c).isNotNull() for c in cols])


def max_of(*cols):
    """Largest of the columns, NULL when any of them is NULL (plain greatest skips NULLs)."""
    return F.when(all_present(*cols), F.greatest(*[col(c) for c in cols]))


def min_of(*cols):
    return F.when(all_present(*cols), F.least(*[col(c) for c in cols]))


def positive(c):
    c = col(c)
    return F.when(c > 0, c)


def rank_correlation(a, b):
    """Pearson correlation of two rank columns as an aggregate; NULL when a side is constant.

    Ranks are multiples of one half, so these sums are exact and the result does not depend on the
    row order: a correlation of zero is zero, never a rounding error with a sign.
    """
    both = all_present(a, b)
    a, b = F.when(both, col(a)), F.when(both, col(b))
    n = F.count(a)
    top = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    left = n * F.sum(a * a) - F.sum(a) * F.sum(a)
    right = n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return ratio(top, F.sqrt(left) * F.sqrt(right))


def strict_mean(c):
    """Mean that is undefined as soon as one value is undefined."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def rounded(c, digits=6):
    return F.round(col(c).cast("double"), digits)


def count_true(test: Column):
    return F.count(F.when(test, F.lit(1)))
