"""Same-date statistics: market aggregates, values relative to the median, percentile ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.functions import rank_kernel
from crosstide.functions.groups import average_ranks, group_median, measure, pinned, small_side, spread
from crosstide.functions.guards import EPS, ratio
from crosstide.operators.cross_kernel import with_date_columns, with_percent_ranks
from crosstide.schema import DATE, KEYS

AMOUNT_WINDOW = 20
# More ranked columns than this are ranked as arrays: a window sorts whole rows once for each of them.
FEW_RANKS = 2


def _market_aggregates():
    found = {
        "market_mean_ret_1": F.avg("ret_1"),
        "market_breadth_up": F.avg(F.when(F.col("ret_1").isNotNull(), (F.col("ret_1") > 0).cast("double"))),
    }
    found.update({f"market_dispersion_ret_{w}": F.stddev_pop(f"ret_{w}") for w in (1, 5)})
    found.update({f"market_limit_{s}_ratio": F.avg(f"flag_limit_{s}") for s in ("up", "down")})
    return found


def date_medians(df, columns, sizes=None):
    """One row per date with the exact median of each column."""
    sizes = sizes or measure(df, [DATE])
    if sizes.fits:
        return df.groupBy(DATE).agg(*[F.median(c).alias(f"_median_{c}") for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns]))
    long = df.select(DATE, cells.alias("_cell")).select(DATE, "_cell.*")
    found = group_median(long, [DATE, "_column"], "_value", sizes)
    return (found.withColumn("_column", F.concat(F.lit("_median_"), "_column")).groupBy(DATE)
            .pivot("_column", [f"_median_{c}" for c in columns]).agg(F.first("median")))


def amount_ratio(panel):
    """Date table: market amount over its trailing mean on the calendar (one row per date)."""
    return trailing_amount_ratio(panel.groupBy(DATE).agg(F.sum("amount").alias("_amount"))).select(DATE, "market_amount_ratio_20")


def trailing_amount_ratio(totals):
    """The ratio beside a table with one row per date and its total ``_amount``."""
    last = Window.orderBy(DATE).rowsBetween(-(AMOUNT_WINDOW - 1), 0)
    mean = F.when(F.count("_amount").over(last) == AMOUNT_WINDOW, F.avg("_amount").over(last))
    return totals.withColumn("market_amount_ratio_20", ratio("_amount", mean + EPS))


def date_statistics(df, aggregates, medians, sizes=None):
    """Add same-date aggregates and ``_median_<column>`` values to every row."""
    sizes = sizes or measure(df, [DATE])
    if sizes.fits:
        day = Window.partitionBy(DATE)
        added = {n: a.over(day) for n, a in aggregates.items()}
        added.update({f"_median_{c}": F.median(c).over(day) for c in medians})
        return spread(df, DATE).withColumns(added)
    if aggregates:
        table = df.groupBy(DATE).agg(*[a.alias(n) for n, a in aggregates.items()])
        df = df.join(small_side(table, sizes), DATE)
    return df.join(small_side(date_medians(df, medians, sizes), sizes), DATE, "left") if medians else df


def market_features(df, sizes=None):
    """C01-C05 on a table that carries the needed returns and flags."""
    windows = (1, 5, 20)
    out = date_statistics(df, _market_aggregates(), [f"ret_{w}" for w in windows], sizes)
    for w in windows:
        out = out.withColumnRenamed(f"_median_ret_{w}", f"market_median_ret_{w}")
    return out


def relative_features(df, sources, sizes=None):
    """Value minus its same-date median; ``sources`` maps output to source."""
    out = date_statistics(df, {}, list(dict.fromkeys(sources.values())), sizes)
    out = out.withColumns({n: F.col(s) - F.col(f"_median_{s}") for n, s in sources.items()})
    return out.drop(*[f"_median_{s}" for s in sources.values()])


def percent_ranks(df, columns, sizes=None, by=(), keys=KEYS):
    """Average-tie percentile rank of each column within its date (and run)."""
    if len(columns) > FEW_RANKS and not by:
        sizes = sizes or measure(df, [DATE])
        if sizes.fits and rank_kernel.fits(sizes, len(df.columns) + len(columns)):
            return with_percent_ranks(df, columns)
    return average_ranks(df, columns, [*by, DATE], [*by, *keys], sizes)


def cross_features(df, panel, sizes=None, arrays=None):
    """The 34 same-date columns, added to per-entity features.

    Dates whose cells fit a task are computed as arrays (``arrays`` forces either way)."""
    sizes = sizes or measure(panel, [DATE])
    if rank_kernel.fits(sizes, len(df.columns)) if arrays is None else arrays:
        return with_date_columns(df).join(small_side(amount_ratio(panel), sizes), DATE)
    df = df if sizes.fits else pinned(df)
    return date_columns(df, sizes).join(small_side(amount_ratio(panel), sizes), DATE)


def date_columns(df, sizes):
    """The same-date columns but for the amount ratio, by windows or, for large dates, by slices."""
    medians = dict.fromkeys([f"ret_{w}" for w in (1, 5, 20)] + list(catalog.RELATIVE_SOURCES.values()))
    out = date_statistics(df, _market_aggregates(), list(medians), sizes)
    out = out.withColumns({
        **{f"market_median_ret_{w}": F.col(f"_median_ret_{w}") for w in (1, 5, 20)},
        **{n: F.col(s) - F.col(f"_median_{s}") for n, s in catalog.RELATIVE_SOURCES.items()},
    }).drop(*[f"_median_{s}" for s in medians])
    return percent_ranks(out, {s: f"csr_{s}" for s in catalog.RANK_SOURCES}, sizes)
