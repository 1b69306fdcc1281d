"""Ordered work inside groups of any size.

Ranks, top-n cuts and exact quantiles need an order within a group (usually one date).  A
plain window sorts a group in one task, which is the cheapest plan while every group is
small.  ``measure`` finds the largest group with one pre-aggregated job over the key
columns; beyond ``row_limit`` the same results come from range slices: the rows are
range-partitioned by (group, order), every slice is numbered on its own, and the totals of
the slices before it (a table with one row per group and slice) are added.  No task then
holds more than one slice, whatever a single group weighs.
"""

import tempfile
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.guards import col

DEFAULT_ROW_LIMIT = 2_000_000
LIMIT_SETTING = "spark.crosstide.maxGroupRows"
BROADCAST_ROWS = 100_000
# Up to this many ranked columns one sort per column is cheapest; beyond it the columns are
# turned into rows and ranked with a single sort.
WIDE_RANKS = 40


def row_limit(spark):
    return int(spark.conf.get(LIMIT_SETTING, str(DEFAULT_ROW_LIMIT)))


@dataclass(frozen=True)
class GroupSizes:
    groups: int
    largest: int
    limit: int = DEFAULT_ROW_LIMIT

    @property
    def fits(self):
        return self.largest <= self.limit

    def scaled(self, factor):
        """Bound for groups that hold up to ``factor`` rows for each measured row."""
        return GroupSizes(self.groups, self.largest * factor, self.limit)


def measure(df, by):
    """Number of groups and rows in the largest one."""
    counts = df.groupBy(*by).count()
    row = counts.agg(F.count(F.lit(1)).alias("g"), F.max("count").alias("m")).first()
    return GroupSizes(row["g"], row["m"] or 0, row_limit(df.sparkSession))


def sizes_of(df, by, sizes):
    return sizes if sizes is not None else measure(df, by)


def small_side(df, sizes):
    """Broadcast a table with one row per measured group, if that row count is small."""
    return F.broadcast(df) if sizes is not None and sizes.groups <= BROADCAST_ROWS else df


def spread(df, *keys):
    """One exchange on the keys at the session's shuffle width, so that costly frames keep every
    core busy even where the bytes are few."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def checkpoint_folder(spark):
    """The cluster's checkpoint folder; only a local session may fall back to /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pinned(df):
    """Write the rows once to the reliable checkpoint folder, so that every reader (and every
    retry after a lost executor) sees the same rows in the same slices."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def with_positions(df, by, order, sizes=None, weight=None, before="_before", total="_total", placed=False):
    """Add, per group, the weight of all earlier rows and the weight of the whole group.

    ``order`` must be a total order inside the group.  The weight is 1 per row by default, so
    ``before + 1`` is the row number.  ``placed`` says that each group already lies in one partition.
    """
    by = list(by)
    amount = F.lit(1).cast("long") if weight is None else col(weight).cast("long")
    sizes = sizes_of(df, by, sizes)
    earlier = lambda w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if sizes.fits:
        df = df if placed or not by else spread(df, *by)
        group = Window.partitionBy(*by)
        ordered = group.orderBy(*order)
        number = (F.row_number().over(ordered) - 1).cast("long") if weight is None else earlier(ordered)
        return df.withColumns({before: number, total: F.sum(amount).over(group)})
    sliced = pinned(df.repartitionByRange(*[col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id()))
    slices = sliced.groupBy(*by, "_slice").agg(F.sum(amount).alias("_weight"))
    group = Window.partitionBy(*by)
    slices = slices.select(
        *by, "_slice",
        F.coalesce(F.sum("_weight").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_start"),
        F.sum("_weight").over(group).alias(total),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    return (sliced.withColumn("_inner", earlier(inside))
            .join(slices, [*by, "_slice"])
            .withColumn(before, F.col("_start") + F.col("_inner"))
            .drop("_slice", "_start", "_inner"))


def average_ranks(df, columns, by, keys, sizes=None, percent=True, placed=False):
    """Average-tie rank of each column among its non-missing values in the group.

    ``columns`` maps source to output name; ``keys`` identify a row.  Percentile ranks divide
    by the number of non-missing values.
    """
    by, sizes = list(by), sizes_of(df, by, sizes)
    if sizes.fits and len(columns) <= WIDE_RANKS:
        df = df if placed else spread(df, *by)
        group = Window.partitionBy(*by)
        ranks = {}
        for source, out in columns.items():
            x = F.col(source)
            ordered = group.orderBy(x.asc_nulls_last())
            ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
            rank = F.rank().over(ordered) + (ties - 1) / 2
            rank = rank / F.count(x).over(group) if percent else rank
            ranks[out] = F.when(x.isNotNull(), rank)
        return df.withColumns(ranks)
    cells = F.explode(F.array(*[F.struct(F.lit(out).alias("_column"), F.col(source).alias("_value"))
                                for source, out in columns.items()]))
    long = (df.select(*dict.fromkeys([*keys, *by]), cells.alias("_cell"))
            .select(*dict.fromkeys([*keys, *by]), "_cell.*").filter(F.col("_value").isNotNull()))
    if sizes.fits:
        group = Window.partitionBy(*by, "_column")
        ordered = group.orderBy("_value")
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        rank = F.rank().over(ordered) + (ties - 1) / 2
        ranked = long.withColumn("_rank", rank / F.count(F.lit(1)).over(group) if percent else rank)
        return df.join(_widened(ranked, keys, columns), list(keys), "left")
    # One row per distinct value first: a value shared by a third of all rows is one row here.
    values = long.groupBy(*by, "_column", "_value").agg(F.count(F.lit(1)).alias("_ties"))
    values = with_positions(values, [*by, "_column"], [F.col("_value").asc()], sizes, weight="_ties")
    rank = F.col("_before") + 1 + (F.col("_ties") - 1) / 2
    rank = rank / F.col("_total") if percent else rank
    values = values.select(*by, "_column", "_value", rank.alias("_rank"))
    ranked = long.join(values, [*by, "_column", "_value"])
    return df.join(_widened(ranked, keys, columns), list(keys), "left")


def _widened(ranked, keys, columns):
    return ranked.groupBy(*keys).pivot("_column", list(columns.values())).agg(F.first("_rank"))


def group_quantiles(df, by, value, probabilities, sizes=None, out="quantiles"):
    """Exact quantiles with linear interpolation, one array per group."""
    by = list(by)
    sizes = sizes_of(df, by, sizes)
    points = [float(p) for p in probabilities]
    if sizes.fits:
        return df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in points])).alias(out))
    distinct = df.filter(col(value).isNotNull()).groupBy(*by, col(value).alias("_value"))
    distinct = distinct.agg(F.count(F.lit(1)).alias("_ties"))
    placed = with_positions(distinct, by, [F.col("_value").asc()], sizes, weight="_ties")
    first, after = F.col("_before"), F.col("_before") + F.col("_ties")
    wanted = []
    for i, p in enumerate(points):
        spot = (F.col("_total") - 1) * F.lit(p)
        low, high = F.floor(spot), F.ceil(spot)
        wanted += [F.max(F.when((first <= low) & (low < after), F.col("_value"))).alias(f"_low{i}"),
                   F.max(F.when((first <= high) & (high < after), F.col("_value"))).alias(f"_high{i}"),
                   F.max(spot - low).alias(f"_part{i}")]
    edges = placed.groupBy(*by).agg(*wanted)
    parts = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}") for i in range(len(points))]
    found = edges.select(*by, F.array(*parts).alias(out))
    # A group without any value keeps its row.
    return df.select(*[col(c) for c in by]).distinct().join(found, by, "left") if by else found


def group_median(df, by, value, sizes=None, out="median"):
    found = group_quantiles(df, by, value, [0.5], sizes, "_half")
    return found.select(*by, F.col("_half")[0].alias(out))
