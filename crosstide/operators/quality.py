"""Audit of a raw panel: profiles, domain checks, duplicates, calendar gaps, label recomputation."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.blocks import mapped
from crosstide.functions.guards import all_present, count_true, finite, max_of, min_of, ratio
from crosstide.functions.quantiles import exact_quantiles
from crosstide.operators.prepare import groups_present
from crosstide.operators.view_rows import ViewRows
from crosstide.schema import DATE, ENTITY, KEYS, LABEL, PRICES

LABEL_ATOL, LABEL_RTOL = 1e-10, 1e-8


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def price_all_missing():
    return ~_any([F.col(p).isNotNull() for p in PRICES])


def price_any_missing():
    return _any([F.col(p).isNull() for p in PRICES])


def with_price_flags(df):
    return df.withColumns({"price_all_nan": price_all_missing(), "price_any_nan": price_any_missing()})


def valid_code():
    return F.col(ENTITY).rlike(r"^\d{6}\.[A-Z]+$")


def valid_date(c=DATE):
    return F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyyMMdd")).isNotNull()


def column_profile(df, columns):
    """Counts of missing, infinite, negative and zero values, and finite bounds, one row per column."""
    parts = []
    for c in columns:
        x, f = F.col(c).cast("double"), finite(F.col(c).cast("double"))
        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"),
            count_true(x.isNull() | F.isnan(x)).alias("missing"),
            count_true(F.abs(x) == float("inf")).alias("infinite"),
            count_true(f < 0).alias("negative"), count_true(f == 0).alias("zero"),
            F.min(f).alias("finite_min"), F.max(f).alias("finite_max")))
    rows = df.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")
    return rows.withColumns({"missing_ratio": ratio("missing", "rows"), "infinite_ratio": ratio("infinite", "rows")})


def price_order_checks(df):
    """Eligible and violating rows of the three price-order rules."""
    o, h, l, c = (F.col(p) for p in PRICES)
    rules = {"high_below_open_or_close": (all_present("high", "open", "close"), h < max_of("open", "close")),
             "low_above_open_or_close": (all_present("low", "open", "close"), l > min_of("open", "close")),
             "high_below_low": (all_present("high", "low"), h < l)}
    parts = [F.struct(F.lit(n).alias("rule"), count_true(ok).alias("eligible"), count_true(ok & bad).alias("violations"))
             for n, (ok, bad) in rules.items()]
    return df.agg(F.array(*parts).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def flag_counts(df, flags):
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("value")) for f in flags]))
    counts = df.select(cells.alias("_c")).groupBy("_c.flag", "_c.value").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("in_domain", F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(False)))


def observation_patterns(df):
    gone, whole = price_all_missing(), ~price_any_missing()
    v, a = F.col("vol"), F.col("amount")
    tests = {"all_ohlc_nan_with_finite_vol": gone & v.isNotNull(),
             "all_ohlc_nan_with_finite_amount": gone & a.isNotNull(),
             "finite_ohlc_with_zero_vol_and_amount": whole & (v == 0) & (a == 0),
             "finite_ohlc_with_missing_vol_or_amount": whole & (v.isNull() | a.isNull())}
    return df.agg(*[count_true(t).alias(n) for n, t in tests.items()])


def label_patterns(df):
    missing = F.col(LABEL).isNull()
    return df.agg(count_true(missing & price_all_missing()).alias("label_nan_and_all_ohlc_nan"),
                  count_true(missing & ~price_any_missing()).alias("label_nan_and_all_ohlc_present"),
                  count_true(~missing & price_any_missing()).alias("label_present_and_any_ohlc_nan"))


def first_examples(df, condition, order, limit):
    """The first rows of each condition value; partial top-k before any shuffle of whole groups."""
    top = F.row_number().over(Window.partitionBy(condition).orderBy(*order))
    return df.withColumn("example", top).filter(F.col("example") <= limit)


def panel_size(df):
    """Rows, entities, dates and bounds from two pre-aggregated key counts."""
    entities = df.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n"),
                                      count_true(F.col(ENTITY).isNull() | F.col(DATE).isNull()).alias("bad"))
    dates = df.groupBy(DATE).agg(F.count(F.lit(1)).alias("n"))
    left = entities.agg(F.sum("n").alias("rows"), F.count(ENTITY).alias("entities"), F.sum("bad").alias("missing_key_rows"))
    right = dates.agg(F.count(DATE).alias("dates"), F.min(DATE).alias("date_min"), F.max(DATE).alias("date_max"))
    return left.crossJoin(F.broadcast(right))


def duplicates(df, keys):
    counts = df.groupBy(*keys).count().filter(F.col("count") > 1)
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return counts.agg(zero(F.sum(F.col("count") - 1), "extra_rows"), F.count(F.lit(1)).alias("key_groups"),
                      zero(F.sum("count"), "participating_rows"))


def require_unique(df, keys=KEYS):
    """The frame itself, after checking that its keys are unique and present."""
    bad = df.groupBy(*keys).count().filter((F.col("count") > 1) | _any([F.col(k).isNull() for k in keys]))
    if bad.take(1):
        raise ValueError(f"missing or duplicate keys {list(keys)}")
    return df


def observations_per_entity(df):
    return df.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("observations"))


def market_calendar(df):
    """Observed dates with index and neighbours: one row per date."""
    order = Window.orderBy(DATE)
    return df.select(DATE).distinct().withColumns({
        "day": F.row_number().over(order) - 1, "next_date": F.lead(DATE).over(order)})


def calendar_gaps(df):
    """Rows that follow absent market dates of their entity, with the number of dates skipped."""
    days = market_calendar(df).select(DATE, "day")
    order = Window.partitionBy(ENTITY).orderBy(DATE)
    placed = df.select(*KEYS).join(days, DATE)
    gaps = placed.withColumn("missing_days", F.col("day") - F.lag("day").over(order) - 1)
    return gaps.filter(F.col("missing_days") > 0)


def gap_summary(gaps):
    by = gaps.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n"), F.sum("missing_days").alias("s"), F.max("missing_days").alias("m"))
    return by.agg(F.sum("n").alias("gap_intervals"), F.sum("s").alias("missing_days"), F.count(F.lit(1)).alias("entities_with_gaps"),
                  F.max("m").cast("long").alias("longest_gap"))


def grid_absence(df):
    """Absent (entity, date) cells in total, before an entity's first and after its last row."""
    days = market_calendar(df).select(DATE, "day")
    spans = df.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n"), F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    total = days.agg(F.count(F.lit(1)).alias("n_dates"))
    first = days.select(F.col(DATE).alias("first"), F.col("day").alias("first_day"))
    last = days.select(F.col(DATE).alias("last"), F.col("day").alias("last_day"))
    spans = spans.join(first, "first").join(last, "last").crossJoin(F.broadcast(total))
    return spans.agg(F.sum(F.col("n_dates") - F.col("n")).alias("absent_cells"),
                     F.sum("first_day").cast("long").alias("leading_days"),
                     F.sum(F.col("n_dates") - 1 - F.col("last_day")).alias("trailing_days"))


def with_price_span(df):
    """First and last date with a price, added to every row of the entity."""
    entity = Window.partitionBy(ENTITY)
    dated = F.when(F.col("close").isNotNull(), F.col(DATE))
    return df.withColumns({"first_priced": F.min(dated).over(entity), "last_priced": F.max(dated).over(entity)})


def price_spans(df):
    dated = F.when(F.col("close").isNotNull(), F.col(DATE))
    return df.groupBy(ENTITY).agg(F.min(dated).alias("first_priced"), F.max(dated).alias("last_priced"))


def price_context():
    """Where a row stands relative to its entity's priced span."""
    date, first, last = F.col(DATE), F.col("first_priced"), F.col("last_priced")
    return (F.when(F.col("close").isNotNull(), "current_close_present").when(first.isNull(), "no_finite_close")
            .when(date < first, "before_first_finite_close").when(date > last, "after_last_finite_close")
            .otherwise("internal_missing_close"))


def missing_price_life_cycle(df):
    gone, date = price_all_missing(), F.col(DATE)
    first, last = F.col("first_priced"), F.col("last_priced")
    rows = with_price_span(df)
    return rows.agg(count_true(gone).alias("rows_all_missing"), count_true(price_any_missing()).alias("rows_any_missing"),
                    count_true(gone & (date < first)).alias("before_first"),
                    count_true(gone & (date > first) & (date < last)).alias("between"),
                    count_true(gone & (date > last)).alias("after_last"),
                    count_true(gone & first.isNull()).alias("never_priced"))


QUANTILE_POINTS = (0, .01, .25, .5, .75, .99, 1)
QUANTILE_NAMES = ("min", "p01", "p25", "p50", "p75", "p99", "max")


def column_quantiles(df, columns, by=()):
    """Exact quantiles of each column, one row per column (and group). The rows are read twice."""
    by = list(by)
    found = exact_quantiles(df, columns, QUANTILE_POINTS, by)
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    groups = groups_present(df, by).select(*by, names) if by else df.sparkSession.range(1).select(names)
    found = groups.join(found, [*by, "column_name"], "left")  # a column without any value keeps its row
    return found.select(*by, "column_name", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)])


def extremes(df, columns):
    """Row keys of each column's smallest and largest value; the smaller key wins a tie."""
    if isinstance(df, ViewRows):
        return _view_extremes(df, list(columns))
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        low = F.min(F.when(x.isNotNull(), F.struct(x.alias("v"), *KEYS)))
        high = F.min(F.when(x.isNotNull(), F.struct((-x).alias("v"), *KEYS)))
        for kind, found, sign in (("min", low, 1.0), ("max", high, -1.0)):
            parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"),
                                  *[found[k].alias(k) for k in KEYS], (found["v"] * sign).alias("value")))
    return df.agg(F.array(*parts).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


def _first_extreme(values, keys):
    """(value, key) of the smallest value, for the smallest key that has it."""
    low = np.nanmin(values)
    return float(low), min(keys(np.flatnonzero(values == low)))


def _view_extremes(view, columns):
    """The same from arrays: a task sends its own extremes of each column, and the best of them remain."""
    def run(parts):
        best = {}
        for batch, cells in parts:
            codes, dates = batch.column(ENTITY), batch.column(DATE).to_numpy(zero_copy_only=False)
            keys = lambda rows: zip(codes.take(pa.array(rows)).to_pylist(), dates[rows].tolist(), strict=True)
            for c in np.flatnonzero(~np.isnan(cells).all(axis=0)).tolist():
                for sign in (1.0, -1.0):
                    x = cells[:, c] * sign
                    if (c, sign) not in best or np.nanmin(x) <= best[c, sign][0]:
                        found = _first_extreme(x, keys)
                        best[c, sign] = min(best.get((c, sign), found), found)
        if best:
            yield pa.RecordBatch.from_pydict({"_column": pa.array([c for c, _ in best], pa.int32()), "_sign": pa.array([s for _, s in best]), "v": pa.array([v for v, _ in best.values()]),
                                              ENTITY: pa.array([k[0] for _, k in best.values()], pa.string()), DATE: pa.array([k[1] for _, k in best.values()], pa.int32())})

    found = mapped(view, columns, KEYS, run, f"_column int, _sign double, v double, {ENTITY} string, {DATE} int")
    found = found.groupBy("_column", "_sign").agg(F.min(F.struct("v", *KEYS)).alias("_e"))
    wanted = view.sparkSession.createDataFrame([(c, n, k, s) for c, n in enumerate(columns) for k, s in (("min", 1.0), ("max", -1.0))], "_column int, column_name string, kind string, _sign double")
    found = F.broadcast(wanted).join(found, ["_column", "_sign"], "left")  # a column without any value keeps its rows
    return found.select("column_name", "kind", *[F.col(f"_e.{k}").alias(k) for k in KEYS], (F.col("_e.v") * F.col("_sign")).alias("value"))


def present_count(columns):
    """Number of present values in a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def label_check(df):
    """Compare labels with the return to the next observed close."""
    order = Window.partitionBy(ENTITY).orderBy(DATE)
    days = market_calendar(df).select(DATE, "next_date")
    rows = df.select(*KEYS, "close", LABEL).withColumns({
        "next_close": F.lead("close").over(order), "next_row_date": F.lead(DATE).over(order)})
    rows = rows.join(days, DATE)
    y, known = F.col(LABEL), F.col("close").isNotNull() & (F.col("close") != 0) & F.col("next_close").isNotNull()
    calculated = ratio("next_close", "close") - 1
    rows = rows.withColumns({
        "calculated": calculated, "error": F.abs(y - calculated), "comparable": y.isNotNull() & known,
        "adjacent": F.coalesce(F.col("next_row_date") == F.col("next_date"), F.lit(False)), "known": known})
    return rows.withColumn("mismatch", F.col("comparable") & (
        F.col("error") > LABEL_ATOL + F.abs(F.col("calculated")) * LABEL_RTOL))


def label_check_summary(checked):
    y, ok, bad = F.col(LABEL), F.col("comparable"), F.col("mismatch")
    return checked.agg(
        count_true(y.isNotNull()).alias("labels"), count_true(ok).alias("comparable"),
        count_true(ok & ~bad).alias("matching"), count_true(bad).alias("mismatching"),
        F.max(F.when(ok, F.col("error"))).alias("max_error"),
        count_true(y.isNotNull() & ~F.coalesce(ok, F.lit(False))).alias("not_comparable"),
        count_true(ok & F.col("adjacent")).alias("next_market_day"),
        count_true(ok & ~F.col("adjacent")).alias("crossing_gap"),
        count_true(ok & ~F.col("adjacent") & ~bad).alias("matching_crossing_gap"),
        count_true(y.isNull() & F.coalesce(F.col("known"), F.lit(False))).alias("missing_despite_prices"))


BLOCK_ROWS = 1 << 20


def key_order_breaks(df, keys, file="_file", position="_position"):
    """Rows whose key is not above the key of the row before it in the file.

    Blocks of rows are compared inside; a table with one row per block compares their edges.
    """
    key = F.struct(*keys)
    blocked = df.select(file, position, key.alias("_key")).withColumn("_block", F.floor(F.col(position) / BLOCK_ROWS))
    inside = F.lag("_key").over(Window.partitionBy(file, "_block").orderBy(position))
    within = blocked.withColumn("_before", inside).agg(
        F.count(F.lit(1)).alias("rows"), count_true(F.col("_before") >= F.col("_key")).alias("inner_breaks"))
    edges = blocked.groupBy(file, "_block").agg(F.min_by("_key", position).alias("_first"), F.max_by("_key", position).alias("_last"))
    edge = F.lag("_last").over(Window.partitionBy(file).orderBy("_block"))
    between = edges.withColumn("_before", edge).agg(count_true(F.col("_before") >= F.col("_first")).alias("edge_breaks"))
    return within.crossJoin(F.broadcast(between)).select(
        "rows", (F.col("inner_breaks") + F.col("edge_breaks")).alias("breaks"))
