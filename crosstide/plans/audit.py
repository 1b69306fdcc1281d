"""Audit, profile and row-predicate queries."""

from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.functions.guards import count_true, finite
from crosstide.operators import quality as Q
from crosstide.operators.evaluate import tradable
from crosstide.operators.features import basic_view, view_rows
from crosstide.operators.folds import Fold
from crosstide.operators.history import history_features
from crosstide.operators.targets import residual_rank
from crosstide.plans import sqltext as S
from crosstide.plans.date_features import full_ctes
from crosstide.plans.labels import FOLDS, labelled
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.plans.runs import PREDS, predictions
from crosstide.schema import DATE, ENTITY, FLAGS, KEYS, LABEL, PRICES, SOURCES
from crosstide.sources.panel import bars, read_table

ROWS = "ts_code, trade_date"
PANEL = S.panel()
ALL_GONE = "(open IS NULL AND high IS NULL AND low IS NULL AND close IS NULL)"
ANY_GONE = "(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL)"
NUMERIC = [*SOURCES, LABEL]


@query("a01_column_profile", PANEL + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL OR isnan({c})) AS missing,
    count(*) FILTER (isinf({c})) AS infinite, count(*) FILTER (isfinite({c}) AND {c} < 0) AS negative,
    count(*) FILTER (isfinite({c}) AND {c} = 0) AS zero, min({c}) AS finite_min, max({c}) AS finite_max,
    round(count(*) FILTER ({c} IS NULL OR isnan({c})) / count(*)::DOUBLE, 6) + 0.0 AS missing_ratio,
    round(count(*) FILTER (isinf({c})) / count(*)::DOUBLE, 6) + 0.0 AS infinite_ratio FROM bars""" for c in SOURCES))
def a01(spark, d):
    p = Q.column_profile(bars(spark, d), SOURCES)
    return p.withColumns({c: F.round(c, 6) for c in ("missing_ratio", "infinite_ratio")})


@query("a02_price_order", S.panel("month") + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER ({ok}) AS eligible, count(*) FILTER ({ok} AND {bad}) AS violations FROM skewed"
    for n, ok, bad in [
        ("high_below_open_or_close", "high IS NOT NULL AND open IS NOT NULL AND close IS NOT NULL", "high < greatest(open, close)"),
        ("low_above_open_or_close", "low IS NOT NULL AND open IS NOT NULL AND close IS NOT NULL", "low > least(open, close)"),
        ("high_below_low", "high IS NOT NULL AND low IS NOT NULL", "high < low")]).replace(
    "SELECT 'high_below_open_or_close'", """, skewed AS (SELECT * REPLACE (CASE WHEN flag_limit_up = 1 THEN low ELSE high END AS high,
    CASE WHEN flag_limit_down = 1 THEN close ELSE low END AS low) FROM bars) SELECT 'high_below_open_or_close'""", 1).replace(") ,", "),"))
def a02(spark, d):
    p = bars(spark, d, "month")
    skewed = p.withColumns({"high": F.when(F.col("flag_limit_up") == 1, F.col("low")).otherwise(F.col("high")),
                            "low": F.when(F.col("flag_limit_down") == 1, F.col("close")).otherwise(F.col("low"))})
    return Q.price_order_checks(skewed)


@query("a03_flag_counts", PANEL + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, {f} AS value, count(*) AS rows, {f} IN (0, 1) AS in_domain FROM bars GROUP BY {f}" for f in FLAGS))
def a03(spark, d):
    return Q.flag_counts(bars(spark, d), FLAGS)


@query("a04_both_flags", PANEL + f""", both_set AS (SELECT {ROWS} FROM bars WHERE flag_limit_up = 1 AND flag_limit_down = 1),
  numbered AS (SELECT *, row_number() OVER (ORDER BY ts_code, trade_date) AS example, count(*) OVER () AS total FROM both_set)
  SELECT {ROWS}, example, total FROM numbered WHERE example <= 10""")
def a04(spark, d):
    both = bars(spark, d).filter((F.col("flag_limit_up") == 1) & (F.col("flag_limit_down") == 1)).select(*KEYS)
    # A global top-k keeps k rows per task; the count is its own one-row aggregate.
    from pyspark.sql import Window
    first = both.orderBy(*KEYS).limit(10).withColumn("example", F.row_number().over(Window.orderBy(*KEYS)))
    return first.crossJoin(F.broadcast(both.agg(F.count(F.lit(1)).alias("total"))))


@query("a05_observation_patterns", PANEL + f""" SELECT count(*) FILTER ({ALL_GONE} AND vol IS NOT NULL) AS all_ohlc_nan_with_finite_vol,
  count(*) FILTER ({ALL_GONE} AND amount IS NOT NULL) AS all_ohlc_nan_with_finite_amount,
  count(*) FILTER (NOT {ANY_GONE} AND vol = 0 AND amount = 0) AS finite_ohlc_with_zero_vol_and_amount,
  count(*) FILTER (NOT {ANY_GONE} AND (vol IS NULL OR amount IS NULL)) AS finite_ohlc_with_missing_vol_or_amount FROM bars""")
def a05(spark, d):
    return Q.observation_patterns(bars(spark, d))


@query("a06_panel_size", PANEL + """ SELECT count(*) AS rows, count(DISTINCT ts_code) AS entities, count(DISTINCT trade_date) AS dates,
  min(trade_date) AS date_min, max(trade_date) AS date_max, count(*) FILTER (ts_code IS NULL OR trade_date IS NULL) AS missing_key_rows FROM bars""")
def a06(spark, d):
    return Q.panel_size(bars(spark, d))


@query("a07_duplicates", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, count(*) AS key_groups,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS participating_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1""")
def a07(spark, d):
    return Q.duplicates(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a08_entity_observations", PANEL + """, counts AS (SELECT ts_code, count(*) AS n FROM bars GROUP BY ts_code)
  SELECT 'histogram' AS part, CAST(n AS DOUBLE) AS observations, CAST(count(*) AS DOUBLE) AS value FROM counts GROUP BY n UNION ALL
  SELECT 'quantile', q, quantile_cont(n, q) FROM counts, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) t(q) GROUP BY q"""
       .replace("quantile_cont(n, q) FROM counts, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) t(q) GROUP BY q",
                "v FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS q, unnest(quantile_cont(n, [0.0, 0.25, 0.5, 0.75, 1.0]))::DOUBLE AS v FROM counts)"))
def a08(spark, d):
    counts = Q.observations_per_entity(bars(spark, d))
    histogram = counts.groupBy("observations").count().select(
        F.lit("histogram").alias("part"), F.col("observations").cast("double"), F.col("count").cast("double").alias("value"))
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    from crosstide.functions.groups import group_quantiles
    quantiles = group_quantiles(counts, [], "observations", points).select(
        F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("q"), F.col("quantiles").alias("v"))).alias("z"))
    quantiles = quantiles.select(F.lit("quantile").alias("part"), F.col("z.q").alias("observations"), F.col("z.v").alias("value"))
    return histogram.unionByName(quantiles)


@query("a09_grid_absence", PANEL + """, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS day, count(*) OVER () AS nd
    FROM (SELECT DISTINCT trade_date FROM bars)),
  spans AS (SELECT ts_code, count(*) AS n, min(day) AS f, max(day) AS l, max(nd) AS nd FROM bars JOIN cal USING (trade_date) GROUP BY ts_code)
  SELECT CAST(sum(nd - n) AS BIGINT) AS absent_cells, CAST(sum(f) AS BIGINT) AS leading_days, CAST(sum(nd - 1 - l) AS BIGINT) AS trailing_days FROM spans""")
def a09(spark, d):
    return Q.grid_absence(bars(spark, d))


SPANNED = PANEL + """, spanned AS (SELECT *, min(CASE WHEN close IS NOT NULL THEN trade_date END) OVER (PARTITION BY ts_code) AS first_priced,
  max(CASE WHEN close IS NOT NULL THEN trade_date END) OVER (PARTITION BY ts_code) AS last_priced FROM bars)"""


@query("a10_price_life_cycle", SPANNED + f""" SELECT count(*) FILTER ({ALL_GONE}) AS rows_all_missing, count(*) FILTER ({ANY_GONE}) AS rows_any_missing,
  count(*) FILTER ({ALL_GONE} AND trade_date < first_priced) AS before_first,
  count(*) FILTER ({ALL_GONE} AND trade_date > first_priced AND trade_date < last_priced) AS between,
  count(*) FILTER ({ALL_GONE} AND trade_date > last_priced) AS after_last,
  count(*) FILTER ({ALL_GONE} AND first_priced IS NULL) AS never_priced FROM spanned""".replace("AS between,", 'AS "between",'))
def a10(spark, d):
    return Q.missing_price_life_cycle(bars(spark, d))


CONTEXT_SQL = """CASE WHEN close IS NOT NULL THEN 'current_close_present' WHEN first_priced IS NULL THEN 'no_finite_close'
  WHEN trade_date < first_priced THEN 'before_first_finite_close' WHEN trade_date > last_priced THEN 'after_last_finite_close'
  ELSE 'internal_missing_close' END"""


@query("p07_price_context", SPANNED + f" SELECT {ROWS}, {CONTEXT_SQL} AS price_context FROM spanned")
def p07(spark, d):
    return Q.with_price_span(bars(spark, d)).select(*KEYS, Q.price_context().alias("price_context"))


@query("j06_span_lookup", SPANNED + f" SELECT {ROWS}, first_priced, last_priced FROM spanned WHERE close IS NULL")
def j06(spark, d):
    panel = bars(spark, d)
    return panel.filter(F.col("close").isNull()).select(*KEYS).join(Q.price_spans(panel), ENTITY, "left")


@query("a11_label_patterns", PANEL + f""" SELECT count(*) FILTER (y_ret_1d IS NULL AND {ALL_GONE}) AS label_nan_and_all_ohlc_nan,
  count(*) FILTER (y_ret_1d IS NULL AND NOT {ANY_GONE}) AS label_nan_and_all_ohlc_present,
  count(*) FILTER (y_ret_1d IS NOT NULL AND {ANY_GONE}) AS label_present_and_any_ohlc_nan FROM bars""")
def a11(spark, d):
    return Q.label_patterns(labelled(spark, d))


_PROFILED = list(catalog.FULL)


@query("a12_exact_quantiles", full_ctes().replace("full_rows AS (", "full_rows AS MATERIALIZED (") + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) + 0.0 AS {n}" for p, n in
                                                  zip(Q.QUANTILE_POINTS, Q.QUANTILE_NAMES)) + " FROM full_rows" for c in _PROFILED))
def a12(spark, d):
    return shown(Q.column_quantiles(view_rows(bars(spark, d), date_sizes(spark, d)), _PROFILED))


@query("a13_extremes", full_ctes().replace("full_rows AS (", "full_rows AS MATERIALIZED (") + " " + " UNION ALL ".join(
    f"(SELECT '{c}' AS column_name, '{k}' AS kind, {ROWS}, round({c}, 6) + 0.0 AS value FROM full_rows WHERE {c} IS NOT NULL "
    f"ORDER BY {c} {o}, ts_code, trade_date LIMIT 1)" for c in _PROFILED for k, o in (("min", "ASC"), ("max", "DESC"))))
def a13(spark, d):
    return shown(Q.extremes(view_rows(bars(spark, d), date_sizes(spark, d)), _PROFILED))


PRESENT = " + ".join(f"CAST({n} IS NOT NULL AS INTEGER)" for n in catalog.BASIC)


@query("a14_value_histogram", S.history(catalog.BASIC) + f" SELECT CAST({PRESENT} AS INTEGER) AS present, count(*) AS rows FROM features GROUP BY 1")
def a14(spark, d):
    return basic_view(bars(spark, d)).groupBy(Q.present_count(catalog.BASIC).alias("present")).agg(F.count(F.lit(1)).alias("rows"))


@query("a15_population_profile", S.history(catalog.BASIC, keep=("ts_code", "trade_date", "y_ret_1d", "open", "high", "low", "close"))
       .replace("flag_limit_up, flag_limit_down FROM stage", "flag_limit_up, flag_limit_down FROM stage") + f""",
  tagged AS (SELECT *, {PRESENT} AS present, CASE WHEN y_ret_1d IS NULL THEN 'missing_y' ELSE 'labelled' END || CASE WHEN flag_limit_up = 0
    THEN '_eligible' ELSE '_limit' END AS population FROM features)
  SELECT population, count(*) AS rows, count(*) FILTER ({ALL_GONE}) AS ohlc_all_missing,
  count(*) FILTER ({ANY_GONE} AND NOT {ALL_GONE}) AS ohlc_partial_missing, count(*) FILTER (NOT {ANY_GONE}) AS ohlc_all_present,
  CAST(min(present) AS INTEGER) AS present_min, round(avg(present), 6) + 0.0 AS present_mean, CAST(max(present) AS INTEGER) AS present_max
  FROM tagged GROUP BY population""")
def a15(spark, d):
    df = history_features(labelled(spark, d), catalog.BASIC, keep=[*KEYS, LABEL, *PRICES])
    tag = F.concat(F.when(F.col(LABEL).isNull(), "missing_y").otherwise("labelled"),
                   F.when(F.col("flag_limit_up") == 0, "_eligible").otherwise("_limit"))
    df = df.withColumns({"population": tag, "present": Q.present_count(catalog.BASIC)})
    return shown(df.groupBy("population").agg(
        F.count(F.lit(1)).alias("rows"), count_true(Q.price_all_missing()).alias("ohlc_all_missing"),
        count_true(Q.price_any_missing() & ~Q.price_all_missing()).alias("ohlc_partial_missing"),
        count_true(~Q.price_any_missing()).alias("ohlc_all_present"), F.min("present").alias("present_min"),
        F.avg("present").alias("present_mean"), F.max("present").alias("present_max")))


@query("a16_present_features", S.history(catalog.BASIC) + f" SELECT {ROWS}, CAST({PRESENT} AS INTEGER) AS present FROM features")
def a16(spark, d):
    return basic_view(bars(spark, d)).select(*KEYS, Q.present_count(catalog.BASIC).alias("present"))


# Labels with a planted defect: on limit-up rows the label is off by 1 %.
CHECKED_SQL = PANEL + f""", planted AS (SELECT * REPLACE (CASE WHEN flag_limit_up = 1 THEN y_ret_1d + 0.01 ELSE y_ret_1d END AS y_ret_1d) FROM bars),
  cal AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT DISTINCT trade_date FROM bars)),
  nexts AS (SELECT p.*, lead(close) OVER e AS next_close, lead(trade_date) OVER e AS next_row_date FROM planted p
    WINDOW e AS (PARTITION BY ts_code ORDER BY trade_date)),
  checked AS (SELECT n.*, next_date, close IS NOT NULL AND close <> 0 AND next_close IS NOT NULL AS known,
    next_close / nullif(close, 0) - 1 AS calculated, abs(y_ret_1d - (next_close / nullif(close, 0) - 1)) AS error,
    coalesce(next_row_date = next_date, false) AS adjacent FROM nexts n JOIN cal USING (trade_date)),
  judged AS (SELECT *, y_ret_1d IS NOT NULL AND known AS comparable,
    y_ret_1d IS NOT NULL AND known AND error > 1e-10 + 1e-8 * abs(calculated) AS mismatch FROM checked)"""


def _planted(spark, d):
    df = labelled(spark, d)
    return df.withColumn(LABEL, F.when(F.col("flag_limit_up") == 1, F.col(LABEL) + 0.01).otherwise(F.col(LABEL)))


@query("a18_label_check", CHECKED_SQL + """ SELECT count(y_ret_1d) AS labels, count(*) FILTER (comparable) AS comparable,
  count(*) FILTER (comparable AND NOT mismatch) AS matching, count(*) FILTER (mismatch) AS mismatching,
  round(max(error) FILTER (comparable), 6) + 0.0 AS max_error, count(*) FILTER (y_ret_1d IS NOT NULL AND NOT comparable) AS not_comparable,
  count(*) FILTER (comparable AND adjacent) AS next_market_day, count(*) FILTER (comparable AND NOT adjacent) AS crossing_gap,
  count(*) FILTER (comparable AND NOT adjacent AND NOT mismatch) AS matching_crossing_gap,
  count(*) FILTER (y_ret_1d IS NULL AND known) AS missing_despite_prices FROM judged""")
def a18(spark, d):
    return shown(Q.label_check_summary(Q.label_check(_planted(spark, d))))


@query("a18_label_mismatches", CHECKED_SQL + f""", shown_rows AS (SELECT *, row_number() OVER (PARTITION BY mismatch ORDER BY ts_code, trade_date) AS example
  FROM judged WHERE mismatch) SELECT {ROWS}, next_row_date, {S.rounded('y_ret_1d', 'calculated', 'error')} FROM shown_rows WHERE example <= 5""")
def a18_rows(spark, d):
    bad = Q.label_check(_planted(spark, d)).filter("mismatch").orderBy(*KEYS).limit(5)
    return shown(bad, *KEYS, "next_row_date", LABEL, "calculated", "error")


@query("j08_calendar_adjacency", CHECKED_SQL + f" SELECT {ROWS}, next_row_date, next_date, adjacent FROM judged")
def j08(spark, d):
    days = Q.market_calendar(bars(spark, d)).select(DATE, "next_date")
    checked = Q.label_check(labelled(spark, d))
    return checked.select(*KEYS, "next_row_date", "adjacent").join(days, DATE).select(*KEYS, "next_row_date", "next_date", "adjacent")


@query("a26_distinct_in_group", PREDS + """ SELECT trade_date, count(DISTINCT pred_a) AS distinct_preds, count(DISTINCT y_ret_1d) AS distinct_labels
  FROM preds GROUP BY trade_date""")
def a26(spark, d):
    df = predictions(spark, d)
    count = lambda c, name: df.groupBy(DATE, c).count().groupBy(DATE).agg(F.count(c).alias(name))
    return count("pred_a", "distinct_preds").join(count(LABEL, "distinct_labels"), DATE)


@query("a27_key_order", """WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS i FROM lineitem),
  k AS (SELECT row(l_orderkey, l_linenumber) AS key, lag(row(l_orderkey, l_linenumber)) OVER (ORDER BY i) AS prev FROM s)
  SELECT count(*) AS rows, count(*) FILTER (prev >= key) AS breaks FROM k""")
def a27(spark, d):
    lines = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_position"))
    return Q.key_order_breaks(lines, ["l_orderkey", "l_linenumber"])


GAPS_SQL = PANEL + """, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day FROM (SELECT DISTINCT trade_date FROM bars)),
  gaps AS (SELECT ts_code, trade_date, day - lag(day) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS missing_days FROM bars JOIN cal USING (trade_date))"""


@query("w27_calendar_gaps", GAPS_SQL + f" SELECT {ROWS}, CAST(missing_days AS BIGINT) AS missing_days FROM gaps WHERE missing_days > 0")
def w27(spark, d):
    return Q.calendar_gaps(bars(spark, d)).select(*KEYS, F.col("missing_days").cast("long"))


@query("w27_gap_summary", GAPS_SQL + """ SELECT count(*) AS gap_intervals, CAST(sum(missing_days) AS BIGINT) AS missing_days,
  count(DISTINCT ts_code) AS entities_with_gaps, CAST(max(missing_days) AS BIGINT) AS longest_gap FROM gaps WHERE missing_days > 0""")
def w27_summary(spark, d):
    return Q.gap_summary(Q.calendar_gaps(bars(spark, d)))


# Row predicates.
@query("p01_finite", PANEL + f""", raw_values AS (SELECT {ROWS}, CASE WHEN flag_limit_up = 1 THEN 'Infinity'::DOUBLE WHEN flag_limit_down = 1 THEN 'NaN'::DOUBLE
  ELSE y_ret_1d END AS x FROM bars) SELECT {ROWS}, round(CASE WHEN isfinite(x) THEN x END, 6) + 0.0 AS x FROM raw_values""")
def p01(spark, d):
    raw = (F.when(F.col("flag_limit_up") == 1, float("inf")).when(F.col("flag_limit_down") == 1, float("nan"))
           .otherwise(F.col(LABEL)))
    return shown(labelled(spark, d).withColumn("x", finite(raw)), *KEYS, "x")


@query("p02_supervised_rows", PANEL + f" SELECT {ROWS}, {S.rounded('y_ret_1d')} FROM bars WHERE y_ret_1d IS NOT NULL")
def p02(spark, d):
    return shown(labelled(spark, d).filter(F.col(LABEL).isNotNull()), *KEYS, LABEL)


@query("p03_date_range", PANEL + f" SELECT {ROWS}, vol FROM bars WHERE trade_date BETWEEN 19990101 AND 19991231")
def p03(spark, d):
    return bars(spark, d).filter(F.col(DATE).between(FOLDS[0].valid_start, FOLDS[0].valid_end)).select(*KEYS, "vol")


@query("p04_eligible_pool", PANEL + f""", pool AS (SELECT {ROWS}, count(*) OVER (PARTITION BY trade_date) AS pool FROM bars
  WHERE flag_limit_up = 0 AND y_ret_1d IS NOT NULL) SELECT * FROM pool WHERE pool >= 10""")
def p04(spark, d):
    pool = labelled(spark, d).filter(tradable() & F.col(LABEL).isNotNull()).select(*KEYS)
    sizes = pool.groupBy(DATE).agg(F.count(F.lit(1)).alias("pool")).filter(F.col("pool") >= 10)
    from crosstide.functions.groups import small_side
    return pool.join(small_side(sizes, date_sizes(spark, d)), DATE).select(*KEYS, "pool")


@query("p05_excluded_date", PANEL + f" SELECT {ROWS} FROM bars WHERE trade_date <> (SELECT max(trade_date) FROM bars)")
def p05(spark, d):
    panel = bars(spark, d).select(*KEYS)
    last = panel.agg(F.max(DATE).alias("last_date"))
    return panel.join(F.broadcast(last), F.col(DATE) != F.col("last_date")).select(*KEYS)


@query("p06_price_flags", PANEL + f" SELECT {ROWS}, {ALL_GONE} AS price_all_nan, {ANY_GONE} AS price_any_nan FROM bars")
def p06(spark, d):
    return Q.with_price_flags(bars(spark, d)).select(*KEYS, "price_all_nan", "price_any_nan")


@query("p08_code_format", """SELECT l_suppkey, code, regexp_full_match(code, '[0-9]{6}\\.[A-Z]+') AS valid FROM (SELECT DISTINCT l_suppkey,
  CASE WHEN l_suppkey % 3 = 0 THEN printf('%05d.SZ', l_suppkey) WHEN l_suppkey % 3 = 1 THEN printf('%06d.sz', l_suppkey)
  ELSE printf('%06d.SZ', l_suppkey) END AS code FROM lineitem)""")
def p08(spark, d):
    k = F.col("l_suppkey")
    code = (F.when(k % 3 == 0, F.format_string("%05d.SZ", k)).when(k % 3 == 1, F.format_string("%06d.sz", k))
            .otherwise(F.format_string("%06d.SZ", k)))
    codes = read_table(spark, d, "lineitem").select(k, code.alias(ENTITY)).distinct()
    return codes.select(k, F.col(ENTITY).alias("code"), Q.valid_code().alias("valid"))


@query("p09_date_validity", PANEL + " SELECT DISTINCT trade_date + 20 AS number, try_strptime(CAST(trade_date + 20 AS VARCHAR), '%Y%m%d') IS NOT NULL AS valid FROM bars")
def p09(spark, d):
    dates = bars(spark, d).select((F.col(DATE) + 20).alias("number")).distinct()
    return dates.withColumn("valid", Q.valid_date("number"))


REGIONS_SQL = PREDS + f""",
  known AS (SELECT ts_code, trade_date, y_ret_1d, pred_a FROM preds WHERE y_ret_1d IS NOT NULL),
  ranks AS (SELECT *, {S.pct('pred_a')} AS pred_rank, {S.pct('y_ret_1d')} AS label_rank FROM known),
  regions AS (SELECT *, 'full' AS region FROM ranks UNION ALL SELECT *, 'top20' FROM ranks WHERE pred_rank > 0.8
    UNION ALL SELECT *, 'middle60' FROM ranks WHERE pred_rank > 0.2 AND pred_rank <= 0.8)"""


@query("p10_region_masks", REGIONS_SQL + f" SELECT region, {ROWS}, {S.rounded('pred_rank')} FROM regions")
def p10(spark, d):
    from crosstide.operators.residual import with_regions
    df = residual_rank(predictions(spark, d), date_sizes(spark, d), pred="pred_a")
    return shown(with_regions(df), "region", *KEYS, "pred_rank")


@query("p13_first_examples", SPANNED + f""", tagged AS (SELECT {ROWS}, {CONTEXT_SQL} AS price_context FROM spanned),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY price_context ORDER BY ts_code, trade_date) AS example FROM tagged)
  SELECT {ROWS}, price_context, example FROM numbered WHERE example <= 5""")
def p13(spark, d):
    tagged = Q.with_price_span(bars(spark, d)).select(*KEYS, Q.price_context().alias("price_context"))
    return Q.first_examples(tagged, "price_context", KEYS, 5)


@query("p14_finite_predictions", PREDS + " SELECT trade_date, count(pred_a) AS predictions FROM preds GROUP BY trade_date")
def p14(spark, d):
    """Row counts per date after the finite-prediction assertion passed."""
    from crosstide.sources.files import require_present
    return require_present(predictions(spark, d), "pred_a").groupBy(DATE).agg(F.count("pred_a").alias("predictions"))


@query("p15_month_bucket", PANEL + " SELECT CAST(trade_date // 100 AS INTEGER) AS month, count(*) AS rows, count(y_ret_1d) AS labels FROM bars GROUP BY 1")
def p15(spark, d):
    return labelled(spark, d).groupBy(F.floor(F.col(DATE) / 100).cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(LABEL).alias("labels"))
