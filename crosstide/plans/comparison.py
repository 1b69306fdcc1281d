"""Model comparison and residual diagnostics."""

from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.functions.groups import pinned
from crosstide.functions.guards import count_true
from crosstide.operators import compare as C
from crosstide.operators import evaluate as E
from crosstide.operators import residual as D
from crosstide.operators import selection as L
from crosstide.operators.history import history_features
from crosstide.plans import runs as P
from crosstide.plans import sqltext as S
from crosstide.plans.control import ALL_SCORES, all_scores
from crosstide.plans.date_features import full_ctes, narrow
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.plans.runs import METRICS, OFFICIAL_HERE, RUN
from crosstide.schema import DATE, ENTITY, KEYS, LABEL
from crosstide.sources.panel import bars

ROWS = "ts_code, trade_date"
FOLD = ["fold"]
FOLD_NAMES = ("F1", "F2", "F3")


def corr_sql(a, b):
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def avg_rank(x, by):
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def daily_corr_sql(where="TRUE"):
    return P.WIDE + f""", pair_ranks AS (SELECT fold, trade_date, {avg_rank('pred_a', 'fold, trade_date')} AS ra, {avg_rank('pred_b', 'fold, trade_date')} AS rb FROM wide WHERE {where}),
  corr_days AS (SELECT fold, trade_date, CASE WHEN max(ra) <> min(ra) AND max(rb) <> min(rb) THEN {corr_sql('ra', 'rb')} END AS prediction_spearman FROM pair_ranks GROUP BY fold, trade_date)"""


SUMMARY_SQL = """ SELECT fold, round(avg({v}), 6) + 0.0 AS mean, round(stddev_pop({v}), 6) + 0.0 AS std, count({v}) AS days, round(median({v}), 6) + 0.0 AS median,
  round(quantile_cont({v}, 0.1), 6) + 0.0 AS p10, round(quantile_cont({v}, 0.9), 6) + 0.0 AS p90 FROM {t} GROUP BY fold"""


@query("d01_prediction_correlation", daily_corr_sql() + SUMMARY_SQL.format(v="prediction_spearman", t="corr_days"))
def d01(spark, d):
    sizes = date_sizes(spark, d)
    daily = C.daily_correlation(P.both_models(spark, d), FOLD, sizes)
    # A fold's days number at most the calendar, so they count as groups of that size.
    return shown(C.daily_summary(daily, "prediction_spearman", FOLD, sizes))


@query("d18_control_agreement", daily_corr_sql("y_ret_1d IS NOT NULL") + " SELECT fold, trade_date, round(prediction_spearman, 6) + 0.0 AS prediction_spearman FROM corr_days")
def d18(spark, d):
    labelled = P.both_models(spark, d).filter(F.col(LABEL).isNotNull())
    return shown(C.daily_correlation(labelled, FOLD, date_sizes(spark, d)))


MEMBERS_SQL = P.WIDE + """, placed AS (SELECT *, row_number() OVER (PARTITION BY fold, trade_date ORDER BY pred_a DESC, ts_code) AS at_a,
    row_number() OVER (PARTITION BY fold, trade_date ORDER BY pred_b DESC, ts_code) AS at_b, count(*) OVER (PARTITION BY fold, trade_date) AS n FROM wide WHERE flag_limit_up = 0),
  flagged AS (SELECT *, at_a <= greatest(n // 10, 1) AS in_a, at_b <= greatest(n // 10, 1) AS in_b FROM placed),
  members AS (SELECT *, CASE WHEN in_a AND in_b THEN 'common_top' WHEN in_a THEN 'a_only' WHEN in_b THEN 'b_only' ELSE 'neither' END AS membership FROM flagged),
  overlap_days AS (SELECT fold, trade_date, count(*) FILTER (in_a AND in_b) AS common, count(*) FILTER (in_a OR in_b) AS union_rows, count(*) FILTER (in_a) AS top_size,
    count(*) FILTER (in_a AND in_b) / count(*) FILTER (in_a OR in_b)::DOUBLE AS jaccard, count(*) FILTER (in_a AND in_b) / count(*) FILTER (in_a)::DOUBLE AS overlap
    FROM members GROUP BY fold, trade_date)"""


def members(spark, d):
    return C.with_membership(P.both_models(spark, d), FOLD, date_sizes(spark, d))


@query("d02_top_overlap", MEMBERS_SQL + f" SELECT fold, trade_date, common, union_rows, top_size, {S.rounded('jaccard', 'overlap')} FROM overlap_days")
def d02(spark, d):
    return shown(C.daily_overlap(members(spark, d), FOLD), "fold", DATE, "common", "union_rows", "top_size", "jaccard", "overlap")


GROUP_RETURNS_SQL = """, labelled_members AS (SELECT *, avg(y_ret_1d) OVER (PARTITION BY fold, trade_date) AS market FROM members WHERE y_ret_1d IS NOT NULL)
  SELECT fold, membership, count(*) AS rows, round(avg(y_ret_1d), 6) + 0.0 AS mean_return, round(avg(y_ret_1d - market), 6) + 0.0 AS mean_excess FROM labelled_members GROUP BY fold, membership"""


@query("d03_group_returns", MEMBERS_SQL + GROUP_RETURNS_SQL)
def d03(spark, d):
    return shown(C.returns_by_membership(members(spark, d), FOLD))


@query("a20_group_means", P.RUNS + """, tagged AS (SELECT *, CASE WHEN y_ret_1d > 0 THEN 'up' WHEN y_ret_1d < 0 THEN 'down' ELSE 'flat' END AS move FROM runs WHERE y_ret_1d IS NOT NULL)
  SELECT model, fold, move, count(*) AS rows, round(sum(y_ret_1d) / count(*), 6) + 0.0 AS mean_return, round(sum(pred) / count(*), 6) + 0.0 AS mean_pred FROM tagged GROUP BY model, fold, move""")
def a20(spark, d):
    y = F.col(LABEL)
    rows = P.runs(spark, d).filter(y.isNotNull()).withColumn("move", F.when(y > 0, "up").when(y < 0, "down").otherwise("flat"))
    return shown(rows.groupBy(*RUN, "move").agg(F.count(F.lit(1)).alias("rows"), (F.sum(y) / F.count(y)).alias("mean_return"),
                                                (F.sum("pred") / F.count("pred")).alias("mean_pred")))


@query("d04_group_missing", MEMBERS_SQL + """ SELECT fold, membership, count(*) FILTER (y_ret_1d IS NULL) AS missing_rows, count(*) AS rows,
  round(count(*) FILTER (y_ret_1d IS NULL) / count(*)::DOUBLE, 6) + 0.0 AS fraction FROM members WHERE membership <> 'neither' GROUP BY fold, membership""")
def d04(spark, d):
    return shown(C.missing_by_membership(members(spark, d), FOLD))


@query("d05_exclusive_fractions", MEMBERS_SQL + """ SELECT fold, round(avg(1 - jaccard), 6) + 0.0 AS exclusive_union_mean, round(max(1 - jaccard), 6) + 0.0 AS exclusive_union_worst,
  round(stddev_pop(1 - jaccard), 6) + 0.0 AS exclusive_union_std, round(avg(1 - overlap), 6) + 0.0 AS exclusive_per_model_mean,
  round(max(1 - overlap), 6) + 0.0 AS exclusive_per_model_worst, round(stddev_pop(1 - overlap), 6) + 0.0 AS exclusive_per_model_std FROM overlap_days GROUP BY fold""")
def d05(spark, d):
    days = C.daily_overlap(members(spark, d), FOLD)
    parts = [(c, n, f) for c in ("exclusive_union", "exclusive_per_model") for n, f in (("mean", F.avg), ("worst", F.max), ("std", F.stddev_pop))]
    return shown(days.groupBy("fold").agg(*[f(c).alias(f"{c}_{n}") for c, n, f in parts]))


_DELTA = ("ic_mean", "annual_excess", "mean_turnover", "final_score")
DELTAS_SQL = ALL_SCORES + ", deltas AS (SELECT s.*, " + ", ".join(f"s.{m} - b.{m} AS delta_{m}" for m in _DELTA) + \
    " FROM scores s JOIN scores b ON b.model = 'a' AND b.fold = s.fold)"


def deltas(spark, d):
    return L.with_deltas(all_scores(spark, d), "a", "model", _DELTA)


@query("j12_baseline_delta", DELTAS_SQL + f" SELECT model, fold, {S.rounded(*[f'delta_{m}' for m in _DELTA])} FROM deltas")
def j12(spark, d):
    return shown(deltas(spark, d), *RUN, *[f"delta_{m}" for m in _DELTA])


_PARTS = ("ic_contribution", "excess_contribution", "turnover_contribution")
PARTS_SQL = "0.4 * delta_ic_mean AS ic_contribution, 0.3 * delta_annual_excess AS excess_contribution, -0.3 * delta_mean_turnover AS turnover_contribution"


@query("d06_score_decomposition", DELTAS_SQL + f", parts AS (SELECT *, {PARTS_SQL} FROM deltas) SELECT model, fold, {S.rounded('delta_final_score', *_PARTS)} FROM parts")
def d06(spark, d):
    return shown(deltas(spark, d).withColumns(L.contributions()), *RUN, "delta_final_score", *_PARTS)


PAIRS = (("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"))


@query("d07_paired_differences", ALL_SCORES + f""", pairs(l, r) AS (VALUES {', '.join(map(str, PAIRS))}),
  both_sides AS (SELECT r || ' - ' || l AS comparison, x.fold, y.final_score - x.final_score AS delta_final_score, 0.4 * (y.ic_mean - x.ic_mean) AS ic_contribution,
    0.3 * (y.annual_excess - x.annual_excess) AS excess_contribution, -0.3 * (y.mean_turnover - x.mean_turnover) AS turnover_contribution
    FROM pairs JOIN scores x ON x.model = l JOIN scores y ON y.model = r AND y.fold = x.fold),
  all_rows AS (SELECT * FROM both_sides UNION ALL SELECT comparison, 'Mean', avg(delta_final_score), avg(ic_contribution), avg(excess_contribution), avg(turnover_contribution)
    FROM both_sides GROUP BY comparison) SELECT comparison, fold, {S.rounded('delta_final_score', *_PARTS)} FROM all_rows""")
def d07(spark, d):
    return shown(L.paired_differences(all_scores(spark, d), PAIRS))


STABILITY_SQL = ", rows_long AS (" + " UNION ALL ".join(
    f"SELECT model, fold, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {{t}}" for m in _DELTA) + """),
  worst AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY CASE WHEN metric = 'mean_turnover' THEN -value ELSE value END NULLS FIRST, fold) AS k FROM rows_long),
  stable AS (SELECT model, metric, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean, CASE WHEN count(value) = count(*) THEN stddev_pop(value) END AS std,
    count(value) AS finite_folds, max(value) FILTER (k = 1) AS worst, max(fold) FILTER (k = 1) AS worst_fold FROM worst GROUP BY model, metric)"""


@query("d08_stability", ALL_SCORES + STABILITY_SQL.format(t="scores") + f" SELECT model, metric, {S.rounded('mean', 'std', 'worst')}, worst_fold, finite_folds FROM stable")
def d08(spark, d):
    return shown(L.stability(all_scores(spark, d), _DELTA))


HOLED = "holed AS (SELECT * REPLACE (CASE WHEN model = 'b' AND fold = 'F2' THEN NULL ELSE final_score END AS final_score) FROM scores)"


def holed(spark, d):
    """Scores with one undefined cell."""
    hole = (F.col("model") == "b") & (F.col("fold") == "F2")
    return all_scores(spark, d).withColumn("final_score", F.when(~hole, F.col("final_score")))


@query("a21_strict_mean", ALL_SCORES + f""", {HOLED} SELECT model, round(CASE WHEN count(final_score) = count(*) THEN avg(final_score) END, 6) + 0.0 AS mean_score,
  count(final_score) AS finite_folds FROM holed GROUP BY model""")
def a21(spark, d):
    from crosstide.functions.guards import strict_mean
    return shown(holed(spark, d).groupBy("model").agg(strict_mean("final_score").alias("mean_score"), F.count("final_score").alias("finite_folds")))


@query("a22_skip_mean", ALL_SCORES + f", {HOLED} SELECT model, round(avg(final_score), 6) + 0.0 AS mean_score, count(final_score) AS finite_folds FROM holed GROUP BY model")
def a22(spark, d):
    return shown(holed(spark, d).groupBy("model").agg(F.avg("final_score").alias("mean_score"), F.count("final_score").alias("finite_folds")))


@query("a23_worst_fold", ALL_SCORES + f""", {HOLED}""" + STABILITY_SQL.format(t="holed") + f""" SELECT model, metric, {S.rounded('mean', 'std')},
  CASE WHEN finite_folds = 3 THEN round(worst, 6) + 0.0 END AS worst, CASE WHEN finite_folds = 3 THEN worst_fold END AS worst_fold, finite_folds FROM stable""")
def a23(spark, d):
    return shown(L.stability(holed(spark, d), _DELTA))


DIAG_SQL = ALL_SCORES + """,
  lab_pool AS (SELECT model, fold, trade_date, ts_code, row_number() OVER (PARTITION BY model, fold, trade_date ORDER BY pred DESC NULLS LAST, ts_code) AS place,
    count(*) OVER (PARTITION BY model, fold, trade_date) AS n FROM runs WHERE flag_limit_up = 0 AND y_ret_1d IS NOT NULL),
  lab_tops AS (SELECT * FROM lab_pool WHERE n >= 10 AND place <= greatest(n // 10, 1))""" + P.turnover_sql("lab_tops", "runs", RUN, "lab_") + """,
  diag AS (SELECT model, fold, avg(turnover) AS diagnostic_turnover FROM lab_turn_days GROUP BY ALL),
  means AS (SELECT model, avg(ic_mean) AS i, avg(annual_excess) AS e, avg(mean_turnover) AS t, avg(diagnostic_turnover) AS g, avg(final_score) AS s
    FROM scores JOIN diag USING (model, fold) GROUP BY model),
  kept_means AS (SELECT m.model, m.i / nullif(b.i, 0) AS ic_retention, m.e / nullif(b.e, 0) AS excess_retention, b.t - m.t AS turnover_reduction,
    b.g - m.g AS diagnostic_reduction, m.s - b.s AS score_improvement FROM means m JOIN means b ON b.model = 'a')"""


@query("d09_retention", DIAG_SQL + f" SELECT model, {S.rounded('ic_retention', 'excess_retention', 'turnover_reduction', 'diagnostic_reduction', 'score_improvement')} FROM kept_means")
def d09(spark, d):
    df, sizes = P.runs(spark, d, "abcd"), date_sizes(spark, d)
    scores = E.score(df, OFFICIAL_HERE, RUN, sizes).join(E.diagnostics(df, OFFICIAL_HERE, RUN, sizes).select(*RUN, "diagnostic_turnover"), RUN)
    return shown(L.retention(scores, "a"))


# Differences are compared at nine decimals, like candidates: the baseline's own are 0 but for the order of a sum's terms.
@query("d10_decision_checks", DELTAS_SQL + """, tests AS (SELECT model, count(*) FILTER (round(delta_ic_mean, 9) > 0) AS improved_ic_mean,
    count(*) FILTER (round(delta_annual_excess, 9) > 0) AS improved_annual_excess, count(*) FILTER (round(delta_mean_turnover, 9) < 0) AS improved_mean_turnover,
    count(*) FILTER (round(delta_final_score, 9) > 0) AS improved_final_score, round(avg(delta_ic_mean), 9) AS i, round(avg(delta_annual_excess), 9) AS e,
    round(avg(final_score), 9) AS s FROM deltas GROUP BY model),
  checks AS (SELECT *, improved_annual_excess >= 2 AS excess_improves_2_of_3, improved_final_score >= 2 AS score_improves_2_of_3, abs(i) <= 0.005 AS ic_stable, s >= 0.25 AS score_above_threshold,
    (i > 0 AND improved_ic_mean >= 2) OR (e > 0 AND improved_annual_excess >= 2) AS ic_or_excess_gain FROM tests)
  SELECT * EXCLUDE (i, e, s), excess_improves_2_of_3 AND score_improves_2_of_3 AND ic_stable AND score_above_threshold AS accepted FROM checks""")
def d10(spark, d):
    return L.decision_checks(deltas(spark, d))


@query("d16_family_verdict", DELTAS_SQL + """ SELECT model, CASE WHEN max(delta_final_score) < 0 THEN 'retain' WHEN min(delta_final_score) > 0 THEN 'deletion_candidate'
  ELSE 'unstable_retain_for_now' END AS verdict, round(min(delta_final_score), 6) + 0.0 AS lowest, round(max(delta_final_score), 6) + 0.0 AS highest FROM deltas WHERE model <> 'a' GROUP BY model""")
def d16(spark, d):
    return shown(L.classify_families(deltas(spark, d).filter("model <> 'a'")))


# Residual diagnostics of every feature: the 147 of the full view and the 15 ranks that the rank view adds.
_ADDED = catalog.rank_view_columns()
STUDIED = [*catalog.FULL, *_ADDED.values()]
MIN_ROWS = 5


def studied(spark, d):
    """Every row of the validation dates with its trailing features, the prediction and the market's amount ratio."""
    from crosstide.operators.cross import amount_ratio
    panel, sizes = bars(spark, d, labelled=True), date_sizes(spark, d)
    df = P.in_folds(history_features(panel, catalog.ENTITY_FEATURES, keep=[*KEYS, LABEL], placed=True))
    return P.dated(df.withColumn("pred", F.coalesce(-F.col("ret_5"), F.lit(0.0))), amount_ratio(panel), sizes)


def daily_correlations(spark, d, against):
    """Of all 162 columns; only rows of validation dates are moved, once."""
    return D.study(studied(spark, d), against, FOLD, date_sizes(spark, d), MIN_ROWS)


def residual_daily(spark, d):
    return daily_correlations(spark, d, ["residual", "pred_rank"])


BY = "fold, region, feature, trade_date"


def study_sql(against):
    """CTEs up to ``daily``: correlations of every feature with the compared columns (a name to its abbreviation)."""
    # The first and the last place among equal values, from one sort a column.
    ranked = ", ".join(f"(rank() OVER w_{short} + round(cume_dist() OVER w_{short} * count(*) OVER (PARTITION BY {BY}))) / 2 AS {short}" for short in ("rv", *against.values()))
    ranked += " FROM long_rows WINDOW " + ", ".join(f"w_{short} AS (PARTITION BY {BY} ORDER BY {c})" for c, short in {"value": "rv", **against}.items())
    pairs = [("rv", short) for short in against.values()]
    shorts = list(against.values())
    pairs += [(y, x) for i, x in enumerate(shorts) for y in shorts[i + 1:]]
    found = ", ".join(f"CASE WHEN max({x}) <> min({x}) AND max({y}) <> min({y}) THEN {corr_sql(x, y)} END AS {x}_{y}" for x, y in pairs)
    return full_ctes(("ts_code", "trade_date", "y_ret_1d")) + ", " + S.FOLD_VALUES + f""",
  viewed AS (SELECT *, {', '.join(f"{S.pct(c)} AS {new}" for c, new in _ADDED.items())} FROM full_rows),
  known AS (SELECT ts_code, trade_date, y_ret_1d, coalesce(-ret_5, 0) AS pred, fold, {narrow(STUDIED)} FROM viewed
    JOIN folds ON trade_date BETWEEN valid_start AND valid_end WHERE y_ret_1d IS NOT NULL),
  ranks AS (SELECT *, {S.pct('y_ret_1d', 'fold, trade_date')} AS label_rank, {S.pct('pred', 'fold, trade_date')} AS pred_rank FROM known),
  regions AS (SELECT *, label_rank - pred_rank AS residual, 'full' AS region FROM ranks UNION ALL SELECT *, label_rank - pred_rank, 'top20' FROM ranks WHERE pred_rank > 0.8
    UNION ALL SELECT *, label_rank - pred_rank, 'middle60' FROM ranks WHERE pred_rank > 0.2 AND pred_rank <= 0.8),
  long_rows AS (UNPIVOT regions ON {', '.join(STUDIED)} INTO NAME feature VALUE value),
  long_ranks AS (SELECT {BY}, {ranked}),
  daily AS (SELECT {BY}, count(*) AS pair_rows, {found} FROM long_ranks GROUP BY {BY} HAVING count(*) >= {MIN_ROWS})"""


STUDY_SQL = study_sql({"residual": "rr", "pred_rank": "rp"})
PARTIAL_SQL = study_sql({"y_ret_1d": "ry", "pred_rank": "rp"})


@query("d11_residual_correlation", STUDY_SQL + f" SELECT {BY}, pair_rows, round(rv_rr, 6) + 0.0 AS ic_residual, round(rv_rp, 6) + 0.0 AS ic_pred_rank FROM daily")
def d11(spark, d):
    return shown(residual_daily(spark, d), "fold", "region", "feature", DATE, "pair_rows", "ic_residual", "ic_pred_rank")


@query("d12_partial_correlation", PARTIAL_SQL + f""", named AS (SELECT *, rv_ry AS ic_label, rv_rp AS ic_pred_rank, rp_ry AS ic_label_pred FROM daily), partials AS (SELECT *, CASE WHEN abs(ic_pred_rank) < 0.999999 AND abs(ic_label_pred) < 0.999999
    THEN (ic_label - ic_pred_rank * ic_label_pred) / sqrt((1 - ic_pred_rank * ic_pred_rank) * (1 - ic_label_pred * ic_label_pred)) END AS partial_ic FROM named)
  SELECT {BY}, pair_rows, {S.rounded('ic_label', 'ic_pred_rank', 'ic_label_pred', 'partial_ic')} FROM partials""")
def d12(spark, d):
    daily = daily_correlations(spark, d, [LABEL, "pred_rank"])
    daily = daily.withColumnsRenamed({f"ic_{LABEL}": "ic_label", f"ic_{LABEL}_pred_rank": "ic_label_pred"})
    defined = (F.abs("ic_pred_rank") < 0.999999) & (F.abs("ic_label_pred") < 0.999999)
    daily = daily.withColumn("partial_ic", F.when(defined, D.partial_correlation("ic_label", "ic_pred_rank", "ic_label_pred")))
    return shown(daily, "fold", "region", "feature", DATE, "pair_rows", "ic_label", "ic_pred_rank", "ic_label_pred", "partial_ic")


MEANS_SQL = STUDY_SQL + """, means AS (SELECT fold, region, feature, avg(rv_rr) AS mean_ic, count(rv_rr) AS finite_days, count(DISTINCT trade_date) AS days
  FROM daily GROUP BY fold, region, feature),
  families(feature, family) AS (VALUES """ + ", ".join(f"('{f}', '{catalog.CATEGORY.get(f, 'cross_section_rank')}')" for f in STUDIED) + ")"


def means(spark, d):
    return D.fold_means(residual_daily(spark, d), "ic_residual")


def families(spark):
    return F.broadcast(catalog.catalog_table(spark).select("feature", "family"))


@query("d13_fold_means", MEANS_SQL + f" SELECT fold, region, feature, finite_days, days, {S.rounded('mean_ic')} FROM means")
def d13(spark, d):
    return shown(means(spark, d), "fold", "region", "feature", "finite_days", "days", "mean_ic")


@query("j13_family_join", MEANS_SQL + f" SELECT fold, region, feature, family, {S.rounded('mean_ic')} FROM means JOIN families USING (feature)")
def j13(spark, d):
    return shown(means(spark, d).join(families(spark), "feature"), "fold", "region", "feature", "family", "mean_ic")


WIDE_SQL = MEANS_SQL + """, pivoted AS (SELECT region, feature, max(mean_ic) FILTER (fold = 'F1') AS F1, max(mean_ic) FILTER (fold = 'F2') AS F2, max(mean_ic) FILTER (fold = 'F3') AS F3
    FROM means GROUP BY region, feature),
  flagged AS (SELECT *, list_avg(list_filter([F1, F2, F3], lambda x: x IS NOT NULL)) AS mean_residual_ic, list_median(list_filter([F1, F2, F3], lambda x: x IS NOT NULL)) AS median_residual_ic,
    coalesce(F1 > 0 AND F2 > 0 AND F3 > 0, false) OR coalesce(F1 < 0 AND F2 < 0 AND F3 < 0, false) AS same_direction,
    CAST(coalesce(abs(F1) >= 0.01, false) AS INTEGER) + CAST(coalesce(abs(F2) >= 0.01, false) AS INTEGER) + CAST(coalesce(abs(F3) >= 0.01, false) AS INTEGER) >= 2 AS two_folds_meaningful FROM pivoted),
  stable AS (SELECT *, same_direction AND two_folds_meaningful AS stable_meaningful FROM flagged)"""


def flagged(spark, d):
    return D.stability_flags(D.fold_table_wide(means(spark, d), FOLD_NAMES), FOLD_NAMES)


@query("a25_fold_pivot", WIDE_SQL + f" SELECT region, feature, {S.rounded('F1', 'F2', 'F3')} FROM pivoted")
def a25(spark, d):
    return shown(D.fold_table_wide(means(spark, d), FOLD_NAMES))


@query("d14_direction_flags", WIDE_SQL + f" SELECT region, feature, same_direction, two_folds_meaningful, stable_meaningful, {S.rounded('mean_residual_ic', 'median_residual_ic')} FROM stable")
def d14(spark, d):
    return shown(flagged(spark, d), "region", "feature", "same_direction", "two_folds_meaningful", "stable_meaningful", "mean_residual_ic", "median_residual_ic")


_FAMILY = ("F1_mean", "F2_mean", "F3_mean", "F1_median", "F2_median", "F3_median", "mean_residual_ic", "median_residual_ic", "mean_absolute_ic")


@query("d15_family_summary", WIDE_SQL + f""", summary AS (SELECT region, family, count(*) AS feature_count, avg(F1) AS F1_mean, avg(F2) AS F2_mean, avg(F3) AS F3_mean,
    median(F1) AS F1_median, median(F2) AS F2_median, median(F3) AS F3_median, avg(s.mean_residual_ic) AS mean_residual_ic, median(s.mean_residual_ic) AS median_residual_ic,
    avg(abs(s.mean_residual_ic)) AS mean_absolute_ic, count(*) FILTER (same_direction) AS same_direction_count, count(*) FILTER (stable_meaningful) AS stable_count,
    coalesce(array_to_string(list_slice(list(feature ORDER BY abs(s.mean_residual_ic) DESC, feature) FILTER (stable_meaningful), 1, 5), ', '), '') AS stable_features
    FROM stable s JOIN families USING (feature) GROUP BY region, family)
  SELECT region, family, feature_count, same_direction_count, stable_count, stable_features, {S.rounded(*_FAMILY)} FROM summary""")
def d15(spark, d):
    rows = flagged(spark, d).join(families(spark), "feature")
    return shown(D.family_summary(rows, FOLD_NAMES), "region", "family", "feature_count", "same_direction_count", "stable_count", "stable_features", *_FAMILY)


MONTHLY_RUNS = P.WIDE + """, runs AS (SELECT 'a' AS model, fold, trade_date // 100 AS month, ts_code, trade_date, y_ret_1d, flag_limit_up, pred_a AS pred FROM wide
  UNION ALL SELECT 'b', fold, trade_date // 100, ts_code, trade_date, y_ret_1d, flag_limit_up, pred_b FROM wide)"""
_MONTH_RUN = ["model", "fold", "month"]


@query("d17_monthly_deltas", MEMBERS_SQL.replace(P.WIDE, MONTHLY_RUNS, 1) + P.scored_sql("runs", _MONTH_RUN, prefix="mm") + P.summary_sql(_MONTH_RUN, p="mm") + f""",
  pair_ranks AS (SELECT fold, trade_date, {avg_rank('pred_a', 'fold, trade_date')} AS ra, {avg_rank('pred_b', 'fold, trade_date')} AS rb FROM wide),
  corr_days AS (SELECT fold, trade_date, CASE WHEN max(ra) <> min(ra) AND max(rb) <> min(rb) THEN {corr_sql('ra', 'rb')} END AS c FROM pair_ranks GROUP BY fold, trade_date),
  corr_months AS (SELECT fold, trade_date // 100 AS month, avg(c) AS correlation FROM corr_days GROUP BY ALL),
  over_months AS (SELECT fold, trade_date // 100 AS month, avg(jaccard) AS jaccard, avg(overlap) AS overlap FROM overlap_days GROUP BY ALL),
  months AS (SELECT fold, month, y.ic_mean - x.ic_mean AS delta_ic_mean, y.annual_excess - x.annual_excess AS delta_annual_excess, y.final_score - x.final_score AS delta_final_score,
    correlation, jaccard, overlap FROM mmscores x JOIN mmscores y USING (fold, month) JOIN corr_months USING (fold, month) JOIN over_months USING (fold, month) WHERE x.model = 'a' AND y.model = 'b')
  SELECT fold, CAST(month AS INTEGER) AS month, {S.rounded('delta_ic_mean', 'delta_annual_excess', 'delta_final_score', 'correlation', 'jaccard', 'overlap')} FROM months""")
def d17(spark, d):
    sizes, month = date_sizes(spark, d), F.floor(F.col(DATE) / 100).cast("int")
    scores = E.score(P.runs(spark, d).withColumn("month", month), OFFICIAL_HERE, _MONTH_RUN, sizes)
    out = L.with_deltas(scores, "a", "model", ["ic_mean", "annual_excess", "final_score"], ["fold", "month"]).filter("model = 'b'")
    wide = P.both_models(spark, d)
    corr = C.daily_correlation(wide, FOLD, sizes).groupBy("fold", month.alias("month")).agg(F.avg("prediction_spearman").alias("correlation"))
    over = C.daily_overlap(C.with_membership(wide, FOLD, sizes), FOLD).groupBy("fold", month.alias("month")).agg(
        F.avg("jaccard").alias("jaccard"), F.avg("overlap").alias("overlap"))
    joined = out.join(corr, ["fold", "month"]).join(over, ["fold", "month"])
    return shown(joined, "fold", "month", "delta_ic_mean", "delta_annual_excess", "delta_final_score", "correlation", "jaccard", "overlap")


TOPS_SQL = P.RUNS + P.scored_sql("runs", RUN)


@query("d19_duplicate_share", TOPS_SQL + """, v AS (SELECT model, fold, trade_date, pred, count(*) AS n FROM tops WHERE y_ret_1d IS NULL GROUP BY ALL)
  SELECT model, fold, CAST(sum(n) AS BIGINT) AS missing_top_rows, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows,
  round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE, 6) + 0.0 AS duplicate_fraction FROM v GROUP BY model, fold""")
def d19(spark, d):
    tops = E.top_rows(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d))
    return shown(C.duplicate_share(tops, RUN))


_SPARSE = ("ret_1", "kmid", "madev_3", "stdret_5", "flag_limit_up", "flag_limit_down")


@query("d20_constant_inputs", S.history(_SPARSE) + """, only_flags AS (SELECT *, coalesce(-ret_1, 0) AS pred FROM features WHERE """
       + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _SPARSE) + """ = 2 AND flag_limit_up = 0 AND flag_limit_down = 0)
  SELECT count(*) AS rows, count(DISTINCT pred) AS distinct_predictions, count(ret_1) AS with_features FROM only_flags""")
def d20(spark, d):
    from crosstide.operators.quality import present_count
    df = history_features(bars(spark, d), _SPARSE).withColumn("pred", F.coalesce(-F.col("ret_1"), F.lit(0.0)))
    rows = df.filter((present_count(_SPARSE) == 2) & (F.col("flag_limit_up") == 0) & (F.col("flag_limit_down") == 0))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pred").alias("distinct_predictions"), F.count("ret_1").alias("with_features"))


@query("d21_review_rows", S.panel() + """, windowed AS (SELECT ts_code, trade_date, flag_limit_up, flag_limit_down, list(close) OVER w AS closes, count(close) OVER w AS n, count(*) OVER w AS m FROM bars
    WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
  SELECT ts_code, trade_date, CAST(m AS BIGINT) AS history_rows, round(CASE WHEN n = 6 AND m = 6 THEN closes[6] / closes[5] - 1 END, 6) + 0.0 AS ret_1,
  round(CASE WHEN n = 6 AND m = 6 THEN closes[6] / closes[1] - 1 END, 6) + 0.0 AS ret_5,
  round(CASE WHEN n = 6 AND m = 6 THEN closes[6] / list_avg(closes[2:6]) - 1 END, 6) + 0.0 AS madev_5 FROM windowed WHERE flag_limit_up = 1 AND flag_limit_down = 1""")
def d21(spark, d):
    from crosstide.operators.review import review_rows
    chosen = (F.col("flag_limit_up") == 1) & (F.col("flag_limit_down") == 1)
    return shown(review_rows(bars(spark, d), chosen), *KEYS, "history_rows", "ret_1", "ret_5", "madev_5")


@query("d22_prefix_invariance", S.panel() + f" SELECT unnest({list(catalog.ENTITY_FEATURES)}) AS feature, cells, 0::BIGINT AS differences "
       "FROM (SELECT count(*) AS cells FROM bars WHERE trade_date < 20000101)")
def d22(spark, d):
    """Feature cells of a truncated panel that differ from the full run (none may)."""
    from crosstide.operators.review import prefix_differences
    return prefix_differences(bars(spark, d), 20000101, list(catalog.ENTITY_FEATURES), placed=True)


@query("w28_missing_label_runs", TOPS_SQL + """, gone AS (SELECT t.model, t.fold, t.ts_code, t.trade_date, c.day FROM tops t JOIN cal c USING (model, fold, trade_date) WHERE y_ret_1d IS NULL),
  islands AS (SELECT *, day - row_number() OVER (PARTITION BY model, fold, ts_code ORDER BY day) AS island FROM gone)
  SELECT model, fold, ts_code, min(trade_date) AS start, max(trade_date) AS "end", count(*) AS run_days FROM islands GROUP BY model, fold, ts_code, island""")
def w28(spark, d):
    df = P.runs(spark, d)
    tops = E.top_rows(df, OFFICIAL_HERE, RUN, date_sizes(spark, d))
    return C.membership_runs(tops, E.calendar(df, RUN), RUN)


PERSIST_SQL = TOPS_SQL + """, gone AS (SELECT t.model, t.fold, t.ts_code, t.trade_date, c.day FROM tops t JOIN cal c USING (model, fold, trade_date) WHERE y_ret_1d IS NULL),
  islands AS (SELECT *, day - row_number() OVER (PARTITION BY model, fold, ts_code ORDER BY day) AS island FROM gone),
  found AS (SELECT model, fold, ts_code, min(trade_date) AS start, count(*) AS run_days FROM islands GROUP BY model, fold, ts_code, island)"""


@query("w28_persistence", PERSIST_SQL + """, longest AS (SELECT model, fold, ts_code, max(run_days) AS longest, count(*) AS r FROM found GROUP BY ALL),
  dates AS (SELECT model, fold, count(*) AS n FROM cal GROUP BY ALL)
  SELECT model, fold, count(*) AS entities, CAST(sum(r) AS BIGINT) AS runs, max(longest) AS longest_run, count(*) FILTER (longest >= 20) AS entities_ge20,
  count(*) FILTER (longest >= 60) AS entities_ge60, count(*) FILTER (longest = n) AS entities_full FROM longest JOIN dates USING (model, fold) GROUP BY model, fold""")
def w28_persistence(spark, d):
    df = P.runs(spark, d)
    days = E.calendar(df, RUN)
    tops = E.top_rows(df, OFFICIAL_HERE, RUN, date_sizes(spark, d))
    return C.persistence(C.membership_runs(tops, days, RUN), days, RUN)


@query("o04_longest_runs", PERSIST_SQL + " SELECT model, fold, ts_code, start, run_days FROM found ORDER BY run_days DESC, model, fold, ts_code, start LIMIT 10")
def o04(spark, d):
    df = P.runs(spark, d)
    tops = E.top_rows(df, OFFICIAL_HERE, RUN, date_sizes(spark, d))
    found = C.membership_runs(tops, E.calendar(df, RUN), RUN)
    return found.orderBy(F.desc("run_days"), *RUN, ENTITY, "start").limit(10).select(*RUN, ENTITY, "start", "run_days")
