"""Turnover control, grids, blends and candidate selection."""

from pyspark.sql import functions as F

from crosstide.operators import evaluate as E
from crosstide.operators import selection as L
from crosstide.operators import turnover as U
from crosstide.plans import runs as P
from crosstide.plans import sqltext as S
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.plans.runs import METRICS, OFFICIAL_HERE, RUN
from crosstide.schema import DATE, ENTITY, KEYS, LABEL

# The declared grid of smoothing weights and exit fractions.
ALPHAS, EXITS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5), (0.1, 0.125, 0.15)
# The extension of the grid, which shares the point (0.5, 0.15) with it.
WIDER_ALPHAS, WIDER_EXITS = (0.5, 0.4, 0.3), (0.15, 0.175, 0.2, 0.225, 0.25)
POINT = [*RUN, "alpha", "exit_fraction"]
ROWS = "ts_code, trade_date"
POOL = OFFICIAL_HERE.min_pool


def smoothing_sql(alphas=ALPHAS):
    listed = ", ".join(f"({a!r}::DOUBLE, {1 - a!r}::DOUBLE)" for a in alphas)
    return P.RUNS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
rk AS (SELECT *, {S.pct('pred', 'model, fold, trade_date')} AS rank,
  row_number() OVER (PARTITION BY model, fold, ts_code ORDER BY trade_date) AS rn FROM runs),
alphas(alpha, keep) AS (VALUES {listed}),
ema AS (SELECT model, fold, alpha, keep, ts_code, rn, rank AS smooth FROM rk, alphas WHERE rn = 1
  UNION ALL SELECT k.model, k.fold, m.alpha, m.keep, k.ts_code, k.rn, m.alpha * k.rank + m.keep * m.smooth
  FROM ema m JOIN rk k ON k.model = m.model AND k.fold = m.fold AND k.ts_code = m.ts_code AND k.rn = m.rn + 1),
sm AS (SELECT k.model, k.fold, m.alpha, k.ts_code, k.trade_date, k.y_ret_1d, k.flag_limit_up, k.rank, m.smooth
  FROM rk k JOIN ema m USING (model, fold, ts_code, rn))"""


def control_sql(alphas=ALPHAS, exits=EXITS):
    return smoothing_sql(alphas) + f""",
exits(exit_fraction) AS (VALUES {', '.join(f'({e!r}::DOUBLE)' for e in exits)}),
el AS (SELECT *, row_number() OVER (PARTITION BY model, fold, alpha, trade_date ORDER BY smooth DESC, ts_code) AS place,
  count(*) OVER (PARTITION BY model, fold, alpha, trade_date) AS n FROM sm WHERE flag_limit_up = 0),
lists AS (SELECT model, fold, alpha, exit_fraction, trade_date, max(n) AS n,
  list(ts_code ORDER BY place) FILTER (place <= greatest(floor(n * exit_fraction), greatest(n // 10, 1))) AS ex
  FROM el CROSS JOIN exits GROUP BY model, fold, alpha, exit_fraction, trade_date),
dts AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY trade_date) AS day FROM (SELECT DISTINCT model, fold, trade_date FROM runs)),
steps AS (SELECT d.model, d.fold, a.alpha, e.exit_fraction, d.trade_date, d.day, coalesce(l.n, 0) >= {POOL} AS ok,
  greatest(l.n // 10, 1) AS k, l.ex FROM dts d CROSS JOIN alphas a CROSS JOIN exits e LEFT JOIN lists l ON l.model = d.model AND l.fold = d.fold
  AND l.alpha = a.alpha AND l.exit_fraction = e.exit_fraction AND l.trade_date = d.trade_date),
hold AS (SELECT model, fold, alpha, exit_fraction, day, CASE WHEN ok THEN list_slice(ex, 1, k) ELSE [] END AS chosen FROM steps WHERE day = 1
  UNION ALL SELECT model, fold, alpha, exit_fraction, day, CASE WHEN NOT ok THEN []
    ELSE list_slice(list_concat(r, list_filter(ex, lambda x: NOT list_contains(r, x))), 1, k) END
  FROM (SELECT s.*, list_slice(list_filter(s.ex, lambda x: list_contains(h.chosen, x)), 1, s.k) AS r FROM hold h JOIN steps s
    ON s.model = h.model AND s.fold = h.fold AND s.alpha = h.alpha AND s.exit_fraction = h.exit_fraction AND s.day = h.day + 1)),
sets AS (SELECT s.model, s.fold, s.alpha, s.exit_fraction, s.trade_date, unnest(h.chosen) AS ts_code
  FROM hold h JOIN steps s USING (model, fold, alpha, exit_fraction, day)),
marked AS (SELECT m.*, e.exit_fraction, t.ts_code IS NOT NULL AS selected FROM sm m CROSS JOIN exits e LEFT JOIN sets t
  ON t.model = m.model AND t.fold = m.fold AND t.alpha = m.alpha AND t.exit_fraction = e.exit_fraction
  AND t.trade_date = m.trade_date AND t.ts_code = m.ts_code),
controlled AS (SELECT *, CAST(count(*) OVER (PARTITION BY model, fold, alpha, exit_fraction, trade_date) + 1 - row_number() OVER (
  PARTITION BY model, fold, alpha, exit_fraction, trade_date ORDER BY selected DESC, smooth DESC, ts_code) AS DOUBLE) AS pred FROM marked)"""


def controlled(spark, d, alphas=ALPHAS, exits=EXITS):
    return U.controlled_predictions(P.runs(spark, d), alphas, exits, RUN, POOL, date_sizes(spark, d))


# Millionths by the same double steps in both engines: halving weights hit decimal ties, which their round functions settle unlike.
MILLIONTHS = "floor(smooth * 1000000 + 0.5::DOUBLE)"


def millionths():
    return F.floor(F.col("smooth") * 1000000 + 0.5)


@query("u01_causal_ema", smoothing_sql() + f" SELECT model, fold, alpha, {ROWS}, {MILLIONTHS} / 1000000 AS smooth FROM sm")
def u01(spark, d):
    ranked = U.daily_rank(P.runs(spark, d), RUN, date_sizes(spark, d))
    return U.causal_ema(ranked, ALPHAS, RUN).select(*RUN, "alpha", *KEYS, (millionths() / 1000000).alias("smooth"))


@query("u02_hysteresis_sets", control_sql() + f" SELECT model, fold, alpha, exit_fraction, {ROWS} FROM sets")
def u02(spark, d):
    sizes, df = date_sizes(spark, d), P.runs(spark, d)
    grid = U.control_grid(df, ALPHAS, EXITS, RUN, POOL, sizes)
    if grid is not None:
        return grid.members().select(*POINT, *KEYS)
    smooth = U.causal_ema(U.daily_rank(df, RUN, sizes), ALPHAS, RUN, keep=["flag_limit_up"])
    band = U.exit_band(smooth, EXITS, [*RUN, "alpha"], POOL, sizes)
    return U.hysteresis_sets(band, [*RUN, "alpha"]).select(*POINT, *KEYS)


WIDER_SQL = control_sql(WIDER_ALPHAS, WIDER_EXITS)


@query("u03_ordinal_prediction", WIDER_SQL + f" SELECT model, fold, alpha, exit_fraction, {ROWS}, selected, pred FROM controlled")
def u03(spark, d):
    """All 15 points of the extension."""
    return controlled(spark, d, WIDER_ALPHAS, WIDER_EXITS).select(*POINT, *KEYS, "selected", "pred")


@query("u04_full_control", control_sql() + f" SELECT model, fold, alpha, exit_fraction, trade_date, count(*) AS rows, "
       f"count(*) FILTER (selected) AS chosen, CAST(sum(CAST(pred * {MILLIONTHS} AS BIGINT)) AS BIGINT) AS weighted FROM controlled GROUP BY ALL")
def u04(spark, d):
    from crosstide.functions.guards import count_true
    days = controlled(spark, d).groupBy(*POINT, DATE).agg(
        F.count(F.lit(1)).alias("rows"), count_true(F.col("selected")).alias("chosen"),
        F.sum(F.col("pred").cast("long") * millionths()).alias("weighted"))
    return days


GRID_SQL = control_sql() + P.scored_sql("controlled", POINT) + P.summary_sql(POINT)
_SCORE = ("ic_mean", "annual_excess", "mean_turnover", "final_score")


def grid_scores(spark, d, alphas=ALPHAS, exits=EXITS):
    return U.controlled_scores(P.runs(spark, d), alphas, exits, OFFICIAL_HERE, RUN, POOL, date_sizes(spark, d))


@query("u05_grid_scores", GRID_SQL + f" SELECT model, fold, alpha, exit_fraction, {S.rounded(*_SCORE)} FROM scores")
def u05(spark, d):
    return shown(grid_scores(spark, d), *POINT, *_SCORE)


@query("u05_extension_scores", WIDER_SQL + P.scored_sql("controlled", POINT) + P.summary_sql(POINT) + f""", anchor AS (SELECT model, fold, final_score AS anchor_score FROM scores WHERE alpha = 0.5 AND exit_fraction = 0.15)
  SELECT model, fold, alpha, exit_fraction, {S.rounded(*_SCORE)}, round(final_score - anchor_score, 6) + 0.0 AS gain_over_anchor FROM scores JOIN anchor USING (model, fold)""")
def u05_extension(spark, d):
    """The 15 points of the extension, each beside the anchor (0.5, 0.15) that it shares with the first grid."""
    from crosstide.functions.groups import pinned
    scores = pinned(grid_scores(spark, d, WIDER_ALPHAS, WIDER_EXITS))
    anchor = scores.filter("alpha = 0.5 AND exit_fraction = 0.15").select(*RUN, F.col("final_score").alias("_anchor"))
    out = scores.join(F.broadcast(anchor), RUN).withColumn("gain_over_anchor", F.col("final_score") - F.col("_anchor"))  # one row per run
    return shown(out, *POINT, *_SCORE, "gain_over_anchor")


SELECT_SQL = """, chosen_rows AS (SELECT * FROM scores WHERE fold IN ({folds})),
  candidates AS (SELECT model, alpha, exit_fraction, avg(final_score) AS mean_score, min(final_score) AS worst_score,
    avg(mean_turnover) AS mean_turnover FROM chosen_rows GROUP BY model, alpha, exit_fraction),
  selected AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(mean_score, 9) DESC, round(worst_score, 9) DESC, round(mean_turnover, 9), alpha DESC, exit_fraction) = 1)"""
_CHOICE = ("mean_score", "worst_score", "mean_turnover")


@query("u06_grid_selection", GRID_SQL + SELECT_SQL.format(folds="'F1', 'F2', 'F3'") + f" SELECT model, alpha, exit_fraction, {S.rounded(*_CHOICE)} FROM selected")
def u06(spark, d):
    return shown(L.select_grid_point(grid_scores(spark, d), ["model"]))


@query("u07_selection_folds", GRID_SQL + SELECT_SQL.format(folds="'F1', 'F2'") + f" SELECT model, alpha, exit_fraction, {S.rounded(*_CHOICE)} FROM selected")
def u07(spark, d):
    # Scored once: the completeness check and the selection both read the stored score rows.
    from crosstide.functions.groups import pinned
    scores = pinned(grid_scores(spark, d))
    return shown(L.select_grid_point(L.require_folds(scores, ["F1", "F2"]), ["model"]))


@query("u13_grid_boundary", GRID_SQL + SELECT_SQL.format(folds="'F1', 'F2', 'F3'") + """ SELECT model, alpha, exit_fraction,
  alpha IN (0.5, 1.0) AS alpha_on_boundary, exit_fraction IN (0.1, 0.15) AS exit_on_boundary FROM selected""")
def u13(spark, d):
    best = L.select_grid_point(grid_scores(spark, d), ["model"])
    return L.grid_boundary(best, ALPHAS, EXITS).select("model", "alpha", "exit_fraction", "alpha_on_boundary", "exit_on_boundary")


@query("a24_metric_surface", GRID_SQL + """ SELECT model, alpha, round(avg(final_score) FILTER (exit_fraction = 0.1), 6) + 0.0 AS exit_100,
  round(avg(final_score) FILTER (exit_fraction = 0.125), 6) + 0.0 AS exit_125, round(avg(final_score) FILTER (exit_fraction = 0.15), 6) + 0.0 AS exit_150 FROM scores WHERE fold IN ('F1', 'F2') GROUP BY model, alpha""")
def a24(spark, d):
    return shown(L.metric_surface(grid_scores(spark, d).filter("fold IN ('F1', 'F2')"), EXITS, by=["model"]))


BLEND_RANKS = P.WIDE + f""", ranked AS (SELECT *, {S.pct('pred_a', 'fold, trade_date')} AS rank_a, {S.pct('pred_b', 'fold, trade_date')} AS rank_b FROM wide),
  weights(weight) AS (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)),
  blended AS (SELECT weight, fold, ts_code, trade_date, y_ret_1d, flag_limit_up, weight * rank_a + (1 - weight) * rank_b AS pred FROM ranked CROSS JOIN weights)"""
WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)


def blended(spark, d):
    from crosstide.functions.groups import average_ranks
    wide = P.both_models(spark, d)
    ranked = average_ranks(wide, {"pred_a": "rank_a", "pred_b": "rank_b"}, ["fold", DATE], ["fold", *KEYS], date_sizes(spark, d))
    grid = spark.createDataFrame([(w,) for w in WEIGHTS], "weight double")
    return L.blend(ranked.crossJoin(F.broadcast(grid)), "rank_a", "rank_b", "weight")


@query("j14_parameter_grid", control_sql() + " SELECT model, fold, alpha, exit_fraction, count(*) AS rows FROM sm CROSS JOIN exits GROUP BY ALL")
def j14(spark, d):
    grid = spark.createDataFrame([(a, e) for a in ALPHAS for e in EXITS], "alpha double, exit_fraction double")
    return P.runs(spark, d).crossJoin(F.broadcast(grid)).groupBy(*POINT).agg(F.count(F.lit(1)).alias("rows"))


@query("u08_rank_blend", BLEND_RANKS + f" SELECT weight, fold, {ROWS}, {S.rounded('pred')} FROM blended")
def u08(spark, d):
    return shown(blended(spark, d), "weight", "fold", *KEYS, "pred")


BLEND_SCORES = BLEND_RANKS + P.scored_sql("blended", ["weight", "fold"]) + P.summary_sql(["weight", "fold"])


@query("u09_weight_selection", BLEND_SCORES + f""", candidates AS (SELECT weight, avg(final_score) AS mean_score, min(final_score) AS worst_score,
  avg(mean_turnover) AS mean_turnover FROM scores WHERE fold IN ('F1', 'F2') GROUP BY weight)
  SELECT weight, {S.rounded(*_CHOICE)} FROM (SELECT * FROM candidates ORDER BY round(mean_score, 9) DESC, round(worst_score, 9) DESC, round(candidates.mean_turnover, 9), abs(weight - 0.5) LIMIT 1)""")
def u09(spark, d):
    scores = E.score(blended(spark, d).filter(F.col("fold").isin("F1", "F2")), OFFICIAL_HERE, ["weight", "fold"], date_sizes(spark, d))
    return shown(L.select_weight(scores))


ALL_SCORES = P.runs_sql("abcd") + P.scored_sql("runs", RUN) + P.summary_sql(RUN)
FEATURE_COUNTS = (("a", 137), ("b", 129), ("c", 121), ("d", 113))


def all_scores(spark, d):
    return E.score(P.runs(spark, d, "abcd"), OFFICIAL_HERE, RUN, date_sizes(spark, d))


@query("u10_feature_set_selection", ALL_SCORES + f""", counts(model, feature_count) AS (VALUES {', '.join(map(str, FEATURE_COUNTS))}),
  deltas AS (SELECT s.*, s.final_score - b.final_score AS delta FROM scores s JOIN scores b ON b.model = 'a' AND b.fold = s.fold),
  sets AS (SELECT model AS feature_set, min(delta) AS worst_delta, avg(final_score) AS mean_score, min(final_score) AS worst_score,
    max(feature_count) AS feature_count, model = 'a' OR round(min(delta), 9) + 0.0 >= 0 AS eligible FROM deltas JOIN counts USING (model) GROUP BY model),
  winner AS (SELECT feature_set AS w FROM sets WHERE eligible ORDER BY round(mean_score, 9) DESC, round(worst_score, 9) DESC, feature_count LIMIT 1)
  SELECT feature_set, feature_count, eligible, feature_set = w AS selected, {S.rounded('worst_delta', 'mean_score', 'worst_score')} FROM sets CROSS JOIN winner""")
def u10(spark, d):
    counts = spark.createDataFrame(list(FEATURE_COUNTS), "feature_set string, feature_count int")
    scores = all_scores(spark, d).withColumnRenamed("model", "feature_set")
    return shown(L.select_feature_set(scores, "a", counts), "feature_set", "feature_count", "eligible", "selected", "worst_delta", "mean_score", "worst_score")


GAP_SQL = P.RUNS + P.scored_sql("runs", RUN) + """,
  lab_pool AS (SELECT model, fold, trade_date, ts_code, row_number() OVER (PARTITION BY model, fold, trade_date ORDER BY pred DESC NULLS LAST, ts_code) AS place,
    count(*) OVER (PARTITION BY model, fold, trade_date) AS n FROM runs WHERE flag_limit_up = 0 AND y_ret_1d IS NOT NULL),
  lab_tops AS (SELECT * FROM lab_pool WHERE n >= 10 AND place <= greatest(n // 10, 1))""" + P.turnover_sql("lab_tops", "runs", RUN, "lab_") + """,
  gaps AS (SELECT model, fold, a.mean_turnover, b.diagnostic_turnover, b.diagnostic_turnover - a.mean_turnover AS turnover_gap, missing_top_fraction, top_rows
    FROM (SELECT model, fold, avg(turnover) AS mean_turnover FROM turn_days GROUP BY ALL) a
    JOIN (SELECT model, fold, avg(turnover) AS diagnostic_turnover FROM lab_turn_days GROUP BY ALL) b USING (model, fold)
    JOIN (SELECT model, fold, count(*) AS top_rows, avg(CASE WHEN y_ret_1d IS NULL THEN 1.0 ELSE 0.0 END) AS missing_top_fraction FROM tops GROUP BY ALL) m USING (model, fold))"""


@query("u11_turnover_gap", GAP_SQL + f" SELECT model, fold, top_rows, {S.rounded('mean_turnover', 'diagnostic_turnover', 'turnover_gap', 'missing_top_fraction')} FROM gaps")
def u11(spark, d):
    return shown(E.diagnostics(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d)))


@query("u12_replay_parity", P.RUNS + P.scored_sql("runs", RUN) + P.summary_sql(RUN) + P.scored_sql("runs", RUN, False, 2, prefix="q") + P.summary_sql(RUN, False, "q")
       + """, diffs AS (SELECT model, fold, greatest(abs(a.ic_mean - b.ic_mean), abs(a.mean_turnover - b.mean_turnover)) AS largest_difference
  FROM scores a JOIN qscores b USING (model, fold)) SELECT model, fold, round(largest_difference, 6) + 0.0 AS largest_difference, largest_difference <= 0.01 AS within FROM diffs""")
def u12(spark, d):
    df, sizes = P.runs(spark, d), date_sizes(spark, d)
    from crosstide.operators.evaluate import PROVISIONAL
    left, right = E.score(df, OFFICIAL_HERE, RUN, sizes), E.score(df, PROVISIONAL, RUN, sizes)
    return shown(L.replay_parity(left, right, RUN, ["ic_mean", "mean_turnover"], 0.01))
