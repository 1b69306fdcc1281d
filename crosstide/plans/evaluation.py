"""Evaluation queries for both policies."""

from pyspark.sql import functions as F

from crosstide.functions.groups import GroupSizes
from crosstide.operators import evaluate as E
from crosstide.plans import runs as P
from crosstide.plans import sqltext as S
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.plans.runs import METRICS, OFFICIAL_HERE, PROVISIONAL_HERE, RUN
from crosstide.schema import DATE, ENTITY, KEYS, LABEL

OFF = P.PREDS + P.scored_sql("preds")
PROV = P.PREDS + P.scored_sql("preds", official=False, min_ic=2)
LISTED = "model, fold, "


@query("e01_daily_ic_official", OFF + f" SELECT trade_date, ic_rows, {S.rounded('rank_ic')} FROM ic_days")
def e01(spark, d):
    return shown(E.daily_ic(P.identity(spark, d), OFFICIAL_HERE, sizes=date_sizes(spark, d)))


@query("e02_daily_ic_provisional", PROV + f" SELECT trade_date, ic_rows, {S.rounded('rank_ic')} FROM ic_days")
def e02(spark, d):
    return shown(E.daily_ic(P.identity(spark, d), PROVISIONAL_HERE, sizes=date_sizes(spark, d)))


_IC = ("ic_mean", "ic_std", "icir", "ic_positive_ratio")


@query("e03_ic_summary", P.RUNS + P.scored_sql("runs", RUN) + P.summary_sql(RUN) + P.scored_sql("runs", RUN, False, 2, prefix="q")
       + P.summary_sql(RUN, False, "q") + f" SELECT 'official' AS policy, {LISTED}{S.rounded(*_IC)} FROM scores UNION ALL "
       f"SELECT 'provisional', {LISTED}{S.rounded(*_IC)} FROM qscores")
def e03(spark, d):
    df, sizes = P.runs(spark, d), date_sizes(spark, d)
    parts = [E.ic_summary(E.daily_ic(df, policy, RUN, sizes), policy, RUN).withColumn("policy", F.lit(name))
             for name, policy in (("official", OFFICIAL_HERE), ("provisional", PROVISIONAL_HERE))]
    return shown(parts[0].unionByName(parts[1]), "policy", *RUN, *_IC)


@query("e04_top_excess", OFF + f""", days AS (SELECT *, top_return - market_return AS top_excess FROM ret_days)
  SELECT trade_date, return_rows, return_top_rows, {S.rounded('top_return', 'market_return', 'top_excess')} FROM days""")
def e04(spark, d):
    days = E.daily_returns(P.identity(spark, d), OFFICIAL_HERE, sizes=date_sizes(spark, d))
    return shown(days, DATE, "return_rows", "return_top_rows", "top_return", "market_return", "top_excess")


@query("e05_ten_groups", PROV.replace("WITH ", "WITH ", 1) + f""", cut AS (SELECT trade_date, y_ret_1d, ntile(10) OVER (PARTITION BY trade_date
    ORDER BY pred DESC, ts_code) AS g, n FROM ret_pool WHERE n >= 10),
  days AS (SELECT trade_date, avg(y_ret_1d) FILTER (g = 1) AS top_return, avg(y_ret_1d) FILTER (g = 10) AS bottom_return,
    avg(y_ret_1d) FILTER (g = 1) - avg(y_ret_1d) FILTER (g = 10) AS spread FROM cut GROUP BY trade_date)
  SELECT trade_date, {S.rounded('top_return', 'bottom_return', 'spread')} FROM days""")
def e05(spark, d):
    days = E.daily_returns(P.identity(spark, d), PROVISIONAL_HERE, sizes=date_sizes(spark, d))
    return shown(days, DATE, "top_return", "bottom_return", "spread")


@query("e06_turnover_official", OFF + f" SELECT trade_date, turnover_top_rows, {S.rounded('turnover')} FROM turn_days")
def e06(spark, d):
    return shown(E.daily_turnover(P.identity(spark, d), OFFICIAL_HERE, sizes=date_sizes(spark, d)))


@query("e07_turnover_provisional", PROV + f" SELECT trade_date, turnover_top_rows, {S.rounded('turnover')} FROM turn_days")
def e07(spark, d):
    return shown(E.daily_turnover(P.identity(spark, d), PROVISIONAL_HERE, sizes=date_sizes(spark, d)))


@query("e08_final_score", P.PREDS
       + ", ready AS (SELECT * REPLACE (coalesce(pred, 0) AS pred) FROM preds)"
       + P.scored_sql("ready") + P.summary_sql() + f" SELECT {S.rounded(*METRICS)} FROM scores")
def e08(spark, d):
    df = P.identity(spark, d).withColumn("pred", F.coalesce("ret_1", F.lit(0.0)))
    return shown(E.score(df, OFFICIAL_HERE, sizes=date_sizes(spark, d)), *METRICS)


_COUNTS = ("rows", "predictions", "missing_predictions", "labels", "return_eligible_rows", "turnover_eligible_rows")
DAILY_SQL = PROV + f""", counts AS (SELECT trade_date, count(*) AS rows, count(pred) AS predictions,
    count(*) - count(pred) AS missing_predictions, count(y_ret_1d) AS labels,
    count(*) FILTER (pred IS NOT NULL AND y_ret_1d IS NOT NULL AND flag_limit_up = 0) AS return_eligible_rows,
    count(*) FILTER (pred IS NOT NULL AND flag_limit_up = 0) AS turnover_eligible_rows FROM preds GROUP BY trade_date),
  daily AS (SELECT c.*, coalesce(i.ic_rows, 0) AS ic_rows, rank_ic, coalesce(return_top_rows, 0) AS return_top_rows,
    top_return, bottom_return, top_return - market_return AS top_excess, top_return - bottom_return AS spread,
    coalesce(turnover_top_rows, 0) AS turnover_top_rows, turnover
    FROM counts c LEFT JOIN ic_days i USING (trade_date) LEFT JOIN ret_days USING (trade_date) LEFT JOIN turn_days USING (trade_date))"""
_DAILY = ("rank_ic", "top_return", "bottom_return", "top_excess", "spread", "turnover")


@query("e09_daily_metrics", DAILY_SQL + f" SELECT trade_date, {', '.join(_COUNTS)}, ic_rows, return_top_rows, turnover_top_rows, "
       f"{S.rounded(*_DAILY)} FROM daily")
def e09(spark, d):
    return shown(E.daily_metrics(P.identity(spark, d), PROVISIONAL_HERE, sizes=date_sizes(spark, d)))


@query("e10_coverage", DAILY_SQL + """ SELECT count(*) AS dates, count(rank_ic) AS ic_dates, count(top_excess) AS return_dates,
  count(turnover) AS turnover_pairs, CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(missing_predictions) AS BIGINT) AS missing_predictions FROM daily""")
def e10(spark, d):
    daily = E.daily_metrics(P.identity(spark, d), PROVISIONAL_HERE, sizes=date_sizes(spark, d))
    return daily.agg(F.count(F.lit(1)).alias("dates"), F.count("rank_ic").alias("ic_dates"),
                     F.count("top_excess").alias("return_dates"), F.count("turnover").alias("turnover_pairs"),
                     F.sum("rows").alias("total_rows"), F.sum("missing_predictions").alias("missing_predictions"))


LABELLED_TURN = P.PREDS + ", labelled_preds AS (SELECT * FROM preds WHERE y_ret_1d IS NOT NULL)" + """,
  turn_pool AS (SELECT trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY pred DESC NULLS LAST, ts_code) AS place,
    count(*) OVER (PARTITION BY trade_date) AS n FROM labelled_preds WHERE flag_limit_up = 0),
  tops AS (SELECT * FROM turn_pool WHERE n >= 10 AND place <= greatest(n // 10, 1))""" + P.turnover_sql("tops", "preds")


@query("e11_diagnostic_turnover", LABELLED_TURN + f" SELECT trade_date, turnover_top_rows, {S.rounded('turnover')} FROM turn_days")
def e11(spark, d):
    return shown(E.daily_turnover(P.identity(spark, d), OFFICIAL_HERE, sizes=date_sizes(spark, d), labelled=True))


RUN_SETS = P.RUNS + P.scored_sql("runs", RUN)


@query("e12_missing_top_share", RUN_SETS + """ SELECT model, fold, count(*) AS top_rows,
  round(avg(CASE WHEN y_ret_1d IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing_top_fraction FROM tops GROUP BY model, fold""")
def e12(spark, d):
    tops = E.top_rows(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d))
    return shown(tops.groupBy(*RUN).agg(F.count(F.lit(1)).alias("top_rows"),
                                        F.avg(F.col(LABEL).isNull().cast("double")).alias("missing_top_fraction")))


@query("e13_top_sets", RUN_SETS + f" SELECT model, fold, trade_date, ts_code, place, n AS pool, {S.rounded('pred')} FROM tops")
def e13(spark, d):
    tops = E.top_rows(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d))
    return shown(tops, *RUN, DATE, ENTITY, "place", "pool", "pred")


TIES_SQL = RUN_SETS + """, pooled AS (SELECT *, place <= greatest(n // 10, 1) AS inside FROM turn_pool WHERE n >= 10),
  cutoffs AS (SELECT model, fold, trade_date, min(pred) AS cut FROM pooled WHERE inside GROUP BY ALL),
  largest AS (SELECT model, fold, trade_date, max(c) AS largest_tie FROM
    (SELECT model, fold, trade_date, pred, count(*) AS c FROM pooled GROUP BY ALL) GROUP BY ALL),
  ties AS (SELECT model, fold, trade_date, max(n) AS eligible_rows, count(*) FILTER (inside) AS top_rows,
    count(*) FILTER (y_ret_1d IS NULL) AS missing_eligible, count(*) FILTER (inside AND y_ret_1d IS NULL) AS missing_top,
    count(*) FILTER (pred = cut) AS cutoff_tie, count(*) FILTER (inside AND pred = cut) AS cutoff_inside
    FROM pooled JOIN cutoffs USING (model, fold, trade_date) GROUP BY model, fold, trade_date)"""


@query("a17_tie_groups", TIES_SQL + """ SELECT model, fold, trade_date, eligible_rows, top_rows, missing_eligible, missing_top, largest_tie,
  cutoff_tie, cutoff_inside, cutoff_inside < cutoff_tie AS boundary_splits_tie FROM ties JOIN largest USING (model, fold, trade_date)""")
def a17(spark, d):
    return E.tie_diagnostics(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d))


@query("e14_floor_spread", OFF + f""", days AS (SELECT trade_date, top_return, bottom_return, top_return - bottom_return AS spread FROM ret_days)
  SELECT trade_date, {S.rounded('top_return', 'bottom_return', 'spread')} FROM days""")
def e14(spark, d):
    days = E.daily_returns(P.identity(spark, d), OFFICIAL_HERE, sizes=date_sizes(spark, d))
    return shown(days, DATE, "top_return", "bottom_return", "spread")


BOTH_SCORES = (P.RUNS + P.scored_sql("runs", RUN) + P.summary_sql(RUN) + P.scored_sql("runs", RUN, False, 2, prefix="q")
               + P.summary_sql(RUN, False, "q"))


@query("e15_policy_delta", BOTH_SCORES + f""", deltas AS (SELECT model, fold, {', '.join(f'a.{m} - b.{m} AS delta_{m}' for m in METRICS)}
  FROM scores a JOIN qscores b USING (model, fold)) SELECT {LISTED}{S.rounded(*[f'delta_{m}' for m in METRICS])} FROM deltas""")
def e15(spark, d):
    df, sizes = P.runs(spark, d), date_sizes(spark, d)
    a, b = E.score(df, OFFICIAL_HERE, RUN, sizes), E.score(df, PROVISIONAL_HERE, RUN, sizes)
    b = b.select(*RUN, *[F.col(m).alias(f"_{m}") for m in METRICS])
    joined = a.join(b, RUN).select(*RUN, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in METRICS])
    return shown(joined)


@query("e16_top_annual_return", RUN_SETS + P.summary_sql(RUN) + f" SELECT {LISTED}{S.rounded('top1_annual_ret', 'annual_spread')} FROM scores")
def e16(spark, d):
    returns = E.daily_returns(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d))
    return shown(E.return_summary(returns, OFFICIAL_HERE, RUN), *RUN, "top1_annual_ret", "annual_spread")


@query("e17_score_runs", RUN_SETS + P.summary_sql(RUN) + f" SELECT {LISTED}{S.rounded(*METRICS)} FROM scores")
def e17(spark, d):
    return shown(E.score(P.runs(spark, d), OFFICIAL_HERE, RUN, date_sizes(spark, d)), *RUN, *METRICS)
