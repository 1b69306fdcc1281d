"""Prediction tables that the evaluation queries share: two reversal models over three folds."""

from pyspark.sql import functions as F

from crosstide.functions.groups import small_side
from crosstide.operators.evaluate import OFFICIAL, PROVISIONAL
from crosstide.operators.folds import fold_table
from crosstide.operators.history import history_features
from crosstide.plans import sqltext as S
from crosstide.plans.labels import FOLDS
from crosstide.schema import DATE, KEYS, LABEL
from crosstide.sources.panel import bars

RUN = ["model", "fold"]
# Each model predicts a reversal of one feature, and 0 where that is undefined.
MODELS = {"a": "ret_1", "b": "ret_5", "c": "madev_5", "d": "volratio_5"}
# The smallest panel holds about 20 tradable rows a date, below the usual thresholds of 30 and 100.
OFFICIAL_HERE = OFFICIAL.adjusted(5, 10)
PROVISIONAL_HERE = PROVISIONAL


def predictions(spark, d, keep=()):
    """Every model's prediction as a column: pred_a to pred_d."""
    panel = bars(spark, d, labelled=True)
    df = history_features(panel, list(MODELS.values()), keep=[*KEYS, LABEL, "flag_limit_up", *keep], placed=True)
    guess = lambda c: F.coalesce(-F.col(c), F.lit(0.0))
    return df.withColumns({f"pred_{m}": guess(c) for m, c in MODELS.items()})


def identity(spark, d):
    """The identity model: last return as prediction, missing where it is undefined."""
    return predictions(spark, d).withColumn("pred", F.col("ret_1"))


def in_folds(df):
    valid = F.col(DATE).between(F.col("valid_start"), F.col("valid_end"))
    return df.join(fold_table(df.sparkSession, FOLDS), valid).drop("train_start", "train_end", "valid_start", "valid_end")


def both_models(spark, d, models="ab"):
    """One row per entity, date and fold, with the models' predictions as columns."""
    wide = in_folds(predictions(spark, d))
    return wide.select("fold", *KEYS, LABEL, "flag_limit_up", *[f"pred_{m}" for m in models])


def runs(spark, d, models="ab"):
    """Long form: one row per model, fold, entity and date."""
    wide = both_models(spark, d, models)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in models]))
    return wide.select("fold", *KEYS, LABEL, "flag_limit_up", cells.alias("_c")).select(
        "_c.model", "fold", *KEYS, "_c.pred", LABEL, "flag_limit_up")


def dated(df, table, sizes, on=(DATE,)):
    return df.join(small_side(table, sizes), list(on))


PREDS = S.history(list(MODELS.values()), keep=("ts_code", "trade_date", "y_ret_1d", "flag_limit_up")) + """,
preds AS (SELECT *, coalesce(-ret_1, 0) AS pred_a, coalesce(-ret_5, 0) AS pred_b, coalesce(-madev_5, 0) AS pred_c,
  coalesce(-volratio_5, 0) AS pred_d, ret_1 AS pred FROM features)"""
WIDE = PREDS + ", " + S.FOLD_VALUES + """,
wide AS (SELECT f.fold, p.ts_code, p.trade_date, p.y_ret_1d, p.flag_limit_up, p.pred_a, p.pred_b, p.pred_c, p.pred_d
  FROM preds p JOIN folds f ON p.trade_date BETWEEN f.valid_start AND f.valid_end)"""


def runs_sql(models="ab"):
    return WIDE + ", runs AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS model, fold, ts_code, trade_date, y_ret_1d, flag_limit_up, pred_{m} AS pred FROM wide" for m in models) + ")"


RUNS = runs_sql()


def scored_sql(source, run=(), official=True, min_ic=5, min_pool=10, prefix=""):
    """CTEs ic_days, pool, ret_days, tops, turn_days for a prediction table."""
    by = ", ".join([*run, "trade_date"])
    r = "".join(f"{c}, " for c in run)
    part = f"PARTITION BY {', '.join(run)}" if run else ""
    known = "" if official else " AND pred IS NOT NULL"
    avg_rank = lambda x: (f"rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + "
                          f"(count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0")
    top = "greatest(n // 10, 1)" if official else "CAST(ceil(n / 10.0) AS BIGINT)"
    having = f" HAVING count(*) >= {min_ic}" if official else ""
    p = prefix
    return f""",
{p}ic_rows AS (SELECT {by}, pred, {avg_rank('pred')} AS rp, {avg_rank('y_ret_1d')} AS ry FROM {source}
  WHERE y_ret_1d IS NOT NULL{known}),
{p}ic_days AS (SELECT {by}, count(*) AS ic_rows, CASE WHEN count(*) >= {min_ic} AND count(pred) = count(*)
  AND max(rp) <> min(rp) AND max(ry) <> min(ry)
  THEN (count(*) * sum(rp * ry) - sum(rp) * sum(ry)) / sqrt(count(*) * sum(rp * rp) - sum(rp) * sum(rp))
    / sqrt(count(*) * sum(ry * ry) - sum(ry) * sum(ry)) END AS rank_ic FROM {p}ic_rows GROUP BY {by}{having}),
{p}ret_pool AS (SELECT {by}, ts_code, pred, y_ret_1d, row_number() OVER (PARTITION BY {by} ORDER BY pred DESC NULLS LAST, ts_code) AS place,
  count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE flag_limit_up = 0 AND y_ret_1d IS NOT NULL{known}),
{p}ret_days AS (SELECT {by}, count(*) AS return_rows, max({top}) AS return_top_rows,
  avg(y_ret_1d) FILTER (place <= {top}) AS top_return, avg(y_ret_1d) FILTER (place > n - greatest(n // 10, 1)) AS bottom_return,
  avg(y_ret_1d) AS market_return FROM {p}ret_pool WHERE n >= {min_pool} GROUP BY {by}),
{p}turn_pool AS (SELECT {by}, ts_code, pred, y_ret_1d, row_number() OVER (PARTITION BY {by} ORDER BY pred DESC NULLS LAST, ts_code) AS place,
  count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE flag_limit_up = 0{known}),
{p}tops AS (SELECT * FROM {p}turn_pool WHERE n >= {min_pool} AND place <= {top})""" + turnover_sql(
        f"{p}tops", source, run, p)


def turnover_sql(tops, source, run=(), p=""):
    by = ", ".join([*run, "trade_date"])
    part = f"PARTITION BY {', '.join(run)}" if run else ""
    same = "".join(f" AND a.{c} = b.{c}" for c in run)
    samec = "".join(f" AND a.{c} = c.{c}" for c in run)
    return f""",
{p}cal AS (SELECT *, row_number() OVER ({part} ORDER BY trade_date) AS day FROM (SELECT DISTINCT {by} FROM {source})),
{p}members AS (SELECT t.*, c.day FROM {tops} t JOIN {p}cal c USING ({by})),
{p}set_sizes AS (SELECT {by}, day, count(*) AS k FROM {p}members GROUP BY ALL),
{p}kept AS (SELECT {', '.join('a.' + c for c in [*run, 'trade_date'])}, count(*) AS both_days FROM {p}members a
  JOIN {p}members b ON a.ts_code = b.ts_code AND a.day = b.day + 1{same} GROUP BY ALL),
{p}turn_days AS (SELECT {', '.join('a.' + c for c in [*run, 'trade_date'])}, a.k AS turnover_top_rows,
  1 - coalesce(x.both_days, 0) / CAST(a.k + c.k - coalesce(x.both_days, 0) AS DOUBLE) AS turnover
  FROM {p}set_sizes a LEFT JOIN {p}set_sizes c ON a.day = c.day + 1{samec}
  LEFT JOIN {p}kept x ON x.trade_date = a.trade_date{''.join(f' AND x.{c} = a.{c}' for c in run)})"""


def summary_sql(run=(), official=True, p="", name="scores"):
    """CTE with one score row per run."""
    keys = "".join(f"{c}, " for c in run)
    group = f"GROUP BY {', '.join(run)}" if run else ""
    if official:
        strict = lambda x: f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"
        std = "CASE WHEN count(rank_ic) = count(*) THEN stddev_samp(rank_ic) END"
        pos = "avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END)"
        icir = "CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END"
    else:
        strict = lambda x: f"avg({x})"
        std, pos = "stddev_pop(rank_ic)", "avg(CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END)"
        icir = "CASE WHEN ic_std > 0 THEN ic_mean / ic_std END"
    join = (lambda t: f"LEFT JOIN {t} USING ({', '.join(run)})") if run else (lambda t: f"CROSS JOIN {t}")
    first = f"(SELECT DISTINCT {', '.join(run)} FROM {p}cal) {join(p + 'ic_sum')}" if run else f"{p}ic_sum"
    return f""",
{p}ic_sum AS (SELECT {keys}{strict('rank_ic')} AS ic_mean, {std} AS ic_std, {pos} AS ic_positive_ratio FROM {p}ic_days {group}),
{p}ret_sum AS (SELECT {keys}{strict('(top_return - market_return)')} * 252 AS annual_excess, {strict('top_return')} * 252 AS top1_annual_ret,
  {strict('(top_return - bottom_return)')} * 252 AS annual_spread FROM {p}ret_days {group}),
{p}turn_sum AS (SELECT {keys}avg(turnover) AS mean_turnover FROM {p}turn_days {group}),
{p}{name} AS (SELECT *, {icir} AS icir, 0.4 * ic_mean + 0.3 * annual_excess + 0.3 * (1 - mean_turnover) AS final_score
  FROM {first} {join(p + 'ret_sum')} {join(p + 'turn_sum')})"""


METRICS = ("ic_mean", "ic_std", "icir", "ic_positive_ratio", "annual_excess", "top1_annual_ret", "mean_turnover", "final_score")
