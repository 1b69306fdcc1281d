"""Targets and folds."""

from pyspark.sql import functions as F

from crosstide.operators import folds, targets
from crosstide.operators.folds import Fold
from crosstide.plans import sqltext as S
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.schema import DATE, KEYS, LABEL
from crosstide.sources.panel import bars

FOLDS = (
    Fold.of("F1", "1995-01-02", "1998-12-31", "1999-01-01", "1999-12-31"),
    Fold.of("F2", "1995-01-02", "1999-12-31", "2000-01-01", "2000-12-31"),
    Fold.of("F3", "1995-01-02", "2000-12-31", "2001-01-01", "2001-12-31"),
)
RECENT = {"F1": (19970101, 19981231), "F2": (19980101, 19991231), "F3": (19990101, 20001231)}
ROWS = "ts_code, trade_date"


def labelled(spark, d):
    return bars(spark, d, labelled=True)


def ranked_labels(spark, d):
    return targets.with_label_rank(labelled(spark, d), date_sizes(spark, d))


@query("t01_forward_return", S.panel() + f" SELECT {ROWS}, {S.rounded('y_ret_1d')} FROM bars WHERE y_ret_1d IS NOT NULL")
def t01(spark, d):
    return shown(labelled(spark, d).filter(F.col(LABEL).isNotNull()), *KEYS, LABEL)


def _rank_query(name, expr, sql):
    text = S.labelled_ranks() + f" SELECT {ROWS}, {sql} AS target FROM ranked"
    query(name, text)(lambda spark, d: shown(ranked_labels(spark, d).select(*KEYS, expr("label_rank").alias("target"))))


_rank_query("t02_rank_target", targets.rank_target, "round(u - 0.5, 6) + 0.0")
_rank_query("t04_rank_decile", targets.decile, "CAST(least(floor(u * 10), 9) AS INTEGER)")
_rank_query("t05_relevance", targets.relevance, "CAST(greatest(least(ceil(u * 10) - 1, 9), 0) AS INTEGER)")
_rank_query("t06_stretched_rank", targets.stretched_rank,
            "round(CASE WHEN u <= 0.9 THEN u ELSE 0.9 + 10.0 * (u - 0.9) END - 0.5, 6) + 0.0")
_rank_query("t07_top_decile", targets.top_decile, "CAST(u > 0.9 AS INTEGER)")


@query("t03_relative_target", S.panel() + f", days AS (SELECT {ROWS}, y_ret_1d - median(y_ret_1d) OVER (PARTITION BY trade_date) AS target "
       f"FROM bars WHERE y_ret_1d IS NOT NULL) SELECT {ROWS}, {S.rounded('target')} FROM days")
def t03(spark, d):
    return shown(targets.relative_target(labelled(spark, d), date_sizes(spark, d)), *KEYS, "target")


@query("t08_group_sizes", S.panel() + f", {S.FOLD_STEPS} SELECT fold, trade_date, count(*) AS group_rows FROM used "
       "WHERE role = 'train' GROUP BY fold, trade_date")
def t08(spark, d):
    train = folds.fold_rows(labelled(spark, d), FOLDS).filter(F.col("role") == "train")
    return targets.group_sizes(train, ["fold"])


@query("t09_residual_rank", S.history(["ret_1"], keep=("ts_code", "trade_date", "y_ret_1d"))
       + f", both_known AS (SELECT {ROWS}, y_ret_1d, -ret_1 AS pred FROM features WHERE y_ret_1d IS NOT NULL AND ret_1 IS NOT NULL), "
       f"ranks AS (SELECT {ROWS}, {S.pct('y_ret_1d')} AS label_rank, {S.pct('pred')} AS pred_rank FROM both_known) "
       f"SELECT {ROWS}, {S.rounded('label_rank', 'pred_rank')}, round(label_rank - pred_rank, 6) + 0.0 AS residual FROM ranks")
def t09(spark, d):
    from crosstide.operators.history import history_features
    df = history_features(labelled(spark, d), ["ret_1"], keep=[*KEYS, LABEL]).withColumn("pred", -F.col("ret_1"))
    return shown(targets.residual_rank(df, date_sizes(spark, d)), *KEYS, "label_rank", "pred_rank", "residual")


@query("t10_target_distribution", S.panel() + """ SELECT count(y_ret_1d) AS present, round(avg(y_ret_1d), 6) + 0.0 AS mean,
  round(stddev_pop(y_ret_1d), 6) + 0.0 AS std, """ + ", ".join(
    f"round(quantile_cont(y_ret_1d, {p}), 6) + 0.0 AS {n}" for p, n in
    [(0, "min"), (.01, "p01"), (.25, "p25"), (.5, "p50"), (.75, "p75"), (.99, "p99"), (1, "max")]) + " FROM bars")
def t10(spark, d):
    return shown(targets.distribution(labelled(spark, d), LABEL))


@query("f01_fold_assignment", S.panel() + f", {S.FOLD_STEPS} SELECT fold, role, {ROWS} FROM candidates")
def f01(spark, d):
    return folds.candidate_rows(bars(spark, d), FOLDS).select("fold", "role", *KEYS)


@query("f02_purge", S.panel() + f", {S.FOLD_STEPS} SELECT fold, role, {ROWS}, purge_date, {S.rounded('y_ret_1d')} FROM used JOIN purge USING (fold, purge_date)")
def f02(spark, d):
    df = labelled(spark, d)
    rows = folds.with_purge(df, FOLDS).filter(~F.col("purged"))
    rows = rows.filter((F.col("role") == "valid") | F.col(LABEL).isNotNull())
    return shown(rows, "fold", "role", *KEYS, "purge_date", LABEL)


@query("f03_recent_window", S.panel() + f""", {S.FOLD_STEPS},
recent(fold, recent_start, recent_end) AS (VALUES ('F1', 19970101, 19981231), ('F2', 19980101, 19991231), ('F3', 19990101, 20001231))
SELECT fold, role, {ROWS}, {S.rounded('y_ret_1d')} FROM used JOIN recent USING (fold)
WHERE role = 'valid' OR trade_date BETWEEN recent_start AND recent_end""")
def f03(spark, d):
    return shown(folds.fold_rows(labelled(spark, d), FOLDS, recent=RECENT), "fold", "role", *KEYS, LABEL)


@query("f04_fold_summary", S.panel() + f""", {S.FOLD_STEPS} SELECT fold,
  count(*) FILTER (role = 'train') AS candidate_rows,
  count(DISTINCT trade_date) FILTER (role = 'train') AS candidate_dates,
  min(trade_date) FILTER (role = 'train') AS candidate_start, max(trade_date) FILTER (role = 'train') AS candidate_end,
  max(purge_date) AS purge_date, count(*) FILTER (purged) AS purge_rows,
  count(*) FILTER (purged AND y_ret_1d IS NOT NULL) AS purge_labelled_rows,
  count(*) FILTER (role = 'train' AND NOT purged) AS rows_after_purge,
  count(*) FILTER (role = 'train' AND NOT purged AND y_ret_1d IS NULL) AS unlabelled_train_rows,
  count(*) FILTER (role = 'train' AND NOT purged AND y_ret_1d IS NOT NULL) AS train_rows,
  min(trade_date) FILTER (role = 'train' AND NOT purged AND y_ret_1d IS NOT NULL) AS train_start,
  max(trade_date) FILTER (role = 'train' AND NOT purged AND y_ret_1d IS NOT NULL) AS train_end,
  count(*) FILTER (role = 'valid') AS valid_rows,
  count(*) FILTER (role = 'valid' AND y_ret_1d IS NOT NULL) AS valid_labelled_rows,
  min(trade_date) FILTER (role = 'valid') AS valid_start, max(trade_date) FILTER (role = 'valid') AS valid_end,
  count(DISTINCT trade_date) FILTER (role = 'valid') AS valid_dates
FROM purged GROUP BY fold""")
def f04(spark, d):
    return folds.fold_summary(labelled(spark, d), FOLDS)


@query("f05_fold_guard", S.panel() + f""", {S.FOLD_STEPS} SELECT fold, count(*) FILTER (role = 'train' AND NOT purged AND y_ret_1d IS NOT NULL) AS train_rows,
  count(*) FILTER (role = 'valid') AS valid_rows FROM purged GROUP BY fold""")
def f05(spark, d):
    return folds.check_folds(folds.fold_summary(labelled(spark, d), FOLDS)).select("fold", "train_rows", "valid_rows")
