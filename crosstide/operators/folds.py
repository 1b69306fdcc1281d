"""Expanding time folds as rows: a fold is a column, so one job serves every fold."""

from dataclasses import astuple, dataclass

from pyspark.sql import functions as F

from crosstide.functions.guards import count_true
from crosstide.schema import DATE, LABEL


def date_number(text):
    """ISO date to yyyymmdd."""
    return int(str(text).replace("-", ""))


@dataclass(frozen=True)
class Fold:
    fold: str
    train_start: int
    train_end: int
    valid_start: int
    valid_end: int

    @staticmethod
    def of(name, *dates):
        return Fold(name, *[date_number(d) for d in dates])


FOLD_COLUMNS = "fold string, train_start int, train_end int, valid_start int, valid_end int"


def fold_table(spark, folds):
    """A table with one row per declared fold; a plan constant, so it can always be broadcast."""
    return F.broadcast(spark.createDataFrame([astuple(f) for f in folds], FOLD_COLUMNS))


def _in_train():
    return F.col(DATE).between(F.col("train_start"), F.col("train_end"))


def _in_valid():
    return F.col(DATE).between(F.col("valid_start"), F.col("valid_end"))


def candidate_rows(df, folds):
    """Row x fold x ``role`` (train, valid), before purging; overlapping periods give both."""
    joined = df.join(fold_table(df.sparkSession, folds), _in_train() | _in_valid())
    roles = F.array(F.when(_in_train(), "train"), F.when(_in_valid(), "valid"))
    return joined.withColumn("role", F.explode(F.array_compact(roles)))


def purge_dates(df, folds):
    """Last observed training date per fold, among all candidates whatever their labels."""
    dates = df.select(DATE).distinct().join(fold_table(df.sparkSession, folds), _in_train())
    return dates.groupBy("fold").agg(F.max(DATE).alias("purge_date"))


def with_purge(df, folds, dated=None):
    """``dated`` may be any cheaper table with the same dates."""
    rows = candidate_rows(df, folds).join(F.broadcast(purge_dates(df if dated is None else dated, folds)), "fold")
    purged = (F.col("role") == "train") & (F.col(DATE) >= F.col("purge_date"))
    return rows.withColumn("purged", purged)


def fold_rows(df, folds, label=LABEL, recent=None, dated=None):
    """Supervised training rows and validation rows of every fold.

    ``recent`` optionally narrows training to a second set of windows (name -> start, end).
    """
    rows = with_purge(df, folds, dated).filter(~F.col("purged"))
    rows = rows.filter((F.col("role") == "valid") | F.col(label).isNotNull())
    if recent is not None:
        windows = df.sparkSession.createDataFrame(
            [(f, *w) for f, w in recent.items()], "fold string, recent_start int, recent_end int")
        rows = rows.join(F.broadcast(windows), "fold")
        rows = rows.filter((F.col("role") == "valid") | F.col(DATE).between(F.col("recent_start"), F.col("recent_end")))
        rows = rows.drop("recent_start", "recent_end")
    return rows.drop("train_start", "train_end", "valid_start", "valid_end", "purge_date", "purged")


def fold_summary(df, folds, label=LABEL):
    """Row, date and bound counts of each fold, from one pre-aggregated row per date."""
    days = df.groupBy(DATE).agg(F.count(F.lit(1)).alias("_rows"), F.count(label).alias("_labelled"))
    train, valid = F.col("role") == "train", F.col("role") == "valid"
    kept = train & ~F.col("purged")
    used = kept & (F.col("_labelled") > 0)
    total = lambda test, what: F.coalesce(F.sum(F.when(test, F.col(what))), F.lit(0))
    dates = lambda test: count_true(test)
    return with_purge(days, folds).groupBy("fold").agg(
        total(train, "_rows").alias("candidate_rows"),
        dates(train).alias("candidate_dates"),
        F.min(F.when(train, F.col(DATE))).alias("candidate_start"),
        F.max(F.when(train, F.col(DATE))).alias("candidate_end"),
        F.max("purge_date").alias("purge_date"),
        total(F.col("purged"), "_rows").alias("purge_rows"),
        total(F.col("purged"), "_labelled").alias("purge_labelled_rows"),
        total(kept, "_rows").alias("rows_after_purge"),
        (total(kept, "_rows") - total(kept, "_labelled")).alias("unlabelled_train_rows"),
        total(kept, "_labelled").alias("train_rows"),
        F.min(F.when(used, F.col(DATE))).alias("train_start"),
        F.max(F.when(used, F.col(DATE))).alias("train_end"),
        total(valid, "_rows").alias("valid_rows"),
        total(valid, "_labelled").alias("valid_labelled_rows"),
        F.min(F.when(valid, F.col(DATE))).alias("valid_start"),
        F.max(F.when(valid, F.col(DATE))).alias("valid_end"),
        dates(valid).alias("valid_dates"),
    )


def check_folds(summary):
    """Fail for folds that are empty or whose training dates reach into validation."""
    bad = summary.filter((F.col("train_rows") == 0) | (F.col("valid_rows") == 0) | (F.col("candidate_dates") < 2)
                         | (F.col("candidate_end") >= F.col("valid_start")))
    names = [r["fold"] for r in bad.select("fold").take(20)]
    if names:
        raise ValueError(f"empty or overlapping folds: {names}")
    return summary
