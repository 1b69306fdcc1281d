"""Exponential moving means along an entity's observed rows.

The mean follows y = (w*y_prev + a*x) / (w + a) with w = (1-a)**gap, where gap counts the rows
since the last present value; without gaps that is the usual recursion.  It is linear, so a
running sum solves it: with L the running sum of the log decays, y_t = sum(b_i*x_i*exp(L_t - L_i)).
The terms are scaled per epoch of ``SPAN_OF_EPOCH`` log units so that no exponent overflows; an
epoch needs only itself and the one before, since anything older has decayed by exp(-250).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.guards import ratio
from crosstide.schema import DATE, ENTITY

SPAN_OF_EPOCH = 250.0


def ewm_means(df, value, spans, entity=ENTITY, date=DATE, seed=None, position=None):
    """Add ``_ema_<span>`` for every span, and ``_seen``, the number of present values so far.

    ``seed`` optionally names, per span, a column whose value replaces the entity's first
    present value: the mean carried over from earlier rows.  ``position`` names a column with the
    row's number among all rows of its entity, where some of them are not in ``df``.
    """
    rows = Window.partitionBy(entity).orderBy(date)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(value)
    df = df.withColumns({"_row": F.row_number().over(rows) if position is None else F.col(position), "_seen": F.count(x).over(upto)})
    df = df.withColumn("_gap", F.col("_row") - F.last(F.when(x.isNotNull(), F.col("_row")), ignorenulls=True).over(before))
    logs, starts = {}, F.col("_gap").isNull()
    for span in spans:
        alpha = 2.0 / (span + 1.0)
        left = F.pow(F.lit(1.0 - alpha), F.col("_gap"))
        gain = F.when(starts, 1.0).otherwise(alpha / (left + alpha))
        term = x if seed is None else F.when(starts, F.coalesce(F.col(seed[span]), x)).otherwise(x)
        logs[f"_log_{span}"] = F.sum(F.when(x.isNotNull() & ~starts, F.ln(left / (left + alpha))).otherwise(0.0)).over(upto)
        logs[f"_term_{span}"] = F.when(x.isNotNull(), gain * term)
    df = df.withColumns(logs)
    scaled = {}
    for span in spans:
        epoch = F.floor(-F.col(f"_log_{span}") / SPAN_OF_EPOCH)
        scaled[f"_epoch_{span}"] = epoch
        scaled[f"_scale_{span}"] = F.col(f"_log_{span}") + epoch * SPAN_OF_EPOCH
    df = df.withColumns(scaled)
    df = df.withColumns({f"_term_{s}": F.col(f"_term_{s}") * F.exp(-F.col(f"_scale_{s}")) for s in spans})
    for span in spans:
        inside = (Window.partitionBy(entity, f"_epoch_{span}").orderBy(date)
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        earlier = Window.partitionBy(entity).orderBy(f"_epoch_{span}").rangeBetween(-1, -1)
        term = f"_term_{span}"
        total = F.coalesce(F.sum(term).over(inside), F.lit(0.0)) + (
            F.coalesce(F.sum(term).over(earlier), F.lit(0.0)) * F.exp(F.lit(-SPAN_OF_EPOCH)))
        df = df.withColumn(f"_ema_{span}", F.when(F.col("_seen") > 0, F.exp(F.col(f"_scale_{span}")) * total))
    spent = ["_row", "_gap"] + [f"_{k}_{s}" for k in ("log", "term", "epoch", "scale") for s in spans]
    return df.drop(*spent)


def ema_deviation(df, spans, value="close", seed=None, seen_before=None, position=None):
    """``emadev_<span>``: value over its moving mean, minus 1, once ``span`` values were seen."""
    means = ewm_means(df, value, spans, seed=seed, position=position)
    seen = F.col("_seen") if seen_before is None else F.col("_seen") + F.col(seen_before)
    return means.withColumns({
        f"emadev_{s}": F.when(seen >= s, ratio(value, f"_ema_{s}") - 1) for s in spans})
