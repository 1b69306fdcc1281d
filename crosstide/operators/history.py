"""Trailing features along an entity's observed rows.

All frames share one partitioning and order, so a build needs one exchange and one sort.  Columns
are made in a few selects: values of single rows and lags, running sums and counts, rolling
aggregates, and arithmetic on those.  Means, spreads, co-moments, extremes and price fits aggregate
inside their frame (at most 60 rows), so a large value leaves no trace once it has left the window.
Only counts are differences of running totals, which is exact; a window without any change is told
apart by counting changes.  A row with a missing value keeps its place: frames
count rows, never calendar days.  Views of many columns are made by ``history_kernel`` with the same rules.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.functions.guards import EPS, finite, max_of, min_of, positive, ratio
from crosstide.functions.groups import spread
from crosstide.operators.ema import ema_deviation
from crosstide.operators.history_kernel import array_features
from crosstide.schema import DATE, ENTITY, KEYS, SOURCES

ROWS_SINCE_CAP = 61
WIDE = 24
# Frames aggregate anew in every row; beyond so many rows in all of them, blocks of arrays are cheaper.
FRAME_ROWS = 60
AGGREGATES = {"sum": F.sum, "avg": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def rows_of_entity():
    return Window.partitionBy(ENTITY).orderBy(DATE)


def so_far():
    return rows_of_entity().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(w):
    return rows_of_entity().rowsBetween(-(w - 1), 0)


def lag(c, w=1):
    return F.lag(c, w).over(rows_of_entity())


def running(x):
    """Running sum of the finite values so far."""
    return F.coalesce(F.sum(finite(x)).over(so_far()), F.lit(0.0))


def last_rows(total, w):
    """Amount of a running total that falls in the last w rows."""
    return F.col(total) - F.coalesce(lag(total, w), F.lit(0))


def lag_return(w, value="close"):
    return ratio(value, lag(value, w)) - 1


def _squared_log(a, b):
    return F.pow(F.ln(positive(a) / positive(b)), 2)


def _log_change(source, w=1):
    return F.log1p(source) - lag(F.log1p(source), w)


def _pair(source):
    """Return and log change of a row, each only where both are present."""
    change = _log_change(source)
    both = lag_return(1).isNotNull() & change.isNotNull()
    return F.when(both, lag_return(1)), F.when(both, change)


def _base():
    """First-select columns by name, each made on demand from raw columns only."""
    found = {f"ret_{w}": lambda w=w: lag_return(w) for w in catalog.RETURN_WINDOWS}
    span = lambda: F.col("high") - F.col("low")
    shape = {"kmid": lambda: F.col("close") - F.col("open"), "klen": span,
             "kup": lambda: F.col("high") - max_of("open", "close"),
             "klow": lambda: min_of("open", "close") - F.col("low"),
             "ksft": lambda: F.col("close") * 2 - F.col("high") - F.col("low")}
    for name, top in shape.items():
        found[name] = lambda top=top: ratio(top(), F.col("open") + EPS)
        if name != "klen":
            found[name + "2"] = lambda top=top: ratio(top(), span() + EPS)
    for price in ("open", "high", "low"):
        found[f"gap_{price}"] = lambda p=price: ratio(p, lag("close")) - 1
    for side, source in (("vol", "vol"), ("amt", "amount")):
        found[f"_log{side}"] = lambda s=source: finite(F.log1p(s))
        for w in catalog.CHANGE_WINDOWS:
            found[f"{side}chg_{w}"] = lambda s=source, w=w: _log_change(s, w)
        found[f"_ret_{side}"] = lambda s=source: _pair(s)[0]
        found[f"_{side}_ret"] = lambda s=source: _pair(s)[1]
    found["illiq_1"] = lambda: F.log1p(F.abs(lag_return(1)) * 1e8 / positive("amount"))
    found["_downside"] = lambda: F.pow(F.when(lag_return(1).isNotNull(), F.least(lag_return(1), F.lit(0.0))), 2)
    found["_range"] = lambda: _squared_log("high", "low")
    found["_garman"] = lambda: _squared_log("high", "low") * 0.5 - _squared_log("close", "open") * (2 * math.log(2) - 1)
    found["_true_range"] = lambda: max_of(span(), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    found["_row"] = lambda: F.row_number().over(rows_of_entity())
    return found


class Build:
    """Collects which columns of the first three selects a set of features needs."""

    def __init__(self):
        self.base, self.moves, self.running, self.rolled, self._known, self.frame_rows = {}, {}, {}, {}, _base(), 0

    def row(self, name):
        if name not in SOURCES and name not in self.base:
            self.base[name] = self._known[name]()
        return F.col(name)

    def _complete(self, source, w):
        """Whether all of the last w values are present."""
        self.row(source)
        if f"_count_{source}" not in self.running:
            self.running[f"_count_{source}"] = F.count(finite(source)).over(so_far())
        return last_rows(f"_count_{source}", w) == w

    def _total(self, name, x, w):
        """Sum over the last w rows, from a running sum."""
        if name not in self.running:
            self.running[name] = running(x)
        return last_rows(name, w)

    def flat(self, source, w):
        """Whether the last w values are all the same: no change between neighbours."""
        self.row(source)
        self.moves[f"_moved_{source}"] = F.coalesce((F.col(source) != lag(source)).cast("double"), F.lit(0.0))
        return self._total(f"_moves_{source}", F.col(f"_moved_{source}"), w - 1) == 0

    def _rolled(self, name, source, w, value):
        if name not in self.rolled:
            self.rolled[name] = F.when(self._complete(source, w), value())
            self.frame_rows += w
        return F.col(name)

    def roll(self, kind, source, w):
        return self._rolled(f"_{kind}_{source}_{w}", source, w, lambda: AGGREGATES[kind](source).over(trailing(w)))

    def spread(self, source, w):
        """Population standard deviation, exactly 0 for a constant window."""
        value = lambda: F.when(self.flat(source, w), 0.0).otherwise(F.stddev_pop(source).over(trailing(w)))
        return self._rolled(f"_spread_{source}_{w}", source, w, value)

    def comoment(self, a, b, w):
        """Population covariance of two columns that are present together."""
        self.row(b)
        return self._rolled(f"_comoment_{a}_{b}_{w}", a, w, lambda: F.covar_pop(a, b).over(trailing(w)))

    def covariance(self, y, x, w):
        """Population covariance computed inside the frame."""
        self.row(x)
        return self._rolled(f"_covar_{y}_{x}_{w}", y, w, lambda: F.covar_pop(y, x).over(trailing(w)))

    def level(self, source, w):
        return self._rolled(f"_flat_{source}_{w}", source, w, lambda: self.flat(source, w))

    def last_event(self, flag):
        self.row("_row")
        seen = rows_of_entity().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.rolled[f"_last_{flag}"] = F.max(F.when(F.col(flag) == 1, F.col("_row"))).over(seen)
        return F.col("_row") - F.col(f"_last_{flag}")


def _definitions(b):
    """Feature name -> function that returns its last-level expression."""
    c = F.col("close")
    d = {}
    for name in [f"ret_{w}" for w in catalog.RETURN_WINDOWS] + list(catalog.CANDLES) + [
            "gap_open", "gap_high", "gap_low", "illiq_1"]:
        d[name] = lambda n=name: b.row(n)
    for x, y in catalog.RETURN_SPREADS:
        d[f"ret_{x}_minus_{y}"] = lambda x=x, y=y: b.row(f"ret_{x}") - b.row(f"ret_{y}")
    for w in catalog.MEAN_WINDOWS:
        d[f"madev_{w}"] = lambda w=w: ratio(c, b.roll("avg", "close", w)) - 1
    for x, y in catalog.MA_PAIRS:
        d[f"ma_{x}_over_{y}"] = lambda x=x, y=y: ratio(b.roll("avg", "close", x), b.roll("avg", "close", y)) - 1
    for w in catalog.RATIO_WINDOWS:
        flat = lambda w: b.roll("max", "close", w) == b.roll("min", "close", w)
        # Row numbers of a full frame are consecutive, so their variance is (w*w - 1) / 12.
        d[f"slope_{w}"] = lambda w=w: F.when(flat(w), 0.0).otherwise(
            ratio(b.covariance("close", "_row", w) / ((w * w - 1) / 12), c + EPS))
        d[f"rsq_{w}"] = lambda w=w: F.when(~b.level("close", w), ratio(
            F.pow(b.covariance("close", "_row", w), 2), F.pow(b.roll("std", "close", w), 2) * ((w * w - 1) / 12)))
        d[f"rsv_{w}"] = lambda w=w: ratio(
            c - b.roll("min", "low", w), b.roll("max", "high", w) - b.roll("min", "low", w) + EPS)
        d[f"stdret_{w}"] = lambda w=w: b.spread("ret_1", w)
        d[f"downvol_{w}"] = lambda w=w: F.sqrt(b.roll("avg", "_downside", w))
        d[f"parkinson_{w}"] = lambda w=w: F.sqrt(b.roll("avg", "_range", w) / (4 * math.log(2)))
        d[f"gkvol_{w}"] = lambda w=w: F.sqrt(max_of(b.roll("avg", "_garman", w), F.lit(0.0)))
        d[f"atr_{w}"] = lambda w=w: ratio(b.roll("avg", "_true_range", w), c + EPS)
    for w in catalog.EXTREME_WINDOWS:
        d[f"distmax_{w}"] = lambda w=w: ratio(c, b.roll("max", "high", w)) - 1
        d[f"distmin_{w}"] = lambda w=w: ratio(c, b.roll("min", "low", w)) - 1
        d[f"illiq_{w}"] = lambda w=w: b.roll("avg", "illiq_1", w)
    for side, source in (("vol", "vol"), ("amt", "amount")):
        for w in (3, *catalog.RATIO_WINDOWS):
            d[f"{side}ratio_{w}"] = lambda s=source, w=w: ratio(s, b.roll("avg", s, w) + EPS)
        for w in catalog.CHANGE_WINDOWS:
            d[f"{side}chg_{w}"] = lambda s=side, w=w: b.row(f"{s}chg_{w}")
        for w in catalog.EXTREME_WINDOWS:
            d[f"log{side}_std_{w}"] = lambda s=side, w=w: b.spread(f"_log{s}", w)
        for w in catalog.CORRELATION_WINDOWS:
            d[f"corr_ret_dlog{side}_{w}"] = lambda s=side, w=w: ratio(
                b.comoment(f"_ret_{s}", f"_{s}_ret", w), b.spread(f"_ret_{s}", w) * b.spread(f"_{s}_ret", w))
    for side in ("up", "down"):
        flag = f"flag_limit_{side}"
        d[flag] = lambda f=flag: F.col(f)
        for w in catalog.EXTREME_WINDOWS:
            d[f"limit_{side}_count_{w}"] = lambda f=flag, w=w: b.roll("sum", f, w)
        d[f"days_since_limit_{side}"] = lambda f=flag: F.when(F.col(f).isNotNull(), F.least(
            F.coalesce(b.last_event(f), F.lit(ROWS_SINCE_CAP)), F.lit(ROWS_SINCE_CAP)).cast("double"))
    return d


def history_features(panel, names, keep=KEYS, wide=None, placed=False):
    """Keys (or the columns in ``keep``) plus the named per-entity features.

    Views of more than ``WIDE`` columns, or of more than ``FRAME_ROWS`` rows in their frames, are computed as arrays over the sorted rows (``wide`` forces either way).
    ``placed`` says that each entity already lies in one partition, as in ``bars``."""
    names, b = list(names), Build()
    spans = [int(n.split("_")[1]) for n in names if n.startswith("emadev_")]
    known = _definitions(b)
    last = {n: known[n]() for n in names if n in known}
    unknown = set(names) - set(last) - {f"emadev_{s}" for s in spans}
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    if len(names) > WIDE or b.frame_rows > FRAME_ROWS if wide is None else wide:
        return array_features(panel, names, keep, placed=placed)
    df = panel.select(*dict.fromkeys([*KEYS, *SOURCES, *keep]))
    df = df if placed else spread(df, ENTITY)
    if spans:
        df = ema_deviation(df, spans).drop("_seen", *[f"_ema_{s}" for s in spans])
    if b.base:
        df = df.select("*", *[v.alias(k) for k, v in b.base.items()])
    if b.moves:
        df = df.select("*", *[v.alias(k) for k, v in b.moves.items()])
    if b.running:
        df = df.select("*", *[v.alias(k) for k, v in b.running.items()])
    if b.rolled:
        df = df.select("*", *[v.alias(k) for k, v in b.rolled.items()])
    return df.select(*keep, *[(last[n] if n in last else F.col(n)).alias(n) for n in names])
