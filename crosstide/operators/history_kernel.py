"""The trailing features as array work over sorted rows, for views of many columns.

One exchange by entity and one sort; then every task streams its rows and computes all columns of a batch at once. A window of w rows is
put together from blocks of 1, 2, 4, ... rows that end at the row (and before one another), so a column costs about log2(w) array
operations for all its windows, instead of re-reading up to 60 rows for each row and column. A block holds rows of its window only:
a large or missing value leaves no trace in later windows. Spreads and co-moments merge block by block (means and centred sums), which keeps
their digits. Exponential means follow their recursion. An entity that goes on in the next batch takes its last rows with it, as many as the
longest look-back, and the state of its means.
"""

import math

import numpy as np
import pyarrow as pa

from crosstide import catalog
from crosstide.functions.guards import EPS
from crosstide.functions.groups import pinned, spread
from crosstide.schema import DATE, ENTITY, KEYS, SOURCES

LOOK_BACK, CAP = 64, 61


def _divided(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def _finite(x):
    return np.where(np.isfinite(x), x, np.nan)


def _positive(x):
    return np.where(x > 0, x, np.nan)


def _log1p(x):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > -1, np.log1p(x), np.nan)


class Rows:
    """Columns of consecutive rows of one or more entities, and values made from them on demand."""

    def __init__(self, columns, place):
        self.place, self.made = place, dict(columns)
        self.n = len(place)

    def shift(self, x, w, fill=np.nan):
        out = np.full(self.n, fill)
        if w < self.n:
            out[w:] = x[:-w] if w else x
        return out

    def lag(self, x, w=1):
        return np.where(self.place >= w, self.shift(x, w), np.nan)

    def get(self, name, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def inside(self, x, w):
        """Values of full windows only."""
        return np.where(self.place >= w - 1, x, np.nan)

    def blocks(self, name, x, kind, k):
        """Aggregate of the last 2^k rows."""
        if k == 0:
            return _finite(x)
        def make():
            half, n = self.blocks(name, x, kind, k - 1), 1 << (k - 1)
            earlier = self.shift(half, n)
            return half + earlier if kind == "sum" else np.maximum(half, earlier) if kind == "max" else np.minimum(half, earlier)
        return self.get(("block", kind, name, k), make)

    def rolled(self, kind, name, w):
        """Sum, avg, min or max of a column over the last w rows, missing unless all are present."""
        def make():
            x = self.base(name)
            if kind == "avg":
                return self.rolled("sum", name, w) / w
            if kind == "sum":
                total, before = None, 0
                for k in range(w.bit_length() - 1, -1, -1):
                    if w >> k & 1:
                        part = self.shift(self.blocks(name, x, "sum", k), before) if before else self.blocks(name, x, "sum", k)
                        total, before = part if total is None else total + part, before + (1 << k)
                return self.inside(total, w)
            k = w.bit_length() - 1
            last = self.blocks(name, x, kind, k)
            first = self.shift(last, w - (1 << k)) if w > 1 << k else last
            return self.inside(np.maximum(last, first) if kind == "max" else np.minimum(last, first), w)
        return self.get(("roll", kind, name, w), make)

    def _moment_block(self, a, b, k):
        """Means of two columns and their centred cross sum over the last 2^k rows."""
        if k == 0:
            x, y = _finite(self.base(a)), _finite(self.base(b))
            return x, y, np.where(np.isnan(x) | np.isnan(y), np.nan, 0.0)
        def make():
            n = 1 << (k - 1)
            x, y, c = self._moment_block(a, b, k - 1)
            ex, ey, ec = (self.shift(v, n) for v in (x, y, c))
            return (x + ex) / 2, (y + ey) / 2, c + ec + (x - ex) * (y - ey) * (n / 2)
        return self.get(("moment", a, b, k), make)

    def comoment(self, a, b, w):
        """Population covariance over the last w rows."""
        def make():
            have, x, y, c = 0, None, None, None
            for k in range(w.bit_length() - 1, -1, -1):
                if w >> k & 1:
                    n, part = 1 << k, self._moment_block(a, b, k)
                    ex, ey, ec = (self.shift(v, have) for v in part) if have else part
                    if not have:
                        x, y, c = ex, ey, ec
                    else:
                        c = c + ec + (x - ex) * (y - ey) * (have * n / (have + n))
                        x, y = (x * have + ex * n) / (have + n), (y * have + ey * n) / (have + n)
                    have += n
            return self.inside(c / w, w)
        return self.get(("cov", a, b, w), make)

    def flat(self, name, w):
        """Whether no value of the last w differs from the one before it."""
        def moves():
            x = self.base(name)
            earlier = self.lag(x)
            return np.cumsum((x != earlier) & ~np.isnan(x) & ~np.isnan(earlier))
        total = self.get(("moves", name), moves)
        return total - self.shift(total.astype(float), w - 1, 0.0) == 0

    def spread(self, name, w):
        with np.errstate(invalid="ignore"):
            std = np.sqrt(np.maximum(self.comoment(name, name, w), 0))
        return np.where(np.isnan(std), np.nan, np.where(self.flat(name, w), 0.0, std))

    def base(self, name):
        """Values of single rows and lags."""
        def make():
            c, o, h, low = (self.made[p] for p in ("close", "open", "high", "low"))
            if name.startswith("ret_") and name[4:].isdigit():
                return _divided(c, self.lag(c, int(name[4:]))) - 1
            if name in _SHAPES:
                top, over = _SHAPES[name]
                top = {"mid": lambda: c - o, "len": lambda: h - low, "up": lambda: h - np.maximum(o, c), "low": lambda: np.minimum(o, c) - low, "sft": lambda: c * 2 - h - low}[top]()
                return _divided(top, (o if over == "open" else h - low) + EPS)
            if name.startswith("gap_"):
                return _divided(self.made[name[4:]], self.lag(c)) - 1
            for side, source in (("vol", "vol"), ("amt", "amount")):
                if name == f"_log{side}":
                    return _log1p(self.made[source])
                if name.startswith(f"{side}chg_"):
                    logs = _log1p(self.made[source])
                    return logs - self.lag(logs, int(name.split("_")[1]))
                if name in (f"_ret_{side}", f"_{side}_ret"):
                    r, change = self.base("ret_1"), self.base(f"{side}chg_1")
                    return np.where(np.isnan(r) | np.isnan(change), np.nan, r if name == f"_ret_{side}" else change)
            with np.errstate(divide="ignore", invalid="ignore"):
                if name == "illiq_1":
                    return _log1p(_divided(np.abs(self.base("ret_1")) * 1e8, _positive(self.made["amount"])))
                if name == "_downside":
                    return np.minimum(self.base("ret_1"), 0.0) ** 2
                if name == "_range":
                    return np.log(_positive(h) / _positive(low)) ** 2
                if name == "_garman":
                    return np.log(_positive(h) / _positive(low)) ** 2 * 0.5 - np.log(_positive(c) / _positive(o)) ** 2 * (2 * math.log(2) - 1)
            if name == "_true_range":
                return np.maximum(np.maximum(h - low, np.abs(h - self.lag(c))), np.abs(low - self.lag(c)))
            if name == "_row":
                return np.arange(self.n, dtype=float)
            raise KeyError(name)
        return self.get(name, make)

    def since_event(self, name):
        flag, at = self.made[name], np.arange(self.n)
        last = np.maximum.accumulate(np.where(flag == 1, at, -1))
        rows = np.where(last >= at - self.place, at - last, CAP)
        return np.where(np.isnan(flag), np.nan, np.minimum(rows, CAP).astype(float))

    def feature(self, name):
        c, (stem, *rest) = self.made["close"], name.rsplit("_", 1)
        w = int(rest[0]) if rest and rest[0].isdigit() else None
        if name in self.made:
            return self.made[name]
        for x, y in catalog.RETURN_SPREADS:
            if name == f"ret_{x}_minus_{y}":
                return self.base(f"ret_{x}") - self.base(f"ret_{y}")
        for x, y in catalog.MA_PAIRS:
            if name == f"ma_{x}_over_{y}":
                return _divided(self.rolled("avg", "close", x), self.rolled("avg", "close", y)) - 1
        if stem == "madev":
            return _divided(c, self.rolled("avg", "close", w)) - 1
        if stem == "slope":
            steady = self.rolled("max", "close", w) == self.rolled("min", "close", w)
            return np.where(steady, 0.0, _divided(self.comoment("close", "_row", w) / ((w * w - 1) / 12), c + EPS))
        if stem == "rsq":
            found = _divided(self.comoment("close", "_row", w) ** 2, self.comoment("close", "close", w) * ((w * w - 1) / 12))
            return np.where(self.flat("close", w), np.nan, found)
        if stem == "rsv":
            low = self.rolled("min", "low", w)
            return _divided(c - low, self.rolled("max", "high", w) - low + EPS)
        if stem == "stdret":
            return self.spread("ret_1", w)
        with np.errstate(invalid="ignore"):
            if stem == "downvol":
                return np.sqrt(self.rolled("avg", "_downside", w))
            if stem == "parkinson":
                return np.sqrt(self.rolled("avg", "_range", w) / (4 * math.log(2)))
            if stem == "gkvol":
                return np.sqrt(np.maximum(self.rolled("avg", "_garman", w), 0.0))
        if stem == "atr":
            return _divided(self.rolled("avg", "_true_range", w), c + EPS)
        if stem in ("distmax", "distmin"):
            return _divided(c, self.rolled("max", "high", w) if stem == "distmax" else self.rolled("min", "low", w)) - 1
        if stem == "illiq" and w > 1:
            return self.rolled("avg", "illiq_1", w)
        for side, source in (("vol", "vol"), ("amt", "amount")):
            if stem == f"{side}ratio":
                return _divided(self.made[source], self.rolled("avg", source, w) + EPS)
            if stem == f"log{side}_std":
                return self.spread(f"_log{side}", w)
            if stem == f"corr_ret_dlog{side}":
                a, b = f"_ret_{side}", f"_{side}_ret"
                return _divided(self.comoment(a, b, w), self.spread(a, w) * self.spread(b, w))
        for side in ("up", "down"):
            if stem == f"limit_{side}_count":
                return self.rolled("sum", f"flag_limit_{side}", w)
            if name == f"days_since_limit_{side}":
                return self.since_event(f"flag_limit_{side}")
        return self.base(name)


_SHAPES = {"kmid": ("mid", "open"), "klen": ("len", "open"), "kmid2": ("mid", "span"), "kup": ("up", "open"), "kup2": ("up", "span"),
           "klow": ("low", "open"), "klow2": ("low", "span"), "ksft": ("sft", "open"), "ksft2": ("sft", "span")}


class Means:
    """Exponential means along the rows of each entity, by their recursion: y = (w*y_before + a*x) / (w + a) with w = (1-a)**gap, where gap counts
    the rows since the last present value. The order of the terms follows the entity's rows alone, never the batches."""

    def __init__(self, spans):
        self.spans, self.last, self.seen, self.gap = spans, dict.fromkeys(spans, 0.0), 0, 0

    def deviations(self, x, begins):
        """{span: value over its mean, minus 1, once ``span`` values were seen}; ``begins`` marks the first row of an entity."""
        n, present = len(x), ~np.isnan(x)
        at, starts = np.arange(n), np.flatnonzero(begins)
        goes_on = np.cumsum(begins) == 0  # rows of the entity that the batch before ended with
        first = np.maximum.accumulate(np.where(begins, at, 0))
        count = np.cumsum(present)
        seen = count - np.where(goes_on, 0, (count - present)[first]) + np.where(goes_on, self.seen, 0)
        before = np.append(-1, np.maximum.accumulate(np.where(present, at, -1))[:-1])
        gap = np.where(before >= first, at - before, np.where(goes_on, at + self.gap, 0))
        fresh, out = present & (seen == 1), {}
        for s in self.spans:
            alpha = 2.0 / (s + 1.0)
            left = (1.0 - alpha) ** gap
            kept = np.where(present & ~fresh, left / (left + alpha), np.where(fresh | begins, 0.0, 1.0))
            added = np.where(present, np.where(fresh, x, alpha / (left + alpha) * x), 0.0)
            y, means = self.last[s], []
            for a, b in zip(kept.tolist(), added.tolist(), strict=True):
                y = a * y + b
                means.append(y)
            self.last[s] = y
            out[s] = np.where(present & (seen >= s), _divided(x, np.array(means)) - 1, np.nan)
        begun, there = starts[-1] if len(starts) else 0, np.flatnonzero(present)
        self.gap = n - int(there[-1]) if len(there) and there[-1] >= begun else n + self.gap if not len(starts) else 0
        self.seen = int(seen[-1])
        return out


def feature_batches(batches, names):
    """(batch, values) of batches sorted by entity and date; ``values(name)`` is the array of a feature of the batch's rows."""
    held, codes, means = None, None, Means([int(n.split("_")[1]) for n in names if n.startswith("emadev_")])
    for batch in batches:
        if not len(batch):
            continue
        table = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in SOURCES}
        code = np.asarray(batch.column(ENTITY).cast(pa.string()).to_pylist(), object)
        begins = np.append(codes is None or codes[-1] != code[0], code[1:] != code[:-1])
        moved = means.deviations(_finite(table["close"]), begins)
        start = 0
        if not begins[0]:
            mine = codes == code[0]
            start = int(mine.sum())
            table = {c: np.concatenate([held[c][mine], table[c]]) for c in SOURCES}
            code = np.concatenate([codes[mine], code])
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
        found = Rows(table, place)
        held, codes = {c: table[c][-LOOK_BACK:] for c in SOURCES}, code[-LOOK_BACK:]
        yield batch, lambda n: moved[int(n.split("_")[1])] if n.startswith("emadev_") else found.feature(n)[start:].astype(float)


def sorted_rows(panel, keep, stored=False, placed=False):
    """Keys, sources and kept columns, each entity in one partition and in date order. ``stored`` writes them once for several readers."""
    rows = panel.select(*dict.fromkeys([*KEYS, *SOURCES, *keep]))
    rows = (rows if placed else spread(rows, ENTITY)).sortWithinPartitions(ENTITY, DATE)
    return pinned(rows) if stored else rows


def array_features(panel, names, keep=KEYS, stored=False, placed=False):
    """Keys (or the columns in ``keep``) plus the named per-entity features.

    ``stored`` writes the narrow rows once, so that every reader makes the features anew instead of reading wide rows.
    ``placed`` says that each entity already lies in one partition."""
    names, keep = list(names), list(dict.fromkeys(keep))
    rows = sorted_rows(panel, keep, stored, placed)
    schema = rows.select(*keep).schema
    made = [n for n in names if n not in keep]
    for n in made:
        schema = schema.add(n, "double")

    def run(batches):
        for batch, values in feature_batches(batches, made):
            out = batch.select(keep)
            for n in made:
                out = out.append_column(n, pa.array(values(n), from_pandas=True))
            yield out

    return rows.mapInArrow(run, schema).select(*keep, *names)
