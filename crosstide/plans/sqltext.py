"""SQL text shared by the oracle queries: the derived panel and per-entity feature columns."""

import math

from crosstide import catalog

EPS = "1e-12"


def rounded(*names):
    """Select-list items rounded like ``shown``; '+ 0.0' turns a negative zero into zero."""
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)


def panel(grain="day"):
    """CTEs up to ``bars``: the labelled panel."""
    start = "l_shipdate" if grain == "day" else f"date_trunc('{grain}', l_shipdate)"
    return f"""WITH shipments AS (
  SELECT l_suppkey, {start} AS start_day, l_extendedprice / l_quantity AS px,
         row(l_orderkey, l_linenumber, l_extendedprice) AS ord, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag
  FROM lineitem),
grouped AS (
  SELECT l_suppkey, start_day, arg_min(px, ord) AS o, max(px) AS h, min(px) AS l, arg_max(px, ord) AS c,
         sum(l_quantity) AS vol, sum(l_extendedprice) AS amount,
         max(CASE WHEN l_discount >= 0.10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS flag_limit_up,
         max(CASE WHEN l_tax >= 0.08 THEN 1.0 ELSE 0.0 END)::DOUBLE AS flag_limit_down,
         bool_and(l_returnflag = 'R') AND day(start_day) = 15 AS void
  FROM shipments GROUP BY l_suppkey, start_day),
unlabelled AS (
  SELECT printf('%06d.SZ', l_suppkey) AS ts_code, CAST(strftime(start_day, '%Y%m%d') AS INTEGER) AS trade_date,
         CASE WHEN NOT void THEN o END AS open, CASE WHEN NOT void THEN h END AS high,
         CASE WHEN NOT void THEN l END AS low, CASE WHEN NOT void THEN c END AS close,
         vol, amount, flag_limit_up, flag_limit_down
  FROM grouped),
bars AS (
  SELECT *, lead(close) OVER (PARTITION BY ts_code ORDER BY trade_date) / nullif(close, 0) - 1 AS y_ret_1d
  FROM unlabelled)"""


def event_panel():
    """CTEs up to ``bars``: the panel of user events."""
    return """WITH grouped AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS vol, sum(value) AS amount,
  max(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)::DOUBLE AS flag_limit_up, max(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE AS flag_limit_down
  FROM events GROUP BY 1, 2),
bars AS (SELECT printf('%06d.EV', user_id) AS ts_code, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS trade_date, open, high, low, close, vol, amount,
  flag_limit_up, flag_limit_down FROM grouped)"""


def windows():
    named = ["e AS (PARTITION BY ts_code ORDER BY trade_date)",
             "past AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"]
    for w in (3, 5, 10, 20, 30, 60):
        named.append(f"w{w} AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
    return "WINDOW " + ", ".join(named)


def full(call, x, w):
    return f"(CASE WHEN count({x}) OVER w{w} = {w} THEN {call} OVER w{w} END)"


def _lag(x, w=1):
    return f"lag({x}, {w}) OVER e"


# Columns that later windows need; each uses raw columns only.
FIRST = {
    "rn": "row_number() OVER e",
    "r1": f"close / nullif({_lag('close')}, 0) - 1",
    "lvol": "CASE WHEN vol > -1 THEN ln(1 + vol) END",
    "lamt": "CASE WHEN amount > -1 THEN ln(1 + amount) END",
    "hl2": "power(ln(CASE WHEN high > 0 THEN high END / CASE WHEN low > 0 THEN low END), 2)",
    "co2": "power(ln(CASE WHEN close > 0 THEN close END / CASE WHEN open > 0 THEN open END), 2)",
    "tr": f"CASE WHEN high IS NOT NULL AND low IS NOT NULL AND {_lag('close')} IS NOT NULL THEN "
          f"greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) END",
}
SECOND = {
    "dvol": f"lvol - {_lag('lvol')}",
    "damt": f"lamt - {_lag('lamt')}",
    "down2": "CASE WHEN r1 IS NOT NULL THEN power(least(r1, 0.0), 2) END",
    "ill": "ln(1 + 1e8 * abs(r1) / CASE WHEN amount > 0 THEN amount END)",
    "gk": f"0.5 * hl2 - {2 * math.log(2) - 1!r} * co2",
}
THIRD = {
    "rv": "CASE WHEN dvol IS NOT NULL THEN r1 END", "vr": "CASE WHEN r1 IS NOT NULL THEN dvol END",
    "ra": "CASE WHEN damt IS NOT NULL THEN r1 END", "ar": "CASE WHEN r1 IS NOT NULL THEN damt END",
}


def staged(grain="day", source="bars"):
    """Panel CTEs plus ``stage``, which holds every helper column."""
    items = lambda d: ", ".join(f"{v} AS {k}" for k, v in d.items())
    w = "WINDOW e AS (PARTITION BY ts_code ORDER BY trade_date)"
    return ((event_panel() if grain == "events" else panel(grain)) + f""",
stage1 AS (SELECT *, {items(FIRST)} FROM {source} {w}),
stage2 AS (SELECT *, {items(SECOND)} FROM stage1 {w}),
stage AS (SELECT *, {items(THIRD)} FROM stage2)""")


def _over(a, b):
    return f"({a}) / nullif({b}, 0)"


def feature(name):
    """Expression over ``stage`` and the named windows."""
    stem, _, tail = name.rpartition("_")
    w = int(tail) if tail.isdigit() else None
    ma = lambda x, w: full(f"avg({x})", x, w)
    if name in ("ret_5_minus_20", "ret_20_minus_60"):
        a, b = name.removeprefix("ret_").split("_minus_")
        return f"{feature('ret_' + a)} - ({feature('ret_' + b)})"
    if name.startswith("ma_"):
        a, b = name.removeprefix("ma_").split("_over_")
        return _over(ma("close", int(a)), ma("close", int(b))) + " - 1"
    if stem == "ret":
        return _over("close", _lag("close", w)) + " - 1"
    if stem == "gap":
        return _over(tail, _lag("close")) + " - 1"
    if stem == "madev":
        return _over("close", ma("close", w)) + " - 1"
    if stem == "stdret":
        return full("stddev_pop(r1)", "r1", w)
    if stem in ("volratio", "amtratio"):
        x = "vol" if stem == "volratio" else "amount"
        return _over(x, f"{ma(x, w)} + {EPS}")
    if stem in ("volchg", "amtchg"):
        x = "l" + stem[:3]
        return f"{x} - {_lag(x, w)}"
    if stem in ("logvol_std", "logamt_std"):
        x = "l" + stem[3:6]
        return full(f"stddev_pop({x})", x, w)
    if stem == "slope":
        return (f"CASE WHEN count(close) OVER w{w} = {w} THEN CASE WHEN max(close) OVER w{w} = min(close) OVER w{w} THEN 0.0 "
                f"ELSE regr_slope(close, rn) OVER w{w} / (close + {EPS}) END END")
    if stem == "rsq":
        return (f"CASE WHEN count(close) OVER w{w} = {w} AND max(close) OVER w{w} <> min(close) OVER w{w} "
                f"THEN regr_r2(close, rn) OVER w{w} END")
    if stem == "rsv":
        lo, hi = full("min(low)", "low", w), full("max(high)", "high", w)
        return _over(f"close - {lo}", f"{hi} - {lo} + {EPS}")
    if stem == "distmax":
        return _over("close", full("max(high)", "high", w)) + " - 1"
    if stem == "distmin":
        return _over("close", full("min(low)", "low", w)) + " - 1"
    if stem == "downvol":
        return f"sqrt({ma('down2', w)})"
    if stem == "parkinson":
        return f"sqrt({ma('hl2', w)} / (4 * ln(2)))"
    if stem == "gkvol":
        return f"CASE WHEN {ma('gk', w)} IS NOT NULL THEN sqrt(greatest({ma('gk', w)}, 0.0)) END"
    if stem == "atr":
        return f"{ma('tr', w)} / (close + {EPS})"
    if name == "illiq_1":
        return "ill"
    if stem == "illiq":
        return ma("ill", w)
    if stem in ("corr_ret_dlogvol", "corr_ret_dlogamt"):
        x, y = ("rv", "vr") if stem.endswith("vol") else ("ra", "ar")
        varies = " AND ".join(f"max({c}) OVER w{w} <> min({c}) OVER w{w}" for c in (x, y))
        return (f"CASE WHEN count({x}) OVER w{w} = {w} AND {varies} THEN covar_pop({x}, {y}) OVER w{w} / "
                f"nullif(stddev_pop({x}) OVER w{w} * stddev_pop({y}) OVER w{w}, 0) END")
    if name.startswith("limit_"):
        flag = "flag_" + "_".join(name.split("_")[:2])
        return full(f"sum({flag})", flag, w)
    if name.startswith("days_since"):
        flag = "flag_limit_" + tail
        return (f"CASE WHEN {flag} IS NOT NULL THEN CAST(least(coalesce(rn - max(CASE WHEN {flag} = 1 THEN rn END) "
                f"OVER past, 61), 61) AS DOUBLE) END")
    if name.startswith("flag_"):
        return name
    top = {"kmid": "close - open", "klen": "high - low", "kup": "high - greatest(open, close)",
           "klow": "least(open, close) - low", "ksft": "2 * close - high - low"}
    if name in top:
        return f"({top[name]}) / (open + {EPS})"
    return f"({top[name[:-1]]}) / (high - low + {EPS})"


def history(names, grain="day", keep=("ts_code", "trade_date")):
    """CTEs up to ``features``: the named per-entity columns, unrounded."""
    plain = [n for n in names if not n.startswith("emadev_")]
    spans = [int(n.split("_")[1]) for n in names if n.startswith("emadev_")]
    text = staged(grain)
    items = ", ".join(f"{feature(n)} AS {n}" for n in plain)
    kept = ", ".join(keep)
    if not spans:
        return text + f", features AS (SELECT {kept}, {items} FROM stage {windows()})"
    text = text.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ema_steps(spans)
    ema = ", ".join(f"CASE WHEN m.seen >= {s} THEN p.close / nullif(m.y{s}, 0) - 1 END AS emadev_{s}" for s in spans)
    both = ", ".join("p." + k for k in keep)
    if not plain:
        return text + f", features AS (SELECT {both}, {ema} FROM stage p JOIN ema m USING (ts_code, rn))"
    listed = ", ".join(f"w.{n}" for n in plain)
    return text + f""", wide AS (SELECT ts_code, trade_date, {items} FROM stage {windows()}),
features AS (SELECT {both}, {listed}, {ema} FROM stage p JOIN ema m USING (ts_code, rn)
  JOIN wide w USING (ts_code, trade_date))"""


def ema_steps(spans):
    first = ", ".join(f"close AS y{s}, 1.0::DOUBLE AS q{s}" for s in spans)
    step = ", ".join(
        f"CASE WHEN m.y{s} IS NULL THEN p.close WHEN p.close IS NULL THEN m.y{s} ELSE "
        f"(m.q{s} * {1 - 2 / (s + 1)!r} * m.y{s} + {2 / (s + 1)!r} * p.close) / (m.q{s} * {1 - 2 / (s + 1)!r} + {2 / (s + 1)!r}) END, "
        f"CASE WHEN m.y{s} IS NULL OR p.close IS NOT NULL THEN 1.0::DOUBLE ELSE m.q{s} * {1 - 2 / (s + 1)!r} END" for s in spans)
    return f"""ema AS (
  SELECT ts_code, rn, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS seen, {first} FROM stage WHERE rn = 1
  UNION ALL
  SELECT p.ts_code, p.rn, m.seen + CASE WHEN p.close IS NULL THEN 0 ELSE 1 END, {step}
  FROM ema m JOIN stage p ON p.ts_code = m.ts_code AND p.rn = m.rn + 1)"""


def pct(x, by="trade_date"):
    """Average-tie percentile rank of a column among its non-missing values."""
    part = f"PARTITION BY {by}, {x} IS NULL"
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x}) + "
            f"(count(*) OVER ({part}, {x}) - 1) / 2.0) / count({x}) OVER ({part}) END")


def labelled_ranks(grain="day"):
    """CTEs up to ``ranked``: labelled rows with the label's percentile rank ``u``."""
    return panel(grain) + f""", ranked AS (SELECT ts_code, trade_date, y_ret_1d, {pct('y_ret_1d')} AS u
  FROM bars WHERE y_ret_1d IS NOT NULL)"""


FOLD_VALUES = """folds(fold, train_start, train_end, valid_start, valid_end) AS (VALUES
  ('F1', 19950102, 19981231, 19990101, 19991231),
  ('F2', 19950102, 19991231, 20000101, 20001231),
  ('F3', 19950102, 20001231, 20010101, 20011231))"""

FOLD_STEPS = FOLD_VALUES + """,
candidates AS (
  SELECT b.*, f.fold, CASE WHEN trade_date BETWEEN valid_start AND valid_end THEN 'valid' ELSE 'train' END AS role
  FROM bars b JOIN folds f ON trade_date BETWEEN train_start AND train_end OR trade_date BETWEEN valid_start AND valid_end),
purge AS (SELECT fold, max(trade_date) AS purge_date FROM candidates WHERE role = 'train' GROUP BY fold),
purged AS (SELECT c.*, p.purge_date, role = 'train' AND trade_date >= p.purge_date AS purged
  FROM candidates c JOIN purge p USING (fold)),
used AS (SELECT * FROM purged WHERE NOT purged AND (role = 'valid' OR y_ret_1d IS NOT NULL))"""
