"""Literal panels and scalar restatements used by the operator tests."""

import math

import numpy as np
import pandas as pd

from crosstide.schema import DATE, ENTITY, KEYS, LABEL, SOURCES, panel_schema


def dates(n, start="2020-01-01"):
    return [int(d.strftime("%Y%m%d")) for d in pd.bdate_range(start, periods=n)]


def walk(code="000001.SZ", n=85, seed=42, scale=1.0):
    """One entity with a random-walk close inside a high/low envelope."""
    rng = np.random.default_rng(seed)
    close = scale * 20 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    opened = close * (1 + rng.normal(0, 0.005, n))
    high = np.maximum(opened, close) * (1 + rng.uniform(0, 0.01, n))
    low = np.minimum(opened, close) * (1 - rng.uniform(0, 0.01, n))
    vol = 1000.0 + 10 * np.arange(n)
    return pd.DataFrame({ENTITY: code, DATE: dates(n), "open": opened, "high": high, "low": low, "close": close,
                         "vol": vol, "amount": vol * close, "flag_limit_up": (np.arange(n) % 13 == 0).astype(float),
                         "flag_limit_down": (np.arange(n) % 17 == 5).astype(float)})


def panel(spark, frame, labelled=False):
    columns = KEYS + SOURCES + ([LABEL] if labelled else [])
    rows = [[None if isinstance(v, float) and math.isnan(v) else v for v in r] for r in frame[columns].itertuples(index=False)]
    rows = [[r[0], int(r[1]), *[None if v is None else float(v) for v in r[2:]]] for r in rows]
    return spark.createDataFrame(rows, panel_schema(labelled))


def predictions(spark, rows):
    """(code, date, pred, label, limit flag) tuples."""
    return spark.createDataFrame(rows, "ts_code string, trade_date int, pred double, y_ret_1d double, flag_limit_up double")


def collected(df, *order):
    return df.orderBy(*(order or KEYS)).toPandas()
