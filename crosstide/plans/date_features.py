"""Same-date features, whole feature views and date-series windows."""

from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.operators import cross
from crosstide.operators.features import basic_view, full_view, rank_view, ranked_view, subset
from crosstide.operators.history import history_features
from crosstide.plans import sqltext as S
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.schema import DATE, ENTITY, KEYS
from crosstide.sources.panel import bars

ROWS = "ts_code, trade_date"


def _day(expr, name):
    return f"{expr} OVER (PARTITION BY trade_date) AS {name}"


MARKET_SQL = {
    "market_mean_ret_1": "avg(ret_1)",
    "market_breadth_up": "avg(CASE WHEN ret_1 IS NOT NULL THEN CASE WHEN ret_1 > 0 THEN 1.0 ELSE 0.0 END END)",
    "market_median_ret_1": "median(ret_1)", "market_median_ret_5": "median(ret_5)",
    "market_median_ret_20": "median(ret_20)",
    "market_dispersion_ret_1": "stddev_pop(ret_1)", "market_dispersion_ret_5": "stddev_pop(ret_5)",
    "market_limit_up_ratio": "avg(flag_limit_up)", "market_limit_down_ratio": "avg(flag_limit_down)",
}
AMOUNT_SQL = """totals AS (SELECT trade_date, sum(amount) AS total FROM bars GROUP BY trade_date),
ratios AS (SELECT trade_date, CASE WHEN count(total) OVER w = 20 THEN total / (avg(total) OVER w + 1e-12) END
  AS market_amount_ratio_20 FROM totals
  WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _market_query(name, needs, outputs):
    sql = (S.history(needs) + f", days AS (SELECT {ROWS}, " + ", ".join(_day(MARKET_SQL[o], o) for o in outputs)
           + f" FROM features) SELECT {ROWS}, {S.rounded(*outputs)} FROM days")
    query(name, sql)(lambda spark, d: shown(
        _market_values(history_features(bars(spark, d), needs), outputs, date_sizes(spark, d)), *KEYS, *outputs))


def _market_values(df, outputs, sizes):
    plain = {o: a for o, a in cross._market_aggregates().items() if o in outputs}
    medians = {o.removeprefix("market_median_"): o for o in outputs if o.startswith("market_median_")}
    out = cross.date_statistics(df, plain, list(medians), sizes)
    return out.withColumnsRenamed({f"_median_{s}": o for s, o in medians.items()})


_market_query("c01_market_mean", ["ret_1"], ["market_mean_ret_1"])
_market_query("c02_breadth", ["ret_1"], ["market_breadth_up"])
_market_query("c03_market_median", ["ret_1", "ret_5", "ret_20"],
              ["market_median_ret_1", "market_median_ret_5", "market_median_ret_20"])
_market_query("c04_dispersion", ["ret_1", "ret_5"], ["market_dispersion_ret_1", "market_dispersion_ret_5"])
_market_query("c05_limit_ratio", ["flag_limit_up", "flag_limit_down"],
              ["market_limit_up_ratio", "market_limit_down_ratio"])


@query("c06_market_amount_ratio", S.panel() + f", {AMOUNT_SQL} SELECT {ROWS}, {S.rounded('market_amount_ratio_20')} "
       "FROM bars JOIN ratios USING (trade_date)")
def c06(spark, d):
    from crosstide.functions.groups import small_side
    panel = bars(spark, d)
    joined = panel.select(*KEYS).join(small_side(cross.amount_ratio(panel), date_sizes(spark, d)), DATE)
    return shown(joined, *KEYS, "market_amount_ratio_20")


@query("w29_date_series_mean", S.panel() + f", {AMOUNT_SQL} SELECT trade_date, {S.rounded('market_amount_ratio_20')} FROM ratios")
def w29(spark, d):
    return shown(cross.amount_ratio(bars(spark, d)))


_RELATIVE = catalog.RELATIVE_SOURCES
_RELATIVE_NEEDS = list(dict.fromkeys(_RELATIVE.values()))


@query("c07_relative", S.history(_RELATIVE_NEEDS) + f", days AS (SELECT {ROWS}, " + ", ".join(
       f"{s} - median({s}) OVER (PARTITION BY trade_date) AS {n}" for n, s in _RELATIVE.items())
       + f" FROM features) SELECT {ROWS}, {S.rounded(*_RELATIVE)} FROM days")
def c07(spark, d):
    df = history_features(bars(spark, d), _RELATIVE_NEEDS)
    return shown(cross.relative_features(df, _RELATIVE, date_sizes(spark, d)), *KEYS, *_RELATIVE)


def _rank_sql(columns, names):
    """Long-form ranks, turned back into one column each."""
    return (S.history(names) + f", ranked AS (SELECT {ROWS}, " + ", ".join(
        f"{S.pct(s)} AS {o}" for s, o in columns.items()) + f" FROM features) SELECT {ROWS}, {S.rounded(*columns.values())} FROM ranked")


_CSR = {s: f"csr_{s}" for s in catalog.RANK_SOURCES}


@query("c08_pct_rank", _rank_sql(_CSR, catalog.RANK_SOURCES))
def c08(spark, d):
    df = history_features(bars(spark, d), catalog.RANK_SOURCES)
    return shown(cross.percent_ranks(df, _CSR, date_sizes(spark, d)), *KEYS, *_CSR.values())


_VIEW = catalog.rank_view_columns()


@query("c09_rank_view", _rank_sql(_VIEW, list(_VIEW)))
def c09(spark, d):
    df = history_features(bars(spark, d), list(_VIEW))
    return shown(rank_view(df, date_sizes(spark, d)), *KEYS, *_VIEW.values())


@query("c11_prediction_rank", S.history(["ret_1"]) + f", preds AS (SELECT {ROWS}, coalesce(-ret_1, 0) AS pred FROM features), "
       f"ranked AS (SELECT {ROWS}, {S.pct('pred')} AS daily_rank FROM preds) SELECT {ROWS}, {S.rounded('daily_rank')} FROM ranked")
def c11(spark, d):
    df = history_features(bars(spark, d), ["ret_1"])
    df = df.withColumn("pred", F.coalesce(-F.col("ret_1"), F.lit(0.0)))
    return shown(cross.percent_ranks(df, {"pred": "daily_rank"}, date_sizes(spark, d)), *KEYS, "daily_rank")


def full_ctes(keep=("ts_code", "trade_date")):
    """CTEs up to ``full_rows``: every column of the full view by its name."""
    days = [_day(MARKET_SQL[n], n) for n in MARKET_SQL]
    days += [f"{s} - median({s}) OVER (PARTITION BY trade_date) AS {n}" for n, s in _RELATIVE.items()]
    days += [f"{S.pct(s)} AS {o}" for s, o in _CSR.items()]
    return (S.history(catalog.ENTITY_FEATURES, keep=keep) + f", {AMOUNT_SQL}, days AS (SELECT features.*, " + ", ".join(days) + " FROM features), "
            "full_rows AS (SELECT * FROM days JOIN ratios USING (trade_date))")


def _full_sql():
    return full_ctes() + f" SELECT {ROWS}, {S.rounded(*catalog.FULL)} FROM full_rows"


def narrow(names):
    """Values as they are compared in ranks over all columns: 32-bit floats."""
    return ", ".join(f"CAST({n} AS FLOAT) AS {n}" for n in names)


_RANKED = [n for n in catalog.FULL if catalog.CATEGORY[n] != "market"]
_MARKET = [n for n in catalog.FULL if catalog.CATEGORY[n] == "market"]


@query("c10_rank_all", full_ctes() + f", narrowed AS (SELECT {ROWS}, {', '.join(_MARKET)}, {narrow(_RANKED)} FROM full_rows), ranked AS (SELECT {ROWS}, {', '.join(_MARKET)}, "
       + ", ".join(f"{S.pct(n)} AS ranked_{n}" for n in _RANKED) + f" FROM narrowed) SELECT {ROWS}, {S.rounded(*_MARKET, *[f'ranked_{n}' for n in _RANKED])} FROM ranked")
def c10(spark, d):
    """All 147 columns: the market ones as they are, the others ranked."""
    out = ranked_view(bars(spark, d), date_sizes(spark, d))
    return shown(out.withColumnsRenamed({n: f"ranked_{n}" for n in _RANKED}))


@query("w30_full_view", _full_sql())
def w30(spark, d):
    return shown(full_view(bars(spark, d), date_sizes(spark, d)))


@query("w30_basic_view", S.history(catalog.BASIC) + f" SELECT {ROWS}, {S.rounded(*catalog.BASIC)} FROM features")
def w30_basic(spark, d):
    return shown(basic_view(bars(spark, d)))


_KEPT = catalog.without_categories(["trend", "volume", "amount", "limit"], catalog.BASIC)


@query("p11_feature_subset", S.history(_KEPT) + f" SELECT {ROWS}, {S.rounded(*_KEPT)} FROM features")
def p11(spark, d):
    return shown(subset(basic_view(bars(spark, d), placed=True), ["trend", "volume", "amount", "limit"], catalog.BASIC))


@query("p12_contract_order")
def p12(spark, d):
    """Contract position of every column that the full view delivers."""
    columns = full_view(bars(spark, d), date_sizes(spark, d)).columns
    rows = bars(spark, d).groupBy().agg(F.count(F.lit(1)).alias("panel_rows"))
    names = spark.createDataFrame(list(enumerate(columns)), "position int, column_name string")
    return names.crossJoin(F.broadcast(rows))


@query("w26_next_return", S.panel() + f" SELECT {ROWS}, {S.rounded('y_ret_1d')} FROM bars")
def w26(spark, d):
    return shown(bars(spark, d, labelled=True), *KEYS, "y_ret_1d")
