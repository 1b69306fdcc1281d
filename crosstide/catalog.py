"""Feature catalog: names, categories, windows and dependencies, built from window rules.

The names and windows are fixed values of the feature contract.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

RETURN_WINDOWS = (1, 2, 3, 5, 10, 20, 30, 60)
MEAN_WINDOWS = (3, 5, 10, 20, 30, 60)
RATIO_WINDOWS = (5, 10, 20, 60)
MA_PAIRS = ((5, 20), (10, 20), (20, 60))
RETURN_SPREADS = ((5, 20), (20, 60))
EXTREME_WINDOWS = (5, 20, 60)
CHANGE_WINDOWS = (1, 5, 20)
CORRELATION_WINDOWS = (5, 20)
CANDLES = ("kmid", "klen", "kmid2", "kup", "kup2", "klow", "klow2", "ksft", "ksft2")

RELATIVE_SOURCES = {
    "relret_1": "ret_1", "relret_5": "ret_5", "relret_20": "ret_20", "relret_60": "ret_60",
    "relstd_20": "stdret_20", "relvolratio_20": "volratio_20", "relamtratio_20": "amtratio_20",
    "relilliq_20": "illiq_20",
}
RANK_SOURCES = (
    "ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "ret_60", "madev_5", "madev_20", "stdret_5",
    "stdret_20", "volratio_5", "volratio_20", "amtratio_5", "amtratio_20", "illiq_20", "rsv_20",
)
# Sources of the rank view; those without a csr_ column get one with the suffix below.
RANK_VIEW_SOURCES = (
    "kmid", "gap_open", "klen", "kup", "klow", "ret_1", "ret_2", "ret_3", "ret_5", "ret_10", "ret_20",
    "ret_60", "madev_5", "madev_20", "madev_60", "stdret_5", "stdret_20", "stdret_60", "downvol_20",
    "volratio_5", "volratio_20", "volratio_60", "amtratio_20", "illiq_20", "corr_ret_dlogvol_20",
    "rsv_20", "rsv_60", "distmax_20", "ma_5_over_20", "ma_20_over_60",
)
RANK_VIEW_SUFFIX = "__csr_d0"


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    window: int | None
    groupby: str
    depends_on: tuple = ()


def _entity_features():
    def add(category, name, window, *needs):
        found.append(Feature(name, category, window, "ts_code", needs))

    found = []
    for w in RETURN_WINDOWS:
        add("return", f"ret_{w}", w)
    for a, b in RETURN_SPREADS:
        add("return", f"ret_{a}_minus_{b}", None, f"ret_{a}", f"ret_{b}")
    for name in CANDLES:
        add("kbar", name, 1)
    for price in ("open", "high", "low"):
        add("kbar", f"gap_{price}", 1)
    for w in MEAN_WINDOWS:
        add("trend", f"madev_{w}", w)
    for w in RATIO_WINDOWS:
        add("trend", f"emadev_{w}", w)
    for a, b in MA_PAIRS:
        add("trend", f"ma_{a}_over_{b}", b)
    for stem in ("slope", "rsq"):
        for w in RATIO_WINDOWS:
            add("trend", f"{stem}_{w}", w)
    for stem in ("distmax", "distmin"):
        for w in EXTREME_WINDOWS:
            add("trend", f"{stem}_{w}", w)
    for w in RATIO_WINDOWS:
        add("trend", f"rsv_{w}", w)
    for stem in ("stdret", "downvol", "parkinson", "gkvol", "atr"):
        for w in RATIO_WINDOWS:
            add("volatility", f"{stem}_{w}", w, *(["ret_1"] if stem in ("stdret", "downvol") else []))
    for category, stem in (("volume", "volratio"), ("amount", "amtratio")):
        for w in (3, *RATIO_WINDOWS):
            add(category, f"{stem}_{w}", w)
    for category, stem in (("volume", "volchg"), ("amount", "amtchg")):
        for w in CHANGE_WINDOWS:
            add(category, f"{stem}_{w}", w)
    for category, stem in (("volume", "logvol_std"), ("amount", "logamt_std")):
        for w in EXTREME_WINDOWS:
            add(category, f"{stem}_{w}", w)
    for side in ("vol", "amt"):
        for w in CORRELATION_WINDOWS:
            add("volume_price", f"corr_ret_dlog{side}_{w}", w, "ret_1", f"{side}chg_1")
    add("liquidity", "illiq_1", 1, "ret_1")
    for w in EXTREME_WINDOWS:
        add("liquidity", f"illiq_{w}", w, "illiq_1")
    for side in ("up", "down"):
        add("limit", f"flag_limit_{side}", 1)
    for side in ("up", "down"):
        for w in EXTREME_WINDOWS:
            add("limit", f"limit_{side}_count_{w}", w)
    for side in ("up", "down"):
        add("limit", f"days_since_limit_{side}", 61)
    return found


def _date_features():
    market = [("market_mean_ret_1", "ret_1")]
    market += [(f"market_median_ret_{w}", f"ret_{w}") for w in (1, 5, 20)]
    market += [("market_breadth_up", "ret_1")]
    market += [(f"market_dispersion_ret_{w}", f"ret_{w}") for w in (1, 5)]
    market += [(f"market_limit_{s}_ratio", f"flag_limit_{s}") for s in ("up", "down")]
    found = [Feature(n, "market", None, "trade_date", (d,)) for n, d in market]
    found.append(Feature("market_amount_ratio_20", "market", 20, "trade_date"))
    found += [Feature(n, "relative", None, "trade_date", (d,)) for n, d in RELATIVE_SOURCES.items()]
    found += [Feature(f"csr_{d}", "cross_section_rank", None, "trade_date", (d,)) for d in RANK_SOURCES]
    return found


FEATURES = tuple(_entity_features() + _date_features())
FULL = tuple(f.name for f in FEATURES)
ENTITY_FEATURES = tuple(f.name for f in FEATURES if f.groupby == "ts_code")
DATE_FEATURES = tuple(f.name for f in FEATURES if f.groupby == "trade_date")
CATEGORY = {f.name: f.category for f in FEATURES}
BASIC = tuple(
    [f"ret_{w}" for w in RETURN_WINDOWS] + list(CANDLES) + [f"madev_{w}" for w in MEAN_WINDOWS]
    + [f"{stem}_{w}" for stem in ("stdret", "volratio", "amtratio") for w in RATIO_WINDOWS]
    + ["gap_open", "gap_high", "gap_low", "flag_limit_up", "flag_limit_down"]
)


def rank_view_columns(existing=FULL):
    """Rank-view sources that have no rank column yet, with the name of the new column."""
    missing = [s for s in RANK_VIEW_SOURCES if f"csr_{s}" not in existing]
    return {s: s + RANK_VIEW_SUFFIX for s in missing}


def without_categories(categories, names=FULL):
    """Feature subset of an ablation run."""
    unknown = set(categories) - set(CATEGORY.values())
    if unknown:
        raise ValueError(f"unknown feature categories: {sorted(unknown)}")
    return [n for n in names if CATEGORY[n] not in categories]


def checked(df, names, keys=("ts_code", "trade_date")):
    """Select keys and features in contract order; fail on any other membership."""
    if len(set(names)) != len(names):
        raise ValueError("duplicate feature names")
    present = set(df.columns) - set(keys)
    if present != set(names):
        raise ValueError(f"features differ from the contract: {sorted(present ^ set(names))}")
    return df.select(*keys, *names)


def catalog_table(spark):
    rows = [(f.name, f.category, f.window, f.groupby, list(f.depends_on)) for f in FEATURES]
    rows += [(new, "cross_section_rank", None, "trade_date", [s]) for s, new in rank_view_columns().items()]
    return spark.createDataFrame(
        rows, "feature string, family string, window int, groupby string, depends_on array<string>")


def dependency_table(spark):
    table = catalog_table(spark)
    return table.select("feature", "family", F.explode("depends_on").alias("source"))
