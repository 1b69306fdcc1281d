"""Per-entity window features, one query per operator."""

from crosstide import catalog
from crosstide.operators.history import history_features
from crosstide.plans import sqltext as S
from crosstide.plans.registry import query, shown
from crosstide.schema import KEYS
from crosstide.sources.panel import bars

R = catalog.RATIO_WINDOWS
X = catalog.EXTREME_WINDOWS

# Price-range shapes are mostly degenerate on daily bars (one shipment a day), so those read months.
FAMILIES = {
    "w01_lag_return": ("day", [f"ret_{w}" for w in catalog.RETURN_WINDOWS]),
    "w02_candle_shape": ("month", list(catalog.CANDLES)),
    "w03_gap": ("day", ["gap_open", "gap_high", "gap_low"]),
    "w04_ma_deviation": ("day", [f"madev_{w}" for w in catalog.MEAN_WINDOWS]),
    "w05_return_std": ("day", [f"stdret_{w}" for w in R]),
    "w06_ratio_to_mean": ("day", [f"{s}_{w}" for s in ("volratio", "amtratio") for w in (3, *R)]),
    "w07_flags": ("day", ["flag_limit_up", "flag_limit_down"]),
    "w08_return_spread": ("day", ["ret_5_minus_20", "ret_20_minus_60"]),
    "w09_ema_deviation": ("day", [f"emadev_{w}" for w in R]),
    "w10_ols_slope": ("day", [f"slope_{w}" for w in R]),
    "w11_ols_r2": ("day", [f"rsq_{w}" for w in R]),
    "w12_stochastic": ("month", [f"rsv_{w}" for w in R]),
    "w13_extreme_distance": ("day", [f"{s}_{w}" for s in ("distmax", "distmin") for w in X]),
    "w14_ma_ratio": ("day", [f"ma_{a}_over_{b}" for a, b in catalog.MA_PAIRS]),
    "w15_downside_volatility": ("day", [f"downvol_{w}" for w in R]),
    "w16_parkinson": ("month", [f"parkinson_{w}" for w in R]),
    "w17_garman_klass": ("month", [f"gkvol_{w}" for w in R]),
    "w18_true_range": ("month", [f"atr_{w}" for w in R]),
    "w19_log_change": ("day", [f"{s}_{w}" for s in ("volchg", "amtchg") for w in catalog.CHANGE_WINDOWS]),
    "w20_log_std": ("day", [f"{s}_{w}" for s in ("logvol_std", "logamt_std") for w in X]),
    "w21_paired_correlation": ("day", [f"corr_ret_dlog{s}_{w}" for s in ("vol", "amt") for w in (5, 20)]),
    "w22_illiquidity": ("day", ["illiq_1"]),
    "w23_rolling_illiquidity": ("day", [f"illiq_{w}" for w in X]),
    "w24_event_count": ("day", [f"limit_{s}_count_{w}" for s in ("up", "down") for w in X]),
    "w25_rows_since_event": ("day", ["days_since_limit_up", "days_since_limit_down"]),
}


def _register(name, grain, features):
    sql = S.history(features, grain) + f" SELECT ts_code, trade_date, {S.rounded(*features)} FROM features"
    query(name, sql)(lambda spark, d: shown(history_features(bars(spark, d, grain), features, placed=True), *KEYS, *features))


for _name, (_grain, _features) in FAMILIES.items():
    _register(_name, _grain, _features)
