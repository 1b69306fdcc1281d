"""Column names and types of the panel."""

from pyspark.sql import types as T

ENTITY = "ts_code"
DATE = "trade_date"
KEYS = [ENTITY, DATE]
PRICES = ["open", "high", "low", "close"]
FLAGS = ["flag_limit_up", "flag_limit_down"]
SOURCES = PRICES + ["vol", "amount"] + FLAGS
LABEL = "y_ret_1d"

# Tokens that a raw file may use for a missing number (fixed values).
NULL_TOKENS = ["", "NaN", "nan", "NA", "null", "NULL"]


def raw_columns(labelled):
    return KEYS + SOURCES + ([LABEL] if labelled else [])


def panel_schema(labelled):
    fields = [T.StructField(ENTITY, T.StringType(), False), T.StructField(DATE, T.IntegerType(), False)]
    fields += [T.StructField(c, T.DoubleType()) for c in raw_columns(labelled)[2:]]
    return T.StructType(fields)


PREDICTION_COLUMNS = KEYS + ["pred", LABEL, "flag_limit_up"]
PREDICTION_SCHEMA = T.StructType(
    [T.StructField(ENTITY, T.StringType()), T.StructField(DATE, T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in PREDICTION_COLUMNS[2:]]
)
