"""Registered queries: a DataFrame builder each, with the same query in SQL where SQL can say it."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstide.functions.groups import measure
from crosstide.schema import DATE
from crosstide.sources.panel import bars

DECIMALS = 6
QUERIES = {}
ORACLES = {}
_SIZES = {}


def query(name, sql=None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def date_sizes(spark, folder, grain="day"):
    """Entities per date of the derived panel, measured once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, grain)
    if key not in _SIZES:
        _SIZES[key] = measure(bars(spark, folder, grain), [DATE])
    return _SIZES[key]


def shown(df, *columns):
    """Round floating columns to the six decimals that results are compared at."""
    wanted = [df.schema[c] for c in columns] if columns else list(df.schema.fields)
    return df.select(*[
        F.round(F.col(f.name), DECIMALS).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in wanted])
