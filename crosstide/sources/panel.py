"""Panels derived from the given tables, one row per (entity, date)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide.functions.groups import measure, spread
from crosstide.functions.guards import finite, ratio
from crosstide.schema import DATE, ENTITY, KEYS, LABEL, PRICES, SOURCES

_LINES = {}


def read_table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entity_window():
    return Window.partitionBy(ENTITY).orderBy(DATE)


def forward_return(close="close"):
    """Return to the next observed row of the same entity."""
    return ratio(F.lead(close).over(entity_window()), close) - 1


def entity_code(key, suffix):
    """The key with six digits at least and the suffix."""
    digits = F.lpad(F.col(key).cast("string"), 6, "0")
    return F.when(F.col(key).between(0, 999_999), F.concat(digits, F.lit(suffix))).otherwise(F.format_string(f"%06d{suffix}", key))


def date_number(day):
    return (F.year(day) * 10_000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def lines_of_suppliers(spark, folder):
    """Lines of the largest supplier, measured once per session and folder; they decide the plan only."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LINES:
        _LINES[key] = measure(read_table(spark, folder, "lineitem"), ["l_suppkey"])
    return _LINES[key]


def bars(spark, folder, grain="day", labelled=False):
    """OHLCV bars of each supplier's shipments; a line's price is its extended price per unit.

    An entity's rows lie in one partition, in date order. Lines go there at once, and one sort serves the bars and the windows over them;
    suppliers with more lines than a task should sort are reduced to bars before that."""
    lines = read_table(spark, folder, "lineitem")
    start = F.col("l_shipdate") if grain == "day" else F.date_trunc(grain, "l_shipdate")
    lines = lines.select(entity_code("l_suppkey", ".SZ").alias(ENTITY), start.alias("start"), "l_orderkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").alias("returned"))
    together = lines_of_suppliers(spark, folder).fits
    lines = (spread(lines, ENTITY) if together else lines).select(
        ENTITY, date_number("start").alias(DATE), "start", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ord"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "returned")
    grouped = lines.groupBy(ENTITY, DATE, "start").agg(
        F.min_by("px", "ord").alias("open"), F.max("px").alias("high"),
        F.min("px").alias("low"), F.max_by("px", "ord").alias("close"),
        F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"),
        F.max((F.col("l_discount") >= 0.10).cast("double")).alias("flag_limit_up"),
        F.max((F.col("l_tax") >= 0.08).cast("double")).alias("flag_limit_down"),
        F.bool_and("returned").alias("void"),
    )
    grouped = grouped if together else spread(grouped, ENTITY)
    shown = ~(F.col("void") & (F.dayofmonth("start") == 15))
    panel = grouped.select(
        *KEYS,
        *[F.when(shown, finite(p)).alias(p) for p in PRICES],
        *[finite(c).alias(c) for c in SOURCES[4:]],
    )
    return panel.withColumn(LABEL, forward_return()) if labelled else panel


def event_bars(spark, folder):
    """Daily bars of each user's event values."""
    events = read_table(spark, folder, "events")
    order = F.struct("ts", "event_id")
    grouped = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("vol"), F.sum("value").alias("amount"),
        F.max((F.col("event_type") == "purchase").cast("double")).alias("flag_limit_up"),
        F.max((F.col("event_type") == "error").cast("double")).alias("flag_limit_down"),
    )
    return grouped.select(
        F.format_string("%06d.EV", "user_id").alias(ENTITY),
        F.date_format("day", "yyyyMMdd").cast("int").alias(DATE), *SOURCES,
    )
