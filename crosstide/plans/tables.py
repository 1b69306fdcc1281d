"""Scans, joins, set operations, sorts and scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosstide import catalog
from crosstide.functions.custom import group_apply, group_transform
from crosstide.functions.groups import checkpoint_folder, small_side, with_positions
from crosstide.functions.guards import count_true, positive
from crosstide.operators.evaluate import calendar, top_rows
from crosstide.operators.folds import fold_table
from crosstide.operators.history import history_features
from crosstide.operators.quality import market_calendar
from crosstide.plans import runs as P
from crosstide.plans import sqltext as S
from crosstide.plans.labels import FOLDS, labelled
from crosstide.plans.registry import date_sizes, query, shown
from crosstide.plans.runs import OFFICIAL_HERE, PREDS, RUN, predictions
from crosstide.schema import DATE, ENTITY, FLAGS, KEYS, LABEL, SOURCES
from crosstide.sources import files
from crosstide.sources.panel import bars, event_bars, read_table

ROWS = "ts_code, trade_date"
PANEL = S.panel()
SPLIT = 20010101


def scratch(spark, name):
    """A new folder for one table, beside the checkpoints that the cluster shares."""
    import uuid
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def both_splits(spark, d):
    """Labelled history and unlabelled test rows, as two tables."""
    panel = labelled(spark, d)
    return panel.filter(F.col(DATE) < SPLIT), panel.filter(F.col(DATE) >= SPLIT).drop(LABEL)


# Scans and sinks.
@query("s01_strict_csv", PANEL + f" SELECT {ROWS}, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in (*SOURCES, LABEL))} FROM bars")
def s01(spark, d):
    """The panel written as text and read back under the strict contract."""
    path = scratch(spark, "panel-csv")
    labelled(spark, d).select(*KEYS, *SOURCES, LABEL).write.csv(path, header=True)
    back = files.read_panel_csv(spark, path, True)
    return back.select(*KEYS, *[F.round(c, 8).alias(c) for c in (*SOURCES, LABEL)])  # a price has up to seven decimals


@query("s02_pruned_scan", "SELECT l_suppkey, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS day, l_quantity FROM lineitem WHERE l_discount >= 0.1")
def s02(spark, d):
    lines = read_table(spark, d, "lineitem").filter(F.col("l_discount") >= 0.1)
    return lines.select("l_suppkey", F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("day"), "l_quantity")


@query("s03_feature_scan", S.history(["ret_1", "madev_5"]) + f" SELECT {ROWS}, {S.rounded('ret_1', 'madev_5')} FROM features WHERE trade_date BETWEEN 19990101 AND 20000630")
def s03(spark, d):
    path = scratch(spark, "features")
    df = history_features(bars(spark, d), ["ret_1", "madev_5", "stdret_5"])
    files.write_features(df.withColumn("split", F.when(F.col(DATE) < SPLIT, "train").otherwise("test")), path)
    return shown(files.read_features(spark, path, ["ret_1", "madev_5"], 19990101, 20000630))


def _stored_predictions(spark, d):
    path = scratch(spark, "predictions")
    df = predictions(spark, d).withColumn("pred", F.col("pred_a"))
    files.write_predictions_csv(df, path)
    return df, files.read_predictions_csv(spark, path), path


@query("s04_prediction_scan", PREDS + f" SELECT {ROWS}, round(pred_a, 6) + 0.0 AS pred, {S.rounded(LABEL, 'flag_limit_up')} FROM preds")
def s04(spark, d):
    return shown(_stored_predictions(spark, d)[1])


@query("s05_prediction_sink", PREDS + " SELECT count(*) AS rows, 0::BIGINT AS changed FROM preds")
def s05(spark, d):
    """Rows that do not survive the text round trip bit by bit (none may)."""
    df, back, _ = _stored_predictions(spark, d)
    back = back.select(*KEYS, F.col("pred").alias("_pred"), F.col(LABEL).alias("_label"))
    joined = df.join(back, KEYS, "left")
    return joined.agg(F.count(F.lit(1)).alias("rows"), count_true(
        ~F.col("pred").eqNullSafe(F.col("_pred")) | ~F.col(LABEL).eqNullSafe(F.col("_label"))).alias("changed"))


@query("s06_feature_sink", S.history(["ret_5"]) + """ SELECT CASE WHEN trade_date < 20010101 THEN 'train' ELSE 'test' END AS split,
  CAST(trade_date // 10000 AS INTEGER) AS year, count(*) AS rows, count(ret_5) AS present FROM features GROUP BY ALL""")
def s06(spark, d):
    path = scratch(spark, "features")
    df = history_features(bars(spark, d), catalog.ENTITY_FEATURES)
    files.write_features(df.withColumn("split", F.when(F.col(DATE) < SPLIT, "train").otherwise("test")), path)
    return spark.read.parquet(path).groupBy("split", "year").agg(F.count(F.lit(1)).alias("rows"), F.count("ret_5").alias("present"))


@query("s07_experiment_log", PANEL + f""", {S.FOLD_STEPS}, counts AS (SELECT fold, count(*) FILTER (role = 'train' AND NOT purged AND y_ret_1d IS NOT NULL) AS train_rows,
  count(*) FILTER (role = 'valid') AS valid_rows FROM purged GROUP BY fold)
  SELECT 'identity' AS experiment, fold, 'done' AS status, train_rows, valid_rows, NULL::DOUBLE AS final_score FROM counts CROSS JOIN range(2)""")
def s07(spark, d):
    from crosstide.operators.folds import fold_summary
    path = scratch(spark, "log")
    rows = fold_summary(labelled(spark, d), FOLDS).select(
        F.lit("identity").alias("experiment"), "fold", F.lit("done").alias("status"), "train_rows", "valid_rows",
        F.lit(None).cast("double").alias("final_score"))
    for _ in range(2):
        files.append_log(rows, path)
    return spark.read.parquet(path)


@query("s08_json_summary", PANEL + " SELECT trade_date, count(*) AS rows, round(avg(y_ret_1d), 6) + 0.0 AS mean_label FROM bars GROUP BY trade_date")
def s08(spark, d):
    path = scratch(spark, "summary")
    days = labelled(spark, d).groupBy(DATE).agg(F.count(F.lit(1)).alias("rows"), F.avg(LABEL).alias("mean_label"))
    files.write_json(days.withColumn("mean_label", F.coalesce("mean_label", F.lit(float("nan")))), path)
    return shown(spark.read.schema("trade_date int, rows long, mean_label double").json(path))


@query("s09_evaluation_split", PREDS + f""" SELECT 'submission' AS part, {ROWS}, round(pred_a, 6) + 0.0 AS value FROM preds
  UNION ALL SELECT 'label', {ROWS}, round(y_ret_1d, 6) + 0.0 FROM preds UNION ALL SELECT 'flag', {ROWS}, flag_limit_up FROM preds""")
def s09(spark, d):
    parts = files.evaluation_inputs(predictions(spark, d).withColumn("pred", F.col("pred_a")))
    named = [t.select(F.lit(n).alias("part"), *KEYS, F.col(c).alias("value"))
             for t, n, c in zip(parts, ("submission", "label", "flag"), ("pred", LABEL, "flag_limit_up"))]
    return shown(named[0].unionByName(named[1]).unionByName(named[2]))


@query("s10_submission", PREDS + f" SELECT {ROWS}, round(pred_a, 6) + 0.0 AS pred FROM preds")
def s10(spark, d):
    path = scratch(spark, "submission")
    df = predictions(spark, d).withColumn("pred", F.col("pred_a"))
    files.write_submission(files.submission(df, bars(spark, d)), path)
    return shown(spark.read.csv(path, header=True, schema="ts_code string, trade_date int, pred double"))


@query("s11_file_manifest")
def s11(spark, d):
    return files.file_manifest(spark, d)


@query("s12_fingerprint")
def s12(spark, d):
    panel = labelled(spark, d)
    return files.fingerprint(panel.withColumn("year", F.floor(F.col(DATE) / 10000).cast("int")), [*KEYS, "vol", LABEL], ["year"])


_NEEDED = [(f.name, f.category, s) for f in catalog.FEATURES for s in f.depends_on]
_NEEDED += [(new, "cross_section_rank", s) for s, new in catalog.rank_view_columns().items()]
_NEEDED_SOURCES = list(dict.fromkeys(s for *_, s in _NEEDED))


@query("s13_feature_catalog", S.history(_NEEDED_SOURCES) + ", listed AS (SELECT [" + ", ".join(f"count({s})" for s in _NEEDED_SOURCES) + "] AS n FROM features), "
       f"counts AS (SELECT unnest({_NEEDED_SOURCES}) AS source, unnest(n) AS present FROM listed), "
       f"needed(feature, family, source) AS (VALUES {', '.join(map(str, _NEEDED))}) SELECT feature, family, source, present FROM needed JOIN counts USING (source)")
def s13(spark, d):
    """Catalog rows, their dependencies, and how many panel rows have each source feature."""
    df = history_features(bars(spark, d), _NEEDED_SOURCES)
    counts = df.agg(F.array(*[F.struct(F.lit(s).alias("source"), F.count(s).alias("present")) for s in _NEEDED_SOURCES]).alias("_c"))
    counts = counts.select(F.explode("_c").alias("_c")).select("_c.*")
    return catalog.dependency_table(spark).join(F.broadcast(counts), "source", "left")


# Joins.
@query("j01_three_way_join", PREDS.replace("bars AS (", "bars AS MATERIALIZED (").replace("preds AS (", "preds AS MATERIALIZED (") + f" SELECT p.ts_code, p.trade_date, {', '.join('round(p.' + c + ', 6) + 0.0 AS ' + c for c in ('pred_a', 'y_ret_1d'))}, b.flag_limit_up FROM preds p JOIN bars b USING ({ROWS}) WHERE p.y_ret_1d IS NOT NULL")
def j01(spark, d):
    pred, label, flag = files.evaluation_inputs(predictions(spark, d).withColumn("pred", F.col("pred_a")))
    joined = pred.join(label.filter(F.col(LABEL).isNotNull()), KEYS).join(flag, KEYS)
    return shown(joined.withColumnRenamed("pred", "pred_a"), *KEYS, "pred_a", LABEL, "flag_limit_up")


@query("j02_validated_left_join", PREDS + f" SELECT p.ts_code, p.trade_date, {S.rounded('pred_a')}, b.vol FROM preds p LEFT JOIN bars b USING ({ROWS})")
def j02(spark, d):
    from crosstide.operators.quality import require_unique
    raw = require_unique(bars(spark, d).select(*KEYS, "vol"))
    joined = predictions(spark, d).select(*KEYS, "pred_a").join(raw, KEYS, "left")
    return shown(files.require_present(joined, "vol"))


@query("j03_two_model_join", PREDS + f" SELECT {ROWS}, round(pred_a, 6) + 0.0 AS pred_left, round(pred_b, 6) + 0.0 AS pred_right FROM preds")
def j03(spark, d):
    df = predictions(spark, d)
    left = df.select(*KEYS, F.col("pred_a").alias("pred_left"))
    right = df.select(*KEYS, F.col("pred_b").alias("pred_right"))
    return shown(files.require_same_keys(left, right).join(right, KEYS))


@query("j04_key_parity", PANEL + f""", l AS (SELECT {ROWS} FROM bars WHERE flag_limit_up = 0), r AS (SELECT {ROWS} FROM bars WHERE flag_limit_down = 0)
  SELECT 'left' AS side, {ROWS} FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'right', {ROWS} FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def j04(spark, d):
    panel = bars(spark, d)
    left, right = (panel.filter(F.col(f) == 0).select(*KEYS) for f in FLAGS)
    only = lambda a, b, side: a.join(b, KEYS, "left_anti").select(F.lit(side).alias("side"), *KEYS)
    return only(left, right, "left").unionByName(only(right, left, "right"))


@query("j05_date_lookup", PANEL + f", days AS (SELECT trade_date, count(*) AS day_rows, sum(vol) AS day_vol FROM bars GROUP BY trade_date) SELECT {ROWS}, vol, day_rows, day_vol FROM bars JOIN days USING (trade_date)")
def j05(spark, d):
    panel = bars(spark, d)
    days = panel.groupBy(DATE).agg(F.count(F.lit(1)).alias("day_rows"), F.sum("vol").alias("day_vol"))
    return panel.select(*KEYS, "vol").join(small_side(days, date_sizes(spark, d)), DATE)


@query("j07_fold_interval_join", PANEL + f""", {S.FOLD_VALUES} SELECT fold, trade_date // 10000 AS year, count(*) AS rows,
  count(*) FILTER (trade_date BETWEEN valid_start AND valid_end) AS valid_rows FROM bars JOIN folds ON trade_date BETWEEN train_start AND valid_end GROUP BY 1, 2""")
def j07(spark, d):
    inside = F.col(DATE).between(F.col("train_start"), F.col("valid_end"))
    rows = bars(spark, d).select(DATE).join(fold_table(spark, FOLDS), inside)
    return rows.groupBy("fold", F.floor(F.col(DATE) / 10000).cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), count_true(F.col(DATE).between(F.col("valid_start"), F.col("valid_end"))).alias("valid_rows"))


@query("j09_key_overlap", PANEL + f" SELECT (SELECT count(*) FROM bars WHERE flag_limit_up = 1) AS left_rows, (SELECT count(*) FROM bars WHERE flag_limit_down = 1) AS right_rows, "
       "count(*) AS common_keys FROM bars WHERE flag_limit_up = 1 AND flag_limit_down = 1")
def j09(spark, d):
    panel = bars(spark, d)
    left, right = (panel.filter(F.col(f) == 1).select(*KEYS) for f in FLAGS)
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    return n(left, "left_rows").crossJoin(F.broadcast(n(right, "right_rows"))).crossJoin(
        F.broadcast(n(left.join(right, KEYS, "left_semi"), "common_keys")))


@query("j10_membership_filter", PANEL + f", hot AS (SELECT trade_date FROM bars GROUP BY trade_date HAVING sum(flag_limit_up) >= 3) "
       f"SELECT {ROWS}, trade_date IN (SELECT trade_date FROM hot) AS hot_date FROM bars WHERE flag_limit_down = 1")
def j10(spark, d):
    panel = bars(spark, d)
    hot = panel.groupBy(DATE).agg(F.sum("flag_limit_up").alias("n")).filter(F.col("n") >= 3).select(DATE)
    rows, side = panel.filter(F.col("flag_limit_down") == 1).select(*KEYS), small_side(hot, date_sizes(spark, d))
    inside = rows.join(side, DATE, "left_semi").withColumn("hot_date", F.lit(True))
    return inside.unionByName(rows.join(side, DATE, "left_anti").withColumn("hot_date", F.lit(False)))


@query("j11_previous_date_join", P.RUNS + P.scored_sql("runs", RUN) + """ SELECT a.model, a.fold, a.trade_date, count(*) AS kept FROM members a
  JOIN members b ON a.model = b.model AND a.fold = b.fold AND a.ts_code = b.ts_code AND a.day = b.day + 1 GROUP BY ALL""")
def j11(spark, d):
    df, sizes = P.runs(spark, d), date_sizes(spark, d)
    days = calendar(df, RUN).select(*RUN, DATE, "day")
    tops = top_rows(df, OFFICIAL_HERE, RUN, sizes).select(*RUN, *KEYS).join(days, [*RUN, DATE])
    before = tops.select(*RUN, ENTITY, (F.col("day") + 1).alias("day"))
    return tops.join(before, [*RUN, ENTITY, "day"]).groupBy(*RUN, DATE).agg(F.count(F.lit(1)).alias("kept"))


# Sets and sorts.
SPLITS = PANEL + """, train AS (SELECT DISTINCT ts_code, trade_date FROM bars WHERE trade_date < 20010101 AND ts_code <> '000003.SZ'),
  test AS (SELECT DISTINCT ts_code, trade_date FROM bars WHERE trade_date >= 20000601 AND ts_code <> '000005.SZ')"""


def _overlapping(spark, d):
    """Two splits that share some dates and differ in two entities."""
    panel = bars(spark, d).select(*KEYS)
    return (panel.filter((F.col(DATE) < SPLIT) & (F.col(ENTITY) != "000003.SZ")),
            panel.filter((F.col(DATE) >= 20000601) & (F.col(ENTITY) != "000005.SZ")))


@query("x01_entities_in_one_split", SPLITS + """ SELECT 'train' AS side, ts_code FROM (SELECT ts_code FROM train EXCEPT SELECT ts_code FROM test)
  UNION ALL SELECT 'test', ts_code FROM (SELECT ts_code FROM test EXCEPT SELECT ts_code FROM train)""")
def x01(spark, d):
    a, b = (t.select(ENTITY) for t in _overlapping(spark, d))
    side = lambda t, n: t.select(F.lit(n).alias("side"), ENTITY)
    return side(a.subtract(b), "train").unionByName(side(b.subtract(a), "test"))


@query("x02_common_dates", SPLITS + " SELECT trade_date FROM train INTERSECT SELECT trade_date FROM test")
def x02(spark, d):
    a, b = (t.select(DATE) for t in _overlapping(spark, d))
    return a.intersect(b)


@query("x03_split_union", PANEL + f" SELECT CASE WHEN trade_date < 20010101 THEN 'train' ELSE 'test' END AS split, {ROWS}, round(CASE WHEN trade_date < 20010101 THEN y_ret_1d END, 6) + 0.0 AS y_ret_1d FROM bars")
def x03(spark, d):
    train, test = both_splits(spark, d)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    return shown(both, "split", *KEYS, LABEL)


@query("x04_set_equality", SPLITS + """ SELECT (SELECT count(*) FROM (SELECT ts_code FROM train EXCEPT SELECT ts_code FROM test)) AS only_train,
  (SELECT count(*) FROM (SELECT ts_code FROM test EXCEPT SELECT ts_code FROM train)) AS only_test,
  NOT EXISTS (SELECT ts_code FROM train EXCEPT SELECT ts_code FROM test) AND NOT EXISTS (SELECT ts_code FROM test EXCEPT SELECT ts_code FROM train) AS equal""")
def x04(spark, d):
    a, b = (t.select(ENTITY) for t in _overlapping(spark, d))
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    both = n(a.subtract(b), "only_train").crossJoin(F.broadcast(n(b.subtract(a), "only_test")))
    return both.withColumn("equal", (F.col("only_train") == 0) & (F.col("only_test") == 0))


@query("x05_union_calendar", SPLITS + " SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS day FROM (SELECT trade_date FROM train UNION SELECT trade_date FROM test)")
def x05(spark, d):
    a, b = _overlapping(spark, d)
    return market_calendar(a.unionByName(b)).select(DATE, F.col("day").cast("long"))


@query("o01_key_sort", PANEL + f" SELECT {ROWS}, vol FROM bars ORDER BY ts_code, trade_date")
def o01(spark, d):
    return bars(spark, d).select(*KEYS, "vol").orderBy(*KEYS)


@query("o02_mixed_sort", PREDS + f", p AS (SELECT {ROWS}, row_number() OVER (PARTITION BY trade_date ORDER BY pred_a DESC, ts_code) AS place FROM preds) SELECT {ROWS}, place FROM p")
def o02(spark, d):
    order = [F.col("pred_a").desc_nulls_last(), F.col(ENTITY).asc()]
    placed = with_positions(predictions(spark, d), [DATE], order, date_sizes(spark, d))
    return placed.orderBy(DATE, *order).select(*KEYS, (F.col("_before") + 1).alias("place"))


@query("o03_top_per_date", PREDS + f", p AS (SELECT {ROWS}, row_number() OVER (PARTITION BY trade_date ORDER BY pred_b DESC, ts_code) AS place FROM preds) SELECT {ROWS}, place FROM p WHERE place <= 3")
def o03(spark, d):
    order = [F.col("pred_b").desc_nulls_last(), F.col(ENTITY).asc()]
    placed = with_positions(predictions(spark, d), [DATE], order, date_sizes(spark, d))
    return placed.filter(F.col("_before") < 3).select(*KEYS, (F.col("_before") + 1).alias("place"))


# Scalars.
@query("n01_math_scalars", PANEL + f""" SELECT {ROWS}, round(ln(vol), 6) + 0.0 AS ln_vol, round(ln(1 + amount), 6) + 0.0 AS log1p_amount, round(sqrt(vol), 6) + 0.0 AS sqrt_vol,
  round(abs(y_ret_1d), 6) + 0.0 AS abs_y, round(power(y_ret_1d, 2), 6) + 0.0 AS squared_y, CAST(floor(y_ret_1d * 10) AS BIGINT) AS floor_y, CAST(ceil(y_ret_1d * 10) AS BIGINT) AS ceil_y,
  CAST(sign(y_ret_1d) AS DOUBLE) AS sign_y, round(least(greatest(y_ret_1d, -0.1), 0.1), 6) + 0.0 AS clipped_y FROM bars WHERE y_ret_1d IS NOT NULL""")
def n01(spark, d):
    y = F.col(LABEL)
    df = labelled(spark, d).filter(y.isNotNull())
    return shown(df.select(*KEYS, F.ln(positive("vol")).alias("ln_vol"), F.log1p("amount").alias("log1p_amount"), F.sqrt("vol").alias("sqrt_vol"),
                           F.abs(y).alias("abs_y"), F.pow(y, 2).alias("squared_y"), F.floor(y * 10).alias("floor_y"), F.ceil(y * 10).alias("ceil_y"),
                           F.signum(y).alias("sign_y"), F.least(F.greatest(y, F.lit(-0.1)), F.lit(0.1)).alias("clipped_y")))


@query("n02_text_and_dates", PANEL + """ SELECT DISTINCT trade_date, strftime(strptime(CAST(trade_date AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS day,
  CAST(replace(strftime(strptime(CAST(trade_date AS VARCHAR), '%Y%m%d'), '%Y-%m-%d'), '-', '') AS INTEGER) AS parsed_back,
  regexp_matches(CAST(trade_date AS VARCHAR), '^1999') AS in_1999 FROM bars""")
def n02(spark, d):
    days = bars(spark, d).select(DATE).distinct().withColumn("day", F.to_date(F.col(DATE).cast("string"), "yyyyMMdd"))
    iso = F.date_format("day", "yyyy-MM-dd")
    return days.select(DATE, iso.alias("day"), F.regexp_replace(iso, "-", "").cast("int").alias("parsed_back"),
                       F.col(DATE).cast("string").rlike("^1999").alias("in_1999"))


@query("n03_array_scalars", """WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_extendedprice, l_partkey) AS a, list(l_suppkey ORDER BY l_extendedprice, l_partkey) AS b FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, array_to_string(list_filter(list_distinct_ordered, lambda x: list_contains(b, x)), ',') AS both_sides, array_to_string(list_slice(list_distinct_ordered, 1, 3), ',') AS first_three,
  list_contains(a, l_orderkey % 100) AS has_code FROM (SELECT *, list_transform(list_filter(list_transform(a, lambda x, i: {'x': x % 100, 'first': list_position(list_transform(a, lambda z: z % 100), x % 100) = i}),
  lambda s: s['first']), lambda s: s['x']) AS list_distinct_ordered FROM o)""")
def n03(spark, d):
    """Array functions on an order's lines (at most seven line numbers; duplicates repeat a few)."""
    lines = read_table(spark, d, "lineitem")
    packed = F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_partkey", "l_suppkey")))
    orders = lines.groupBy("l_orderkey").agg(packed.alias("s"))
    codes = F.array_distinct(F.transform(F.col("s")["l_partkey"], lambda x: x % 100))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return orders.select("l_orderkey", text(F.array_intersect(codes, F.col("s")["l_suppkey"])).alias("both_sides"),
                         text(F.slice(F.array_union(codes, codes), 1, 3)).alias("first_three"),
                         F.array_contains(F.col("s")["l_partkey"], F.col("l_orderkey") % 100).alias("has_code"))


@query("n04_nested_json", PANEL + """, placed AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY vol DESC, trade_date) AS k FROM bars)
  SELECT ts_code, CAST(to_json(list({'trade_date': trade_date, 'vol': vol} ORDER BY trade_date, vol)) AS VARCHAR) AS samples FROM placed WHERE k <= 3 GROUP BY ts_code""")
def n04(spark, d):
    panel = bars(spark, d).select(*KEYS, "vol", "flag_limit_up")
    top = F.row_number().over(Window.partitionBy(ENTITY).orderBy(F.desc("vol"), DATE))
    samples = panel.withColumn("_k", top).filter(F.col("_k") <= 3)
    return samples.groupBy(ENTITY).agg(F.to_json(F.sort_array(F.collect_list(F.struct(DATE, "vol")))).alias("samples"))


@query("uf1_named_transform", PANEL + f", m AS (SELECT trade_date, median(vol) AS median_vol, max(amount) - min(amount) AS amount_range FROM bars GROUP BY trade_date) "
       f"SELECT {ROWS}, {S.rounded('median_vol', 'amount_range')} FROM bars JOIN m USING (trade_date)")
def uf1(spark, d):
    panel = bars(spark, d).select(*KEYS, "vol", "amount")
    out = group_transform(panel, "vol", "median", [DATE], "median_vol")
    out = group_transform(out, "amount", lambda c: F.max(c) - F.min(c), [DATE], "amount_range")
    return shown(out, *KEYS, "median_vol", "amount_range")


@query("uf1_custom_group", PANEL + """, moves AS (SELECT ts_code, trade_date, coalesce(close > lag(close) OVER e, false) AS up FROM bars WINDOW e AS (PARTITION BY ts_code ORDER BY trade_date)),
  islands AS (SELECT ts_code, up, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS island FROM moves),
  rises AS (SELECT ts_code, island, count(*) FILTER (up) AS n FROM islands GROUP BY ALL)
  SELECT ts_code, max(n) AS longest FROM rises GROUP BY ts_code""")
def uf1_custom(spark, d):
    """Longest rise of each entity with pandas code; a group is one entity, one row per date."""
    def longest_rise(frame):
        frame = frame.sort_values(DATE)
        up = (frame["close"].diff() > 0).astype(int)
        streak = up.groupby((up == 0).cumsum()).cumsum()
        return frame[[ENTITY]].head(1).assign(longest=int(streak.max()))
    return group_apply(bars(spark, d).select(*KEYS, "close"), longest_rise, [ENTITY], "ts_code string, longest long")


@query("s03_event_bars", """WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS vol, sum(value) AS amount FROM events GROUP BY 1, 2)
  SELECT printf('%06d.EV', user_id) AS ts_code, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS trade_date, open, high, low, close, vol, round(amount, 4) + 0.0 AS amount FROM g""")
def event_panel(spark, d):
    return event_bars(spark, d).select(*KEYS, "open", "high", "low", "close", "vol", F.round("amount", 4).alias("amount"))
