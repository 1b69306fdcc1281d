"""Turnover control: daily rank, causal smoothing, and a top set with hysteresis.

Smoothing and hysteresis are recurrences, so their groups are ordered.  A smoothing group is one
entity of one run: at most one row per date; all entities of a task take each step together.  A hysteresis group is one run between two resets;
it is folded in one task only while its row bound is small, and date by date with distributed
cuts beyond that.
"""

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.functions.groups import checkpoint_folder, measure, pinned, row_limit, with_positions
from crosstide.operators import day_kernel
from crosstide.operators.cross import percent_ranks
from crosstide.operators.evaluate import score, summed, tradable
from crosstide.schema import DATE, ENTITY, KEYS


def daily_rank(df, run=(), sizes=None, pred="pred", out="rank"):
    return percent_ranks(df, {pred: out}, sizes, by=run)


def _smoother(alphas, value, group, out, wide=False):
    """The exponential recursion over sorted rows, for all entities of a batch and all weights at once.

    ``wide`` gives a row one column a weight; otherwise it is repeated for every weight.

    Step t handles the t-th row of every entity; an entity that goes on in the next batch takes its last values with it."""
    weights = np.array(alphas)

    def same_as_before(batch):
        same = np.ones(len(batch) - 1, bool)
        for c in group:
            column = batch.column(c)
            same &= pc.equal(column[1:], column[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        return same

    def run(batches):
        key, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            if np.isnan(x).any():
                raise ValueError("smoothing needs a rank in every row")
            now = tuple(batch.column(c)[0].as_py() for c in group)
            begins = np.append(True, ~same_as_before(batch)) if len(batch) > 1 else np.array([True])
            y = np.empty((len(x), len(weights)))
            first = np.flatnonzero(begins)
            before = np.full((len(first), len(weights)), np.nan)
            if "prior" in batch.schema.names:
                before[:] = batch.column("prior").cast(pa.float64()).to_numpy(zero_copy_only=False)[first, None]
            if now == key:
                before[0] = last
            start = x[first, None]
            y[first] = np.where(np.isnan(before), start, weights * start + (1 - weights) * before)
            place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(1, place.max() + 2))
            for a, b in zip(ends[:-1], ends[1:]):
                at = order[a:b]
                y[at] = weights * x[at, None] + (1 - weights) * y[at - 1]
            key, last = tuple(batch.column(c)[len(batch) - 1].as_py() for c in group), y[-1]
            if wide:
                done = batch.select(out)
                for j in range(len(alphas)):
                    done = done.append_column(f"smooth_{j}", pa.array(np.ascontiguousarray(y[:, j])))
                yield done
                continue
            for j, alpha in enumerate(alphas):
                done = batch.select(out).append_column("alpha", pa.array(np.full(len(x), alpha)))
                yield done.append_column("smooth", pa.array(np.ascontiguousarray(y[:, j])))
    return run


def causal_ema(df, alphas, run=(), value="rank", prior=None, keep=(), wide=False):
    """Smoothed value per run, entity, date and alpha, beside the columns named in ``keep``; ``wide``: one row with smooth_0, smooth_1, ...

    ``prior`` optionally gives each entity's last smoothed value from earlier dates. One exchange by entity; a task streams its sorted rows.
    """
    if any(not 0 < a <= 1 for a in alphas):
        raise ValueError("alpha must be in (0, 1]")
    keys = list(dict.fromkeys([*run, *KEYS, *keep]))
    rows = df.select(*keys, *([] if value in keys else [value]))
    if prior is not None:
        rows = rows.join(prior.select(*run, ENTITY, F.col("smooth").alias("prior")), [*run, ENTITY], "left")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = [f"smooth_{j}" for j in range(len(alphas))] if wide else ["alpha", "smooth"]
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{c} double" for c in made]])
    dealt = rows.repartition(*run, ENTITY).sortWithinPartitions(*run, ENTITY, DATE)
    return dealt.mapInArrow(_smoother([float(a) for a in alphas], value, [*run, ENTITY], keys, wide), schema)


def exit_band(df, exits, run=(), min_pool=100, sizes=None):
    """Tradable rows that can be held at each exit fraction, best first.

    Adds ``place``, ``pool``, ``top_size`` and ``stretch``, which counts the dates with too few
    tradable rows so far: such a date empties the set, so stretches are independent.
    """
    by = [*run, DATE]
    placed = with_positions(df.filter(tradable()), by, [F.col("smooth").desc(), F.col(ENTITY).asc()], sizes,
                            before="place", total="pool")
    placed = placed.withColumns({"place": F.col("place") + 1, "top_size": F.greatest(F.floor(F.col("pool") / 10), F.lit(1))})
    pools = df.groupBy(*by).agg(F.count(F.when(tradable(), F.lit(1))).alias("_n"))
    thin = F.sum((F.col("_n") < min_pool).cast("long")).over(Window.partitionBy(*run).orderBy(DATE))
    pools = pools.withColumn("stretch", thin).filter(F.col("_n") >= min_pool).drop("_n")
    banded = placed.join(pools, by).withColumn("exit_fraction", F.explode(F.array(*[F.lit(float(e)) for e in exits])))
    widest = F.greatest(F.floor(F.col("pool") * F.col("exit_fraction")), F.col("top_size"))
    return banded.filter(F.col("place") <= widest)


def _holder(keys):
    """Walk the dates of one stretch: keep members inside the band, then fill from the top."""
    def hold(frame):
        frame = frame.sort_values([DATE, "place"], kind="stable").reset_index(drop=True)
        codes, names = pd.factorize(frame[ENTITY])
        held, chosen = np.zeros(len(names), dtype=bool), np.zeros(len(frame), dtype=bool)
        dates = frame[DATE].to_numpy()
        edges = np.flatnonzero(np.r_[True, dates[1:] != dates[:-1], True])
        size = frame["top_size"].to_numpy()
        for start, end in zip(edges[:-1], edges[1:]):
            day, k = codes[start:end], int(size[start])
            stay = held[day]
            order = np.r_[np.flatnonzero(stay), np.flatnonzero(~stay)][:k]
            held[:] = False
            held[day[order]] = True
            chosen[start + order] = True
        return frame.loc[chosen, keys]
    return hold


def hysteresis_sets(band, run=(), group_rows=None):
    """Chosen members as rows (run, exit_fraction, date, entity).

    ``group_rows`` is an upper bound on the band rows of one stretch; measured when absent.
    """
    group = [*run, "exit_fraction", "stretch"]
    if group_rows is None:
        group_rows = measure(band, group).largest
    keys = [*run, "exit_fraction", *KEYS]
    if group_rows <= row_limit(band.sparkSession):
        types = {f.name: f.dataType.simpleString() for f in band.schema.fields}
        rows = band.select(*group, *KEYS, "place", "top_size")
        return rows.groupBy(*group).applyInPandas(_holder(keys), ", ".join(f"{k} {types[k]}" for k in keys))
    return _sets_by_date(band, run)


def _sets_by_date(band, run):
    """The same walk with one distributed cut per date: members first, then the best of the rest.

    The band is stored by date, so a turn reads one date of it and the members of the turn before.
    A stretch's members are dropped after its last date.  Only the list of dates reaches the driver.
    """
    spark, group = band.sparkSession, [*run, "exit_fraction", "stretch"]
    rows = pinned(band.select(*group, *KEYS, "place", "top_size"))
    days = [r[0] for r in rows.select(DATE).distinct().orderBy(DATE).collect()]
    keys = [*run, "exit_fraction", *KEYS]
    if not days:
        return rows.select(*keys)
    root, sizes = f"{checkpoint_folder(spark)}/sets-{uuid.uuid4().hex}", measure(rows, [*group, DATE])
    rows = rows.join(rows.groupBy(*group).agg(F.max(DATE).alias("_last")), group)
    rows.withColumn("_part", F.pmod(F.hash(ENTITY), F.lit(8))).repartition(DATE, "_part").drop("_part").write.partitionBy(
        DATE).parquet(f"{root}/band")
    stored = rows.drop(DATE).schema
    held = None
    for date in days:
        day = spark.read.schema(stored).parquet(f"{root}/band/{DATE}={date}")
        stay = F.lit(0) if held is None else F.coalesce("_stay", F.lit(0))
        seen = day if held is None else day.join(held.select(*group, ENTITY, F.lit(1).alias("_stay")), [*group, ENTITY], "left")
        cut = with_positions(seen.withColumn("_stay", stay), group, [F.col("_stay").desc(), F.col("place").asc()], sizes)
        members = cut.filter(F.col("_before") < F.col("top_size")).select(*group, ENTITY, "_last", F.lit(True).alias("_chosen"))
        if held is not None:
            # A run without a band on this date keeps its members through its own stretch.
            older = held.filter(F.col("_last") > date).join(day.select(*group).distinct(), group, "left_anti")
            members = members.unionByName(older.withColumn("_chosen", F.lit(False)))
        members.write.parquet(f"{root}/sets/{DATE}={date}")
        held = spark.read.schema(members.schema).parquet(f"{root}/sets/{DATE}={date}")
    return spark.read.schema(StructType([*members.schema, rows.schema[DATE]])).parquet(f"{root}/sets").filter("_chosen").select(*keys)


def ordinal_predictions(df, sets, run=(), sizes=None):
    """Unique scores n..1 per date: chosen rows first, then by smoothed value, then by entity."""
    chosen = sets.select(*run, *KEYS, F.lit(1).alias("_chosen"))
    marked = df.join(chosen, [*run, *KEYS], "left").fillna({"_chosen": 0})
    placed = with_positions(marked, [*run, DATE], [F.col("_chosen").desc(), F.col("smooth").desc(), F.col(ENTITY).asc()], sizes)
    return placed.withColumn("pred", (F.col("_total") - F.col("_before")).cast("double")).withColumn(
        "selected", F.col("_chosen") == 1).drop("_before", "_total", "_chosen")


@dataclass(frozen=True)
class Grid:
    """Rows by date with one smoothed value a weight, and the members of every (weight, exit fraction)."""
    dated: DataFrame
    sets: DataFrame
    run: list
    keep: list
    alphas: list
    exits: list

    def predictions(self):
        return day_kernel.point_rows(self.dated, self.sets, self.run, self.keep, self.alphas, self.exits)

    def scores(self, policy):
        """One score row per run and point; the points are never rows of their own."""
        point = [*self.run, "alpha", "exit_fraction"]
        return summed(day_kernel.point_scores(self.dated, self.sets, self.run, self.alphas, self.exits, policy), policy, point)

    def members(self):
        """Members as rows (run, alpha, exit fraction, date, entity)."""
        listed = F.array(*[F.when(F.col("_exits").bitwiseAND(F.lit(1 << e)) != 0, F.lit(float(x))) for e, x in enumerate(self.exits)])
        weights = F.array(*[F.lit(float(a)) for a in self.alphas])
        return self.sets.select(*self.run, *KEYS, weights[F.col("_weight")].alias("alpha"), F.explode(F.array_compact(listed)).alias("exit_fraction"))


def control_grid(df, alphas, exits, run=(), min_pool=100, sizes=None, rank=None):
    """rank -> smooth -> hysteresis for every grid point, or None where a date's rows at all points do not fit a task."""
    sizes = sizes or measure(df, [*run, DATE])
    if not day_kernel.fits(sizes, len(alphas) * len(exits)):
        return None
    alphas, exits = [float(a) for a in alphas], [float(e) for e in exits]
    ranked = df.withColumnRenamed(rank, "rank") if rank else daily_rank(df, run, sizes)
    keep = [c for c in df.columns if c not in {"pred", rank, *run, *KEYS}]
    smooth = causal_ema(ranked, alphas, run, keep=keep, wide=True)
    dated = day_kernel.dated_rows(smooth, run, keep, len(alphas))
    band = day_kernel.bands(dated, run, alphas, exits, min_pool)
    return Grid(dated, day_kernel.held_sets(band, run, alphas, exits, min_pool), list(run), keep, alphas, exits)


def controlled_predictions(df, alphas, exits, run=(), min_pool=100, sizes=None, rank=None):
    """rank -> smooth -> hysteresis -> ordinal, for every grid point in one plan.

    ``rank`` names a column that already holds the value to smooth; otherwise ``pred`` is ranked.
    """
    sizes = sizes or measure(df, [*run, DATE])
    grid = control_grid(df, alphas, exits, run, min_pool, sizes, rank)
    if grid is not None:
        return grid.predictions()
    per_run = measure(df, run) if run else measure(df, [])
    ranked = df.withColumnRenamed(rank, "rank") if rank else daily_rank(df, run, sizes)
    kept = [c for c in df.columns if c not in {"pred", rank, *run, *KEYS}]
    smooth = pinned(causal_ema(ranked, alphas, run, keep=kept))
    grid = [*run, "alpha"]
    band = exit_band(smooth, exits, grid, min_pool, sizes)
    bound = math.ceil(per_run.largest * max(max(exits), 0.1)) + sizes.groups
    sets = hysteresis_sets(band, grid, bound)
    points = smooth.withColumn("exit_fraction", F.explode(F.array(*[F.lit(float(e)) for e in exits])))
    return ordinal_predictions(points, sets, [*grid, "exit_fraction"], sizes)


def controlled_scores(df, alphas, exits, policy, run=(), min_pool=100, sizes=None):
    """One score row per run and grid point."""
    sizes = sizes or measure(df, [*run, DATE])
    grid = control_grid(df, alphas, exits, run, min_pool, sizes)
    if grid is not None:
        return grid.scores(policy)
    return score(controlled_predictions(df, alphas, exits, run, min_pool, sizes), policy, [*run, "alpha", "exit_fraction"], sizes)
