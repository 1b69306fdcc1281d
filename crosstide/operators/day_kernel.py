"""Daily scores and the held sets of a grid as array work over rows sorted by date.

A task streams its rows and works on whole dates, so nothing is copied per grid point before a date is in hand: the rows of a run cross
the network once, with one smoothed value a weight, however many points are scored. A date's rows must fit a task (``fits``).
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crosstide.functions.groups import pinned, spread
from crosstide.schema import DATE, ENTITY, KEYS, LABEL

METRICS = ("ic_rows", "rank_ic", "top_return", "bottom_return", "market_return")
DAY = "ic_rows long, _counted boolean, rank_ic double, top_return double, bottom_return double, market_return double, tops array<string>"
COUNTS = "rows long, predictions long, missing_predictions long, labels long, return_eligible_rows long, turnover_eligible_rows long, return_top_rows long"
# Rows x grid points of one date that a task may hold.
CELL_LIMIT = 1 << 24


def fits(sizes, points=1):
    return sizes.fits and sizes.largest * points <= CELL_LIMIT


def whole_groups(batches, keys):
    """Tables of the rows with equal keys, from batches sorted by them."""
    held, last = [], None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k)
            if n > 1:
                change[1:] |= ~pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False) & ~pc.and_(
                    pc.is_null(c[1:]), pc.is_null(c[:-1])).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(edges[:-1], edges[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def numbers(table, name):
    return table.column(name).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


def by_entity(table):
    """The rows in entity order, which settles equal values."""
    return table.take(pc.sort_indices(table.column(ENTITY).combine_chunks()))


def average_ranks(x):
    """Average-tie ranks from 1; the values hold no NaN."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    change = np.append(True, y[1:] != y[:-1])
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(x))
    out = np.empty(len(x))
    out[order] = np.repeat((start + end + 1) / 2, end - start)
    return out


def correlation(a, b):
    """Of two rank columns. The sums are exact, as ranks are multiples of one half."""
    n = len(a)
    left, right = n * (a @ a) - a.sum() ** 2, n * (b @ b) - b.sum() ** 2
    return (n * (a @ b) - a.sum() * b.sum()) / (math.sqrt(left) * math.sqrt(right)) if left > 0 and right > 0 else None


class Day:
    """The rows of one date in entity order, ready to be scored by any number of predictions."""

    def __init__(self, table, policy):
        self.policy, self.label, self.entity = policy, numbers(table, LABEL), table.column(ENTITY).combine_chunks()
        self.tradable = numbers(table, "flag_limit_up") == 0
        self.known = ~np.isnan(self.label)
        self.ranks = {}

    def label_ranks(self, used):
        key = used.tobytes()
        if key not in self.ranks:
            self.ranks = {key: average_ranks(self.label[used])}
        return self.ranks[key]

    def top(self, n):
        return max(n // 10, 1) if self.policy.strict else -(-n // 10)

    def scores(self, pred):
        """One row of ``DAY``."""
        given = ~np.isnan(pred)
        allowed = np.ones(len(pred), bool) if self.policy.strict else given
        used, pool = self.known & allowed, self.tradable & allowed
        n = int(used.sum())
        enough = n >= self.policy.min_ic_rows
        ic = correlation(average_ranks(pred[used]), self.label_ranks(used)) if enough and given[used].all() and n else None
        order = np.argsort(-pred, kind="stable")  # missing predictions last
        placed = order[pool[order]]
        tops = self.entity.take(pa.array(placed[:self.top(len(placed))])) if len(placed) >= max(self.policy.min_pool, 1) else None
        paid = placed[self.known[placed]]
        top = bottom = market = None
        if len(paid) >= max(self.policy.min_pool, 1):
            y, size = self.label[paid], self.top(len(paid))
            top, bottom, market = y[:size].mean(), y[len(y) - max(len(y) // 10, 1):].mean(), y.mean()
        return n, enough if self.policy.strict else True, ic, top, bottom, market, tops


    def sets(self, pred):
        """Places of the top set and of the top set of labelled rows; None where too few rows are tradable."""
        order = np.argsort(-pred, kind="stable")
        allowed = self.tradable if self.policy.strict else self.tradable & ~np.isnan(pred)
        placed = order[allowed[order]]
        first = lambda rows: rows[:self.top(len(rows))] if len(rows) >= max(self.policy.min_pool, 1) else None
        return first(placed), first(placed[self.known[placed]])


def day_table(keys, rows):
    """Rows of ``DAY`` behind key columns (name: Arrow array)."""
    n, counted, ic, top, bottom, market, tops = zip(*rows, strict=True)
    floats = lambda v: pa.array([None if x is None else float(x) for x in v], pa.float64())
    sets = [None if t is None else t.cast(pa.string()).to_pylist() for t in tops]
    return pa.table({**keys, "ic_rows": pa.array(n, pa.int64()), "_counted": pa.array([bool(c) for c in counted]), "rank_ic": floats(ic), "top_return": floats(top),
                     "bottom_return": floats(bottom), "market_return": floats(market), "tops": pa.array(sets, pa.list_(pa.string()))})


def keyed(df, names):
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in names)


def day_counts(table, day):
    """One row of ``COUNTS``."""
    given, known = (table.column(c).is_valid().to_numpy() for c in ("pred", LABEL))
    paid = int((day.tradable & day.known & (day.policy.strict | ~np.isnan(numbers(table, "pred")))).sum())
    top = day.top(paid) if paid >= max(day.policy.min_pool, 1) else 0
    n, preds = len(table), int(given.sum())
    found = (n, preds, n - preds, int(known.sum()), int((given & known & day.tradable).sum()), int((given & day.tradable).sum()), top)
    return {f.split()[0]: pa.array([v], pa.int64()) for f, v in zip(COUNTS.split(", "), found, strict=True)}


def daily_scores(df, policy, run=(), counts=False):
    """One row per run and date: correlation, returns and the top set, with ``counts`` also ``COUNTS``. One exchange by date."""
    by = [*run, DATE]
    rows = spread(df.select(*by, ENTITY, "pred", LABEL, "flag_limit_up"), *by).sortWithinPartitions(*by)

    def score(batches):
        for table in whole_groups(batches, by):
            table = by_entity(table)
            day = Day(table, policy)
            keys = {c: table.column(c).combine_chunks()[:1] for c in by} | (day_counts(table, day) if counts else {})
            yield from day_table(keys, [day.scores(numbers(table, "pred"))]).to_batches()

    return rows.mapInArrow(score, f"{keyed(df, by)}, {f'{COUNTS}, ' if counts else ''}{DAY}")


def daily_sets(df, policy, run=()):
    """One row per run and date: the top set, the top set of labelled rows, and the size and the unlabelled rows of the first. One exchange by date."""
    by = [*run, DATE]
    rows = spread(df.select(*by, ENTITY, "pred", LABEL, "flag_limit_up"), *by).sortWithinPartitions(*by)

    def cut(batches):
        for table in whole_groups(batches, by):
            table = by_entity(table)
            day = Day(table, policy)
            found = day.sets(numbers(table, "pred"))
            names = [None if rows is None else day.entity.take(pa.array(rows)).cast(pa.string()).to_pylist() for rows in found]
            size, missing = (0, 0) if found[0] is None else (len(found[0]), int((~day.known[found[0]]).sum()))
            yield pa.RecordBatch.from_pydict({
                **{c: table.column(c).combine_chunks()[:1] for c in by}, "tops": pa.array(names[:1], pa.list_(pa.string())),
                "labelled_tops": pa.array(names[1:], pa.list_(pa.string())), "top_rows": pa.array([size], pa.int64()), "missing": pa.array([missing], pa.int64())})

    return rows.mapInArrow(cut, f"{keyed(df, by)}, tops array<string>, labelled_tops array<string>, top_rows long, missing long")


# The grid: every (weight, exit fraction) of a run from rows that hold one smoothed value a weight.
def dated_rows(smooth, run, keep, weights):
    """The rows stored by date. ``smooth`` holds the columns smooth_0, smooth_1, ..., one a weight."""
    by = [*run, DATE]
    columns = [f"smooth_{j}" for j in range(weights)]
    return pinned(spread(smooth.select(*run, *KEYS, *keep, *columns), *by).sortWithinPartitions(*by))


def bands(dated, run, alphas, exits, min_pool):
    """Tradable rows inside the widest band of each weight, best first; a date with too few of them is one row without an entity."""
    by = [*run, DATE]

    def cut(batches):
        for table in whole_groups(batches, by):
            first = {c: table.column(c)[0] for c in by}
            table = by_entity(table.filter(pc.fill_null(pc.equal(table.column("flag_limit_up").cast(pa.float64()), 0.0), False)))
            n, size = len(table), max(len(table) // 10, 1)
            thin = n < max(min_pool, 1)
            held = 1 if thin else min(max(math.floor(n * max(exits)), size), n)
            for j in range(len(alphas)):
                if thin:
                    entity = pa.nulls(1, pa.string())
                else:
                    order = np.argsort(-numbers(table, f"smooth_{j}"), kind="stable")[:held]
                    entity = table.column(ENTITY).combine_chunks().take(pa.array(order)).cast(pa.string())
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.repeat(v, held) for c, v in first.items()}, ENTITY: entity, "_weight": pa.array(np.full(held, j, np.int32)),
                    "place": pa.array(np.arange(1, held + 1, dtype=np.int32)), "pool": pa.array(np.full(held, n, np.int32))})

    return dated.mapInArrow(cut, f"{keyed(dated, by)}, {ENTITY} string, _weight int, place int, pool int")


def held_sets(band, run, alphas, exits, min_pool):
    """Members of every point as rows (run, date, entity, _weight, _exits): bit e of ``_exits`` says that exit fraction e holds the row.

    One task walks a run and weight date by date and keeps the members of the last date only."""
    by, group = [*run, DATE], [*run, "_weight"]
    rows = spread(band, *group).sortWithinPartitions(*group, DATE, "place")

    def walk(batches):
        now, held = None, None
        for table in whole_groups(batches, [*group, DATE]):
            key = tuple(table.column(c)[0].as_py() for c in group)
            if key != now:
                now, held = key, [None] * len(exits)
            n, names = table.column("pool")[0].as_py(), table.column(ENTITY).combine_chunks()
            if n < max(min_pool, 1):
                held = [None] * len(exits)
                continue
            k, mask = max(n // 10, 1), np.zeros(len(names), np.int64)
            for e, fraction in enumerate(exits):
                inside = max(math.floor(n * fraction), k)
                day = names[:inside]
                stay = np.zeros(len(day), bool) if held[e] is None else pc.is_in(day, value_set=held[e]).to_numpy(zero_copy_only=False)
                chosen = np.concatenate([np.flatnonzero(stay), np.flatnonzero(~stay)])[:k]
                held[e] = day.take(pa.array(chosen))
                mask[chosen] |= 1 << e
            kept = pa.array(np.flatnonzero(mask))
            out = table.select([*by, ENTITY, "_weight"]).take(kept).combine_chunks()
            yield from out.append_column("_exits", pa.array(mask[mask > 0])).to_batches()

    return rows.mapInArrow(walk, f"{keyed(band, by)}, {ENTITY} string, _weight int, _exits long")


def _points(table, sets, alphas, exits):
    """For every point of a date: (weight, exit, selected, ordinal prediction) over the rows in entity order."""
    weight, mask = (sets.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_weight", "_exits"))
    at = pc.index_in(sets.column(ENTITY).combine_chunks(), value_set=table.column(ENTITY).combine_chunks()).to_numpy(zero_copy_only=False) if len(sets) else np.zeros(0, np.int64)
    n = len(table)
    for j in range(len(alphas)):
        order = np.argsort(-numbers(table, f"smooth_{j}"), kind="stable")
        bits = np.zeros(n, np.int64)
        mine = weight == j
        bits[at[mine].astype(np.int64)] = mask[mine]
        for e in range(len(exits)):
            chosen = (bits >> e & 1).astype(bool)
            first = chosen[order]
            pred = np.empty(n)
            pred[np.concatenate([order[first], order[~first]])] = np.arange(n, 0, -1)
            yield j, e, chosen, pred


def point_rows(dated, sets, run, keep, alphas, exits):
    """All rows at every point, with ``smooth``, ``selected`` and ``pred``."""
    by = [*run, DATE]
    columns = [*run, *KEYS, *keep]

    def rows(table, chosen):
        table, parts = by_entity(table), []
        for j, e, held, pred in _points(table, chosen, alphas, exits):
            parts.append(table.select(columns).append_column("alpha", pa.array(np.full(len(pred), float(alphas[j])))).append_column(
                "smooth", table.column(f"smooth_{j}")).append_column("exit_fraction", pa.array(np.full(len(pred), float(exits[e])))).append_column(
                "pred", pa.array(pred)).append_column("selected", pa.array(held)))
        return pa.concat_tables(parts)

    schema = f"{keyed(dated, columns)}, alpha double, smooth double, exit_fraction double, pred double, selected boolean"
    return dated.groupBy(*by).cogroup(sets.groupBy(*by)).applyInArrow(rows, schema)


def point_scores(dated, sets, run, alphas, exits, policy):
    """One row of ``DAY`` per run, point and date."""
    by = [*run, DATE]

    def rows(table, chosen):
        table = by_entity(table)
        day, keys, found = Day(table, policy), [], []
        for j, e, _, pred in _points(table, chosen, alphas, exits):
            keys.append((float(alphas[j]), float(exits[e])))
            found.append(day.scores(pred))
        names = {c: pa.repeat(table.column(c)[0], len(keys)) for c in by}
        return day_table({**names, "alpha": pa.array([k[0] for k in keys]), "exit_fraction": pa.array([k[1] for k in keys])}, found)

    return dated.groupBy(*by).cogroup(sets.groupBy(*by)).applyInArrow(rows, f"{keyed(dated, by)}, alpha double, exit_fraction double, {DAY}")
