"""Average-tie ranks and rank correlations of many columns of one group at once.

The features of a row travel as one array of 32-bit floats, so a group crosses to Python once, after one exchange on the group's
keys, and every column is ranked by one sort over the whole matrix. Values are compared as 32-bit floats: what two orders of a sum make
of one value stays one value. Correlations are those of centred ranks, which are multiples of one half, so a constant side is exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

PACKED = "_packed"
# Cells (rows x columns) of a group that one task may hold; a larger group takes the caller's sliced way.
CELL_LIMIT = 1 << 25
# Columns ranked at once.
BLOCK = 16


def fits(sizes, columns):
    return sizes.largest * columns <= CELL_LIMIT


def packed(df, names, keep):
    """The kept columns and one array with the named columns."""
    return df.select(*keep, F.array(*[F.col(n).cast("float") for n in names]).alias(PACKED))


def matrix(table, columns):
    """Rows x columns of doubles; NULL is NaN."""
    cells = table.column(PACKED).combine_chunks().flatten()
    return cells.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, columns)


def ranks(values):
    """Average-tie ranks down each column, from 1; NaN stays NaN."""
    n = len(values)
    if not n:
        return values.astype(np.float64)
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, axis=0)
    place = np.broadcast_to(np.arange(n)[:, None], values.shape)
    change = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(np.vstack([np.ones((1, values.shape[1]), bool), change]), place, 0), axis=0)
    last = np.minimum.accumulate(np.where(np.vstack([change, np.ones((1, values.shape[1]), bool)]), place, n)[::-1], axis=0)[::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    out[np.isnan(values)] = np.nan
    return out


def norm(a, b):
    """Root of a product of exact sums; of equal ones it is the sum itself, so that a correlation that ends at a decimal is that decimal."""
    return np.where(a == b, a, np.sqrt(a) * np.sqrt(b))


def correlations(values, against):
    """Rows used, and the rank correlation with each compared column and of the compared columns among themselves, per column.

    A column uses its rows that are not NaN; columns with the same rows share the ranking of the compared ones.
    """
    columns, m = values.shape[1], against.shape[1]
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    used, own, among = np.zeros(columns, np.int64), np.full((columns, m), np.nan), np.full((columns, len(pairs)), np.nan)
    if not len(values):
        return used, own, among
    present = ~np.isnan(values)
    _, which = np.unique(np.packbits(present, axis=0), axis=1, return_inverse=True)
    which = which.ravel()
    for k in range(which.max() + 1):
        mine = np.flatnonzero(which == k)
        rows = present[:, mine[0]]
        used[mine] = n = int(rows.sum())
        if n < 2:
            continue
        y = ranks(against[rows]) - (n + 1) / 2
        yy = (y * y).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            for a in range(0, len(mine), BLOCK):
                part = mine[a:a + BLOCK]
                x = ranks(values[:, part][rows].astype(np.float64)) - (n + 1) / 2
                xx = (x * x).sum(axis=0)
                own[part] = np.where((xx[:, None] > 0) & (yy > 0), x.T @ y / norm(xx[:, None], yy), np.nan)
            for p, (i, j) in enumerate(pairs):
                among[mine, p] = y[:, i] @ y[:, j] / norm(yy[i], yy[j]) if yy[i] > 0 and yy[j] > 0 else np.nan
    return used, own, among


def ranked_columns(df, names, by, keep, prefix):
    """Percentile ranks of all named columns inside each group, as columns with the prefix."""
    schema = df.select(*keep).schema
    from pyspark.sql.types import DoubleType, StructType
    for n in names:
        schema = StructType(schema.fields).add(f"{prefix}{n}", DoubleType())

    def run(table):
        found = ranks(matrix(table, len(names)))
        with np.errstate(invalid="ignore", divide="ignore"):
            found = found / (~np.isnan(found)).sum(axis=0)
        out = table.select(list(keep))
        for i, n in enumerate(names):
            out = out.append_column(f"{prefix}{n}", pa.array(np.ascontiguousarray(found[:, i]), from_pandas=True))
        return out

    return packed(df, names, keep).groupBy(*by).applyInArrow(run, schema)


def region_correlations(df, features, against, by, regions, region_rank, minimum_rows):
    """Long rows (group, region, feature, pair_rows, ic_<compared>, ic_<compared>_<compared>).

    ``regions`` maps a name to the bounds (above, up to) of the rank column that decides the region; None is no bound.
    """
    pairs = [(a, b) for i, a in enumerate(against) for b in against[i + 1:]]
    outputs = [f"ic_{a}" for a in against] + [f"ic_{a}_{b}" for a, b in pairs]
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "region string", "feature string", "pair_rows long", *[f"`{o}` double" for o in outputs]])
    keep = list(dict.fromkeys([*by, *against, region_rank]))

    def run(table):
        values = matrix(table, len(features))
        numbers = lambda c: table.column(c).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        place, compared = numbers(region_rank), np.stack([numbers(c) for c in against], axis=1)
        known = ~np.isnan(compared).any(axis=1)
        parts = []
        for name, (above, upto) in regions.items():
            rows = known if above is None else known & (place > above)
            rows = rows if upto is None else rows & (place <= upto)
            used, own, among = correlations(values[rows], compared[rows])
            kept = np.flatnonzero(used >= max(minimum_rows, 1))
            found = np.concatenate([own, among], axis=1)[kept]
            columns = {c: pa.repeat(table.column(c)[0], len(kept)) for c in by}
            columns |= {"region": pa.repeat(name, len(kept)), "feature": pa.array([features[i] for i in kept], pa.string()), "pair_rows": pa.array(used[kept])}
            columns |= {o: pa.array(np.ascontiguousarray(found[:, i]), from_pandas=True) for i, o in enumerate(outputs)}
            parts.append(pa.table(columns))
        return pa.concat_tables(parts)

    return packed(df, features, keep).groupBy(*by).applyInArrow(run, schema)
