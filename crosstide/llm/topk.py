"""Exact top-k by inner product with multi-resolution segment statistics.

Components become integers floor(256 x). Vectors are cut into segments at several resolutions; with the mean and the deviation of
each segment, |x - y|^2 >= sum of length * ((mean_x - mean_y)^2 + (dev_x - dev_y)^2), so x.y = (|x|^2 + |y|^2 - |x - y|^2) / 2 has the upper
bound sum of length * (mean_x mean_y + dev_x dev_y). A block of queries meets a block of candidates: bounds are computed coarse
to fine, pairs whose bound falls below the k-th best exact score so far drop out, and survivors get exact integer scores.

Queries go in blocks against all rows in blocks (block numbers are join keys; nothing is broadcast), each pair of blocks returns
at most k rows a query, and a window over those ranks them. Ties go to the smaller vec_id.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id; only vectors of equal
length are compared; empty vectors score 0. A query's own row is every row with its vec_id; a repeated id is one query (its
vectors in turn would be ambiguous, so the first by value is taken) while repeated candidates count each. Empty tables give none.
Sums are 64-bit; components beyond 2^20 use plain integer sums without bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosstide.llm.common import Scratch

K, EVERY, SCALE, BLOCK, SEGMENTS = 5, 50, 256, 2048, (1, 4, 16)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, float]:
    """For each row sqrt(length) * (means, deviations) of its segments: the dot product of two such rows is the upper bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    sizes = np.sqrt([len(p) for p in parts])
    means = np.stack([x[:, p].mean(axis=1) for p in parts], axis=1)
    devs = np.stack([x[:, p].std(axis=1) for p in parts], axis=1)
    return np.concatenate([means * sizes, devs * sizes], axis=1)


def block_top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, segments=SEGMENTS):
    """(query index, row index, score) of each query's k best rows of the block, all ties at the end settled by id.
    Also the number of pairs that needed an exact score."""
    n, m = len(queries), len(rows)
    if not n or not m:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64), 0
    exact = lambda i, j: np.einsum("ij,ij->i", queries[i], rows[j])
    small = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)) <= 1 << 20
    alive = q_ids[:, None] != ids[None, :]
    if queries.shape[1] and small:
        qf, rf = queries.astype(float), rows.astype(float)
        slack = 1e-6 * (1 + np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(rf, axis=1).max())
        for level, parts in enumerate(segments):
            bound = statistics(qf, parts) @ statistics(rf, parts).T + slack
            bound[~alive] = -np.inf
            if level == 0:  # a first threshold: exact scores of the k rows with the best coarse bounds
                kk = min(k, m)
                near = np.argpartition(-bound, kk - 1, axis=1)[:, :kk]
                first = np.einsum("qd,qkd->qk", queries, rows[near]).astype(float)
                first[~np.take_along_axis(alive, near, 1)] = -np.inf
                least = first.min(axis=1) if kk == k else np.full(n, -np.inf)
            else:
                near = np.argpartition(-bound, kk - 1, axis=1)[:, :kk]
                found = np.einsum("qd,qkd->qk", queries, rows[near]).astype(float)
                found[~np.take_along_axis(alive, near, 1)] = -np.inf
                least = np.maximum(least, found.min(axis=1)) if kk == k else least
            alive &= bound >= least[:, None]
    i, j = np.nonzero(alive)
    score = np.concatenate([exact(i[a:a + 65536], j[a:a + 65536]) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0, np.int64)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], j[keep], score[keep], len(order)


def _blocks(rows: DataFrame, size: int, queries: bool):
    """Rows gathered into (dim, block, ids, values) with int64 values."""
    def run(frames):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len), sort=True):
                for a in range(0, len(part), size):
                    own = part.iloc[a:a + size]
                    values = np.stack(own["v"].to_list()).astype(np.int64) if dim else np.zeros((len(own), 0), np.int64)
                    yield pd.DataFrame({"dim": [dim], "block": [number], "ids": [own["vec_id"].to_numpy(np.int64).tobytes()], "values": [values.tobytes()]})
                    number += 1

    return rows.mapInPandas(run, "dim int, block long, ids binary, values binary")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score); the queries are the rows whose vec_id is divisible by `every`."""
    valid = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(CAST(x AS DOUBLE)) = double('inf'))"
    rows = vectors.filter(valid).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))").alias("v"))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _blocks(asked, block, True).select("dim", F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("values").alias("q"))
    q = Scratch(vectors.sparkSession).table("queries", q)  # numbers and contents are read apart: a recomputed task might deal rows otherwise
    c = _blocks(rows, block, False)
    numbers = q.select("dim", "qb")  # a few numbers a block: pairs of blocks, then their contents by number
    work = c.join(numbers, "dim").join(q, ["dim", "qb"]).repartition(width, "block", "qb")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                qs, cs = np.frombuffer(r["q"], np.int64).reshape(len(q_ids), r["dim"]), np.frombuffer(r["values"], np.int64).reshape(len(ids), r["dim"])
                for a in range(0, len(q_ids), 512):
                    i, j, score, _ = block_top(qs[a:a + 512], q_ids[a:a + 512], cs, ids, k)
                    yield pa.RecordBatch.from_pydict({"query_id": q_ids[a + i] if len(i) else pa.array([], pa.int64()), "vec_id": ids[j] if len(j) else pa.array([], pa.int64()), "score": pa.array(score, pa.int64())})

    found = work.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
