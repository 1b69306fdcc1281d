"""Interaction of quality filters: what each filter removes first, and what another one would have removed anyway.

A document's failures are a mask of five bits. Documents are counted by part and mask (32 cells a part: all, good, toxic), which says
everything about any subset and order of the filters. A part's cells are then walked over the 32 subsets in Gray-code order: one filter
is toggled at a time, each cell keeps a counter of its active failures, and the running survivors change by the cells whose counter
leaves or reaches zero. The survivors of all 32 states are stored; a step of an order is the difference of two states.

Filter E (same text as a smaller doc_id) is table-wide: rows are first reduced to (text digest, part, other failures, labels), with their
least id, so a text in a third of all rows is a few rows when the least id of each digest is sought.

Null texts are empty. A null doc_id is later than any id, so it fails E if any row with an id has its text; rows of one id do not fail
by each other. Null sources are the part ''. Several labels of one document: good or toxic if any of them says so. Empty tables give
no parts. Other columns of the tables are not read."""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosstide.llm.common import LAST_ID, text_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SYMBOLS = re.compile(rb"[#$%&*|]")
NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(raw: bytes) -> int:
    """Bits 0 to 3: the filters that look at the text alone."""
    words = raw.split()  # bytes: exactly the blanks 09-0D and 20
    n = len(words)
    points = len(raw) if raw.isascii() else len(raw.decode())
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * len(raw.translate(None, NOT_CAPITALS)) > 5 * points) << 2 | (SYMBOLS.search(raw) is not None) << 3


def judged(docs: DataFrame) -> DataFrame:
    """(id, part, digest, mask) of every row."""
    columns = [F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch)
            raws = [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "part": batch.column("part"), "digest": pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()),
                "mask": pa.array([own_failures(r) for r in raws], pa.int32())})

    return docs.select(*columns).mapInArrow(run, "id long, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): one row a part with (mask, n, good, toxic) of each mask that occurs."""
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = judged(docs).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    # Rows without an id find no label; their second key spreads them.
    rows = rows.withColumn("apart", F.when(F.col("id") == int(LAST_ID), 1 + F.pmod(F.xxhash64("digest"), F.lit(1 << 30))).otherwise(F.lit(0).cast("long")))
    rows = rows.join(said.withColumn("apart", F.lit(0).cast("long")), ["id", "apart"], "left").fillna(False, ["good", "toxic"])
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("earliest", F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("earliest").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("earliest")).alias("n"))))
    counted = groups.select("part", "good", "toxic", split.alias("s")).groupBy("part", "s.mask").agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of each subset of filters. counts: parts x 32 masks x counts; the result: parts x 32 subsets x counts."""
    bits = counts.shape[1].bit_length() - 1
    with_bit = [np.flatnonzero(np.arange(1 << bits) >> f & 1) for f in range(bits)]
    active, running, subset = np.zeros(1 << bits, np.int64), counts.sum(axis=1), 0
    states = np.empty_like(counts)
    states[:, 0] = running
    for turn in range(1, 1 << bits):
        f = (turn & -turn).bit_length() - 1  # the bit in which neighbouring Gray codes differ
        subset ^= 1 << f
        mine = with_bit[f]
        if subset >> f & 1:
            running = running - counts[:, mine[active[mine] == 0]].sum(axis=1)
            active[mine] += 1
        else:
            active[mine] -= 1
            running = running + counts[:, mine[active[mine] == 0]].sum(axis=1)
        states[:, subset] = running
    return states


def steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every order and step: arrays of parts x orders x 5."""
    states = gray_walk(counts)
    which = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    after = np.cumsum(1 << which, axis=1)
    before = after - (1 << which)
    lost = states[:, before] - states[:, after]
    failing = np.stack([counts[:, np.arange(32) >> f & 1 == 1, 0].sum(axis=1) for f in range(5)], axis=1)[:, which]
    removed = lost[..., 0]
    share = np.stack([(removed * (which == f)).sum(axis=(1, 2)) for f in range(5)], axis=1)
    return {"kept": states[:, after, 0], "removed": removed, "redundant": failing - removed, "unique_fails": counts[:, 1 << which, 0],
            "good_lost": lost[..., 1], "toxic_lost": lost[..., 2], "shapley": share[:, which]}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 64):  # 600 rows a part
                some = batch.slice(a, 64)
                counts = np.zeros((len(some), 32, 3), np.int64)
                for i, found in enumerate(some.column("cells").to_pylist()):
                    for c in found:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                found = steps(counts)
                n, orders = len(some), len(ORDERS)
                parts = some.column("part").take(pa.array(np.repeat(np.arange(n), orders * 5)))
                yield pa.RecordBatch.from_pydict({
                    "part": parts, "filter_order": pa.array(np.tile(np.repeat(ORDERS, 5), n), pa.string()), "step": pa.array(np.tile(np.arange(1, 6), n * orders), pa.int32()),
                    **{c: pa.array(np.ascontiguousarray(found[c]).ravel(), pa.int64()) for c in COUNTS}})

    return cells(docs, labels).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


ORACLE = r"""WITH RECURSIVE rows AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  cut AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM rows),
  failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, first_id IS NOT NULL)] AS fails
    FROM cut LEFT JOIN said USING (doc_id)),
  cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
  orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)),
  taken AS (SELECT o, s, list_transform(string_split(o, ''), lambda c: ascii(c) - 64) AS f FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
  counted AS (SELECT part, o, s, f[s] AS filter, coalesce(sum(n) FILTER (NOT list_contains(list_transform(f[:s], lambda k: fails[k]), true)), 0) AS kept,
    coalesce(sum(n) FILTER (fails[f[s]] AND NOT list_contains(list_transform(f[:s - 1], lambda k: fails[k]), true)), 0) AS removed,
    coalesce(sum(n) FILTER (fails[f[s]]), 0) AS failing, coalesce(sum(n) FILTER (fails[f[s]] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails[f[s]] AND NOT list_contains(list_transform(f[:s - 1], lambda k: fails[k]), true)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails[f[s]] AND NOT list_contains(list_transform(f[:s - 1], lambda k: fails[k]), true)), 0) AS toxic_lost
    FROM cells CROSS JOIN taken GROUP BY part, o, s, f)
  SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, (failing - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted"""
