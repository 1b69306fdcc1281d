"""SimHash near duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A 64-bit fingerprint is cut into `max_bits` + 2 blocks. Two fingerprints that differ in at most `max_bits` bits agree in at least
two blocks, so every pair of blocks is a join key (32 bits wide for max_bits = 2). Fingerprints are made distinct first, so a
group of exact copies is one row. Inside a key, pairs are joined and verified while the key holds at most `hot` fingerprints.
A larger key is handled without pairs: two members differ in at most 2 bits exactly when the sets of values within one bit of
them meet, so each member is linked to the smallest member around each such value (at most 65 of them share one). Links join
components by rounds of stored tables; nothing is collected.

Null texts have no word and so fingerprint zero. Documents with a null id get a fingerprint; they stand as later than any id, and
a component of null ids only has a null component_id. Repeated rows are copies. An empty table gives none."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosstide.llm.common import LAST_ID, Scratch, components, text_bytes

WORDS, MAX_BITS, HOT, SEED = 3, 2, 64, 42


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    from xxhash import xxh64_intdigest

    parts = raw.lower().split()  # bytes: A-Z only, and exactly the blanks 09-0D and 20
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)[:len(parts) - words + 1]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends[words - 1:].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[a:a + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, f) of every row: the id (missing: the largest long) and the fingerprint as a signed long."""
    columns = [F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]

    def run(batches):
        for batch in batches:
            offsets, data = text_bytes(batch)
            found = np.array([fingerprint(bytes(data[a:b]), words) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "f": pa.array(found.view(np.int64), pa.int64())})

    return docs.select(*columns).mapInArrow(run, "id long, f long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(mask, number) of each pair of blocks."""
    cuts = np.linspace(0, 64, max_bits + 3).round().astype(int).tolist()
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [(x | y, i) for i, (x, y) in enumerate(combinations(whole, 2))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(scratch: Scratch, prints: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (f, node), enough to connect every close pair."""
    if max_bits != 2:
        raise ValueError("blocks and the way for large keys are laid out for 2 bits")
    masks = _blocks(max_bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.lit(_signed(m)).alias("mask"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key")) for m, i in masks]))
    rows = prints.select("f", "node", keys.alias("k")).select("f", "node", "k.block", "k.mask", "k.key")
    sizes = rows.groupBy("block", "key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = scratch.table("keys", rows.join(sizes, ["block", "key"]))
    few = rows.filter(F.col("size") <= hot)
    left, right = few.select("block", "key", F.col("f").alias("fa"), F.col("node").alias("a")), few.select("block", "key", F.col("f").alias("fb"), F.col("node").alias("b"))
    pairs = left.join(right, ["block", "key"]).filter("fa < fb").filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits).select("a", "b")
    around = F.explode(F.concat(F.array(F.col("f")), F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(_signed(1 << i))) == 0, F.col("f").bitwiseXOR(F.lit(_signed(1 << i)))) for i in range(64)]), lambda x: x.isNotNull())))
    many = rows.filter(F.col("size") > hot).select("block", "key", "node", around.alias("z"))
    many = many.withColumn("b", F.min("node").over(Window.partitionBy("block", "key", "z"))).filter("b < node").select(F.col("node").alias("a"), "b")
    return pairs.union(many).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table("fingerprints", fingerprints(docs, words))
    prints = scratch.table("distinct", rows.groupBy("f").agg(F.min("id").alias("first")))
    whole = components(scratch, links(scratch, prints.select("f", F.col("f").alias("node")), hot=hot))
    prints = prints.join(whole, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("component", "f").alias("c"))
    least = prints.groupBy("c").agg(F.min("first").alias("component"))
    missing = F.lit(int(LAST_ID))
    return rows.join(prints.join(least, "c").select("f", "component"), "f").select(
        F.nullif("id", missing).alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.nullif("component", missing).alias("component_id"))
