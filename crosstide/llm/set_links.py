"""Links between sets of word shingles: candidates from tensored MinHash keys, each confirmed on the full sets.

A text's set holds the 64-bit hashes of its distinct shingles (fewer words: the whole sequence; no word: empty). Texts with equal sets are
one node. Two small collections of `HALVES` half keys, each of `WIDTH` minima, are computed per node; every half of the first combined
with every half of the second is a table key. So 2 x 8 x 2 = 32 minima give the 64 keys of four minima that would take 256. A pair of
similarity s shares no key with probability 1 - (1 - (1 - s^2)^8)^2: 0.0006 at 0.8, 0.000003 at 0.9.

Every pair that shares a key is compared on its full sets unless it is in one component already or cannot be similar, in four steps:
1. each node with the leader with which it shares most keys. A key's leader is its most central node, whose keys hold most nodes: in a group of
   near copies that is a text near the common origin, which links whatever can be linked;
2. keys of at most `hot` nodes: all pairs between components; larger keys: the leader with all others outside its component;
3. keys of more than `hot` nodes that still hold two components (a passage that very many different texts share, or copies changed too much):
   their nodes are asked anew by an exact prefix filter. Shingles that no other asked node has cannot be shared; those that remain are
   ordered from rare to frequent. Sets of n and at least l shingles are similar only if they share ceil(s (n + l) / (1 + s)) of them, so they share
   one of the first n + 1 less that number. Partners' sizes are taken by classes, and a key is a shingle with both classes;
4. prefix keys that are still large and open go in rounds: round r compares the next of a key's nodes, about 8^r, with all others outside
   their component, until the key lies in one component or all its nodes were compared.
A pair is left out only where its sizes, or the shingles that either side shares with any asked node, are too few for the similarity. A group
of n near copies costs about n comparisons in step 1; nothing is dropped or capped. A set travels once per comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import LAST_ID, LEAST_TASKS, ROWS_A_TASK, Scratch, components, text_bytes

PERCENT, HALVES, WIDTH, HOT, SALTS, SEED, STEP = 80, 8, 2, 32, 16, 42, 1.05


def _odd(seed: int, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)


_MINIMA, _WITHIN, _COMBINED = _odd(SEED, 2 * HALVES * WIDTH, 1), _odd(SEED + 1, WIDTH), _odd(SEED + 2, 2, HALVES)


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    from xxhash import xxh64_intdigest

    parts = raw.lower().split()  # bytes: A-Z only, and exactly the blanks 09-0D and 20
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)[:len(parts) - words + 1]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends[words - 1:].tolist(), strict=True)], np.uint64))


def half_keys(found: np.ndarray) -> np.ndarray:
    """2 x HALVES half keys of a set."""
    least = np.full(len(_MINIMA), ~np.uint64(0))
    for a in range(0, len(found), 2048):
        least = np.minimum(least, (_MINIMA * found[a:a + 2048]).min(axis=1))
    least ^= least >> np.uint64(31)
    halves = (least.reshape(2 * HALVES, WIDTH) * _WITHIN).sum(axis=1, dtype=np.uint64)
    return halves ^ halves >> np.uint64(29)


def table_keys(halves: np.ndarray) -> np.ndarray:
    """HALVES x HALVES keys of each row of half keys."""
    both = halves.reshape(-1, 2, HALVES) * _COMBINED
    return (both[:, 0, :, None] + both[:, 1, None, :]).reshape(len(both), -1)


def sketched(rows: DataFrame, words: int) -> DataFrame:
    """(row, id, node, n, halves) of rows with the columns __row, doc_id and text."""
    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            offsets, data = text_bytes(batch)
            sets = [shingles(bytes(data[a:b]), words) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "id": batch.column("id"), "node": pa.array(np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)),
                "n": pa.array([len(s) for s in sets], pa.int64()), "halves": pa.array([half_keys(s).tobytes() for s in sets], pa.binary())})

    return _texts(rows).select("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("id"), "text").mapInArrow(run, "row long, id long, node long, n long, halves binary")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("__row").alias("row"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, n, m, side): the table keys of every node with a shingle. m: how many of its n shingles another node may share."""
    def run(batches):
        for batch in batches:
            halves = np.frombuffer(b"".join(batch.column("halves").to_pylist()), np.uint64)
            size = HALVES * HALVES
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(table_keys(halves).ravel().view(np.int64)), "node": pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), size)),
                "n": pa.array(np.repeat(batch.column("n").to_numpy(zero_copy_only=False), size))})

    return nodes.filter("n > 0").select("node", "n", "halves").mapInArrow(run, "key long, node long, n long").withColumns({"m": F.col("n"), "side": F.lit(2)})


class Links:
    """The links found so far between the nodes of one table, and their components."""

    def __init__(self, scratch: Scratch, percent: int = PERCENT, hot: int = HOT, parts: int | None = None):
        """parts: tasks at most for a step's stored result."""
        self.scratch, self.percent, self.hot, self.turn, self.parts = scratch, percent, hot, 0, parts
        self.group = scratch.spark.createDataFrame([], "node long, component long")

    def name(self, of: str) -> str:
        self.turn += 1
        return f"{of}{self.turn}"

    def stored(self, of: str, df: DataFrame) -> DataFrame:
        return self.scratch.table(self.name(of), df, self.parts)

    def fit(self, x: str = "", y: str = ""):
        """Whether two nodes may be similar by their sizes n and shareable shingles m, and a key is meant for both (columns with the prefixes
        x and y): sides are 0 and 1 where a key joins two size classes, and 2 where all nodes may meet."""
        n, m = (f"{x}n", f"{y}n"), (f"{x}m", f"{y}m")
        return ((F.col(f"{x}side") + F.col(f"{y}side")) % 3 == 1) & (F.least(*n) * 100 >= F.greatest(*n) * self.percent) & (F.least(*m) * (100 + self.percent) >= (F.col(n[0]) + F.col(n[1])) * self.percent)

    def grouped(self, df: DataFrame, *of: tuple[str, str]) -> DataFrame:
        """Adds the component of each named node."""
        for node, out in of:
            df = df.join(self.group.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))
        return df

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Adds the pairs (a, b) that are similar on their full sets, and joins their components."""
        percent = self.percent

        def run(batches):
            for batch in batches:
                left, right = batch.column("x"), batch.column("y")
                (xo, xv), (yo, yv) = ((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (left, right))
                keep = np.zeros(len(batch), bool)
                for k in range(len(batch)):
                    x, y = xv[xo[k]:xo[k + 1]], yv[yo[k]:yo[k + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        both = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        found = self.stored("links", both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
        if found.isEmpty():
            return
        # Known components stand for the links found before.
        old = self.group.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        inner = Scratch(self.scratch.spark)
        self.group = self.stored("group", components(inner, old.union(found), self.parts))
        inner.clear()

    def open_keys(self, shared: DataFrame) -> DataFrame:
        """The rows of keys that hold two components, with each node's component c."""
        now = self.grouped(shared, ("node", "c"))
        still = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
        return now.join(still, "key")

    def link(self, keys: DataFrame, sets_of, exact: bool = False) -> None:
        """Steps 1 and 2 over keys (key, node, n, m, side), then 3 (or 4 if these are exact keys already). sets_of(nodes) gives (node, set)."""
        scratch, hot, started = self.scratch, self.hot, self.turn
        sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("side").alias("low"), F.max("side").alias("high")).filter("size > 1 AND (high = 2 OR low < high)").select("key", "size")
        met = self.stored("met", keys.join(sizes, "key"))
        ranked = met.join(met.groupBy("node").agg(F.sum("size").alias("central")), "node")
        leads = ranked.groupBy("key").agg(F.max(F.struct("central", "node", "n", "m", "side")).alias("lead"))
        leads = leads.select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.m").alias("lead_m"), F.col("lead.side").alias("lead_side"))
        shared = self.stored("shared", met.join(leads, "key"))
        sets = self.stored("sets", sets_of(shared.select("node").distinct()))
        led = shared.filter(F.col("node") != F.col("lead")).filter(self.fit("", "lead_"))
        first = led.groupBy("node", "lead").count().groupBy("node").agg(F.max(F.struct("count", "lead")).alias("best"))
        first = self.stored("pairs", first.select(F.least("best.lead", "node").alias("a"), F.greatest("best.lead", "node").alias("b")).distinct())
        self.confirm(first, sets)
        open_ = self.stored("open", self.open_keys(shared))
        few, many = open_.filter(F.col("size") <= hot), open_.filter(F.col("size") > hot)
        other = few.select("key", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("m").alias("other_m"), F.col("side").alias("other_side"), F.col("c").alias("other_c"))
        pairs = few.join(other, "key").filter("other < node AND other_c <> c").filter(self.fit("", "other_")).select(F.col("other").alias("a"), F.col("node").alias("b"))
        led = self.grouped(many.filter(F.col("node") != F.col("lead")).filter(self.fit("", "lead_")), ("lead", "lead_c"))
        pairs = pairs.union(led.filter("lead_c <> c").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))).distinct()
        self.confirm(pairs.join(first, ["a", "b"], "left_anti"), sets)
        large = self.stored("large", self.open_keys(many.drop("c")))
        scratch.drop(*[f"{kind}{k}" for k in range(started, self.turn) for kind in ("met", "shared", "open", "pairs")])
        if not large.isEmpty():
            if exact:
                self.rounds(large, sets)
            else:
                nodes = self.stored("asked", large.select("node", "n").distinct())
                self.link(self.prefixes(nodes, sets), lambda some: sets.join(some, "node", "left_semi"), exact=True)

    def prefixes(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """(key, node, n, m, side): for each size class of partners, a set's rarest shareable shingles, enough that similar sets share one."""
        s, size_class = self.percent, lambda n: F.floor(F.ln(n.cast("double")) / float(np.log(STEP)) + 1e-9)
        cells = sets.join(nodes, "node").select("node", "n", F.explode("set").alias("shingle"))
        counts = cells.groupBy("shingle").agg(F.count("*").alias("count")).filter("count > 1")
        ranked = cells.join(counts, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("order"))  # as long as one set
        ranked = ranked.withColumns({"m": F.size("order").cast("long"), "own": size_class(F.col("n"))}).filter(F.col("m") * 100 >= F.col("n") * s)
        lowest = size_class(F.floor(F.col("n") * s / 100)) - 1  # one class beyond, against rounding
        ranked = ranked.withColumn("other", F.explode(F.sequence(lowest, size_class(F.ceil(F.col("n") * 100 / s)) + 1)))
        least = F.greatest(F.floor(F.pow(F.lit(STEP), F.col("other").cast("double")) - 1e-6), F.floor(F.col("n") * s / 100), F.lit(1))
        needed = F.ceil((F.col("n") + least) * s / (100 + s) - 1e-9)
        # the n - m shingles that nobody shares come first in the order
        prefix = F.slice("order", 1, F.greatest(F.col("n") - needed + 1 - (F.col("n") - F.col("m")), F.lit(0)).cast("int"))
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        key = F.xxhash64(F.least("own", "other"), F.greatest("own", "other"), "p.shingle")
        return self.stored("prefixes", ranked.select("node", "n", "m", "own", "other", F.explode(prefix).alias("p")).select(key.alias("key"), "node", "n", "m", side.alias("side")))

    def rounds(self, large: DataFrame, sets: DataFrame) -> None:
        """Step 4."""
        done, upto, largest, shared = 0, 1, large.agg(F.max("size")).first()[0], large.drop("c")
        while done < largest:
            now = self.stored("round", self.open_keys(shared))
            if now.isEmpty():
                return
            place = F.pmod(F.xxhash64("node"), F.col("size"))
            lead = now.filter((place >= done) & (place < upto))
            lead = lead.select("key", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("m").alias("x_m"), F.col("side").alias("x_side"), F.col("c").alias("x_c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            met = now.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(lead, ["key", "salt"]).filter("c <> x_c").filter(self.fit("", "x_"))
            self.confirm(met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct(), sets)
            done, upto = upto, 8 * upto


def linked(scratch: Scratch, rows: DataFrame, words: int, percent: int = PERCENT, hot: int = HOT, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(marks, nodes) of stored rows with a unique column __row: marks (row, id, node, n) of every row; nodes (node, id, row, component) with
    the first row of each node. more: further candidate pairs of rows (a, b), confirmed like all others."""
    parts = max(LEAST_TASKS, -(-rows.count() // ROWS_A_TASK))
    marks = scratch.table("marks", sketched(rows, words))
    heads = marks.groupBy("node").agg(F.min(F.struct("id", "row", "n", "halves")).alias("head"))
    nodes = scratch.table("nodes", heads.select("node", "head.*"), parts)

    def sets_of(some: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                offsets, data = text_bytes(batch)
                yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "set": pa.array([shingles(bytes(data[a:b]), words).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.list_(pa.int64()))})

        wanted = nodes.join(some, "node", "left_semi").select("row", "node")
        return _texts(rows).join(wanted, "row").select("node", "text").mapInArrow(run, "node long, set array<long>")

    found = Links(scratch, percent, hot, parts)
    if more is not None:
        node = lambda side: marks.select(F.col("row").alias(side), F.col("node").alias(f"{side}_node"), F.col("n").alias(f"{side}_n"))
        pairs = more.join(node("a"), "a").join(node("b"), "b").withColumns({"a_m": F.col("a_n"), "b_m": F.col("b_n"), "a_side": F.lit(2), "b_side": F.lit(2)}).filter("a_node <> b_node AND a_n > 0 AND b_n > 0").filter(found.fit("a_", "b_"))
        pairs = scratch.table("given", pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), parts)
        found.confirm(pairs, sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    found.link(keyed(nodes), sets_of)
    return marks.drop("halves"), found.grouped(nodes.select("node", "id", "row", "n"), ("node", "component"))
