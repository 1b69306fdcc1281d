"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and how often two ids are linked.

Each text is encoded by a byte-level BPE (A, over space + text) and a SentencePiece model (B, which adds the space). Byte offsets where
tokens of both end cut them into groups; every A token of a group is linked to every B token of it. A pair's count is the number of
documents that hold it linked.

Fast path: an array gives for each A id the B id with the same bytes. A group of one A token and that B token needs no pair: the task
counts documents per A id in a vector as long as the vocabulary, and only these vectors are summed. All other links (several tokens a
side, or a B id of the same bytes that is not the array's) are pairs; they alone enter a shuffle. A pair of the array that also stands in
an irregular group of a document is counted in the vector, once per document.

Counts come back to the documents: the vectors, and each A id's highest count, are as long as the vocabulary whatever the input. Pairs
with at least 1/`HOT_SHARE` of all (document, pair) rows are at most `HOT_SHARE` and are broadcast, so the join of the others has no key
with more than that share of the rows.

Texts that are null, empty, or whose tokens' bytes are not those of space + text (for instance with U+2581 itself) have no tokens: zeros
and ''. Rows with a null doc_id or a repeated one are documents of their own. Very long texts are encoded whole; groups of any length are
linked by their distinct ids. An empty table gives none. Other columns are not read."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm import tokens
from crosstide.llm.common import Scratch, cuts, text_bytes

PIECE_BYTES, WIDE, HOT_SHARE = 1 << 21, 4096, 100_000
SPACE_MARK = "▁"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabularies:
    """Both encoders, the bytes of their ids, and the B id of the same bytes for each A id (-1: none)."""

    def __init__(self, a_path: str | None, b_path: str | None):
        import sentencepiece

        self.a = tokens.encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or piece_path())
        self.size_a, self.size_b = self.a.n_vocab, self.b.get_piece_size()
        self.a_bytes = [b""] * self.size_a
        for token in self.a.token_byte_values():
            self.a_bytes[self.a.encode_single_token(token)] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        same: dict[bytes, int] = {}
        for i in sorted(range(self.size_b), key=self.b.is_byte):  # a piece rather than a byte
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                same.setdefault(self.b_bytes[i], i)
        self.same = np.array([same.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.words = {end: [f"{i}{end}" for i in range(max(self.size_a, self.size_b))] for end in ",|;"}

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where their bytes are not those of the text."""
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        if b"".join([self.b_bytes[i] for i in b]) != whole or b"".join([self.a_bytes[i] for i in a]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@functools.lru_cache(maxsize=1)
def vocabularies(a_path: str | None = None, b_path: str | None = None) -> Vocabularies:
    """One a worker process."""
    return Vocabularies(a_path, b_path)


def common_ends(a: np.ndarray, b: np.ndarray, v: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side every group holds."""
    ends_a, ends_b = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
    at = np.searchsorted(ends_a, ends_b)
    both = ends_a[np.minimum(at, len(ends_a) - 1)] == ends_b
    last_b = np.flatnonzero(both)
    return np.diff(at[both], prepend=-1), np.diff(last_b, prepend=-1)


def group_digest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, v: Vocabularies) -> str:
    """sha256 of `a1,a2|b1;a3|b2,b3`."""
    comma, bar, semicolon = (v.words[c] for c in ",|;")
    parts = []
    if (n_a == 1).all() and (n_b == 1).all():
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            parts += (bar[x], semicolon[y])
    else:
        i, j, left, right = 0, 0, a.tolist(), b.tolist()
        for x, y in zip(n_a.tolist(), n_b.tolist(), strict=True):
            if x == y == 1:
                parts += (bar[left[i]], semicolon[right[j]])
            else:
                parts += [comma[k] for k in left[i:i + x - 1]]
                parts.append(bar[left[i + x - 1]])
                parts += [comma[k] for k in right[j:j + y - 1]]
                parts.append(semicolon[right[j + y - 1]])
            i, j = i + x, j + y
    return hashlib.sha256("".join(parts)[:-1].encode()).hexdigest()


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, v: Vocabularies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of one document: the array's A ids with their occurrences, and other pairs (a * size_b + b) with theirs."""
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    single = (n_a == 1) & (n_b == 1)
    single[single] = v.same[a[start_a[single]]] == b[start_b[single]]
    found, times = [a[start_a[single]] * v.size_b + b[start_b[single]]], [np.ones(int(single.sum()), np.int64)]
    rest = np.flatnonzero(~single)
    wide = n_a[rest] * n_b[rest] > WIDE
    for g in rest[wide].tolist():
        x, cx = np.unique(a[start_a[g]:start_a[g] + n_a[g]], return_counts=True)
        y, cy = np.unique(b[start_b[g]:start_b[g] + n_b[g]], return_counts=True)
        found.append((x[:, None] * v.size_b + y).ravel())
        times.append((cx[:, None] * cy).ravel())
    rest = rest[~wide]
    if len(rest):
        size = n_a[rest] * n_b[rest]
        of = np.repeat(np.arange(len(rest)), size)
        within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        wide_b = n_b[rest][of]
        found.append(a[start_a[rest][of] + within // wide_b] * v.size_b + b[start_b[rest][of] + within % wide_b])
        times.append(np.ones(len(of), np.int64))
    pairs, back = np.unique(np.concatenate(found), return_inverse=True)
    times = np.bincount(back, weights=np.concatenate(times), minlength=len(pairs)).astype(np.int64)
    x, y = pairs // v.size_b, pairs % v.size_b
    array = v.same[x] == y
    return x[array], times[array], pairs[~array], times[~array]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids array<int>, id_times array<long>, pairs array<long>, pair_times array<long>, vector array<long>"


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row per document, and per task one more (row null) with its vector of document counts. Must be stored before use."""
    names = [n.split()[0] for n in ALIGNED.split(", ")]

    def run(batches):
        v, vector, schema = vocabularies(a_path, b_path), None, None
        for batch in batches:
            offsets, data = text_bytes(batch)
            if vector is None:
                vector = np.zeros(v.size_a, np.int64)
            for lo, hi in cuts(offsets, PIECE_BYTES, 2000):
                rows = []
                for k in range(lo, hi):
                    both = v.encoded(str(data[offsets[k]:offsets[k + 1]], "utf-8"))
                    if both is None:
                        rows.append((0, 0, 0, 0, "", [], [], [], []))
                        continue
                    n_a, n_b = common_ends(*both, v)
                    ids, times, pairs, pair_times = links(*both, n_a, n_b, v)
                    vector[ids] += 1
                    rows.append((len(both[0]), len(both[1]), len(n_a), int((n_a * n_b).sum()), group_digest(*both, n_a, n_b, v), ids.astype(np.int32), times, pairs, pair_times))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3)
                arrays = [batch.column("row").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], pa.nulls(hi - lo, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names)
                schema = schema or [x.type for x in arrays]
        if schema is not None:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in schema[:-1]], pa.array([vector], schema[-1])], names)

    columns = [F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]
    return docs.select(*columns).mapInArrow(run, ALIGNED)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    v = vocabularies(a_path, b_path)
    size_a, size_b = v.size_a, v.size_b
    stored = scratch.table("aligned", aligned(docs, a_path, b_path))
    per_id = np.zeros(size_a, np.int64)
    for r in stored.filter("vector IS NOT NULL").select(F.posexplode("vector").alias("id", "n")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        per_id[r.id] = r.n
    cells = stored.filter("row IS NOT NULL").select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pair_times").alias("times"))
    counts = scratch.table("counts", cells.groupBy("pair").agg(F.count("*").alias("n")))
    best, total = per_id.copy(), 0
    for r in counts.groupBy(F.expr(f"pair div {size_b}").alias("id")).agg(F.max("n").alias("n"), F.sum("n").alias("all")).collect():  # at most the vocabulary
        best[r.id], total = max(best[r.id], r.n), total + r["all"]

    # The highest count of each A id joins the pairs once; the table is as long as the vocabulary.
    highest = spark.createDataFrame(pa.table({"id": pa.array(np.arange(size_a)), "best": pa.array(best)}))
    counts = scratch.table("judged", counts.withColumn("id", F.expr(f"pair div {size_b}")).join(F.broadcast(highest), "id").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")))
    # `hot` pairs hold 1 / hot_share of all rows or more each, so there are at most hot_share of them.
    is_hot = F.col("n") * hot_share >= max(total, 1)
    hot, cold = counts.filter(is_hot), counts.filter(~is_hot)
    looked = cells.join(F.broadcast(hot), "pair", "left")
    known = looked.filter("n IS NOT NULL").select("row", "times", "n", "is_best")
    rare = looked.filter("n IS NULL").select("row", "pair", "times").join(cold, "pair").select("row", "times", "n", "is_best")
    sums = known.union(rare).groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("pair_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("pair_best"))

    def regular(batches):
        for batch in batches:
            ids, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "id_times"))
            ends = np.append(0, np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)))
            add = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
            yield batch.drop_columns(["ids", "id_times"]).append_column("id_sum", pa.array(add(times * per_id[ids]), pa.int64())).append_column(
                "id_best", pa.array(add(times * (per_id[ids] == best[ids])), pa.int64()))

    kept = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    base = stored.filter("row IS NOT NULL").select(*[c.split()[0] for c in kept.split(", ")], "ids", "id_times").mapInArrow(regular, kept + ", id_sum long, id_best long")
    both = base.join(sums, "row", "left").fillna(0, ["pair_sum", "pair_best"])
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("id_best") + F.col("pair_best")).alias("n_best"), (F.col("id_sum") + F.col("pair_sum")).alias("count_sum"), "groups_sha256")
