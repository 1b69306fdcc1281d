"""Prediction by partial matching: byte contexts with escapes and symbol exclusion, pretrained on the training documents.

The model is a context tree of up to `order` preceding bytes over lower-cased texts. A node with T symbols counted and D distinct
ones predicts a seen symbol with count / (T + D) and escapes with D / (T + D) to the context without its oldest byte, where the
symbols of the longer context are excluded from counts. Below order 0 the symbols left are alike (256 bytes and the text's end).

Documents are gathered into stored chunks. Each chunk sends the distinct (context, symbol) pairs of its documents, with the
training counts, to buckets by the two latest bytes; a bucket holds the whole subtree of these bytes and answers the log
probability of each pair. Only orders 0 and 1 are common to all buckets: at most 256 * 257 counts, which go with the tasks.
Words for the unigram base go the same way. Chunks then sum over their documents; no model is broadcast or collected.

Null texts are empty. A null id is scored, held out iff crc32 of the text 'null' says so. Repeated rows count each. An empty table
gives none. Columns other than doc_id and text are not read."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import LAST_ID, Scratch, chunked, packed, unpacked

ORDER, CHUNK_BYTES, BUCKET_BYTES = 5, 8 << 20, 16 << 20
END, SYMBOLS, TOP = 256, 257, 5
"""A pair is (TOP latest bytes, latest first) * 512 + symbol; `order` may be 2 to TOP."""


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"null" if i == LAST_ID else b"%d" % i) % 5 == 1 for i in ids.tolist()], bool)


def symbols(raw: bytes, offsets: np.ndarray, order: int):
    """Pair of each symbol, end included, and each document's number of symbols. Before a text stand zero bytes."""
    lead = bytes(8)
    text = b"".join(lead + raw[a:b] + b"\0" for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    a = np.frombuffer(text, np.uint8)
    sizes = np.diff(offsets) + 1
    stop = np.cumsum(sizes + 8) - 1
    real = np.ones(len(a), bool)
    for k in range(8):
        real[stop - sizes + 1 - 8 + k] = False
    at = np.flatnonzero(real)
    pair = np.ndarray((len(a) - 7,), np.dtype("<u8"), a, 0, (1,))[at - 8]
    pair = (pair >> np.uint64(8 * (8 - order))) << np.uint64(8 * (TOP - order) + 9)
    symbol = a.astype(np.uint64)
    symbol[stop] = END
    return (pair | symbol[at]).astype(np.int64), sizes


def _words(raw: bytes, offsets: np.ndarray):
    """Number of each token, ends included, the distinct tokens in order of appearance, and each document's number of tokens."""
    seen: dict[bytes, int] = {b"": 0}
    numbers, sizes = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = [seen.setdefault(w, len(seen)) for w in raw[a:b].split()]
        own.append(0)
        numbers.append(np.array(own, np.int64))
        sizes.append(len(own))
    return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), list(seen), np.array(sizes, np.int64)


def _open(row):
    return unpacked(row["text"]).lower(), unpacked(row["offsets"], np.int64), unpacked(row["ids"], np.int64)


def _pair_bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    latest = (pairs >> (8 * (TOP - 2) + 9)).astype(np.uint64)
    return ((latest * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _groups(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


ASKED = pa.schema([("chunk_id", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("what", pa.binary()), ("counts", pa.binary())])


def _requests(order: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, offsets, ids = _open(row)
                learn = ~held_out(ids)
                out = []
                pairs, sizes = symbols(raw, offsets, order)
                code, distinct = pd.factorize(pairs)
                counts = np.bincount(code[np.repeat(learn, sizes)], minlength=len(distinct))
                for part in _groups(_pair_bucket(distinct, buckets)):
                    out.append((row["chunk_id"], int(_pair_bucket(distinct[part[:1]], buckets)[0]), 0, packed(distinct[part]), packed(counts[part].astype(np.uint32))))
                code, words, sizes = _words(raw, offsets)
                counts = np.bincount(code[np.repeat(learn, sizes)], minlength=len(words))
                bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
                for part in _groups(bucket):
                    out.append((row["chunk_id"], int(bucket[part[0]]), 1, packed(b"\n".join(words[i] for i in part)), packed(counts[part].astype(np.uint32))))
                for o in out:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(o, ASKED, strict=True)], schema=ASKED)
    return run


def _low(batches):
    """Counts of (latest byte, symbol) over all pairs of a task."""
    total = np.zeros(256 * 512, np.int64)
    for batch in batches:
        for what, counts in zip(batch.column("what").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            pairs = unpacked(what, np.int64)
            np.add.at(total, (pairs >> (8 * (TOP - 1) + 9)) << 9 | pairs & 511, unpacked(counts, np.uint32).astype(np.int64))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


class Tree:
    """The subtree over given distinct pairs and their training counts, and the counts of orders 0 and 1."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, first: np.ndarray, order: int):
        self.order, self.first = order, first
        zero = first.sum(axis=0)
        t0, d0 = zero.sum(), (zero > 0).sum()
        self.levels = {}
        for k in range(order, 1, -1):
            key, inv = np.unique(((pairs >> (8 * (TOP - k) + 9)) << 9) | (pairs & 511), return_inverse=True)
            n = np.bincount(inv, counts, len(key)).astype(np.int64)
            context, owner = np.unique(key >> 9, return_inverse=True)
            self.levels[k] = (key, n, context, np.bincount(owner, n, len(context)), np.bincount(owner, minlength=len(context)), owner)
        # of each context: the counts that its symbols have in the next shorter context
        self.hidden = {}
        for k, (key, _, context, _, _, owner) in self.levels.items():
            if k > 2:
                lower, n = self.levels[k - 1][:2]
                shorter = ((key >> 17) << 9) | (key & 511)
                self.hidden[k] = np.bincount(owner, n[np.searchsorted(lower, shorter)], len(context))
            else:
                self.hidden[k] = np.bincount(owner, first[(key >> 17), key & 511], len(context))
        self.zero, self.t0, self.d0 = zero, t0, d0
        self.t1, self.d1 = first.sum(axis=1), (first > 0).sum(axis=1)
        self.hidden1 = ((first > 0) * zero[None, :]).sum(axis=1)

    def log10(self, pairs: np.ndarray) -> np.ndarray:
        """log10 probability of each pair's symbol in its context."""
        p, open_ = np.zeros(len(pairs)), np.ones(len(pairs), bool)
        symbol = pairs & 511
        hidden, distinct = np.zeros(len(pairs)), np.zeros(len(pairs))  # of the longer context: counts and symbols to leave out
        for k in range(self.order, -1, -1):
            if k > 1:
                key, n, context, t, d, _ = self.levels[k]
                of = pairs >> (8 * (TOP - k) + 9)
                at = np.minimum(np.searchsorted(context, of), max(len(context) - 1, 0))
                known = context[at] == of if len(context) else np.zeros(len(pairs), bool)
                place = np.minimum(np.searchsorted(key, of << 9 | symbol), max(len(key) - 1, 0))
                count = np.where(key[place] == (of << 9 | symbol), n[place], 0) if len(key) else np.zeros(len(pairs))
                total, kinds, below = (np.where(known, x[at], 0) if len(context) else np.zeros(len(pairs)) for x in (t, d, self.hidden[k]))
            elif k == 1:
                of = pairs >> (8 * (TOP - 1) + 9)
                count, total, kinds, below = self.first[of, symbol], self.t1[of], self.d1[of], self.hidden1[of]
                known = total > 0
            else:
                count, total, kinds, below = self.zero[symbol], np.full(len(pairs), self.t0), np.full(len(pairs), self.d0), np.zeros(len(pairs))
                known = total > 0
            left, fresh = total - hidden, kinds - distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = open_ & known & (count > 0)
                p[hit] += np.log10(count[hit]) - np.log10(left[hit] + fresh[hit])
                miss = open_ & known & (count == 0) & (fresh > 0)
                p[miss] += np.log10(fresh[miss]) - np.log10(left[miss] + fresh[miss])
            open_ &= ~hit
            hidden, distinct = np.where(known, below, 0), np.where(known, kinds, 0)
        p[open_] -= np.log10(SYMBOLS - self.d0)
        return p


ANSWERS = "chunk_id long, bucket long, kind int, answer binary, n long, v long"


def _answers(order: int, first: np.ndarray):
    """One bucket of pairs (log probabilities as 32-bit floats), or of words (training counts; and one row of sums)."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        if rows[0]["kind"] == 0:
            asked = [unpacked(r["what"], np.int64) for r in rows]
            distinct, inv = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(inv, np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]), len(distinct)).astype(np.int64)
            found = Tree(distinct[counts > 0], counts[counts > 0], first, order).log10(distinct).astype(np.float32)
            for r, part in zip(rows, np.split(inv, np.cumsum([len(a) for a in asked])[:-1]), strict=True):
                out.append((r["chunk_id"], r["bucket"], 0, packed(found[part]), 0, 0))
        else:
            seen: dict[bytes, int] = {}
            numbers = [np.array([seen.setdefault(w, len(seen)) for w in unpacked(r["what"]).split(b"\n")], np.int64) for r in rows]
            counts = np.bincount(np.concatenate(numbers), np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]), len(seen)).astype(np.int64)
            out = [(r["chunk_id"], r["bucket"], 1, packed(counts[part]), 0, 0) for r, part in zip(rows, numbers, strict=True)]
            out.append((None, rows[0]["bucket"], 1, None, int(counts.sum()), int((counts > 0).sum())))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk_id", "bucket", "kind", "answer", "n", "v"])
    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(order: int, buckets: int, n_train: int, v_train: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {(r["kind"], r["bucket"]): r["answer"] for r in right.to_pylist()}
        parts = []
        for row in left.to_pylist():
            raw, offsets, ids = _open(row)
            sums = lambda values, sizes: np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)  # noqa: E731  every document has an end
            pairs, sizes = symbols(raw, offsets, order)
            code, distinct = pd.factorize(pairs)
            logs = np.zeros(len(distinct))
            for part in _groups(_pair_bucket(distinct, buckets)):
                logs[part] = unpacked(answers[0, int(_pair_bucket(distinct[part[:1]], buckets)[0])], np.float32)
            score = sums(logs[code], sizes)
            code, words, sizes = _words(raw, offsets)
            counts = np.zeros(len(words), np.int64)
            for part in _groups(np.array([zlib.crc32(w) % buckets for w in words], np.int64)):
                counts[part] = unpacked(answers[1, zlib.crc32(words[part[0]]) % buckets], np.int64)
            base = sums(np.log10((counts + 0.5) / (n_train + 0.5 * (v_train + 1)))[code], sizes)
            known = sums((counts > 0).astype(np.int64)[code], sizes)
            missing = ids == LAST_ID
            parts.append(pa.table([pa.array(np.where(missing, 0, ids), pa.int64(), mask=missing), held_out(ids), sizes, known.astype(np.int64), np.full(len(ids), n_train), base, score], schema=SCORES))
        return pa.concat_tables(parts) if parts else SCORES.empty_table()
    return run


def score_documents(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: held_out, token counts, the unigram base and the model's log10 probability of the whole text."""
    if not 2 <= order <= TOP:
        raise ValueError(f"order must be 2 to {TOP}")
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.table("chunks", chunked(docs, chunk_bytes)).select("chunk_id", "ids", "offsets", "text", "n_bytes")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = int(max(8, min(1 << 16, -(-total // bucket_bytes))))
    chunks = chunks.drop("n_bytes")
    asked = scratch.table("asked", chunks.mapInArrow(_requests(order, buckets), "chunk_id long, bucket long, kind int, what binary, counts binary"))
    low = asked.filter("kind = 0").select("what", "counts").mapInArrow(_low, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 256 * 257 rows
    first = np.zeros((256, SYMBOLS), np.int64)
    for r in low:
        first[r["pair"] >> 9, r["pair"] & 511] = r["n"]
    answers = scratch.table("answers", asked.groupBy("kind", "bucket").applyInArrow(_answers(order, first), ANSWERS))
    scratch.drop("asked")
    sums = answers.filter("chunk_id IS NULL").agg(F.sum("n"), F.sum("v")).first()
    found = answers.filter("chunk_id IS NOT NULL").select("chunk_id", "bucket", "kind", "answer")
    return chunks.groupBy("chunk_id").cogroup(found.groupBy("chunk_id")).applyInArrow(
        _scored(order, buckets, sums[0] or 0, sums[1] or 0), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
