"""Exact removal of long byte strings that an earlier document holds, by longest-previous-factor arrays.

Every window of `length` bytes is judged by the smallest of the hashes of its `gram`-byte substrings (its anchor): equal windows have
equal anchors. Consecutive windows with one anchor form a segment.

1. Documents are gathered into stored chunks. Each chunk sends its anchors, once each, to the anchor's bucket; the bucket answers
   which of them occur in several documents. Only segments with such an anchor go on, whole texts never do.
2. Segments, equal ones of a chunk once, go to the anchor's bucket. There the windows of all segments get their suffix order
   (prefix doubling up to `length` bytes). The previous and the next smaller document in that order give each window its longest
   previous factor; a factor of `length` bytes is an earlier copy.
3. Answers return to the chunk, which removes the covered bytes.

Chunks and buckets hold a bounded number of bytes; their number grows with the input. A string that stands in very many documents
is sent once a chunk, so chunk_bytes bounds how hot a bucket can get.

Null texts are empty. A null id counts as later than any other; rows of equal id are not earlier than one another. An empty table gives
none. Documents shorter than `length` bytes are never changed. Extra columns are carried only with keep=True."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import Scratch, chunked, packed, steps, unpacked

LENGTH, CHUNK_BYTES, BUCKET_BYTES = 50, 2 << 20, 16 << 20


def anchors(text: np.ndarray, offsets: np.ndarray, length: int):
    """(start, windows, anchor) of each segment of the documents text[offsets[i]:offsets[i + 1]]; no window crosses documents."""
    gram = max(1, min(length, length // 2 + 3))
    n, empty = len(text), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if n < length:
        return empty
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), np.dtype("<u8"), padded, 0, (1,))
    m = n - gram + 1
    if gram >= 8:
        h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        for at in [*range(8, gram - 8, 8), gram - 8] if gram > 8 else []:
            h ^= h >> np.uint64(29)
            h += words[at:at + m]
            h *= np.uint64(0xBF58476D1CE4E5B9)
    else:
        h = (words[:m] & np.uint64((1 << (8 * gram)) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < width:
        h = np.minimum(h[:len(h) - (width - step)], h[width - step:])
    valid = np.ones(len(h), bool)  # h[i] is the anchor of the window at i
    for end in offsets[1:-1]:
        valid[max(0, end - length + 1):end] = False
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (h[1:] != h[:-1])
    start = np.flatnonzero(change)
    stop = change.copy()
    stop |= ~valid
    ends = np.append(np.flatnonzero(stop), len(h))
    return start, ends[np.searchsorted(ends, start, side="right")] - start, h[start]


def suffix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each place a number that orders the strings of `length` bytes there; equal strings get equal numbers. Prefix doubling:
    strings of 8 bytes, then 16, 32, and so on, the last step overlapping."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    words = np.ndarray((len(data) + length,), np.dtype(">u8"), padded, 0, (1,)).astype(np.uint64)
    if length < 8:
        return np.unique(words[at] >> np.uint64(8 * (8 - length)), return_inverse=True)[1]
    size, rank = 8, np.unique(words[:len(data)], return_inverse=True)[1].astype(np.uint64)
    while size < length:
        step = min(size, length - size)
        later = np.zeros(len(rank), np.uint64)
        later[:max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank[at].astype(np.int64)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value, or -1; all open places jump along their pointers together."""
    at = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero((at >= 0) & (values[at] >= values))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (values[at[todo]] >= values[todo])]
    return at


def earlier_copy(ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each place has a previous factor of full length in a smaller document: its previous or next smaller document in
    suffix order starts with an equal string."""
    order = np.lexsort((docs, ranks))
    r, d = ranks[order], docs[order]
    before = smaller_before(d)
    after = len(d) - 1 - smaller_before(d[::-1])[::-1]
    hit = (before >= 0) & (r[before] == r)
    inside = after < len(d)
    hit |= inside & (r[np.where(inside, after, 0)] == r)
    found = np.empty(len(d), bool)
    found[order] = hit
    return found


def _chunk(row, length: int):
    offsets = unpacked(row["offsets"], np.int64)
    text = np.frombuffer(unpacked(row["text"]), np.uint8)
    return text, offsets, unpacked(row["ids"], np.int64), anchors(text, offsets, length)


def _by_bucket(anchor: np.ndarray, buckets: int):
    """(bucket, key) of anchors: the key is unique in its bucket but for rare clashes, which only send more. Keys of rising
    anchors rise."""
    return (anchor.astype(np.uint32) % np.uint32(buckets)).astype(np.int64), (anchor >> np.uint64(32)).astype(np.uint32)


def _requests(length: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, offsets, _, (start, _, anchor) = _chunk(row, length)
                distinct, first, owner = np.unique(anchor, return_index=True, return_inverse=True)
                doc = np.searchsorted(offsets, start, side="right")
                several = np.zeros(len(distinct), bool)
                several[owner[doc != doc[first][owner]]] = True
                bucket, key = _by_bucket(distinct, buckets)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                    yield pa.RecordBatch.from_pydict({"chunk_id": [row["chunk_id"]], "bucket": [int(bucket[part[0]])], "keys": [packed(steps(key[part], np.uint32))], "several": [np.packbits(several[part]).tobytes()]})
    return run


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: which keys stand in several documents, a bit for each key that a chunk sent."""
    keys = [np.cumsum(unpacked(b, np.uint32), dtype=np.int64) for b in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(table["several"].to_pylist(), keys, strict=True)]
    _, owner, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[owner[np.concatenate(several).astype(bool)]] = True
    parts = np.split(shared[owner], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"chunk_id": table["chunk_id"].cast(pa.int64()), "bucket": table["bucket"].cast(pa.int64()), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def _segments(length: int, buckets: int):
    schema = pa.schema([("chunk_id", pa.int64()), ("bucket", pa.int64()), ("segments", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = {b: bits for b, bits in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True)}
        for row in left.to_pylist():
            text, offsets, ids, (start, windows, anchor) = _chunk(row, length)
            distinct, owner = np.unique(anchor, return_inverse=True)
            bucket, key = _by_bucket(distinct, buckets)
            order = np.argsort(bucket, kind="stable")
            shared = np.zeros(len(distinct), bool)
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                shared[part] = np.unpackbits(np.frombuffer(answers[int(bucket[part[0]])], np.uint8), count=len(part)).astype(bool)
            use = np.flatnonzero(shared[owner])
            of, raw = bucket[owner[use]], text.tobytes()
            doc = ids[np.searchsorted(offsets, start[use], side="right") - 1]
            size = windows[use] + length - 1
            by = np.argsort(of, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if len(by) else []:
                seen: dict[bytes, int] = {}
                number = np.array([seen.setdefault(raw[a:a + n], len(seen)) for a, n in zip(start[use[part]].tolist(), size[part].tolist(), strict=True)], np.int64)
                least, first = np.full(len(seen), np.iinfo(np.int64).max), np.unique(number, return_index=True)[1]
                np.minimum.at(least, number, doc[part])
                out.append((row["chunk_id"], int(of[part[0]]), packed(b"".join(seen)), packed(np.array([len(s) for s in seen], np.uint32)), packed(key[owner[use[part[first]]]]), packed(least),
                            packed(np.concatenate([steps(number, np.int32), steps(start[use[part]], np.int32)]))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _judged(length: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: for each segment that a chunk sent 0 (stays), 1 (an earlier document holds it all), or 2 and a bit for each window."""
        seen: dict[bytes, int] = {}
        numbers, docs, keys = [], [], []
        for segments, sizes in zip(table["segments"].to_pylist(), table["sizes"].to_pylist(), strict=True):
            raw, ends = unpacked(segments), np.cumsum(unpacked(sizes, np.uint32).astype(np.int64))
            begins = np.append(0, ends[:-1])
            numbers.append(np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64))
        keys = np.concatenate([unpacked(b, np.uint32) for b in table["keys"].to_pylist()])
        docs = np.concatenate([unpacked(b, np.int64) for b in table["docs"].to_pylist()])
        every = np.concatenate(numbers)
        least = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(least, every, docs)
        key = np.zeros(len(seen), np.uint32)
        key[every] = keys
        _, owner, count = np.unique(key, return_inverse=True, return_counts=True)
        texts = list(seen)
        size = np.array([len(t) for t in texts], np.int64)
        # segments that alone have their anchor cannot meet another; the others are put in suffix order
        use = np.flatnonzero(count[owner] > 1)
        bits: dict[int, np.ndarray] = {}
        if len(use):
            data = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
            begin = np.cumsum(size[use]) - size[use]
            n = size[use] - length + 1
            segment = np.repeat(np.arange(len(use)), n)
            at = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n) + begin[segment]
            hit = earlier_copy(suffix_ranks(data, at, length), least[use][segment])
            some = np.unique(segment[hit])
            edge = np.append(0, np.cumsum(n))
            bits = {int(use[s]): hit[edge[s]:edge[s + 1]] for s in some}
        out = []
        for chunk, bucket, number, sent in zip(table["chunk_id"].to_pylist(), table["bucket"].to_pylist(), numbers, np.split(docs, np.cumsum([len(x) for x in numbers])[:-1]), strict=True):
            state = (least[number] < sent).astype(np.uint8)
            partial = [i for i, s in enumerate(number.tolist()) if s in bits and not state[i]] if bits else []
            state[partial] = 2
            found = np.concatenate([bits[int(number[i])] for i in partial]) if partial else np.zeros(0, bool)
            out.append((chunk, bucket, packed(state), packed(np.packbits(found))))
        return pa.table({"chunk_id": pa.array([o[0] for o in out], pa.int64()), "bucket": pa.array([o[1] for o in out], pa.int64()), "state": pa.array([o[2] for o in out], pa.binary()), "bits": pa.array([o[3] for o in out], pa.binary())})
    return run


def _covered(n: int, offsets, ids, length: int, right: pa.Table) -> np.ndarray:
    """Which bytes of a chunk go."""
    edges = np.zeros(n + 1, np.int64)
    sent, judged = {}, {}
    for r in right.to_pylist():
        if r["places"] is not None:
            sent[r["bucket"]] = r
        else:
            judged[r["bucket"]] = r
    for b, r in sent.items():
        size, least = unpacked(r["sizes"], np.uint32).astype(np.int64), unpacked(r["docs"], np.int64)
        number, start = np.cumsum(unpacked(r["places"], np.int32).reshape(2, -1), axis=1, dtype=np.int64)
        state, bits = unpacked(judged[b]["state"], np.uint8), unpacked(judged[b]["bits"])
        doc = ids[np.searchsorted(offsets, start, side="right") - 1]
        whole = (state[number] == 1) | (doc > least[number])
        np.add.at(edges, start[whole], 1)
        np.add.at(edges, start[whole] + size[number[whole]], -1)
        windows = np.where(state == 2, size - length + 1, 0)
        some = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(windows.sum())).astype(bool)
        edge = np.append(0, np.cumsum(windows))
        for i in np.flatnonzero((state[number] == 2) & ~whole):
            hit = np.flatnonzero(some[edge[number[i]]:edge[number[i] + 1]]) + start[i]
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + length, -1)
    return np.cumsum(edges)[:n] > 0


def _kept(length: int, keep: bool, names: list[str], schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            offsets, ids, raw = unpacked(row["offsets"], np.int64), unpacked(row["ids"], np.int64), unpacked(row["text"])
            gone = _covered(len(raw), offsets, ids, length, right)
            text = np.frombuffer(raw, np.uint8)
            if keep:
                gone = _whole_letters(text, gone)
            stays, head = text[~gone], np.append(0, np.cumsum(~gone))
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[offsets[:-1][offsets[:-1] < len(gone)]] |= gone[offsets[:-1][offsets[:-1] < len(gone)]]
            runs = np.append(0, np.cumsum(first))
            a, b = offsets[:-1], offsets[1:]
            kept = [stays[head[x]:head[y]].tobytes() for x, y in zip(a, b, strict=True)]
            if keep:
                rest = pa.ipc.open_stream(unpacked(row["rest"])).read_all()
                columns = {c: rest[c] for c in rest.column_names}
                columns["text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
                parts.append(pa.table([columns[c].cast(schema.field(c).type) if c in columns else None for c in names], schema=schema))
            else:
                parts.append(pa.table([
                    pa.array(np.where(ids == np.iinfo(np.int64).max, 0, ids), pa.int64(), mask=ids == np.iinfo(np.int64).max), pa.array(b - a, pa.int64()),
                    pa.array((b - a) - (head[b] - head[a]), pa.int64()), pa.array(runs[b] - runs[a], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()
    return run


def _whole_letters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Shrinks removed runs so that no letter of several bytes is cut."""
    lead = (text & 0xC0) != 0x80
    letter = np.cumsum(lead) - lead[0] if len(text) else np.zeros(0, int)
    cut = np.zeros(int(letter[-1]) + 1 if len(letter) else 0, bool)
    cut[letter[~gone]] = True
    return ~cut[letter]


def removed(docs: DataFrame, length: int = LENGTH, keep: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """keep=False: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. keep=True: the rows of docs with what stays of
    their texts, where removed runs end at whole letters."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    chunks = scratch.table("chunks", chunked(docs, chunk_bytes, keep))
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = int(max(8, min(1 << 24, -(-total // bucket_bytes))))
    bare = chunks.select("chunk_id", "ids", "offsets", "text")
    asked = bare.mapInArrow(_requests(length, buckets), "chunk_id long, bucket long, keys binary, several binary")
    shared = asked.groupBy("bucket").applyInArrow(_shared, "chunk_id long, bucket long, bits binary")
    segments = bare.groupBy("chunk_id").cogroup(shared.groupBy("chunk_id")).applyInArrow(
        _segments(length, buckets), "chunk_id long, bucket long, segments binary, sizes binary, keys binary, docs binary, places binary")
    segments = scratch.table("segments", segments)
    judged = segments.select("chunk_id", "bucket", "segments", "sizes", "keys", "docs").groupBy("bucket").applyInArrow(_judged(length), "chunk_id long, bucket long, state binary, bits binary")
    none = F.lit(None).cast("binary")
    back = segments.select("chunk_id", "bucket", "sizes", "docs", "places", none.alias("state"), none.alias("bits")).unionByName(
        judged.select("chunk_id", "bucket", none.alias("sizes"), none.alias("docs"), none.alias("places"), "state", "bits"))
    if keep:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = docs.schema
        schema = to_arrow_schema(out)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields)
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    carried = chunks if keep else bare
    return carried.groupBy("chunk_id").cogroup(back.groupBy("chunk_id")).applyInArrow(_kept(length, keep, [f.name for f in schema], schema), kind)
