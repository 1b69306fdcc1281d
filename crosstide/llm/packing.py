"""Lexical retrieval packing into fixed windows of tokens.

Documents are encoded once and stored. Document frequencies, the number of documents and their mean length are taken over all
rows. Rows are then sent to shards by content: a hashed sample of at most `pivots` whole rows stands for the table, each row asks this
sample with all its terms (one dense row of BM25 weights a term: at most vocabulary x pivots numbers in a task), and rows are range-partitioned and sorted by their best pivot (similar pivots lie side by side), their
second best and their row number. So related documents of the whole table meet, and a hot pivot is split by the columns behind it.
A shard is a run of that order: at most `shard_docs` rows and about `shard_bytes` bytes of ids, across Arrow batches.

Each shard has its own postings, with BM25 weights from the frequencies of the whole table. Packing runs through the shard: a seed
document opens a window, the index is asked with all the seed's terms (or its `query_terms` strongest), and the unused documents
with the best scores follow until the window is full (the next unused one in order, when none scores). Windows are cut from that
stream, so every window but a shard's last is full. The last, shorter rest becomes windows of powers of two tokens, which need no
padding. A neighbour that lies in another shard is not found; `README.md` gives the measured share.

Null texts are empty and consist of the end id alone. Repeated rows are packed each; a null id is carried as null. An empty
table gives no row. Columns other than doc_id and text are not read. sequence_id = partition * 2^33 + number in the partition."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm import tokens
from crosstide.llm.common import Scratch, text_bytes

WINDOW, SHARD_DOCS, SHARD_BYTES, PIVOTS, GATHER, COMMON, BLOCK = 1024, 2048, 8 << 20, 1024, 256, 16, 256
K1, B = 1.2, 0.75
STORED = np.dtype("<u2")  # the vocabulary has fewer ids than 65,536; they are 32-bit only where they are put out


class Whole(NamedTuple):
    """Counts over all rows: documents, their mean length, and the document frequency of each id."""

    n: int
    mean: float
    df: np.ndarray


class Index:
    """Inverted index of one shard. docs: an array of token ids for each document; whole: counts to weigh with (missing: the shard's own).

    Terms in more than one of COMMON documents hold most postings: they are dense lines, multiplied for BLOCK seeds at once and kept (a number
    for each two documents of the shard at most). The other terms' postings are added by seed."""

    def __init__(self, docs: list[np.ndarray], query_terms: int | None = None, whole: Whole | None = None):
        n, lengths = len(docs), np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(n), lengths)
        pairs, tf = np.unique(np.concatenate(docs).astype(np.int64) * n + owner if n else np.zeros(0, np.int64), return_counts=True)
        term, self.doc = pairs // max(n, 1), pairs % max(n, 1)
        change = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.first, self.term = np.append(change, len(term)), term[change]
        df = np.diff(self.first)
        whole = whole or Whole(n, lengths.mean() if n else 0, np.bincount(self.term, df, self.term.max(initial=-1) + 1))
        idf = np.log1p((whole.n - whole.df[self.term] + 0.5) / (whole.df[self.term] + 0.5))
        row = np.repeat(np.arange(len(df)), df)
        norm = K1 * (1 - B + B * lengths / max(whole.mean, 1)) if n else lengths
        self.weight = idf[row] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n, useful = n, np.flatnonzero(df[row] > 1)  # a term of one document retrieves nothing else
        order = useful[np.lexsort((row[useful], -self.weight[useful], self.doc[useful]))] if query_terms else useful[np.argsort(self.doc[useful], kind="stable")]
        of = self.doc[order]
        start = np.searchsorted(of, np.arange(n + 1))
        self.terms = [row[order[a:min(b, a + query_terms) if query_terms else b]] for a, b in zip(start[:-1], start[1:], strict=True)]
        common = np.flatnonzero((df > 1) & (df * COMMON > n))
        self.line = np.full(len(df), -1)
        self.line[common] = np.arange(len(common))
        self.lines, dense = np.zeros((len(common), n)), self.line[row] >= 0
        self.lines[self.line[row[dense]], self.doc[dense]] = self.weight[dense]
        self.blocks = {}

    def of(self, terms: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents for distinct terms, by number."""
        spans = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.first[terms + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n) if spans else np.zeros(self.n)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the terms of the seed."""
        block, terms = seed // BLOCK, self.terms[seed]
        if block not in self.blocks:
            asked = self.terms[block * BLOCK:(block + 1) * BLOCK]
            line = self.line[np.concatenate(asked)]
            has, owner = np.zeros((len(asked), len(self.lines))), np.repeat(np.arange(len(asked)), list(map(len, asked)))
            has[owner[line >= 0], line[line >= 0]] = 1
            self.blocks[block] = has @ self.lines
        return self.blocks[block][seed % BLOCK] + self.of(terms[self.line[terms] < 0])


class Pivots:
    """BM25 weights of a few documents, asked with whole texts. Kept as (term, document, weight) and laid out densely where they are used."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], whole: Whole):
        """rows: the distinct ids and their frequencies for each document."""
        self.n = len(rows)
        self.term = np.concatenate([ids for ids, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(self.n), [len(ids) for ids, _ in rows])
        tf = np.concatenate([tf for _, tf in rows]).astype(float) if rows else np.zeros(0)
        length = np.bincount(self.doc, tf, self.n)
        idf = np.log1p((whole.n - whole.df[self.term] + 0.5) / (whole.df[self.term] + 0.5))
        self.weight = (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / max(whole.mean, 1)))).astype(np.float32)

    def dense(self, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The line of each id (0: no pivot has it) and the lines of weights for all, or the first, pivots."""
        known = np.unique(self.term)
        line = np.zeros(int(known.max(initial=-1)) + 2, np.int32)
        line[known] = np.arange(1, len(known) + 1)
        use = self.doc < (first or self.n)
        table = np.zeros((len(known) + 1, first or self.n), np.float32)
        table[line[self.term[use]], self.doc[use]] = self.weight[use]
        return line, table


def asked(ids: np.ndarray, line: np.ndarray, table: np.ndarray) -> np.ndarray:
    """BM25 scores of all pivots for a text's ids."""
    lines = line[np.minimum(np.unique(ids), len(line) - 1)]
    lines, score = lines[lines > 0], np.zeros(table.shape[1], np.float32)
    for a in range(0, len(lines), GATHER):
        score += table[lines[a:a + GATHER]].sum(axis=0)
    return score


class Asked:
    """`asked` for many texts: lines that more than one of COMMON pivots has are multiplied for BLOCK texts at once, the others added by text."""

    def __init__(self, line: np.ndarray, table: np.ndarray):
        self.line, self.table, n = line, table, table.shape[1]
        common = np.flatnonzero((table > 0).sum(axis=1) * COMMON > n)
        self.place, self.common = np.full(len(table), -1), table[common]
        self.place[common] = np.arange(len(common))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """A line of scores for each text."""
        lines = [self.line[np.minimum(np.unique(ids), len(self.line) - 1)] for ids in texts]
        has, rest = np.zeros((len(texts), len(self.common)), np.float32), []
        for k, mine in enumerate(lines):
            at = self.place[mine]
            has[k, at[at >= 0]] = 1
            rest.append(mine[(at < 0) & (mine > 0)])
        score = has @ self.common
        for k, mine in enumerate(rest):
            for a in range(0, len(mine), GATHER):
                score[k] += self.table[mine[a:a + GATHER]].sum(axis=0)
        return score


def best_first(score: np.ndarray, few: int = 64):
    """The places of all scores but zero, the best first and equal ones by place; beyond the first few they are sorted only if asked for."""
    least = np.partition(score, -few)[-few] if len(score) > few else 0
    for found in (np.flatnonzero((score >= least) & (score > 0)), None):
        found = np.flatnonzero((score < least) & (score > 0)) if found is None else found
        yield from found[np.argsort(-score[found], kind="stable")]


def order_of(docs: list[np.ndarray], window: int = WINDOW, query_terms: int | None = None, whole: Whole | None = None) -> list[int]:
    """The order in which the documents are laid into windows."""
    index, used, order, filled, following = Index(docs, query_terms, whole), np.zeros(len(docs), bool), [], 0, 0
    while len(order) < len(docs):
        if filled % window == 0 or not order:
            while used[following]:
                following += 1
            seed = following
            used[seed] = True
            order.append(seed)
            filled += len(docs[seed])
        else:
            seed = order[-1]  # it was cut by the window's end, and its rest opens this window
        room = -filled % window
        if not room:
            continue
        score = index.scores(seed)
        score[used] = 0
        for near in best_first(score):
            used[near] = True
            order.append(int(near))
            filled += len(docs[near])
            room -= len(docs[near])
            if room <= 0:
                break
        if room > 0 and len(order) < len(docs):
            while used[following]:
                following += 1
            used[following] = True
            order.append(following)
            filled += len(docs[following])
    return order


def windows_of(total: int, window: int = WINDOW) -> list[int]:
    """Lengths of the windows of a stream: full ones, then powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces_of(lengths: list[int], order: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of each piece."""
    pieces, sizes = [], windows_of(sum(lengths), window)
    at, room, offset = 0, sizes[0] if sizes else 0, 0
    for doc in order:
        start = 0
        while start < lengths[doc]:
            part = min(room - offset, lengths[doc] - start)
            pieces.append((doc, start, part, at, offset))
            start, offset = start + part, offset + part
            if offset == room and at + 1 < len(sizes):
                at, room, offset = at + 1, sizes[at + 1], 0
    return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, row, ids) of every row; store it before it is used twice, as row numbers follow the order of reading."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        encode, end = tokens.encoder(), np.zeros(1, np.uint32)
        if encode.max_token_value > np.iinfo(STORED).max:
            raise ValueError("stored ids are too narrow for this vocabulary")
        for batch in batches:
            offsets, data = text_bytes(batch)
            for a in range(0, len(batch), 256):
                part = offsets[a:a + 257]
                texts = [str(data[x:y], "utf-8", "replace") for x, y in zip(part[:-1], part[1:], strict=True)]
                # the search for special strings takes a fifth of the time, so it runs only where one stands
                raw = [np.concatenate((encode.encode_to_numpy(x, allowed_special={tokens.SPECIAL} if tokens.SPECIAL in x else set(), disallowed_special=()), end)).astype(STORED).tobytes() for x in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:a + len(raw)], "row": np.arange(number, number + len(raw)), "ids": pa.array(raw, pa.binary())})
                number += len(raw)

    return docs.select(*columns).mapInArrow(run, "doc_id long, row long, ids binary")


def rows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    offsets, data = text_bytes(batch, "ids")
    return [np.frombuffer(data[a:b], STORED).astype("<u4") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def counted(rows: DataFrame) -> Whole:
    """Counts over all encoded rows. Only sums by id reach the driver: as many rows as the vocabulary has ids."""
    def run(batches):
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for ids in rows_of(batch):
                distinct = np.unique(ids)
                if len(distinct) and distinct[-1] >= len(df):
                    df = np.append(df, np.zeros(int(distinct[-1]) + 1 - len(df), np.int64))
                df[distinct] += 1
                n, total = n + 1, total + len(ids)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(found, [-1, -2]), "df": np.append(df[found], [n, total])})

    sums = {r.term: int(r.df) for r in rows.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(max(sums, default=-1) + 1, np.int64)
    df[list(sums)] = list(sums.values())
    return Whole(n, total / max(n, 1), df)


def by_content(scratch: Scratch, rows: DataFrame, whole: Whole, pivots: int = PIVOTS) -> DataFrame:
    """Encoded rows in the order of their best pivots, range-partitioned."""
    def frequencies(batches):
        for batch in batches:
            found = [np.unique(ids, return_counts=True) for ids in rows_of(batch)]
            yield pa.RecordBatch.from_pydict({"mark": batch.column("mark"), "ids": pa.array([x.astype("<u4").tobytes() for x, _ in found], pa.binary()), "tf": pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary())})

    mark = F.xxhash64("row")  # distinct for distinct rows
    last = rows.select(mark.alias("mark")).orderBy("mark").limit(pivots).agg(F.max("mark")).first()[0]
    sample = rows.filter(mark <= F.lit(last)).select(mark.alias("mark"), "ids").mapInArrow(frequencies, "mark long, ids binary, tf binary")
    texts = [(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.tf, "<i8")) for r in sample.orderBy("mark").collect()]  # pivots x vocabulary at most
    index = Pivots(texts, whole)
    heads = max(1, len(texts) // 16)  # pivots are laid out by the best of the first few
    line, table = index.dense(heads)
    head = [int(asked(ids, line, table).argmax()) if len(texts) else 0 for ids, _ in texts]
    place = np.empty(len(texts), np.int32)
    place[np.lexsort((np.arange(len(texts)), head))] = np.arange(len(texts), dtype=np.int32)
    del texts, line, table

    def run(batches):
        weights = None
        for batch in batches:
            weights = weights or Asked(*index.dense())
            best, texts = np.zeros((len(batch), 2), np.int32), rows_of(batch)
            for a in range(0, len(texts), BLOCK):
                score = weights.scores(texts[a:a + BLOCK]).round(3)  # the order of a sum's terms does not decide between equal pivots
                each = np.arange(len(score))
                best[a:a + BLOCK, 0] = first = score.argmax(axis=1)
                score[each, first] = -1
                best[a:a + BLOCK, 1] = score.argmax(axis=1)
            near = place[best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0]), pa.array(near[:, 1])], [*batch.schema.names, "near", "next"])

    placed = scratch.table("placed", rows.mapInArrow(run, "doc_id long, row long, ids binary, near int, next int"))
    scratch.drop("encoded")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(width, "near", "next", "row").sortWithinPartitions("near", "next", "row").select("doc_id", "ids")


def shards(batches, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES):
    """(doc_ids, ids) of each shard: consecutive rows, also across batches."""
    names, docs, held = [], [], 0
    for batch in batches:
        for name, ids in zip(batch.column("doc_id").to_pylist(), rows_of(batch), strict=True):
            if docs and (len(docs) == shard_docs or held + ids.nbytes > shard_bytes):
                yield names, docs
                names, docs, held = [], [], 0
            names.append(name)
            docs.append(ids)
            held += ids.nbytes
    if docs:
        yield names, docs


def pack(docs: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES, query_terms: int | None = None, with_ids: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids as little-endian unsigned 32-bit integers."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table("encoded", encoded(docs))
    whole = counted(rows)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for names, docs_ids in shards(batches, shard_docs, shard_bytes):
            lengths = [len(d) for d in docs_ids]
            found = pieces_of(lengths, order_of(docs_ids, window, query_terms, whole), window)
            doc, start, length, at, offset = (np.array(x, np.int64) for x in zip(*found, strict=True))
            raw = [docs_ids[d][s:s + n].tobytes() for d, s, n, _, _ in found]
            columns = {
                "doc_id": pa.array([names[d] for d in doc], pa.int64()), "start": start, "length": length,
                "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()), "doc_tokens": np.array(lengths, np.int64)[doc],
                "sequence_id": number + at, "offset": offset}
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
            number += int(at[-1]) + 1

    return by_content(scratch, rows, whole, pivots).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
