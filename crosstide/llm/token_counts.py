"""Token counts of whole documents, huge ones by overlap resynchronisation.

A document of up to `chunk_chars` characters is encoded at once. A longer one is encoded in overlapping chunks with offsets.
Neighbouring chunks are spliced at a stable common boundary: a place where a lone space stands between two characters that are
no white space, and where both encodings start a token. There every pre-token pattern of the vocabulary ends before the space
and starts with it, whatever came earlier, so the tokens left of the place are those of the left chunk and the tokens right of
it those of the right chunk. Where an overlap holds no such place it is widened, in the worst case to the rest of the document.

Null texts count as empty (0 tokens). Rows are independent: repeated ids give repeated rows, a null id stays null, an empty
table gives none. Columns other than doc_id and text are not read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm import tokens
from crosstide.llm.common import text_bytes

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def spliced_count(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, path: str | None = None) -> int:
    """Tokens of a text, from chunks of `chunk` characters that overlap by `overlap` characters or more."""
    encode = tokens.library(path).encode
    starts_of = lambda a, b: [a + s for s, _ in encode(text[a:b], add_special_tokens=False).offsets]
    total, begin, end = 0, 0, min(len(text), chunk + overlap)
    left, since = starts_of(begin, end), 0
    while end < len(text):
        wide, at = overlap, None
        while True:
            begin = max(since, end - wide)
            stop = min(len(text), begin + chunk + wide)
            right = starts_of(begin, stop)
            common = set(left) & set(right)
            # the last two tokens of the left chunk may be cut short by its end
            at = next((p for p in sorted(common, reverse=True) if begin < p < end - 2 and p > since and stable(text, p)), None)
            if at is not None or end == len(text):
                break
            wide *= 2
            end = min(len(text), end + wide)
            left = [p for p in starts_of(since, end)]
        if at is None:
            break
        total += sum(since <= p < at for p in left)
        left, since, end = [p for p in right if p >= at], at, stop
    return total + sum(p >= since for p in left)


def token_counts(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")]

    def count(batches):
        encode = tokens.encoder()
        for batch in batches:
            offsets, data = text_bytes(batch)
            n_tokens = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = str(data[a:b], "utf-8", "replace")
                n_tokens.append(len(encode.encode_to_numpy(text, allowed_special="all")) if len(text) <= chunk_chars else spliced_count(text, chunk_chars, overlap_chars))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(offsets[1:] - offsets[:-1], pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return docs.select(*columns).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
