"""Exact byte-level BPE ids of whole texts.

The ids are those of the tokenizers library for byte_bpe_50k.json; they come from the same vocabulary as ranks, which the
tiktoken library encodes several times faster. The special string is one token wherever it stands, the library's default."""

from __future__ import annotations

import base64
import functools

import numpy as np

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
"""Fixed values of the vocabulary file."""
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
"""The same splits as the vocabulary's own pattern without stepping back: a run of one class ends where it ends; spaces at the end of a text
are one piece; a single space before another character is all that the last alternative is left with."""


def json_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """One encoder a worker process; path: a file of base64 token and rank per line."""
    import tiktoken

    with open(path or ranks_path(), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def ids(text: str, path: str | None = None) -> np.ndarray:
    """Token ids of one text as unsigned 32-bit integers."""
    return encoder(path).encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)


@functools.lru_cache(maxsize=2)
def library(path: str | None = None):
    """The tokenizers library's own object, for encodings with offsets."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or json_path())
