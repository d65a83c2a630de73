"""Token counts and cuts with a public byte-level tokenizer, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary is unless a caller names another file in the same format (base64 token, blank, rank).
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: the published pattern that cuts text before the merges of this vocabulary.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer; loaded once in each Python worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def byte_shapes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By token: how many characters begin in it; whether it begins inside a character."""
    table = ranks(path)
    begins = np.zeros(max(table.values()) + 1, dtype=np.int32)
    inside = np.zeros(len(begins), dtype=bool)
    for token, rank in table.items():
        begins[rank] = sum((b & 0xC0) != 0x80 for b in token)
        inside[rank] = (token[0] & 0xC0) == 0x80
    return begins, inside


def count(text: str | None, path: str = DEFAULT_TOKENIZER) -> int | None:
    return None if text is None else len(encoder(path).encode_ordinary(text))


def token_count(column: str | Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """Tokens of a text column (null for null), in Arrow batches."""

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for texts in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int32")

    return counted(column)


def first_tokens(column: str | Column, most: int, path: str = DEFAULT_TOKENIZER) -> Column:
    """Struct (content, token_count): the text cut after ``most`` tokens, and how many it has then; null for null.

    A cut inside a character loses that character, so the text stays valid.
    """

    @F.pandas_udf("struct<content:string, token_count:int>")
    def cut_off(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for texts in batches:
            rows = []
            for t in texts:
                found = [] if t is None else enc.encode_ordinary(t)
                rows.append((None, None) if t is None else (t, len(found)) if len(found) <= most else (enc.decode_bytes(found[:most]).decode("utf-8", "ignore"), most))
            yield pd.DataFrame(rows, columns=["content", "token_count"]).astype({"token_count": "Int32"})

    return cut_off(column)
