"""Sizes in tokens of a public tokenizer. The vocabulary's path is a parameter; nothing is trained or copied."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("TRADELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of blanks too long for the tokenizer's pattern matcher, which goes through them recursively.
LONG_BLANKS = regex.compile(r"\p{White_Space}{20000,}")


@functools.cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(path: str = VOCABULARY) -> list[int]:
    """The number of bytes of each token, by its id."""
    enc = encoding(path)
    return [len(enc.decode_single_token_bytes(t)) for t in range(len(enc.token_byte_values()))]


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Token ids of the whole text, as the tokenizer gives them at any length; none for null. A long run of blanks is one piece before merging (but for
    its last blank, where more text follows), so the text is cut at its ends, which changes no token."""
    if not text:
        return []
    enc = encoding(path)
    if len(text) < 20_000 or not (runs := list(LONG_BLANKS.finditer(text))):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in runs:
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()]) + enc._core_bpe.encode_single_piece(text[m.start() : end].encode("utf-8"))
        at = end
    return out + enc.encode_ordinary(text[at:])


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text column; 0 for null or empty."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(encode(t, path)) for t in texts], dtype="int32")

    return count(F.col(text) if isinstance(text, str) else text)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores if it has fewer (one small file, say); otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
