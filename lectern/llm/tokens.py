"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Set LECTERN_VOCABULARY, pass ``vocabulary``, or ship the file with ``addFile`` where executors keep it elsewhere.
DEFAULT_VOCABULARY = os.environ.get("LECTERN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's authors cut a text into words before merging.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary file of ``path``, loaded once a Python worker."""
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = DEFAULT_VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text))


def n_tokens(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens; null for a null text, 0 for an empty one."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = encoding(path)
        for texts in batches:
            yield pd.Series([None if t is None else len(tokens.encode_ordinary(t)) for t in texts], dtype="Int64")

    return F.pandas_udf(of, T.LongType())(text)
