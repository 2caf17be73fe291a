"""Token counts by a public tokenizer.

The vocabulary file's path is a parameter; it must be readable on every executor. Each Python
worker loads it once. NULL texts count 0 tokens; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("LOAMSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


def with_tokens(rows: DataFrame, column: str = "text", to: str = "tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``rows`` with the number of tokens of ``column``."""

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        own = encoding(path)
        return pd.Series(np.fromiter((len(own.encode_ordinary(t)) if t else 0 for t in texts), dtype=np.int64, count=len(texts)))

    return rows.withColumn(to, counted(F.col(column)))
