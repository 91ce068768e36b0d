"""Token counts of texts: by a tokenizer's ranks where a file of them is given, else by the estimate of four characters a token."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.text import token_estimate

#: Fixed value: the published pattern of the cl100k_base encoding
CL100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = CL100K):
    """An encoding from a file of base64 tokens and ranks; None if the library isn't there or the file doesn't read."""
    try:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError, ValueError):
        return None


def token_count(text: Column | str, path: str | None = None, pattern: str = CL100K) -> Column:
    """Tokens of a text; null is null. path: a rank file at the same place on every executor, whose tokens are counted in Arrow batches; without it, or where it doesn't read, characters divided by four."""
    if path is None or encoding(path, pattern) is None:
        return token_estimate(text)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = encoding(path, pattern)
        for b in batches:
            yield pd.Series([None if t is None else len(made.encode_ordinary(t)) for t in b], dtype="Int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(F.col(text) if isinstance(text, str) else text)
