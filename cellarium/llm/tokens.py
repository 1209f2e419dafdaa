"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder and file of the vocabulary; both can be set per call.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: Characters encoded at once; longer texts are cut before a blank, where no token reaches across.
CHUNK = 100_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import sys

    import tiktoken

    sys.path.append(os.path.dirname(os.path.realpath(os.path.dirname(path))))
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The whole text in parts that can be encoded one by one; a run without blanks is cut hard."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            blank = text.rfind(" ", at + 1, end)
            end = blank if blank > at else end
        yield text[at:end]
        at = end


def count_tokens(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; null for null."""
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([None if not isinstance(t, str) else sum(len(enc.encode_ordinary(p)) for p in pieces(t)) for t in texts], dtype="Int64")

    return count(text)
