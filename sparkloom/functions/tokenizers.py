"""Public tokenizers by their libraries, as Arrow functions; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS = T.ArrayType(T.IntegerType())
#: Fixed value: the public split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(8)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(8)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_bpe(path: str):
    """Ids of a byte-level vocabulary; null stays null."""

    def encode(s: pd.Series) -> pd.Series:
        e = _ranks(path)
        return s.map(e.encode_ordinary, na_action="ignore")

    return F.pandas_udf(encode, IDS)


def byte_bpe_text(path: str):
    """The text of ids."""

    def decode(s: pd.Series) -> pd.Series:
        e = _ranks(path)
        return s.map(lambda x: e.decode([int(i) for i in x]), na_action="ignore")

    return F.pandas_udf(decode, T.StringType())


def sentence_pieces(path: str):
    def encode(s: pd.Series) -> pd.Series:
        e = _pieces(path)
        return s.map(lambda t: e.encode(t), na_action="ignore")

    return F.pandas_udf(encode, IDS)
