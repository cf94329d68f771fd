"""Token ids of the whole corpus by a public byte-level BPE vocabulary.

The merges of a word run over two contiguous arrays: the boundaries of its parts and, beside each, the rank of the
pair that starts there. The smallest rank is found by scanning, its boundary deleted, and the two ranks beside it
looked up anew. Words of over ``SHORT`` bytes take the same merges by a heap, so that their cost doesn't grow with
the square of their length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 128
_NONE = 1 << 60


class Encoder(dict):
    """Word to its ids, remembered up to a bound; ``encode`` for whole texts."""

    LIMIT = 1 << 18

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else self.merged(raw) if len(raw) <= SHORT else self.merged_long(raw)
        if len(raw) <= SHORT:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = ids
        return ids

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Merges by scanning the rank array; two more entries close it."""
        get = self.ranks.get
        cut = list(range(len(raw) + 1))
        rank = [get(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while rank:
            low = min(rank)
            if low == _NONE:
                break
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(raw[cut[i] : cut[i + 2]], _NONE)
            if i:
                rank[i - 1] = get(raw[cut[i - 1] : cut[i + 1]], _NONE)
        return tuple(self.ranks[raw[a:b]] for a, b in zip(cut, cut[1:], strict=False))

    def merged_long(self, raw: bytes) -> tuple[int, ...]:
        """The same merges, lowest rank and then leftmost first, from a heap over linked parts."""
        get, n = self.ranks.get, len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [(get(raw[i : i + 2], _NONE), i, i + 2) for i in range(n - 1)]
        live = [x for x in live if x[0] != _NONE]
        heapify(live)
        gone = bytearray(n + 1)
        while live:
            _, i, end = heappop(live)
            j = after[i] if not gone[i] else n
            if gone[i] or j >= n or after[j] != end:
                continue
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    stop = after[after[k]]
                    if (r := get(raw[k:stop])) is not None:
                        heappush(live, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """No ids for null and empty text; strings of special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The process's encoder of that vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _there(path: str) -> str:
    """The file on this machine: at its path, or as the session sent it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(_there(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, flat = [0], []
                for text in part.column(1).to_pylist():
                    if text:
                        flat.append(np.fromiter(chain.from_iterable(map(own.__getitem__, own.split(text))), np.int32))
                        sizes.append(sizes[-1] + len(flat[-1]))
                    else:
                        sizes.append(sizes[-1])
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row, repeated rows too, in one pass without a shuffle. Null and empty texts have no ids, an empty list.
    Workers that lack the vocabulary file at its path get it from the session."""
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if os.path.exists(vocabulary):
        documents.sparkSession.sparkContext.addFile(os.fspath(vocabulary))
    return docs.mapInArrow(_run(os.fspath(vocabulary)), "doc_id bigint, ids array<int>")
