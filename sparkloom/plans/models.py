"""Model stages: anything with ``score(texts)`` runs over Arrow batches, one instance a worker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Model(Protocol):
    def score(self, texts: list[str | None]) -> list[float | None]: ...


class LengthModel:
    """A stand-in that needs no weights: the length's reciprocal."""

    def score(self, texts: list[str | None]) -> list[float | None]:
        return [None if t is None else 1.0 / (1 + len(t)) for t in texts]


class Echo:
    """A stand-in client for tools and generation: the text comes back."""

    def complete(self, texts: list[str | None]) -> list[str | None]:
        return list(texts)


class WordByWord:
    """A stand-in translator of a few words: each known word, without case, becomes its counterpart."""

    def __init__(self, words: dict[str, str]) -> None:
        self.words = words

    def complete(self, texts: list[str | None]) -> list[str | None]:
        return [None if t is None else " ".join(self.words.get(w.lower(), w) for w in t.split(" ")) for t in texts]


def scored(df: DataFrame, text: str, model: Model, out: str = "score") -> DataFrame:
    """``df`` with the model's score of a text column; null stays null if the model says so."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(out, pa.array(model.score(b.column(text).to_pylist()), pa.float64()))

    return df.mapInArrow(run, schema)


def completed(df: DataFrame, text: str, client, out: str = "output", tries: int = 5) -> DataFrame:
    """``df`` with the client's completion; a batch that fails ``tries`` times keeps its input."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).to_pylist()
            done = texts
            for _ in range(tries):
                try:
                    done = client.complete(texts)
                    break
                except (OSError, TimeoutError):
                    continue
            yield b.append_column(out, pa.array(done, pa.string()))

    return df.mapInArrow(run, schema)
