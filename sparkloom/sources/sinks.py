"""Sinks: rotating JSON lines, text lines, vocabularies."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenfile import created


def rotating_json(df: DataFrame, path: str, shard_rows: int = 100_000, shards: int | None = None) -> None:
    """JSON lines in files of at most ``shard_rows``; of all rows, or the first ``shards`` files' worth."""
    (df.limit(shard_rows * shards) if shards else df).write.option("maxRecordsPerFile", shard_rows).json(path)


def text_lines(df: DataFrame, column: str, path: str) -> None:
    """One row a line; line ends inside become blanks."""
    df.select(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\r\n]+", " ")).write.text(path)


def embedding_file(df: DataFrame, token: str, vector: str, path: str) -> DataFrame:
    """Tokens and vectors as one npz file of ``vocab`` and ``embedding``, which a format of one file wants from one task;
    returns what was written."""

    def run(batches):
        words, rows = [], []
        for b in batches:
            words += b.column(0).to_pylist()
            rows += b.column(1).to_pylist()
        raw = io.BytesIO()
        np.savez(raw, vocab=np.array(words, str), embedding=np.array(rows, np.float32))
        with created(path) as f:
            f.write(raw.getvalue())
        yield pa.RecordBatch.from_pydict({"path": [path], "rows": [len(words)]})

    return df.select(token, vector).coalesce(1).mapInArrow(run, "path string, rows bigint")


def vocabulary_to_json(vocabulary: DataFrame) -> DataFrame:
    """``(token, id)`` as one JSON object; a vocabulary fits one row."""
    return vocabulary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id"))))).alias("json"))


def vocabulary_from_json(spark: SparkSession, text: str) -> DataFrame:
    m = spark.createDataFrame([(text,)], "json string").select(F.from_json("json", "map<string,bigint>").alias("m"))
    return m.select(F.explode("m").alias("token", "id"))
