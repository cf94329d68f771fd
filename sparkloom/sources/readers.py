"""Readers: a schema each, never inferred; file order never matters, rows carry what orders them."""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tokenfile import opened

SPAN = "STRUCT<text: STRING>"
NESTED_QA = f"data ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<context: STRING, qas: ARRAY<STRUCT<question: STRING, answers: ARRAY<{SPAN}>>>>>>>"
ANNOTATIONS = "data STRUCT<text: STRING>, annotations ARRAY<STRUCT<result: ARRAY<STRUCT<id: STRING, type: STRING, from_id: STRING, to_id: STRING, labels: ARRAY<STRING>, value: STRUCT<start: INT, end: INT, labels: ARRAY<STRING>, choices: ARRAY<STRING>>>>>>"


def json_texts(spark: SparkSession, path: str, split: str = "", limit: int | None = None) -> DataFrame:
    """The field ``text`` of JSON lines in the files whose name holds the split."""
    df = spark.read.schema("text STRING").json(path, pathGlobFilter=f"*{split}*.json*")
    return df.limit(limit) if limit else df


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("text STRING").json(path)


def plain_documents(spark: SparkSession, path: str, key: str = "text") -> DataFrame:
    """JSON lines plain or zstd-compressed under a folder; other files are passed over."""
    return spark.read.schema(f"{key} STRING").json(path, recursiveFileLookup=True, pathGlobFilter="*.{jsonl,json,zst}")


def word_problems(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: question, blank-separated numbers, equation, answer; ``number{i}`` in the question filled in from the last."""
    df = spark.read.csv(path, header=True, schema="question STRING, numbers STRING, equation STRING, answer STRING", escape='"', multiLine=True)
    return df.select(fill_numbers(F.col("question"), F.col("numbers")).alias("question"), F.array("answer").alias("answers"))


def fill_numbers(question: Column, numbers: Column) -> Column:
    n = F.split(F.trim(F.coalesce(numbers, F.lit(""))), r"\s+")
    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(n) - 1)), question, lambda t, i: F.replace(t, F.concat(F.lit("number"), i.cast("string")), F.get(n, i)))


def masked_facts(spark: SparkSession, path: str) -> DataFrame:
    """The first masked sentence of either shape, where the mask ends it; cut before the mask."""
    df = spark.read.schema("masked_sentences ARRAY<STRING>, evidences ARRAY<STRUCT<masked_sentence: STRING>>, obj_label STRING").json(path)
    s = F.coalesce(F.get("masked_sentences", F.lit(0)), F.get("evidences", F.lit(0))["masked_sentence"])
    return df.select(s.alias("s"), F.array("obj_label").alias("answers")).where(F.col("s").rlike(r"\[MASK\]\s*[.,!?]?\z")).select(F.concat(F.lit("Complete: "), F.trim(F.substring_index("s", "[MASK]", 1))).alias("question"), "answers")


def web_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of utterances with targets like (list (description "X") …): all descriptions are answers."""
    df = spark.read.schema("utterance STRING, targetValue STRING").json(path, multiLine=True)
    found = F.regexp_extract_all("targetValue", F.lit(r"\(description ([^)]*)\)"), F.lit(1))
    return df.select(F.col("utterance").alias("question"), F.transform(found, lambda x: F.replace(x, F.lit('"'), F.lit(""))).alias("answers"))


def open_questions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("question STRING, answer ARRAY<STRING>").json(path)
    return df.select(F.concat("question", F.lit(" ?")).alias("question"), F.col("answer").alias("answers"))


def alias_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one object with Data[].Question and Answer.NormalizedAliases, one after the other."""
    df = spark.read.schema("Data ARRAY<STRUCT<Question: STRING, Answer: STRUCT<NormalizedAliases: ARRAY<STRING>>>>").json(list(paths), multiLine=True)
    return df.select(F.explode("Data").alias("d")).select(F.col("d.Question").alias("question"), F.col("d.Answer.NormalizedAliases").alias("answers"))


def nested_qa(spark: SparkSession, path: str, first_only: bool = True) -> DataFrame:
    """data → paragraphs → qas; the first question and answer of each paragraph, or all of them."""
    p = spark.read.schema(NESTED_QA).json(path, multiLine=True).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    q = p.select("p.context", F.explode(F.slice("p.qas", 1, 1) if first_only else F.col("p.qas")).alias("q"))
    return q.select("context", F.col("q.question").alias("question"), (F.slice("q.answers.text", 1, 1) if first_only else F.col("q.answers.text")).alias("answers"))


def delimited(spark: SparkSession, path: str, columns: dict[str, int], skip: int = 0, separator: str = "\t") -> DataFrame:
    """Columns by position; the first ``skip`` lines of each file are headings."""
    df = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    if skip:
        head = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "\r?\n"), 1, skip)).alias("value"))
        df = df.join(head.distinct(), "value", "left_anti")
    parts = F.split("value", F.lit(f"[{separator}]"))
    return df.select(*[F.get(parts, F.lit(i)).alias(name) for name, i in columns.items()])


def text_lines(spark: SparkSession, path: str, out: str = "text") -> DataFrame:
    """Lines with their number in the file: ``file, line_no, text``."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", out))


def labelled_folders(spark: SparkSession, path: str) -> DataFrame:
    """One text a file, its folder's name the label, its first line the text."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.substring_index("value", "\n", 1).alias("text"), F.element_at(F.split(F.input_file_name(), "/"), -2).alias("label"))


def tagged_blocks(lines: DataFrame, file: str = "file", order: str = "line_no", text: str = "text", mark: str = "-DOCSTART-") -> DataFrame:
    """'token tag' lines, blocks parted by blank lines or a mark: ``tokens, tags``."""
    from ..operators.ordered import blocks

    stop = (F.trim(text) == "") | F.startswith(F.col(text), F.lit(mark))
    b = blocks(lines, [file], order, stop, "block").where(~stop)
    parts = F.split(text, r"[ \t\x02]+")
    b = b.select(file, "block", order, F.get(parts, F.lit(0)).alias("token"), F.element_at(parts, -1).alias("tag"))
    rows = b.groupBy(file, "block").agg(F.array_sort(F.collect_list(F.struct(order, "token", "tag"))).alias("r"))
    return rows.select(file, "block", F.transform("r", lambda x: x["token"]).alias("tokens"), F.transform("r", lambda x: x["tag"]).alias("tags"))


def stories(spark: SparkSession, path: str) -> DataFrame:
    """Files of article lines and, after the first '@highlight', highlights: ``article, highlights``."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    parts = F.split("value", "@highlight")
    clean = lambda t: F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    return df.select(F.input_file_name().alias("file"), clean(F.get(parts, F.lit(0))).alias("article"), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), clean), "\n").alias("highlights"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def annotations(df: DataFrame) -> DataFrame:
    """Entities of an annotation export: ``text, id, start, end, label``."""
    r = df.select(F.col("data.text").alias("text"), F.explode("annotations").alias("a")).select("text", F.explode("a.result").alias("r")).where("r.type = 'labels'")
    return r.select("text", F.col("r.id").alias("id"), F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"), F.get(F.col("r.value.labels"), F.lit(0)).alias("label"))


def relations(df: DataFrame) -> DataFrame:
    r = df.select(F.explode("annotations").alias("a")).select(F.explode("a.result").alias("r")).where("r.type = 'relation'")
    return r.select(F.col("r.from_id").alias("from_id"), F.col("r.to_id").alias("to_id"), F.get(F.col("r.labels"), F.lit(0)).alias("label"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, md5`` of files, to verify what was fetched."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def from_function(calls: DataFrame, argument: str, rows, schema: str) -> DataFrame:
    """What a generator function yields for each row's argument, run where the row is; batches of 4,096."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                held = []
                for r in rows(x):
                    held.append(r)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return calls.select(argument).mapInArrow(run, kind)


def embeddings(spark: SparkSession, path: str, unknown: str = "[UNK]", padding: str = "[PAD]", extended: DataFrame | None = None, only: bool = False) -> DataFrame:
    """``token, embedding`` of npz files of ``vocab`` and ``embedding``, the unknown token's and the padding's zeros after
    them. With a vocabulary ``extended`` (one column of tokens) its tokens come too, zeros where they have no vector;
    ``only`` leaves out what isn't in it."""

    def rows(file: str):
        with np.load(io.BytesIO(opened(file).read())) as z:
            yield from zip(z["vocab"].tolist(), z["embedding"].tolist(), strict=True)

    files = spark.read.format("binaryFile").load(path).select("path")
    got = from_function(files, "path", rows, "token string, embedding array<float>")
    if extended is not None:
        more = extended.toDF("token").distinct()
        got = got.join(more, "token", "right" if only else "full")
    got = got.unionByName(spark.createDataFrame([(unknown, None), (padding, None)], got.schema)).dropDuplicates(["token"])
    width = got.agg(F.max(F.size("embedding")).alias("w"))  # one row
    return got.join(F.broadcast(width), F.lit(True)).select("token", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), F.col("w"))).alias("embedding"))


class Splits(tuple):
    """Frames of a data set by place, slice or split name."""

    def __new__(cls, frames: dict[str, DataFrame]) -> Splits:
        made = super().__new__(cls, frames.values())
        made.names = tuple(frames)
        return made

    def __getitem__(self, key):
        return super().__getitem__(self.names.index(key) if isinstance(key, str) else key)

    def union(self, column: str) -> DataFrame:
        """All rows, with the name of their split."""
        marked = [df.withColumn(column, F.lit(name)) for name, df in zip(self.names, self, strict=True)]
        return reduce(DataFrame.unionByName, marked)


def with_labels(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``df`` with the label names of a column of label numbers in its metadata."""
    return df.withMetadata(column, {"names": list(names)})


def label_names(df: DataFrame) -> list[str]:
    """The label names of the last column that has some; none of a frame without."""
    return next((f.metadata["names"] for f in reversed(df.schema.fields) if "names" in f.metadata), [])


def adapted(data: DataFrame | dict[str, DataFrame] | list[DataFrame], splits: tuple[str, ...] = ()) -> Splits | DataFrame:
    """What a loader of another library gives: frames by split, frames in the order of ``splits``, or one frame as it is.
    Label names stay with each frame (``label_names``)."""
    if isinstance(data, dict):
        return Splits(data)
    return Splits(dict(zip(splits, data, strict=True))) if isinstance(data, list) else data


#: Name to reader, for callers that choose by name; each takes the session and a path.
REGISTRY = {f.__name__: f for f in (json_texts, plain_documents, word_problems, masked_facts, web_questions, open_questions, alias_questions, nested_qa, text_lines, labelled_folders, stories, checksums)}


def load(spark: SparkSession, name: str, path: str, splits: tuple[str, ...] = (), **options) -> DataFrame | Splits:
    """A registered reader's rows; with splits a frame for each, from the folder of its name."""
    if name not in REGISTRY:
        raise ValueError(f"no reader {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return Splits({s: REGISTRY[name](spark, f"{path}/{s}", **options) for s in splits}) if splits else REGISTRY[name](spark, path, **options)
