"""Readers, sinks, the binary token file and what is left without the training-data subpackage."""

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.sources import readers, sinks, tokenfile


def put(path: Path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_json_texts(spark, tmp_path):
    put(tmp_path / "a-train-0.json", '{"text": "one"}\n{"text": "two", "x": 1}\n{}\n')
    put(tmp_path / "b-test-0.json", '{"text": "three"}\n')
    assert [r.text for r in readers.json_texts(spark, str(tmp_path), "train").collect()] == ["one", "two", None]
    assert readers.json_texts(spark, str(tmp_path), limit=2).count() == 2


def test_word_problems(spark, tmp_path):
    p = put(tmp_path / "m.csv", 'Question,Numbers,Equation,Answer\n"had number0, then number1","12 7",x,19\n' + '"number10 and number1",' + '"' + " ".join(map(str, range(20, 31))) + '",x,1\n')
    assert [r.question for r in readers.word_problems(spark, p).collect()] == ["had 12, then 7", "30 and 21"]


def test_facts_and_questions(spark, tmp_path):
    p = put(tmp_path / "f.json", '{"masked_sentences": ["It is in [MASK] ."], "obj_label": "Rome"}\n{"evidences": [{"masked_sentence": "[MASK] it is"}], "obj_label": "x"}\n')
    assert [(r.question, r.answers) for r in readers.masked_facts(spark, p).collect()] == [("Complete: It is in", ["Rome"])]
    p = put(tmp_path / "w.json", json.dumps([{"utterance": "who", "targetValue": '(list (description "A B") (description C))'}]))
    assert readers.web_questions(spark, p).collect()[0].answers == ["A B", "C"]


def test_blocks_stories_folders(spark, tmp_path):
    put(tmp_path / "c/x.txt", "-DOCSTART- O\n\na B\nb O\n\nc O\n")
    lines = readers.text_lines(spark, str(tmp_path / "c"))
    assert sorted((r.tokens, r.tags) for r in readers.tagged_blocks(lines).collect()) == [(["a", "b"], ["B", "O"]), (["c"], ["O"])]
    put(tmp_path / "s/1.story", "First line\n\nsecond\n@highlight\n\nshort one\n@highlight\nshort two\n")
    r = readers.stories(spark, str(tmp_path / "s")).collect()[0]
    assert (r.article, r.highlights) == ("First line second", "short one\nshort two")
    put(tmp_path / "d/pos/1.txt", "good\nmore")
    assert [(r.text, r.label) for r in readers.labelled_folders(spark, str(tmp_path / "d")).collect()] == [("good", "pos")]


def test_delimited_and_registry(spark, tmp_path):
    p = put(tmp_path / "t.tsv", "h1\th2\n1\ta\n2\tb\n")
    assert sorted(map(tuple, readers.delimited(spark, p, {"second": 1, "first": 0}, skip=1).collect())) == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError):
        readers.load(spark, "nothing", p)
    assert readers.load(spark, "checksums", p).collect()[0].md5 == __import__("hashlib").md5(Path(p).read_bytes()).hexdigest()


def test_xml(spark, tmp_path):
    p = put(tmp_path / "a.xml", "<all><article id='1'><p>x</p></article><article id='2'><p>y</p></article></all>")
    assert [r.p for r in readers.xml_rows(spark, p, "article", "_id STRING, p STRING").orderBy("_id").collect()] == ["x", "y"]


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").cast("string").alias("text")).coalesce(1)
    sinks.rotating_json(df, str(tmp_path / "r"), shard_rows=10, shards=2)
    files = sorted((tmp_path / "r").glob("*.json"))
    assert [len(f.read_text().splitlines()) for f in files] == [10, 10]
    v = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id bigint")
    text = sinks.vocabulary_to_json(v).collect()[0].json
    assert sorted(map(tuple, sinks.vocabulary_from_json(spark, text).collect())) == [("a", 0), ("b", 1)]


def test_token_file_round_trip(spark, tmp_path):
    rows = [(d, s, list(range(d * 10 + s, d * 10 + s + d))) for d in range(6) for s in range(3)]
    df = spark.createDataFrame(rows, "doc bigint, sent int, tokens array<int>")
    written = tokenfile.write(df, str(tmp_path), "doc", "sent", "tokens").collect()
    assert sum(w["items"] for w in written) == 18
    tokenfile.register(spark)
    back = spark.read.format("tokenfile").load(",".join(w.prefix for w in written))
    assert sorted(r.tokens for r in back.collect()) == sorted(t for _, _, t in rows)
    assert back.select("item").distinct().count() == 18


def test_token_index_layout(tmp_path):
    tokenfile.write_pair(str(tmp_path / "x"), [np.array([1, 2, 3]), np.array([], int), np.array([4])], [0, 2, 3], np.uint16)
    dtype, sizes, pointers, docs = tokenfile.read_index(str(tmp_path / "x"))
    assert (dtype, sizes.tolist(), pointers.tolist(), docs.tolist()) == (np.dtype(np.uint16), [3, 0, 1], [0, 6, 6], [0, 2, 3])
    (tmp_path / "y.idx").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        tokenfile.read_index(str(tmp_path / "y"))


def test_legacy_index(spark, tmp_path):
    items, prefix = [np.array([1, 2, 3]), np.array([4, 5])], str(tmp_path / "z")
    tokenfile.write_pair(prefix, items, [0, 1, 2])
    tokenfile.write_legacy_index(prefix, items, [0, 1, 2])
    tokenfile.register(spark)
    assert sorted(map(tuple, spark.read.format("tokenfile").load(prefix).collect())) == [(0, 0, [1, 2, 3]), (1, 1, [4, 5])]


def test_partial_reads_and_paths_with_a_scheme(spark, tmp_path):
    items, prefix = [np.arange(10), np.array([], int), np.array([7, 8])], f"file://{tmp_path}/deep/x"
    tokenfile.write_pair(prefix, items, [0, 1, 2, 3])
    tokenfile.register(spark)
    read = spark.read.format("tokenfile").option("offset", 3).option("length", 4)
    assert sorted(map(tuple, read.load(prefix).collect())) == [(0, 0, 10, [3, 4, 5, 6]), (1, 1, 0, []), (2, 2, 2, [])]


def test_splits_by_name_place_and_slice(spark):
    frames = {n: readers.with_labels(spark.range(i + 1), "id", ["a", "b"]) for i, n in enumerate(("train", "test"))}
    splits = readers.adapted(frames)
    assert splits["test"] is splits[1] is frames["test"] and splits[0:1] == (frames["train"],)
    assert readers.label_names(splits[0].where("id >= 0")) == ["a", "b"] and readers.label_names(spark.range(1)) == []
    assert readers.adapted(list(frames.values()), ("x", "y"))["y"] is frames["test"] and readers.adapted(frames["test"]) is frames["test"]
    assert sorted(map(tuple, splits.union("s").collect())) == [(0, "test"), (0, "train"), (1, "test")]
    with pytest.raises(ValueError):
        splits["none"]


def test_embedding_files(spark, tmp_path):
    e = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "token string, v array<float>")
    sinks.embedding_file(e, "token", "v", f"{tmp_path}/e.npz").collect()
    more = spark.createDataFrame([("b",), ("c",)], "token string")
    got = {only: {r.token: r.embedding for r in readers.embeddings(spark, f"{tmp_path}/e.npz", extended=more, only=only).collect()} for only in (False, True)}
    assert got[False] == {"a": [1, 2], "b": [3, 4], "c": [0, 0], "[UNK]": [0, 0], "[PAD]": [0, 0]} and set(got[True]) == {"b", "c", "[UNK]", "[PAD]"}


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from sparkloom import scratch

    def session(master, named=None):
        context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {})
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))

    with pytest.raises(ValueError):
        scratch.scratch(session("spark://host:7077"))
    assert scratch.scratch(session("spark://host:7077", "hdfs://x/y/")).startswith("hdfs://x/y/") and scratch.scratch(session("local[2]"))


def test_core_stands_alone():
    code = "import sys; sys.modules['sparkloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'subset_translator' in q and set(e.oracle_sql()) <= set(q); assert not any(m.startswith('sparkloom.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
