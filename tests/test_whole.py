"""Queries over whole tables against plain Python, beside their SQL."""

import os
import unicodedata

import numpy as np
import pytest

from sparkloom.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def ids(spark):
    rows = spark.read.parquet(f"{DATA}/pack_records.parquet").where("size(input_ids) > 0").select("record_id", "tool", "input_ids").collect()
    return {r.record_id: r.input_ids for r in sorted(rows, key=lambda r: r.record_id)}


def rows(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, DATA).collect()))


def test_tags_of_long_records(spark, ids):
    spans, flags, pairs = [], [], {}
    for r, x in ids.items():
        t = [0, *(i % 3 for i in x), 0]
        start = [t[i] == 2 or (t[i] == 1 and t[i - 1] == 0) for i in range(1, len(t) - 1)]
        end = [t[i] > 0 and t[i + 1] != 1 for i in range(1, len(t) - 1)]
        flags += [(r, i, s, e) for i, (s, e) in enumerate(zip(start, end, strict=True))]
        spans += [(r, s, e) for s, e in zip(np.flatnonzero(start).tolist(), np.flatnonzero(end).tolist(), strict=True)]
        for s in (i for i, v in enumerate(x) if v % 3 == 2):
            e = next((i for i in range(s, len(x)) if x[i] % 3 == 1), None)
            if e is not None:
                pairs[r, e] = s
    assert max(map(len, ids.values())) >= 200
    assert rows(spark, "w15_tags_to_spans") == sorted(spans)
    assert rows(spark, "w16_pointer_match") == sorted((r, s, e) for (r, e), s in pairs.items())
    assert rows(spark, "w21_tag_flags") == sorted(flags)


def test_viterbi_of_long_records(spark, ids):
    got = {r.record_id: r.tags for r in QUERIES["w17_viterbi"](spark, DATA).collect()}
    assert set(got) == set(ids)
    for r, x in ids.items():
        score = np.array([[v % 5, v % 7, v % 3] for v in x], float)
        move = np.zeros((3, 3))
        move[0, 1] = -1000
        best, path = score[0] + move[0], [[0], [1], [2]]
        for s in score[1:]:
            come = best[:, None] + move
            path = [[*path[f], to] for to, f in enumerate(come.argmax(0).tolist())]
            best = come.max(0) + s
        assert got[r] == path[int(best.argmax())]


def test_ngram_ban_of_long_records(spark, ids):
    want = {}
    for r, x in ids.items():
        for a, b in zip(x, x[1:]):
            want.setdefault((r, a), set()).add(b)
    assert max(map(len, ids.values())) > 60
    assert rows(spark, "x45_ngram_ban") == sorted((r, a, sorted(b)) for (r, a), b in want.items())


def test_fixed_samples_of_all_tools(spark, ids):
    stream = [t for x in ids.values() for t in x]
    assert rows(spark, "w02_fixed_samples") == [(i, stream[i * 64 : i * 64 + 65]) for i in range((len(stream) - 1) // 64)]


def test_functions_over_all_texts(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("doc_id", "text").collect()]
    assert any("\n" in t for _, t in texts) and not all(t.isascii() for _, t in texts)
    assert rows(spark, "g01_scalar_function") == sorted((i, unicodedata.normalize("NFC", t)) for i, t in texts)
    assert rows(spark, "g04_compose") == sorted((i, t.strip(" ")[:20].replace(" ", "_")) for i, t in texts)


def test_shards_and_filters_by_content(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("doc_id", "text").collect()]
    assert 25 < len(texts) <= 100_000 and rows(spark, "s03_rotating_shards") == [(0, len(texts))]
    assert rows(spark, "p05_stream_filter") == sorted((i,) for i, t in texts if " " in t and len(t) > 10)
