"""Every query against its SQL twin in DuckDB, on the smallest tables; those that number rows on larger ones too."""

import math
import os
from pathlib import Path

import pytest

from sparkloom.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def large():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(LARGE).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(LARGE).exists(), reason="no such tables here")
@pytest.mark.parametrize("name", ["w01_prefix_pointers", "w02_fixed_samples", "w06_shuffle_index", "w07_split_by_position", "w10_blend", "w13_rank", "t02_buffered_sort", "t06_wraparound", "b01_stack", "b06_seq2seq", "j05_zip", "a04_best_threshold", "a16_spearman", "m04_ordered_map", "x28_missing_period", "x33_calculator", "f01_arithmetic", "f04_date_text"])
def test_query_on_large_tables(spark, large, name):
    check(QUERIES[name](spark, LARGE), large, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    check(QUERIES[name](spark, DATA), duck, name)


def check(df, duck, name):
    got = [tuple(r.asDict(recursive=True).values()) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    types = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    for f in df.schema:
        assert types.get(f.dataType.typeName(), kinds[f.name]) == kinds[f.name], f"{f.name}: {f.dataType.typeName()} {kinds[f.name]}"
