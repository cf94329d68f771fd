"""Evaluation texts inside training text, by suffix arrays over shards of the corpus.

A shard is a run of documents held by one task: their words as numbers, a break after each document. Its suffix
array holds the starts of suffixes in the order of their first words, as deep as the shortest match that counts.
Each test suffix is looked up in it by binary search; what it finds is extended word by word to the longest
verbatim match. A suffix whose first words include one that no test text has can't match and is left out of the
array, which changes no result. The test texts are held whole by each task: they are the queries, and larger sets
of them go through in blocks of ``BLOCK_BYTES``, each a pass over the corpus. First words that many test suffixes share with
many places are expanded ``AT_ONCE`` matches at a time, so that a task holds no more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed
from .words import MIN_WORDS, words

#: Successive words that make a leak, and of texts in Han characters successive characters.
WORDS, HAN = 8, 12
SHARD_WORDS = 1_000_000
#: UTF-8 bytes of test texts in a block, and matches expanded at a time.
BLOCK_BYTES, AT_ONCE = 8 << 20, 1 << 20
_HAN = regex.compile(r"\p{Han}")


class TestTexts:
    """Test passages as numbered words: ``ids`` flat, with a break after each; ``least`` words count for a passage."""

    def __init__(self, passages: list[tuple[int, str]]) -> None:
        self.number: dict[bytes, int] = {}
        ids, owner, least = [], [], []
        for item, text in passages:
            ws = words(text)
            han = sum(1 for w in ws if _HAN.match(w.decode()))
            need = HAN if 2 * han > len(ws) else WORDS
            if len(ws) < need:
                continue
            ids.extend(self.number.setdefault(w, len(self.number) + 1) for w in ws)
            ids.append(-1)
            owner.extend([item] * (len(ws) + 1))
            least.extend([need] * (len(ws) + 1))
        self.ids = np.array(ids, np.int64)
        self.owner = np.array(owner, np.int64)
        self.least = np.array(least, np.int64)


def _ranks(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``depth`` words: prefixes doubled, ``depth`` a power of two."""
    rank = ids
    step = 1
    while step < depth:
        two = np.full(len(rank), -1, np.int64)
        two[:-step] = rank[step:]
        _, rank = np.unique(rank * np.int64(1 << 31) + two, return_inverse=True)
        step *= 2
    return rank[starts]


def leaks(corpus: np.ndarray, test: TestTexts, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Longest matches of one shard, some at a time: (start in the corpus, start in the test words, length).

    ``corpus`` has the test texts' word numbers, 0 for words of no test text and for breaks.
    """
    depth = 1 << (WORDS.bit_length() - 1)
    if len(corpus) < WORDS or not len(test.ids):
        return
    # only suffixes of at least WORDS test words
    stop = np.flatnonzero(corpus == 0)
    ahead = np.append(stop, len(corpus))[np.searchsorted(stop, np.arange(len(corpus)))] - np.arange(len(corpus))
    starts = np.flatnonzero(ahead >= WORDS)
    if not len(starts):
        return
    # the kept stretches and the test words in one array, so that ranks compare
    keep = np.zeros(len(corpus) + 1, bool)
    keep[:-1] = corpus > 0
    place = np.flatnonzero(keep[:-1] | np.append(False, keep[:-2]))
    joined = np.concatenate((corpus[place], [0], np.maximum(test.ids, 0)))
    at = np.searchsorted(place, starts)
    tests = np.flatnonzero(np.maximum(test.ids, 0) > 0)
    rank = _ranks(joined, np.concatenate((at, tests + len(place) + 1)), depth)
    ours, theirs = rank[: len(starts)], rank[len(starts) :]
    array = np.argsort(ours, kind="stable")  # the suffix array
    sorted_ranks = ours[array]
    low, high = np.searchsorted(sorted_ranks, theirs, "left"), np.searchsorted(sorted_ranks, theirs, "right")
    found = np.flatnonzero(high > low)
    tests, low, count = tests[found], low[found], (high - low)[found]
    # each test suffix's hits in runs of `at_once`, then runs together while they are no more than that
    runs = -(-count // at_once)
    of = np.repeat(np.arange(len(count)), runs)
    skip = (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)) * at_once
    size = np.minimum(count[of] - skip, at_once)
    turn = np.cumsum(size) // at_once
    for one in np.split(np.arange(len(of)), np.flatnonzero(turn[1:] != turn[:-1]) + 1):
        n = size[one]
        at = np.repeat(low[of[one]] + skip[one], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield _extended(corpus, test, starts[array[at]], np.repeat(tests[of[one]], n), depth)


def _extended(corpus: np.ndarray, test: TestTexts, c: np.ndarray, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of ``depth`` words, at ``c`` in the corpus and ``q`` in the tests, as long as they go; those long enough."""
    # a hit that continues one before it is part of that longer match
    first = (c == 0) | (q == 0)
    first |= (corpus[np.maximum(c - 1, 0)] == 0) | (test.ids[np.maximum(q - 1, 0)] != corpus[np.maximum(c - 1, 0)])
    q, c = q[first], c[first]
    length = np.full(len(q), depth, np.int64)
    live = np.arange(len(q))
    while len(live):
        x, y = c[live] + length[live], q[live] + length[live]
        inside = (x < len(corpus)) & (y < len(test.ids))
        live, x, y = live[inside], x[inside], y[inside]
        live = live[(corpus[x] == test.ids[y]) & (corpus[x] > 0)]
        length[live] += 1
    ok = length >= test.least[q]
    return c[ok], q[ok], length[ok]


def _search(test: TestTexts, pairs_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flat, ends, size = [], [], [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            corpus, end, own, seen = np.concatenate(flat), np.array(ends), np.array(ids, np.int64), np.empty((0, 2), np.int64)
            for c, q, length in leaks(corpus, test):
                doc = np.searchsorted(end, c, "right")
                if pairs_only:  # of each document and item one row a shard
                    seen = np.unique(np.concatenate((seen, np.stack([own[doc], test.owner[q]], 1))), axis=0)
                else:
                    yield rows(own[doc], test.owner[q], c - np.concatenate(([0], end))[doc], length)
            if len(seen):
                yield rows(seen[:, 0], seen[:, 1], np.zeros(len(seen)), np.zeros(len(seen)))

        def rows(doc, item, first, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(item), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "item_id", "first_word", "n_words"])

        get = test.number.get
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                if len(ws) < MIN_WORDS:
                    continue
                flat.append(np.fromiter((get(w, 0) for w in [*ws, b""]), np.int64, len(ws) + 1))
                size += len(ws) + 1
                ids.append(doc)
                ends.append(size)
                if size >= SHARD_WORDS:
                    yield from shard()
                    ids, flat, ends, size = [], [], [], 0
        if flat:
            yield from shard()

    return run


def passages(items: DataFrame) -> DataFrame:
    """``(item_id, text)``: each item's question with its placeholders filled in, and its context."""
    numbers = F.split(F.trim(F.coalesce("numbers", F.lit(""))), r"\s+")
    # from the last placeholder to the first, so that number1 leaves number10 alone
    filled = F.when(F.col("numbers").isNull(), F.col("question")).otherwise(
        F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(numbers) - 1)), F.col("question"), lambda t, i: F.replace(t, F.concat(F.lit("number"), i.cast("string")), F.get(numbers, i)))
    )
    question = F.when(F.col("obj_label").isNull(), filled).otherwise(F.replace(filled, F.lit("[MASK]"), F.col("obj_label")))
    return items.select("item_id", F.explode(F.array(question, F.col("context"))).alias("text")).where("text is not null and item_id is not null")


def leaked(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_only: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest matches ``(doc_id, item_id, first_word, n_words)``: words of the document from ``first_word`` that are the
    item's too; with ``pairs_only`` no places, and a pair once a shard. Repeated documents give repeated rows. Null and empty texts and those under ``MIN_WORDS`` words match
    nothing, nor do test passages under the least match. Nothing is shuffled."""
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    rows = passages(items).distinct().orderBy("item_id", "text").toLocalIterator()
    found, block, size = None, [], 0
    schema = "doc_id bigint, item_id bigint, first_word int, n_words int"

    def search() -> DataFrame:
        one = docs.mapInArrow(_search(TestTexts(block), pairs_only), schema)
        return one if found is None else found.unionByName(one)

    for r in rows:
        n = len(r.text.encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            found, block, size = search(), [], 0
        block.append((r.item_id, r.text))
        size += n
    return search()


def leaking_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``, each pair once."""
    return leaked(documents, items, pairs_only=True).select("doc_id", "item_id").distinct()


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents`` without those that hold a test passage; rows with a null id are searched by their text."""
    bad = leaked(documents, items, pairs_only=True).select("doc_id").distinct()
    nameless = documents.where("doc_id is null")
    # written once, so that the numbers stay
    texts = checkpointed(nameless.where("text is not null").select("text").distinct().select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    held = texts.join(leaked(texts, items, pairs_only=True).select("doc_id").distinct(), "doc_id").select("text")
    kept = documents.where("doc_id is not null").join(bad, "doc_id", "left_anti")
    return kept.unionByName(nameless.join(held, "text", "left_anti"))
