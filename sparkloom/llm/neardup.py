"""Near-duplicate documents: count-vector R-trees over cells of documents that share a token of their prefixes.

Tokens are the runs of three successive words. They are hashed into groups; the group counts of a document are
its point, and the overlap of two documents is at most the sum of the coordinate minima of their points. R-trees
hold the points, a node by its largest count in each coordinate, so that the same bound rules out whole nodes.
One R-tree over everything can't prune: points of unrelated long texts lie as close as those of related ones in
nearly all coordinates (README has the figures). So the forest has one tree a cell, and a cell holds the documents with
the same token in their prefixes: the tokens of a document in one order for all documents, as many as two sets at the
threshold can't both lack. So every pair shares a cell. The order has rare tokens first, as counted over all documents,
which keeps cells small. Cells of up to ``CELL`` documents are one leaf. Pairs that survive the bound are verified on their token sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import across, checkpointed, partitions, within
from .words import MIN_WORDS, mix, shingles, words

#: Points in a leaf of a tree, documents of a cell that is a single leaf, and of a block of a cell that is larger.
LEAF, CELL, BLOCK = 64, 256, 2048
#: Coordinates of a point, each a count of up to ``FULL``, two a byte.
DIMS, FULL = 128, 15
#: Bytes of text whose postings make a bucket, about, so that a task's memory doesn't grow with the input.
BUCKET_BYTES = 24 << 20
#: Members from which a cell, as the counts tell, is split into blocks before any task gathers it.
HOT = 1 << 20
#: Counters of tokens, as a power of two: one for so many bytes of text, within bounds, and those of a slice. A counter that
#: several tokens share counts them all; that changes the cells' sizes, never the result.
BYTES_A_COUNTER, FEWEST_BITS, MOST_BITS, COUNTERS_A_SLICE = 6, 16, 26, 1 << 16
#: What ``_heat`` makes of a count of one: the token is in one document, as counters never count too little.
ONCE = 8
_U = np.uint64


def _sliced_hits(slot: np.ndarray, slots: int) -> pa.RecordBatch:
    """Slot numbers packed by slice, two bytes each."""
    slot = np.sort(slot)
    cuts = np.searchsorted(slot, np.arange(0, slots + 1, COUNTERS_A_SLICE))
    used = np.flatnonzero(np.diff(cuts)).tolist()
    hits = [(slot[cuts[i] : cuts[i + 1]] % COUNTERS_A_SLICE).astype(np.uint16).tobytes() for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(hits, pa.binary())], names=["part", "hits"])


def _slots(bits: int):
    """Documents to the counters their tokens hit, packed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                ws = [w if len(w) >= MIN_WORDS else [] for w in map(words, batch.column("text").slice(at, 8192).to_pylist())]
                yield _sliced_hits((mix(shingles(ws)[0]) >> _U(64 - bits)).astype(np.uint32), 1 << bits)

    return run


def _heat(table: pa.Table) -> pa.Table:
    """A slice's counts, an eighth of a power of two a step."""
    hits = np.frombuffer(b"".join(table.column("hits").to_pylist()), np.uint16)
    count = np.bincount(hits, minlength=COUNTERS_A_SLICE)
    heat = np.minimum(8 * np.log2(1 + count), 255).astype(np.uint8)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "heat": pa.array([heat.tobytes()], pa.binary())})


def _sliced(rows: DataFrame, to_slices, combine, kind: str) -> list[tuple[int, bytes]]:
    """Parts of a table of fixed size, each packed by slice, combined a slice a task; what comes to the driver has its size."""
    got = rows.mapInArrow(to_slices, "part int, hits binary").groupBy("part").applyInArrow(combine, f"part int, {kind} binary").collect()
    return [(r[0], r[1]) for r in got]


def token_heat(docs: DataFrame, text_bytes: int) -> np.ndarray:
    """How many of all documents have a token, a byte for each of the counters its hash may hit."""
    bits = min(max((text_bytes // BYTES_A_COUNTER).bit_length(), FEWEST_BITS), MOST_BITS)
    heat = np.zeros(1 << bits, np.uint8)
    for part, counts in _sliced(docs.select("text"), _slots(bits), _heat, "heat"):
        heat[part * COUNTERS_A_SLICE : (part + 1) * COUNTERS_A_SLICE] = np.frombuffer(counts, np.uint8)
    return heat


#: Slots of the mark table of documents to verify; it is as large whatever the input, and only spares work.
MARKS = 1 << 23


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot numbers to slices."""
    for batch in batches:
        yield _sliced_hits(batch.column(0).to_numpy(), MARKS)


def _marked(table: pa.Table) -> pa.Table:
    bits = np.zeros(COUNTERS_A_SLICE, bool)
    bits[np.frombuffer(b"".join(table.column("hits").to_pylist()), np.uint16)] = True
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _where_marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most of those whose id is not in ``ids``, before anything is shuffled; an exact join follows."""
    bits = np.zeros(MARKS // 8, np.uint8)
    a_slice = COUNTERS_A_SLICE // 8
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("int")
    for part, some in _sliced(ids.select(slot.alias("slot")), _marks, _marked, "bits"):
        bits[part * a_slice : (part + 1) * a_slice] = np.frombuffer(some, np.uint8)
    held = bits.tobytes()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(held, np.uint8)
        for b in batches:
            at = b.column("slot").to_numpy()
            yield b.select(["doc_id", "text"]).filter(pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    return docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(keep, "doc_id bigint, text string")


def prefix_keys(tokens: np.ndarray, offsets: np.ndarray, heat: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the documents' prefixes: (64-bit key, document, rank in the order, heat), of at most 8,192 documents. Sets of sizes m and n at the
    threshold have threshold * max(m, n) tokens in common or more. The first of these in the order stands in both
    prefixes, as in each set at least that many tokens follow or are it. Tokens that one document has are in no pair and left out."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    h = mix(tokens) >> _U(21)
    packed = doc.astype(np.uint64) << _U(51) | heat[h >> _U(44 - len(heat).bit_length())].astype(np.uint64) << _U(43) | h
    packed.sort()
    rank = np.arange(len(doc)) - np.repeat(offsets[:-1], n)
    on = (rank < (n - np.ceil(threshold * n - 1e-9) + 1)[doc]) & ((packed >> _U(43)).astype(np.uint8) != ONCE)
    return mix(packed[on] & _U((1 << 43) - 1)), doc[on], rank[on], (packed[on] >> _U(43)).astype(np.uint8)


def points(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Group counts of each document, two a byte; counts over ``FULL`` stay there."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    at = doc * DIMS + (mix(tokens) >> _U(57)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=n * DIMS), FULL).astype(np.uint8).reshape(n, DIMS)
    return counts[:, : DIMS // 2] | counts[:, DIMS // 2 :] << 4


def unpacked(vectors: list[bytes]) -> np.ndarray:
    """Points as a byte a coordinate."""
    two = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, DIMS // 2)
    return np.concatenate((two & FULL, two >> 4), axis=1)


def overlap_bound(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """At most so many tokens are in both: the minima's sum, and what lies over ``FULL`` in either."""
    over = np.minimum(na - a.sum(-1, dtype=np.int64), nb - b.sum(-1, dtype=np.int64))
    return np.minimum(a, b).sum(-1, dtype=np.int64) + np.maximum(over, 0)


def needed(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Common tokens at which two sets of these sizes reach the similarity."""
    return np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)


class RTree:
    """Bulk-loaded R-tree of points: leaves of ``LEAF`` points near in size and in their largest coordinates;
    a node keeps each coordinate's maximum, its smallest size and what its points have over ``FULL``. ``tests`` counts
    the nodes and points a search has looked at."""

    def __init__(self, pts: np.ndarray, n: np.ndarray) -> None:
        self.tests = 0
        top = np.argmax(pts.reshape(len(pts), 8, DIMS // 8).sum(2, dtype=np.int64), axis=1)
        self.order = np.lexsort((n, top, np.floor(4 * np.log2(np.maximum(n, 1)))))
        self.pts, self.n = pts[self.order], n[self.order]
        self.over = self.n - self.pts.sum(1, dtype=np.int64)
        self.levels = []
        box, least, over = self.pts, self.n, self.over
        while len(box) > 1:
            cut = np.arange(0, len(box), LEAF if not self.levels else 8)
            box, least, over = np.maximum.reduceat(box, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(over, cut)
            self.levels.append((box, least, over))
            if len(box) == 1:
                break

    def search(self, p: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Points, by their number before loading, that may be as similar."""
        over = n - int(p.sum(dtype=np.int64))
        live = np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            box, least, most = self.levels[depth]
            self.tests += len(live)
            ok = np.minimum(box[live], p).sum(1, dtype=np.int64) + np.minimum(over, most[live]) >= needed(n, np.maximum(least[live], n * threshold), threshold)
            width = LEAF if depth == 0 else 8
            live = (live[ok][:, None] * width + np.arange(width)).ravel()
            live = live[live < (len(self.pts) if depth == 0 else len(self.levels[depth - 1][0]))]
        self.tests += len(live)
        ok = overlap_bound(self.pts[live], p, self.n[live], np.int64(n)) >= needed(self.n[live], n, threshold)
        return self.order[live[ok]]


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each document's token set; of an empty one 0."""
    n = np.diff(offsets)
    own = np.flatnonzero(n > 0)
    sets = np.zeros(len(n), np.uint64)
    if len(own):
        sets[own] = mix(np.add.reduceat(mix(tokens), offsets[own]) ^ n[own].astype(np.uint64))
    return sets


def _scan(buckets: int, heat: np.ndarray, threshold: float, hot: int):
    """Documents to packed postings a bucket, and to their points. Postings of tokens of at least the heat ``hot`` aren't
    gathered by cell but spread over the buckets, with the whole key."""

    packed_heat = zlib.compress(heat, 1)  # every executor gets a copy, on its disk too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heat, turn = np.frombuffer(zlib.decompress(packed_heat), np.uint8), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                ids, text = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
                ws = [w if len(w) >= MIN_WORDS else [] for w in map(words, text)]
                tokens, offsets = shingles(ws)
                n = np.diff(offsets)
                own = np.flatnonzero(n > 0)
                if not len(own):
                    continue
                sets = set_ids(tokens, offsets)
                pts = points(tokens, offsets)
                rows = {"bucket": [turn % buckets], "sets": [sets[own].tobytes()], "cells": [None], "at": [None], "ranks": [None], "docs": [ids[own].astype(np.int64).tobytes()], "sizes": [n[own].astype(np.uint32).tobytes()], "points": [pts[own].tobytes()]}
                turn += 1
                key, doc, rank, warm = prefix_keys(tokens, offsets, heat, threshold)
                if (warm >= hot).any():
                    h = warm >= hot
                    for name, value in (("bucket", (turn * 7) % buckets), ("sets", sets[doc[h]].tobytes()), ("cells", key[h].tobytes()), ("at", None), ("ranks", None), ("docs", None), ("sizes", None), ("points", None)):
                        rows[name].append(value)
                    key, doc, rank = key[~h], doc[~h], rank[~h]
                where = (key % _U(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                key, doc, rank = (key[order] >> _U(32)).astype(np.uint32), doc[order], np.minimum(rank[order], 65_535).astype(np.uint16)
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                for b in range(buckets):
                    x, y = cuts[b], cuts[b + 1]
                    if x < y:
                        used, local = np.unique(doc[x:y], return_inverse=True)
                        for name, value in (("bucket", b), ("sets", sets[used].tobytes()), ("cells", key[x:y].tobytes()), ("at", local.astype(np.uint16).tobytes()), ("ranks", rank[x:y].tobytes()), ("docs", None), ("sizes", n[used].astype(np.uint32).tobytes()), ("points", None)):
                            rows[name].append(value)
                kinds = [pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return run


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs


def _leaf_pairs(cell: np.ndarray, sets: np.ndarray, n: np.ndarray | None = None, rank: np.ndarray | None = None, threshold: float = 0.0, largest: int = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells sorted: the distinct pairs of small cells (a, b); cells and members of the large ones. With sizes and ranks,
    pairs are left out that miss the threshold even if all tokens after the cell's are common; a pair may share one
    before it, but then the cell of their first common token has the pair."""
    order = np.lexsort((sets, cell))
    cell, sets = cell[order], sets[order]
    keep = np.concatenate(([True], (cell[1:] != cell[:-1]) | (sets[1:] != sets[:-1])))
    cell, sets = cell[keep], sets[keep]
    if rank is not None:
        n, rank = n[order][keep], rank[order][keep].astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    count = np.diff(np.append(start, len(cell)))
    found = [np.empty((0, 2), np.uint64)]
    for k in np.unique(count[(count > 1) & (count <= largest)]).tolist():
        first, x, y = start[count == k], *np.triu_indices(k, 1)
        few = max(1, (1 << 20) // len(x))  # cells at a time
        for at in range(0, len(first), few):
            member = first[at : at + few, None] + np.arange(k)
            i, j = member[:, x].ravel(), member[:, y].ravel()
            if rank is not None:
                most = np.minimum(n[i] - rank[i], n[j] - rank[j])
                ok = (most >= needed(n[i], n[j], threshold)) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[ok], j[ok]
            found.append(_distinct(np.stack([sets[i], sets[j]], 1)))
    pairs = _distinct(np.concatenate(found))
    big = np.repeat(count > largest, count)
    return pairs[:, 0], pairs[:, 1], cell[big], sets[big]


def _cells(threshold: float, largest: int):
    """A bucket's postings to pairs (kind p) and members of large cells (c); the documents' points go through (m). Many to
    a row, as a row each takes several times the disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sets, sizes, ranks = [], [], [], []

        def row(kind: str, a: bytes, b: bytes, n: bytes | None = None, vec: bytes | None = None) -> pa.RecordBatch:
            cols = [pa.array([kind], pa.string()), *(pa.array([x], pa.binary()) for x in (a, b, n, vec))]
            return pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "n", "vec"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["docs"] is not None:
                    yield row("m", r["docs"], r["sets"], r["sizes"], r["points"])
                elif r["ranks"] is None:
                    yield row("c", r["cells"], r["sets"])
                else:
                    cells.append(np.frombuffer(r["cells"], np.uint32))
                    at = np.frombuffer(r["at"], np.uint16)
                    sets.append(np.frombuffer(r["sets"], np.uint64)[at])
                    sizes.append(np.frombuffer(r["sizes"], np.uint32)[at].astype(np.int64))
                    ranks.append(np.frombuffer(r["ranks"], np.uint16))
        if cells:
            # a bucket's rows may be of several buckets; the keys differ in their low bits, which only adds chance pairs
            a, b, c, m = _leaf_pairs(*map(np.concatenate, (cells, sets, sizes, ranks)), threshold, largest)
            for at in range(0, len(a), 8192):
                yield row("p", a[at : at + 8192].tobytes(), b[at : at + 8192].tobytes())
            for at in range(0, len(c), 8192):
                yield row("c", c[at : at + 8192].astype(np.uint64).tobytes(), m[at : at + 8192].tobytes())

    return run


def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many pairs, or of many members of large cells, to a row each."""
    for batch in batches:
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (a, b)], names=["a", "b"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many documents to a row each."""
    for batch in batches:
        for r in batch.to_pylist():
            p = r["vec"]
            cols = [pa.array(np.frombuffer(r["a"], np.int64)), pa.array(np.frombuffer(r["b"], np.int64)), pa.array(np.frombuffer(r["n"], np.uint32).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([p[i : i + DIMS // 2] for i in range(0, len(p), DIMS // 2)], pa.binary())], names=["doc_id", "set_id", "n", "vec"])


def _bounded(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pa_, pb = (unpacked(b.column(k).to_pylist()) for k in ("va", "vb"))
                na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
                ok = overlap_bound(pa_, pb, na, nb) >= needed(na, nb, threshold)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _joined(threshold: float):
    """Pairs within one block, or between two blocks, of a large cell, by R-tree."""

    def run(table: pa.Table) -> pa.Table:
        s, n, side = (table.column(k).to_numpy() for k in ("a", "n", "side"))
        pts = unpacked(table.column("vec").to_pylist())
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        tree, out = RTree(pts[right], n[right]), []
        for q in left.tolist() if len(right) else ():
            hit = s[right[tree.search(pts[q], int(n[q]), threshold)]]
            hit = hit[hit > s[q]] if side[q] == 0 else hit[hit != s[q]]
            out.append(np.stack([np.minimum(hit, s[q]), np.maximum(hit, s[q])], 1))
        both = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return run


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their token sets, six bytes a token (they have 48 bits)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            tokens, offsets = shingles([words(t) for t in batch.column("text").slice(at, 8192).to_pylist()])
            six = tokens.view(np.uint8).reshape(-1, 8)[:, :6]
            sets = [six[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(tokens, offsets).view(np.int64)), pa.array(sets, pa.binary())], names=["set_id", "tokens"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                both = np.zeros((len(x) + len(y)) // 6, np.uint64)
                both.view(np.uint8).reshape(-1, 8)[:, :6] = np.frombuffer(x + y, np.uint8).reshape(-1, 6)
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                sims.append(common / (len(both) - common))
            sim = pa.array(sims, pa.float64())
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), sim], names=["a", "b", "similarity"])
            yield out.filter(pa.array([s >= threshold for s in sims], pa.bool_()))

    return run


def near_duplicates(documents: DataFrame, threshold: float = 0.55, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, block: int = BLOCK, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links): each document of at least ``MIN_WORDS`` words with the id of its token set, ``(doc_id, set_id)``;
    and the pairs of different token sets whose Jaccard similarity reaches the threshold, ``(a, b, similarity)``, a < b.

    Documents with equal sets are one node, however many there are, so copies never make pairs here. Null, empty and
    short texts have no tokens and appear in neither table; rows that repeat an id stay repeated; other columns are ignored.
    No pair is missed, whatever the sizes: two sets at the threshold share a token of their prefixes, so a cell. ``cell``,
    ``block`` and ``hot`` say which cells are a leaf, blocks and split early; they change the cost only.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes")).collect()[0]
    buckets = max(partitions(documents.sparkSession), -(-(size.bytes or 0) // BUCKET_BYTES))
    heat = token_heat(docs, size.bytes or 0)
    warmest = int(8 * np.log2(1 + hot))
    packed = docs.mapInArrow(_scan(buckets, heat, threshold, warmest), "bucket int, sets binary, cells binary, at binary, ranks binary, docs binary, sizes binary, points binary")
    found = checkpointed(packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_cells(threshold, cell), "kind string, a binary, b binary, n binary, vec binary"))

    points_of = found.where("kind = 'm'").mapInArrow(_members, "doc_id bigint, set_id bigint, n bigint, vec binary")
    members = points_of.select("doc_id", "set_id")
    nodes = points_of.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    pairs = found.where("kind = 'p'").mapInArrow(_one_each, "a bigint, b bigint").distinct()
    va, vb = (nodes.select(F.col("set_id").alias(k), F.col("n").alias(f"n{k}"), F.col("vec").alias(f"v{k}")) for k in "ab")
    close = pairs.join(va, "a").join(vb, "b").where(F.col("na") >= threshold * F.col("nb")).where(F.col("nb") >= threshold * F.col("na")).mapInArrow(_bounded(threshold), "a bigint, b bigint")

    # a large cell's blocks hold sizes within a factor of the threshold, so that only a block's own and the next sizes meet it
    large = found.where("kind = 'c'").mapInArrow(_one_each, "a bigint, b bigint").select(F.col("a").alias("cell"), F.col("b").alias("a")).distinct().join(nodes.select(F.col("set_id").alias("a"), "n", "vec"), "a")
    large = large.withColumn("step", F.floor(F.ln("n") / F.lit(float(-np.log(threshold)))).cast("int"))
    blocks = large.groupBy("cell", "step").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    near = blocks.select("cell", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above")).join(blocks, ["cell", "step"], "right").withColumn("above", F.coalesce("above", F.lit(0)))
    below = blocks.select("cell", (F.col("step") + 1).alias("step"), F.col("blocks").alias("below"))
    near = near.join(below, ["cell", "step"], "left").withColumn("below", F.coalesce("below", F.lit(0)))
    spread = large.join(near, ["cell", "step"]).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    # a pair of blocks is (step, lower block, step, upper block); side -1 is the lower, 1 the upper, 0 a block with itself
    place = F.struct(F.col("step").alias("s"), F.col("own").alias("b"))

    def others(count: str, shift: int):
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1), lambda i: i < F.col(count)), lambda i: F.struct((F.col("step") + shift).alias("s"), i.alias("b")))

    spread = spread.withColumn("me", place).withColumn("other", F.explode(F.concat(others("blocks", 0), others("above", 1), others("below", -1))))
    spread = spread.select("cell", "a", "n", "vec", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"), F.when(F.col("me") == F.col("other"), 0).when(F.col("me") < F.col("other"), -1).otherwise(1).alias("side"))
    in_trees = spread.groupBy("cell", "lo", "hi").applyInArrow(_joined(threshold), "a bigint, b bigint")

    # signed order decides which is a: the stages before compare unsigned numbers
    both = close.unionByName(in_trees).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    both = checkpointed(both)
    wanted = checkpointed(both.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(nodes.select("set_id", "doc_id"), "set_id"))
    # token sets are shuffled, not texts; those of other texts that come with an id wanted for one are left out
    some = _where_marked(docs, wanted).select("text").mapInArrow(_token_sets, "set_id bigint, tokens binary")
    sets = checkpointed(some.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))
    ta, tb = (sets.select(F.col("set_id").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    links = both.join(ta, "a").join(tb, "b").mapInArrow(_verified(threshold), "a bigint, b bigint, similarity double")
    return members, links.dropDuplicates(["a", "b"])


def duplicate_pairs(documents: DataFrame, threshold: float = 0.55, **limits: int) -> DataFrame:
    """Every two documents at the threshold or over, equal token sets too: ``(doc_id_a, doc_id_b)``, the smaller id first, each once."""
    members, links = near_duplicates(documents, threshold, **limits)
    members, links = checkpointed(members.distinct()), checkpointed(links.select("a", "b"))
    several = checkpointed(members.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id"))

    def met(nodes: DataFrame, member: str) -> DataFrame:
        return across(links, nodes, "set_id", member).unionByName(within(nodes, "set_id", member))

    # an id with one text meets another such id once, and many copies make many pairs, so these aren't shuffled again
    if several.isEmpty():
        return met(members, "doc_id").select(F.least("left", "right").alias("doc_id_a"), F.greatest("left", "right").alias("doc_id_b"))
    # an id that comes with several texts may meet another, or itself, more than once
    nodes = members.join(several.withColumn("texts", F.lit(True)), "doc_id", "left").select("set_id", F.struct("doc_id", F.coalesce("texts", F.lit(False)).alias("texts")).alias("member"))
    found = met(checkpointed(nodes), "member").select(F.least("left.doc_id", "right.doc_id").alias("doc_id_a"), F.greatest("left.doc_id", "right.doc_id").alias("doc_id_b"), (F.col("left.texts") | F.col("right.texts")).alias("texts"))
    return found.where("not texts").drop("texts").unionByName(found.where("texts and doc_id_a <> doc_id_b").drop("texts").distinct())


def duplicate_groups(documents: DataFrame, threshold: float = 0.55) -> DataFrame:
    """One row a document that has a duplicate: ``(doc_id, group_id, links)``; the group is the smallest id reached
    by links, ``links`` the number of different texts its text is linked to. Labels spread by minimum over the links
    and jump over what is already joined, so the rounds grow with the logarithm of a chain's length."""
    members, links = near_duplicates(documents, threshold)
    members, links = checkpointed(members.distinct()), checkpointed(links)
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = checkpointed(members.groupBy("set_id").agg(F.min("doc_id").alias("label"), F.count("*").alias("copies")))
    label = checkpointed(label.join(edges.select(F.col("a").alias("set_id")).distinct(), "set_id", "left_semi").unionByName(label.where("copies > 1")).distinct())
    home = label.select(F.col("label").alias("home"), "set_id")
    while True:
        near = edges.join(label.select(F.col("set_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("set_id")).agg(F.min("label").alias("near"))
        step = label.join(near, "set_id", "left").withColumn("next", F.least("label", F.coalesce("near", "label")))
        hop = home.join(step.select("set_id", F.col("next").alias("hop")), "set_id").select(F.col("home").alias("next"), "hop")
        step = checkpointed(step.join(hop, "next", "left").select("set_id", F.least("next", F.coalesce("hop", "next")).alias("label"), "copies", (F.least("next", F.coalesce("hop", "next")) < F.col("label")).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    degree = edges.groupBy(F.col("a").alias("set_id")).agg(F.count("*").alias("links"))
    return members.join(label, "set_id").join(degree, "set_id", "left").select("doc_id", F.col("label").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
