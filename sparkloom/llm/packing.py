"""Harmonic packing of items of uneven length into containers of fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity/(k+1) and up to capacity/k, and a
container of class k takes k items. Workers pack their share of the items on their own; a share is a hash range of the
ids small enough for one task, large enough that the few containers left open don't matter. Classes go from the longest
items to the shortest. As the containers of a class leave room, a second step fills it: before a class opens containers
of its own, its items go where larger classes left room for them, the tightest fit first. ``fill=False`` leaves it out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a worker packs, about.
SHARE = 40_000


class _Room:
    """What is left in containers: places left to the containers that have as many."""

    def __init__(self) -> None:
        self.boxes: dict[int, list[int]] = {}
        self.gaps: list[int] = []  # sorted

    def add(self, gap: int, boxes: list[int]) -> None:
        if gap and boxes:
            if gap not in self.boxes:
                insort(self.gaps, gap)
                self.boxes[gap] = []
            self.boxes[gap].extend(boxes)

    def take(self, n: int) -> tuple[int, int] | None:
        """A container with the least room that holds ``n``, and its room; it is taken out."""
        at = bisect_left(self.gaps, n)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        box = self.boxes[gap].pop()
        if not self.boxes[gap]:
            del self.boxes[gap], self.gaps[at]
        return box, gap


def harmonic(lengths: np.ndarray, capacity: int, fill: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Container and start of each item, and the number of containers. Lengths are 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")  # so classes come in a row, k = 1 first
    size = lengths[order]
    k = capacity // np.maximum(size, 1)
    box, start = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    room, used = _Room(), 0
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True]))) if len(k) else np.zeros(1, int)
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rest = list(range(first, end))
        if fill:
            rest = _filled(rest, size, room, capacity, box, start)
        own, c = np.array(rest, np.int64), int(k[first])
        if not len(own):
            continue
        # c items a container; the last one may have fewer
        i = np.arange(len(own))
        box[own] = used + i // c
        before = np.cumsum(size[own]) - size[own]
        start[own] = before - before[i // c * c]
        last = np.minimum(np.arange(c - 1, len(own) + c - 1, c), len(own) - 1)
        left = capacity - start[own[last]] - size[own[last]]
        for gap in np.unique(left).tolist():
            room.add(gap, (used + np.flatnonzero(left == gap)).tolist())
        used += len(last)
    out_box, out_start = np.empty_like(box), np.empty_like(start)
    out_box[order], out_start[order] = box, start
    return out_box, out_start, used


def _filled(items: list[int], size: np.ndarray, room: _Room, capacity: int, box: np.ndarray, start: np.ndarray) -> list[int]:
    """Puts a class's items, the longest first, where they fit most tightly; returns those that fit nowhere."""
    at = 0
    out = []
    while at < len(items):
        n = int(size[items[at]])
        found = room.take(n)
        if found is None:  # a shorter item may still fit
            stop = at
            while stop < len(items) and size[items[stop]] == n:
                stop += 1
            out += items[at:stop]
            at = stop
            continue
        b, gap = found
        box[items[at]], start[items[at]] = b, capacity - gap
        room.add(gap - n, [b])
        at += 1
    return out


def _packer(fill: bool):
    def run(table: pa.Table) -> pa.Table:
        record, length, capacity = (table.column(c).to_numpy() for c in ("record_id", "n_tokens", "capacity"))
        order = np.argsort(record, kind="stable")  # whatever order the rows came in
        record, length, cap = record[order], length[order].astype(np.int64), int(capacity[0])
        pieces = -(-length // cap)
        of = np.repeat(np.arange(len(record)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(length[of] - piece * cap, cap)
        box, start, _ = harmonic(size, cap, fill)
        name = f"{table.column('tool')[0].as_py()}/{table.column('share')[0].as_py()}/"
        k = len(of)
        return pa.table({"record_id": pa.array(record[of]), "tool": pa.array([table.column("tool")[0].as_py()] * k, pa.string()), "piece": pa.array(piece.astype(np.int32)), "pieces": pa.array(pieces[of].astype(np.int32)), "container_id": pa.array([name + str(b) for b in box.tolist()], pa.string()), "start": pa.array(start.astype(np.int32)), "n_tokens": pa.array(size.astype(np.int32)), "capacity": pa.array(np.full(k, cap, np.int32))})

    return run


PACKED = "record_id bigint, tool string, piece int, pieces int, container_id string, start int, n_tokens int, capacity int"


def pack(records: DataFrame, limits: DataFrame, fill: bool = True, share: int = SHARE) -> DataFrame:
    """One row a piece of a record: ``record_id, tool, piece, pieces, container_id, start, n_tokens, capacity``.

    A record that comes twice counts once (of unlike rows with one id the first by tool and length). Only records longer
    than their tool's ``max_length`` are cut, into pieces of the capacity and a rest. Records with nothing to place (null
    or empty ids), and those whose tool is null or has no positive limit, come out once with a null container. Rows with a
    null id are left out; of several limits of a tool the smallest holds; other columns are ignored.
    """
    one = records.where("record_id is not null").groupBy("record_id").agg(F.min(F.struct("tool", F.coalesce(F.size("input_ids"), F.lit(0)).alias("n"))).alias("r"))
    one = one.select("record_id", F.col("r.tool").alias("tool"), F.greatest(F.col("r.n"), F.lit(0)).cast("int").alias("n_tokens"))
    capacity = limits.groupBy("tool").agg(F.min("max_length").alias("capacity")).where("tool is not null and capacity > 0")
    shares = one.groupBy("tool").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    facts = capacity.join(shares, "tool")
    placed = one.where("n_tokens > 0").join(facts, "tool").withColumn("share", F.pmod(F.xxhash64("record_id"), F.col("shares")).cast("int"))
    placed = placed.select("record_id", "tool", "n_tokens", "capacity", "share").groupBy("tool", "share").applyInArrow(_packer(fill), PACKED)
    aside = one.join(capacity, "tool", "left").where("n_tokens = 0 or capacity is null")
    aside = aside.select("record_id", "tool", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("int").alias("start"), "n_tokens", "capacity")
    return placed.unionByName(aside)


def packing_report(packed: DataFrame) -> DataFrame:
    """A row a tool: containers, places used, and the share of places left unused."""
    by = packed.where("container_id is not null").groupBy("tool", "container_id").agg(F.sum("n_tokens").alias("used"), F.first("capacity").alias("capacity"))
    by = by.groupBy("tool").agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("capacity").alias("places"))
    return by.select("tool", "containers", "used", (1 - F.col("used") / F.col("places")).alias("unused_share"))
