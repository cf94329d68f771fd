"""Streams of events: windows with a watermark, sessions, and packing that keeps an open batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, every: str, late: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Counts and sums by window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str, key: str, time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))


def pack_open(key, frames: Iterator[pd.DataFrame], state: GroupState, most: int) -> Iterator[pd.DataFrame]:
    """Greedy packing by shard: the pack number and its fill stay between batches."""
    pack, fill = state.get if state.exists else (0, 0)
    for f in frames:
        f = f.sort_values("item")
        out = []
        for n in f["size"]:
            if fill and fill + n > most:
                pack, fill = pack + 1, 0
            fill += int(n)
            out.append(pack)
        yield pd.DataFrame({"shard": f["shard"], "item": f["item"], "pack": out})
    state.update((pack, fill))


def packed(items: DataFrame, most: int) -> DataFrame:
    """``shard, item, pack`` of a stream of ``shard, item, size``."""

    def run(key, frames, state):
        yield from pack_open(key, frames, state, most)

    return items.groupBy("shard").applyInPandasWithState(run, "shard bigint, item bigint, pack bigint", "pack bigint, fill bigint", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now run through the stream into a table in that folder, which is returned."""
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "complete":
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
