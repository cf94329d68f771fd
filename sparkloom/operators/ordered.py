"""Folds over rows in order, splits and blends by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import per_row
from .relational import numbered, numbered_within, running


def fixed_samples(df: DataFrame, order: list[str], tokens: str, length: int) -> DataFrame:
    """``(sample, tokens)``: the documents end to end, sample i the ``length`` + 1 tokens from i·length on. A token at a
    sample's border belongs to both. No fold: positions are prefix sums."""
    placed = running(df.select(*order, F.col(tokens).alias("_t"), F.size(tokens).alias("_n")).where("_n > 0"), order, "_n", "_at", total="_total")
    # a document is cut at the borders first, so that what is shuffled are arrays, a piece a sample it touches
    first, last = F.floor(F.greatest(F.col("_at") - 1, F.lit(0)) / length), F.floor((F.col("_at") + F.col("_n") - 1) / length)
    cut = placed.withColumn("sample", F.explode(F.sequence(first, last))).where(F.col("sample") < F.floor((F.col("_total") - 1) / length))
    start = F.greatest(F.col("sample") * length - F.col("_at"), F.lit(0))
    stop = F.least((F.col("sample") + 1) * length + 1 - F.col("_at"), F.col("_n"))
    piece = F.slice("_t", (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    cut = cut.select("sample", F.struct(F.col("_at").alias("at"), piece.alias("t")).alias("p")).where("size(p.t) > 0")
    return cut.groupBy("sample").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"])).alias("tokens"))


def split_by_position(df: DataFrame, order: list[str], weights: str) -> DataFrame:
    """Adds ``split``: train, valid or test by position; weights like '949,50,1', cut points rounded half to even and the
    rounding error taken from them all."""
    w = [float(x) for x in weights.replace("/", ",").split(",")][:3]
    w += [0.0] * (3 - len(w))
    cuts = [F.lit(0.0)]
    for x in w:
        cuts.append(cuts[-1] + F.rint(F.lit(x / sum(w)) * F.col("_total")))
    i, over = F.col("idx"), cuts[-1] - F.col("_total")
    n = numbered(df, order, total="_total")
    return n.withColumn("split", F.when(i < cuts[1] - over, "train").when(i < cuts[2] - over, "valid").otherwise("test")).drop("_total")


def validated(df: DataFrame, asked: str, weight: str) -> DataFrame:
    """``df`` unchanged; a row that is asked for without a positive weight is an error when it is read."""
    return df.where(F.assert_true(~F.coalesce(F.col(asked), F.lit(False)) | (F.coalesce(F.col(weight), F.lit(0.0)) > 0), F.lit("an asked split has no weight")).isNull())


def blend(df: DataFrame, source: str, order: list[str], weights: DataFrame) -> DataFrame:
    """Adds ``blend_order``: the k-th row of a source stands at (k + 0.5) / weight, so every prefix holds the sources by weight."""
    return numbered_within(df, source, order, "k").join(weights, source).withColumn("blend_order", (F.col("k") + 0.5) / F.col("weight"))


def blocks(df: DataFrame, keys: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """Numbers runs of rows within the keys; a row for which ``starts`` holds begins one."""
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def pointer_spans(df: DataFrame, keys: list[str], order: str, starts: Column, ends: Column) -> DataFrame:
    """``(keys, start, stop)``: each end with the latest start since the end before it. Rows hold a position each; a
    position that is both starts and ends its span."""
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    got = df.withColumn("start", F.max(F.when(starts, F.col(order))).over(upto)).withColumn("__last", F.max(F.when(ends, F.col(order))).over(before))
    return got.where(ends & (F.col("start") > F.coalesce("__last", F.lit(-1)))).select(*keys, "start", F.col(order).alias("stop"))


def pairs_by_end(starts: Column, ends: Column) -> Column:
    """Each end with the latest start that meets no earlier end first: of start s the end is the smallest at or over it,
    and of an end the largest such start stays."""
    pairs = per_row(_pairs_by_end, T.ArrayType(T.ArrayType(T.IntegerType())))(starts, ends)
    return F.transform(pairs, lambda p: F.struct(p[0].alias("s"), p[1].alias("e")))


def _pairs_by_end(starts, ends) -> list[list[int]]:
    last, after, i = {}, sorted(set(ends)), 0
    for s in sorted(set(starts)):
        while i < len(after) and after[i] < s:
            i += 1
        if i < len(after):
            last[after[i]] = s
    return [[s, e] for e, s in last.items()]


def pack_greedily(lengths: Column, most: int) -> Column:
    """Pack number of each length in order: a pack closes when the next one doesn't fit; one too long is a pack of its own."""
    zero = F.struct(F.lit(-1).alias("pack"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["sum"] + n <= most) & (acc["pack"] >= 0)
        pack = F.when(fits, acc["pack"]).otherwise(acc["pack"] + 1)
        return F.struct(pack.alias("pack"), F.when(fits, acc["sum"] + n).otherwise(n).alias("sum"), F.array_append(acc["out"], pack).alias("out"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])


def viterbi(scores: Column, penalty: float = 1000.0) -> Column:
    """Best tags 0/1/2 = O/I/B of rows of three scores; an I after an O costs ``penalty``."""

    def decode(rows) -> list[int]:
        best, back = [0.0, -1e9, -1e9], []
        for s in rows:
            come = [max((best[f] - (penalty if to == 1 and f == 0 else 0.0), -f) for f in range(3)) for to in range(3)]
            back.append([-f for _, f in come])
            best = [v + x for (v, _), x in zip(come, s, strict=True)]
        tag, out = best.index(max(best)), []
        for b in reversed(back):
            out.append(tag)
            tag = b[tag]
        return out[::-1]

    return per_row(decode, T.ArrayType(T.IntegerType()))(scores)
