"""A language model of word pairs, trained and run as joins: scores of texts, greedy, sampled and beam continuations.

It stands in for models that need weights: what decodes takes any table of ``prev, next, logp``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relational import top_k
from ..scratch import checkpointed

#: Stands before the first word and after the last.
EDGE = ""


def pairs(df: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """``(keys, prev, next)`` for each two neighbours, the edges among them."""
    edge = F.array(F.lit(EDGE))
    both = F.arrays_zip(F.concat(edge, words).alias("prev"), F.concat(words, edge).alias("next"))
    return df.select(*keys, F.explode(both).alias("p")).select(*keys, "p.prev", "p.next")


def trained(df: DataFrame, words: Column) -> DataFrame:
    """``prev, next, n, total, logp``: how often a pair and its first word stand in the texts, and the pair's log share."""
    n = pairs(df, [], words).groupBy("prev", "next").agg(F.count("*").alias("n"))
    total = n.groupBy("prev").agg(F.sum("n").alias("total"))
    return n.join(total, "prev").withColumn("logp", F.ln(F.col("n") / F.col("total")))


def scores(df: DataFrame, key: str, words: Column, model: DataFrame) -> DataFrame:
    """``key, score``: the mean log probability of a text's pairs, every count one higher so that none is impossible."""
    size = model.select("next").distinct().agg(F.count("*").alias("v"))  # one row
    p = pairs(df, [key], words).join(model.select("prev", "next", "n"), ["prev", "next"], "left").join(model.groupBy("prev").agg(F.first("total").alias("total")), "prev", "left")
    p = p.join(F.broadcast(size), F.lit(True)).withColumn("logp", F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("v"))))
    return p.groupBy(key).agg(F.avg("logp").alias("score"))


def _uniform(*parts: Column) -> Column:
    """A repeatable number over 0 and under 1."""
    return (F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)


def _started(df: DataFrame, key: str, last: str) -> DataFrame:
    return df.select(key, F.col(last).alias("prev"), F.array().cast("array<string>").alias("words"), F.lit(0.0).alias("score"), F.lit(False).alias("done"))


def _continued(live: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What is not done, by each word that may follow; one that none follows is done."""
    more = live.where("not done").join(after, "prev", "left")
    end = F.coalesce("next", F.lit(EDGE)) == EDGE
    return more.select(key, F.coalesce("next", F.lit(EDGE)).alias("prev"), F.when(end, F.col("words")).otherwise(F.array_append("words", F.col("next"))).alias("words"), (F.col("score") + F.coalesce("logp", F.lit(0.0))).alias("score"), end.alias("done"), "logp")


def _best(df: DataFrame, key: str, beams: int, out: str = "_r") -> DataFrame:
    by = W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "words")
    return df.withColumn(out, F.row_number().over(by)).where(F.col(out) <= beams)


def decoded(df: DataFrame, key: str, last: str, model: DataFrame, steps: int, beams: int = 1, temperature: float | None = None, seed: int = 0) -> DataFrame:
    """``key, beam, words, score``: the ``beams`` best continuations of each row's word, at most ``steps`` words, up to the
    edge; a row whose word the model lacks has an empty one. One beam is greedy; with a temperature words are drawn by their
    probability instead, repeatably. Of equal ones the first by words is kept."""
    after = model.select("prev", "next", "logp")
    if temperature is None:
        after = top_k(after, ["prev"], [F.desc("logp"), "next"], beams)  # no others can be among the best
    after = checkpointed(after)  # read once a step
    live = _started(df, key, last)
    for step in range(steps):
        more = _continued(live, after, key)
        if temperature is None:
            live = _best(more.drop("logp").unionByName(live.where("done")), key, beams).drop("_r")
        else:
            noise = -F.ln(-F.ln(_uniform(F.lit(seed), F.col(key), F.lit(step), F.col("prev"))))
            drawn = more.groupBy(key).agg(F.max_by(F.struct("prev", "words", "score", "done"), F.struct(F.coalesce("logp", F.lit(0.0)) / temperature + noise, "prev")).alias("b"))
            live = drawn.select(key, "b.*").unionByName(live.where("done"))
    return _best(live, key, beams, "beam").select(key, "beam", "words", "score")


def decoded_in_groups(df: DataFrame, key: str, last: str, model: DataFrame, steps: int, beams: int, groups: int, diversity: float) -> DataFrame:
    """``key, group, beam, words, score``: as many groups of beams, a word losing ``diversity`` for each time an earlier group
    has chosen it at the same step."""
    # a word may lose its place to others, as many as earlier groups can choose
    after = checkpointed(top_k(model.select("prev", "next", "logp"), ["prev"], [F.desc("logp"), "next"], beams * groups))
    lives = [_started(df, key, last) for _ in range(groups)]
    for _ in range(steps):
        taken = None
        for g, live in enumerate(lives):
            more = _continued(live, after, key)
            if taken is not None:
                often = taken.groupBy(key, "prev").agg(F.count("*").alias("n"))
                more = more.join(often, [key, "prev"], "left").withColumn("score", F.col("score") - diversity * F.coalesce("n", F.lit(0))).drop("n")
            lives[g] = _best(more.drop("logp").withColumn("new", F.lit(True)).unionByName(live.where("done").withColumn("new", F.lit(False))), key, beams).drop("_r")
            chosen = lives[g].where("new").select(key, "prev")
            taken = chosen if taken is None else taken.unionByName(chosen)
            lives[g] = lives[g].drop("new")
    named = [_best(live, key, beams, "beam").select(key, F.lit(g).alias("group"), "beam", "words", "score") for g, live in enumerate(lives)]
    return reduce(DataFrame.unionByName, named)
