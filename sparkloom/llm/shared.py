"""How many parts data has that is packed by hand, and pairs of the members of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import checkpointed

__all__ = ["across", "checkpointed", "partitions", "within"]

#: Members of a group in one block, about; larger groups meet block by block, so that no task has a whole hot group.
BLOCK = 4096


def partitions(spark: SparkSession, least: int = 12) -> int:
    """Parts for data packed by hand, as many as the session's shuffles have."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _blocks(members: DataFrame, key: str, block: int) -> DataFrame:
    """The groups of more than one block: ``key, blocks``."""
    return members.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")


def _owned(members: DataFrame, key: str, member: str, many: DataFrame) -> DataFrame:
    got = members.join(many, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return got.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))


def across(links: DataFrame, members: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """``(left, right)``: each member of group ``a`` with each of group ``b``, for the links ``(a, b)``."""
    many = _blocks(members, key, block)
    owned = _owned(members, key, member, many)
    for side in "ab":
        links = links.join(many.select(F.col(key).alias(side), F.col("blocks").alias(f"n{side}")), side, "left")
        links = links.withColumn(f"o{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"n{side}", F.lit(1)) - 1)))
    left, right = (owned.select(F.col(key).alias(k), F.col("own").alias(f"o{k}"), F.col(member).alias(out)) for k, out in (("a", "left"), ("b", "right")))
    return links.select("a", "b", "oa", "ob").join(left, ["a", "oa"]).join(right, ["b", "ob"]).select("left", "right")


def within(members: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """``(left, right)``: every two members of a group, the smaller first; groups of one have none."""
    several = members.join(members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), key)
    owned = _owned(several, key, member, _blocks(members, key, block))
    left = owned.select(key, F.col(member).alias("left"), F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"))
    right = owned.select(key, F.col(member).alias("right"), F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"))
    both = left.join(right, [key, "lo", "hi"]).where("lo < hi or left < right")
    return both.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
