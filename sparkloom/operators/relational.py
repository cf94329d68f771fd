"""Ordered and grouped operators over rows that carry their order as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import checkpointed


def _cols(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key. Ranked by key and a hash of the row first, so that a hot key's rows are cut to
    ``k`` a part before they meet in one task."""
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(32))
    part = df.withColumn("_salt", salt)
    part = part.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*_cols(order)))).where(F.col("_rn") <= k)
    return part.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*_cols(order)))).where(F.col("_rn") <= k).drop("_rn", "_salt")


#: Bits of a row's number within its part, as ``monotonically_increasing_id`` gives them.
_WITHIN = 33


def _parts(df: DataFrame, order: list) -> tuple[DataFrame, Column, Column]:
    """The rows ranged and sorted by ``order`` and written once, so that a row's part and its place there are fixed
    whatever reads them later; with the columns of the part and the place. One shuffle."""
    ranged = df.repartitionByRange(*_cols(order)).sortWithinPartitions(*_cols(order))
    fixed = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    return fixed, F.shiftright("__id", _WITHIN), F.col("__id").bitwiseAND(F.lit((1 << _WITHIN) - 1))


def numbered(df: DataFrame, order: list, out: str = "idx", total: str | None = None) -> DataFrame:
    """Rows numbered from 0 over the whole table, in parallel: ranges of the order are counted, then each adds what lies
    before it; ``total`` names a column for the number of all rows. ``order`` must leave no ties, or rows that tie are
    numbered either way. Of a part only its count is shuffled, a row a part.
    """
    fixed, part, place = _parts(df, order)
    counts = fixed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("__total", F.sum("__n").over(W.partitionBy())).drop("__n")
    got = fixed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + place)  # a row a part
    return (got.withColumn(total, F.col("__total")) if total else got).drop("__id", "__part", "__before", "__total")


def running(df: DataFrame, order: list, value: str, out: str, total: str | None = None) -> DataFrame:
    """Sum of ``value`` over all rows before, in parallel: the parts of the order are summed first. ``total`` names a column
    for the sum of all rows."""
    fixed, part, _ = _parts(df, order)
    sums = fixed.groupBy(part.alias("__part")).agg(F.sum(value).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("__total", F.sum("__s").over(W.partitionBy())).drop("__s")
    own = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy("__id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = fixed.withColumn("__part", part).withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__own"))
    return (got.withColumn(total, F.col("__total")) if total else got).drop("__id", "__part", "__own", "__before", "__total")


def numbered_within(df: DataFrame, key: str, order: list, out: str) -> DataFrame:
    """Rows of each key numbered from 0, in parallel within a key too: the rows of all keys are numbered in a row. There are
    few keys; null is one."""
    n = numbered(df, [key, *order], "__i")
    first = n.groupBy(F.col(key).alias("__k")).agg(F.min("__i").alias("__first"))
    return n.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("__k"))).withColumn(out, F.col("__i") - F.col("__first")).drop("__i", "__k", "__first")


def ranked(df: DataFrame, key: str, value: str, out: str, down: bool = False) -> DataFrame:
    """The rank of each row's value within its key, from 1, equal values alike with the first of their places. Values are
    counted first, and the counts summed over ranges, so no key is one task's. There are few keys; null is one."""
    n = df.groupBy(key, value).agg(F.count("*").alias("__n"))
    run = running(n, [key, F.desc(value) if down else F.col(value)], "__n", "__b")
    first = run.groupBy(F.col(key).alias("__k")).agg(F.min("__b").alias("__first"))
    run = run.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("__k")))
    run = run.select(F.col(key).alias("__k"), F.col(value).alias("__v"), (F.col("__b") - F.col("__first") + 1).alias(out))
    return df.join(run, F.col(key).eqNullSafe(F.col("__k")) & (F.col(value) == F.col("__v"))).drop("__k", "__v")


def ordered_list(order: str, *cols: str) -> Column:
    """Structs of a group in the order of a column."""
    return F.array_sort(F.collect_list(F.struct(order, *cols)))


def weighted_loss(probabilities: Column, decay: float = 0.2, failed: float = 1000.0) -> Column:
    """Mean of -ln p over positions, weighted 1, 1 - decay, ... down to 0; ``failed`` where no position weighs."""
    reach = int(1 / decay)
    near = F.slice(probabilities, 1, reach)
    weight = F.transform(near, lambda p, i: F.greatest(F.lit(0.0), 1 - decay * i))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    loss = F.aggregate(F.zip_with(near, weight, lambda p, w: -w * F.ln(p)), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, loss / total).otherwise(F.lit(failed))


def sharded(df: DataFrame, order: list, modulo: int, contiguous: int) -> DataFrame:
    """``modulo_shard`` by row number, ``contiguous_shard`` in runs of which the first ones are a row longer."""
    n = numbered(df, order, total="_c")
    size, longer = F.floor(F.col("_c") / contiguous), F.col("_c") % contiguous
    edge = longer * (size + 1)
    run = F.when(F.col("idx") < edge, F.floor(F.col("idx") / (size + 1))).otherwise(longer + F.floor((F.col("idx") - edge) / F.greatest(size, F.lit(1))))
    return n.withColumn("modulo_shard", F.col("idx") % modulo).withColumn("contiguous_shard", run.cast("bigint")).drop("_c")


def with_inferred_labels(df: DataFrame, label: str, order: str, out: str) -> DataFrame:
    """Labels numbered in the order they are first seen."""
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    ids = first.withColumn(out, (F.row_number().over(W.orderBy("_first", label)) - 1).cast("bigint")).drop("_first")
    return df.join(ids, label)
