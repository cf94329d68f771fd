"""Batches: padding, truncation, special tokens, masks, preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import pad

IGNORED = -100


def padded(df: DataFrame, batch: str, fields: dict[str, int], multiple: int = 1, left: bool = False) -> DataFrame:
    """The array columns of ``fields`` padded, each with its value, to its batch's longest, rounded up to a multiple."""
    for name, value in fields.items():
        widest = F.max(F.greatest(F.size(name), F.lit(0))).over(W.partitionBy(batch))
        to = (F.ceil(widest / multiple) * multiple).cast("int")
        df = df.withColumn(name, pad(F.coalesce(F.col(name), F.array().cast("array<int>")), to, F.lit(value), left))
    return df


def special_tokens(a: Column, b: Column | None, cls: int, sep: int) -> Column:
    """[CLS] a [SEP] (b [SEP]) with type ids."""
    first = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)))
    if b is None:
        return F.struct(first.alias("ids"), F.transform(first, lambda _: F.lit(0)).alias("types"))
    second = F.concat(b, F.array(F.lit(sep)))
    return F.struct(F.concat(first, second).alias("ids"), F.concat(F.transform(first, lambda _: F.lit(0)), F.transform(second, lambda _: F.lit(1))).alias("types"))


def longest_first(n_a: Column, n_b: Column, remove: Column) -> tuple[Column, Column]:
    """Lengths left of a pair after taking ``remove`` tokens one by one from the longer, in a tie from the second."""
    gap = n_a - n_b
    # the longer side shrinks alone until the two are even, then they take turns
    alone = F.least(F.abs(gap), remove)
    a = F.when(gap > 0, n_a - alone).otherwise(n_a)
    b = F.when(gap < 0, n_b - alone).otherwise(n_b)
    rest = remove - alone
    return F.greatest(a - F.floor(rest / 2), F.lit(0)).cast("int"), F.greatest(b - F.ceil(rest / 2), F.lit(0)).cast("int")


def stride_windows(ids: Column, width: int, stride: int) -> Column:
    """Windows of ``width`` that overlap by ``stride``, the last one where the end is reached."""
    step = width - stride
    n = F.greatest(F.ceil((F.size(ids) - width) / step).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(ids, i * step + 1, F.lit(width)))


def shifted(ids: Column) -> Column:
    """Inputs without the last token, labels without the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), n).alias("inputs"), F.slice(ids, F.lit(2), n).alias("labels"))


def masked(ids: Column, key: Column, mask: int, vocabulary: int, specials: tuple[int, ...] = ()) -> Column:
    """About 15 % of the tokens chosen by a hash of key and place; of those 80 % masked, 10 % another token, 10 % kept.
    Labels are the tokens where chosen, elsewhere ``IGNORED``."""

    def draw(i: Column, salt: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), i.cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("int")

    def chosen(x: Column, i: Column) -> Column:
        return (draw(i, "pick") < 9830) & ~x.isin(list(specials))

    def new(x: Column, i: Column) -> Column:
        how = draw(i, "how")
        return F.when(~chosen(x, i), x).when(how < 52428, F.lit(mask)).when(how < 58982, draw(i, "token") % vocabulary).otherwise(x)

    return F.struct(F.transform(ids, new).alias("ids"), F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(IGNORED))).alias("labels"))


def fair_shares(df: DataFrame, key: str, part: str, size: str, most: int) -> DataFrame:
    """Adds ``kept``: parts of a key share ``most`` by water-filling; short parts keep all, the others the average that is left."""
    by = W.partitionBy(key).orderBy(size, part)
    before = F.coalesce(F.sum(size).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n, rank = F.count("*").over(W.partitionBy(key)), F.row_number().over(by)
    level = F.floor((most - before) / (n - rank + 1))
    # the first part over its level fixes the level for all after it
    marked = df.withColumn("_level", level).withColumn("_over", F.col(size) > F.col("_level"))
    stop = F.min(F.when(F.col("_over"), F.struct(size, part, "_level"))).over(W.partitionBy(key))
    marked = marked.withColumn("_stop", stop)
    after = F.col("_stop").isNotNull() & (F.struct(F.col(size), F.col(part)) >= F.struct(F.col(f"_stop.{size}"), F.col(f"_stop.{part}")))
    return marked.withColumn("kept", F.when(after, F.greatest(F.col("_stop._level"), F.lit(0))).otherwise(F.col(size)).cast("bigint")).drop("_level", "_over", "_stop")


def preference_pack(prompt: Column, chosen: Column, rejected: Column, most: int) -> Column:
    """Prompt, chosen and rejected in one row of at most ``most``: the prompt loses its start first, then the answers their
    ends in proportion; rejected positions restart after the prompt; labels are 0 outside the answers."""
    room = F.greatest(F.lit(most) - F.size(chosen) - F.size(rejected), F.lit(1))
    n = F.least(F.size(prompt), room)
    p = F.slice(prompt, F.size(prompt) - n + 1, n)
    left = F.lit(most) - n
    over = F.size(chosen) + F.size(rejected) > left
    c_n = F.when(over, F.floor(left * F.size(chosen) / (F.size(chosen) + F.size(rejected)))).otherwise(F.size(chosen)).cast("int")
    r_n = F.when(over, left - c_n).otherwise(F.size(rejected)).cast("int")
    c, r = F.slice(chosen, F.lit(1), c_n), F.slice(rejected, F.lit(1), r_n)
    zeros = F.transform(p, lambda _: F.lit(0))
    def count(x: Column, start: Column) -> Column:
        return F.transform(x, lambda _, i: start + i)

    ids = F.concat(p, c, r)
    return F.struct(ids.alias("ids"), F.concat(count(p, F.lit(0)), count(c, n), count(r, n)).alias("positions"), F.concat(zeros, c, F.transform(r, lambda _: F.lit(0))).alias("chosen_labels"), F.concat(zeros, F.transform(c, lambda _: F.lit(0)), r).alias("rejected_labels"))


def chat(turns: Column, system: str) -> Column:
    """The system text and each turn as 'User: …' and 'Assistant: …', the last answer maybe open; ``turns`` in order, of structs user, bot."""
    lines = F.transform(turns, lambda t, i: F.concat(F.lit("User: "), t["user"], F.lit("\nAssistant:"), F.coalesce(F.concat(F.lit(" "), t["bot"], F.lit("\n")), F.lit(""))))
    return F.concat(F.lit(system + "\n"), F.array_join(lines, ""))
