"""Augmentation of token lists; what is random is drawn from a hash, so that it repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(key: Column, i: Column, salt: str) -> Column:
    """A number from 0 to 65535."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), i.cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("int")


def count(n: Column, share: float, least: int, most: int) -> Column:
    """How many tokens change: a share, within bounds, at most three tenths of those that may."""
    return F.least(F.greatest(F.ceil(n * share), F.lit(least)), F.lit(most), F.floor(n * 0.3)).cast("int")


def eligible(tokens: Column, stop: list[str]) -> Column:
    """Places of tokens that may change: no stop word, no digit."""
    at = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return F.transform(F.filter(at, lambda x: ~F.lower(x["t"]).isin(stop) & ~x["t"].rlike("[0-9]")), lambda x: x["i"])


def chosen(tokens: Column, key: Column, salt: str, stop: list[str], share: float = 0.1, least: int = 1, most: int = 10) -> Column:
    """The places drawn among the eligible ones."""
    may = eligible(tokens, stop)
    drawn = F.array_sort(F.transform(may, lambda i: F.struct(draw(key, i, salt).alias("d"), i.alias("i"))))
    return F.transform(F.slice(drawn, F.lit(1), F.greatest(count(F.size(may), share, least, most), F.lit(0))), lambda x: x["i"])


def delete(tokens: Column, at: Column) -> Column:
    return F.filter(tokens, lambda t, i: ~F.array_contains(at, i))


def substitute(tokens: Column, at: Column, words: dict[str, str]) -> Column:
    """Words of the dictionary at the places replaced."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.transform(tokens, lambda t, i: F.when(F.array_contains(at, i), F.coalesce(F.try_element_at(table, F.lower(t)), t)).otherwise(t))


def insert(tokens: Column, at: Column, word: Column) -> Column:
    """The word before each place."""
    return F.flatten(F.transform(tokens, lambda t, i: F.when(F.array_contains(at, i), F.array(word, t)).otherwise(F.array(t))))


def swap(tokens: Column, at: Column) -> Column:
    """Each place changes with the next one; a place just after a chosen one stays with that swap."""
    first = F.filter(at, lambda i: ~F.array_contains(at, i - 1) & (i + 1 < F.size(tokens)))
    return F.transform(tokens, lambda t, i: F.when(F.array_contains(first, i), F.get(tokens, i + 1)).when(F.array_contains(first, i - 1), F.get(tokens, i - 1)).otherwise(t))
