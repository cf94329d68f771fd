"""Vectors and sequences in array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it uses more than once, made once a row: an array of one binds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(x: Column) -> Column:
    return bound(F.array_max(x), lambda m: bound(F.transform(x, lambda v: F.exp(v - m)), lambda s: bound(total(s), lambda t: F.transform(s, lambda v: v / t))))


def indices_over(x: Column, limit: Column) -> Column:
    at = F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.transform(F.filter(at, lambda s: s["v"] > limit), lambda s: s["i"])


def penalised(x: Column, penalty: float, temperature: float) -> Column:
    return F.transform(x, lambda v: F.when(v < 0, v * penalty).otherwise(v / penalty) / temperature)


def span_tags(length: Column, start: Column, n: Column) -> Column:
    """B I E, or S for a single, from ``start``; O elsewhere."""

    def tag(i: Column) -> Column:
        last = start + n - 1
        return F.when(i == start, F.when(n == 1, "S").otherwise("B")).when((i > start) & (i < last), "I").when((i == last) & (n > 1), "E").otherwise("O")

    return F.transform(F.sequence(F.lit(0), length - 1), tag)


def ngrams(x: Column, n: int) -> Column:
    """All runs of ``n``, none for a shorter array."""
    return F.when(F.size(x) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.slice(x, i, n)))


def pad(x: Column, to: Column, value: Column, left: bool = False) -> Column:
    more = F.array_repeat(value, F.greatest(to - F.size(x), F.lit(0)))
    return F.concat(more, x) if left else F.concat(x, more)
