"""Tool calls in text: the calculator, the calendar, and the holidays they know."""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import bound

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}


def calculate(expression: str) -> float | int | None:
    """The value of an expression of numbers, + - * / and brackets; None for anything else."""

    def value(node):
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError(ast.dump(node))

    try:
        return value(ast.parse(expression.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


#: What a call holds, up to the last bracket that closes, and the lone number that is no sum.
_INSIDE, _LONE = re.compile(r"Calculator\((.*)\)"), re.compile(r"\s*-?\s*\d+(\.\d+)?\s*%?\s*")


def _called(text: str | None) -> str | None:
    call = _INSIDE.search(text or "")
    found = None if call is None or _LONE.fullmatch(call[1]) else calculate(call[1])
    if found is None:
        return text
    head, _, tail = text.partition("]")
    return f"{head} -> {found} ]{tail}"


def calculator(text: Column) -> Column:
    """The text with its call answered before the first bracket that closes, or unchanged: no call, a lone number, or an
    expression of anything but numbers, + - * / // % and brackets. Evaluated without eval; only texts with a call leave the JVM."""
    answer = F.pandas_udf(lambda s: s.map(_called, na_action="ignore"), T.StringType())
    return F.coalesce(answer(F.when(F.contains(text, F.lit("Calculator(")), text)), text)


#: Name, month, and the day: a date, or (weekday 0=Monday, which one; -1 the last).
HOLIDAYS = (
    ("New Year's Day", 1, 1), ("Martin Luther King Jr. Day", 1, (0, 3)), ("Washington's Birthday", 2, (0, 3)), ("Memorial Day", 5, (0, -1)),
    ("Juneteenth National Independence Day", 6, 19), ("Independence Day", 7, 4), ("Labor Day", 9, (0, 1)), ("Columbus Day", 10, (0, 2)),
    ("Veterans Day", 11, 11), ("Thanksgiving", 11, (3, 4)), ("Christmas Day", 12, 25),
)


def _holiday(rule: tuple, year: Column) -> Column:
    """The day of a rule in a year; weekday() is 0 for Monday."""
    _, month, day = rule
    start = F.make_date(year, F.lit(month), F.lit(1))
    if isinstance(day, int):
        return F.date_add(start, day - 1)
    weekday, which = day
    if which < 0:
        end = F.last_day(start)
        return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)))
    return F.date_add(start, F.pmod(F.lit(weekday) - F.weekday(start), F.lit(7)) + 7 * (which - 1))


def _is_holiday(rule: tuple, day: Column) -> Column:
    """Whether a day is the rule's, by its month, weekday and place in the month."""
    _, month, on = rule
    if isinstance(on, int):
        return (F.month(day) == month) & (F.day(day) == on)
    weekday, which = on
    place = F.day(day) + 7 > F.day(F.last_day(day)) if which < 0 else F.ceil(F.day(day) / 7) == which
    return (F.month(day) == month) & (F.weekday(day) == weekday) & place


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """``(name, day)`` of the years, by rule."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    days = F.array(*[F.struct(F.lit(r[0]).alias("name"), _holiday(r, F.col("year")).alias("day")) for r in HOLIDAYS])
    return years.select(F.explode(days).alias("h")).select("h.name", "h.day")


def calendar(call: Column, as_of: Column) -> Column:
    """'[ Calendar(d) ]' and '[ Calendar(d1,d2) ]' answered before the bracket: the weekday of each date and the holiday it is,
    and the days between. A date is 'today' (also 'current', 'now': ``as_of``), year-month-day, or part of a holiday's name, of
    the first date's year or that of ``as_of``. A call without a date stays as it is."""
    args = F.transform(F.split(F.regexp_extract(call, r"Calendar\((.*)\)", 1), ","), lambda a: F.trim(a))
    nothing = F.struct(F.lit(None).cast("date").alias("day"), F.lit("").alias("text"))

    def named(day: Column) -> Column:
        name = F.coalesce(*[F.when(_is_holiday(r, day), F.lit(r[0])) for r in HOLIDAYS])
        return F.coalesce(F.concat(F.lit(", "), name, F.lit(" of "), F.year(day).cast("string")), F.lit(""))

    def dated(a: Column, year: Column) -> Column:
        given, weekday = F.try_to_date(a, "yyyy-M-d"), lambda d: F.date_format(d, "EEEE")
        found = F.coalesce(*[F.when(F.contains(F.lit(r[0].lower()), F.lower(a)), _holiday(r, year)) for r in HOLIDAYS])
        full = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(", "), weekday(d))
        result = F.when(F.lower(a).isin("today", "current", "now"), F.struct(as_of.alias("day"), F.concat(full(as_of), named(as_of)).alias("text")))
        result = result.when(a.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), F.struct(given.alias("day"), F.concat(weekday(given), named(given)).alias("text")))
        return F.coalesce(result.otherwise(F.struct(found.alias("day"), full(found).alias("text"))), nothing)

    def one(a: Column) -> Column:
        return bound(dated(a, F.year(as_of)), lambda x: F.when(x["day"].isNotNull(), F.concat(a, F.lit(" is "), x["text"], F.lit(" ]"))))

    def two(a: Column, b: Column) -> Column:
        def both(x: Column) -> Column:
            return bound(dated(b, F.coalesce(F.year(x["day"]), F.year(as_of))), lambda y: text(x, y))

        def text(x: Column, y: Column) -> Column:
            said = [F.when(z["day"].isNotNull(), F.concat(w, F.lit(" is "), z["text"], F.lit(". "))).otherwise("") for w, z in ((a, x), (b, y))]
            n = F.datediff(y["day"], x["day"])
            span = lambda p, q: F.concat(F.lit("The days from "), p, F.lit(" until "), q, F.lit(" is "), F.abs(n).cast("string"), F.lit(" days. "))
            apart = F.when(n > 0, span(a, b)).when(n < 0, span(b, a)).when(n == 0, F.concat(a, F.lit(" is "), b, F.lit(". "))).otherwise("")
            return F.when(x["day"].isNotNull() | y["day"].isNotNull(), F.concat(*said, apart, F.lit(" ]")))

        return bound(dated(a, F.year(as_of)), both)

    def answer(x: Column) -> Column:
        return F.when(F.size(x) == 1, one(x[0])).when(F.size(x) == 2, two(F.get(x, F.lit(0)), F.get(x, F.lit(1))))

    said = F.when(call.rlike(r"Calendar\(.*\)"), bound(args, answer))
    return F.coalesce(F.concat(F.substring_index(call, "]", 1), F.lit("-> "), said), call)
