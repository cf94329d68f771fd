"""Predicates that pick text for a tool, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a date, a relative day, another script. Blanks, digits and word characters are
# those of any script; the classes are spelled out so that they mean the same to every engine.
BLANKS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
_D, _S, _W = r"\p{Nd}", BLANKS, r"[\p{L}\p{N}_]"
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
NUMBER = rf"^[-+]?{_D}+(\.{_D}+)?%?\z"
#: The digits of other scripts, and what they count.
_DIGITS = tuple(map("".join, zip(*((chr(c), str(unicodedata.digit(chr(c)))) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"), strict=True)))
#: Dates as whole words.
DATES = (
    rf"{_D}{{4}}[-/]{_D}{{1,2}}[-/]{_D}{{1,2}}",
    rf"{_D}{{1,2}}[-/]{_D}{{1,2}}[-/]{_D}{{2,4}}",
    rf"{_D}{{1,2}} ?{_MONTH}{_W}* ?{_D}{{2,4}}",
    rf"{_MONTH}{_W}* {_D}{{1,2}},? {_D}{{4}}",
)
#: Distances in days, anywhere.
DISTANCES = (rf"{_D}+{_S}+days{_S}+ago", rf"in{_S}+{_D}+{_S}+days")
RELATIVE_DAYS = ("tomorrow", "today", "yesterday", "the day after tomorrow", "the day before yesterday")
ARABIC, GERMAN, SPANISH, HINDI, CHINESE = "\u0600-\u06ff", "äöüßÄÖÜ", "ñáéíóúüÁÉÍÓÚÜ", "\u0900-\u097f", "\u4e00-\u9fff"
VIETNAMESE = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠàáâãèéêìíòóôõùúăđĩũơƯư"
OTHER_SCRIPTS = f"[{ARABIC}{GERMAN}{SPANISH}{VIETNAMESE}{HINDI}{CHINESE}]"
HOLIDAYS = (
    "New Year's Day", "Martin Luther King Jr. Day", "Washington's Birthday", "Memorial Day", "Juneteenth National Independence Day",
    "Independence Day", "Labor Day", "Columbus Day", "Veterans Day", "Thanksgiving", "Christmas Day",
)


def tokens(text: Column) -> Column:
    """Tokens between blanks of any kind, none empty; null for null text."""
    return F.filter(F.split(text, BLANKS + "+"), lambda t: t != "")


def other_script(text: Column) -> Column:
    """A letter of Arabic, German, Spanish, Vietnamese, Hindi or Chinese that English lacks."""
    return text.rlike(OTHER_SCRIPTS)


def date_text(text: Column) -> Column:
    """A date, a distance in days, a relative day or a holiday's name."""
    words = (*RELATIVE_DAYS, *(h.lower() for h in HOLIDAYS))
    whole = rf"(?<!{_W})(?:{'|'.join(DATES)})(?!{_W})"
    # an array of one binds the lower-case text, so that it is made once a row
    return text.rlike(f"{whole}|{'|'.join(DISTANCES)}") | F.exists(F.array(F.lower(text)), lambda low: reduce(or_, (low.contains(w) for w in words)))


def arithmetic_text(text: Column, span: int = 100) -> Column:
    """Three successive numbers, less than ``span`` tokens apart and not all under 100, of which two give the third by one
    of the four operations; a percent sign divides by 100."""
    at = F.transform(tokens(text), lambda t, i: F.struct(i.alias("at"), t.alias("t")))
    numbers = F.transform(
        F.transform(F.filter(at, lambda x: x["t"].rlike(NUMBER)), lambda x: F.struct(x["at"].alias("at"), F.translate(x["t"], *_DIGITS).alias("t"))),
        lambda x: F.struct(x["at"].alias("at"), F.when(x["t"].endswith("%"), F.rtrim(x["t"], F.lit("%")).try_cast("double") / 100).otherwise(x["t"].try_cast("double")).alias("v")),
    )

    def fits(n: Column, i: Column) -> Column:
        x = [F.get(n, i + k) for k in range(3)]
        small = reduce(lambda p, q: p & q, (v["v"] < 100 for v in x))
        hits = []
        for a, b, c in permutations([v["v"] for v in x]):
            hits += [a + b == c, a - b == c, a * b == c, F.coalesce(F.try_divide(a, b) == c, F.lit(False))]
        return (x[2]["at"] - x[0]["at"] < span) & ~small & reduce(or_, hits)

    def any_three(n: Column) -> Column:
        return (F.size(n) >= 3) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(n) - 3, F.lit(0))), lambda i: F.coalesce(fits(n, i), F.lit(False)))

    # an array of one binds the numbers, so that they are found once a row
    return F.coalesce(F.exists(F.array(numbers), any_three), F.lit(False))


def hash_keep(key: Column, share: float) -> Column:
    """A repeatable sample: the key's md5, as a number in 0 to 65535, under the share."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int") < int(share * 65536)
