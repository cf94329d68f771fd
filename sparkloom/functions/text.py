"""Text functions, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "‘’“”：，。、《》【】（）！？；…～·—『』「」〈〉"
FULL = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
CLEAN_UP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def half_width(t: Column) -> Column:
    return F.translate(t, FULL, HALF)


def collapse_runs(t: Column, over: int = 100) -> Column:
    """Runs of one character longer than ``over`` shrink to one; runs of line ends stay."""
    return F.regexp_replace(t, rf"(.)\1{{{over},}}", "$1")


def answer_form(t: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(t), ASCII_PUNCTUATION + CJK_PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"[ \t\n\r\f]+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def char_form(t: Column) -> Column:
    """No blanks; Chinese punctuation as ASCII."""
    return F.translate(F.regexp_replace(t, r"[ \t\n\r\f]+", ""), "，。！？：；（）", ",.!?:;()")


def model_output(t: Column) -> Column:
    """What follows <unk> is cut; line ends and closing marks become blanks."""
    return F.replace(F.replace(F.substring_index(t, "<unk>", 1), F.lit("\n"), F.lit(" ")), F.lit("</s>"), F.lit(" "))


def chinese_sentences(t: Column) -> Column:
    """Cut after sentence marks, closing quotes kept with their sentence."""
    cut = F.regexp_replace(t, "([。！？?])([^”’])", "$1\n$2")
    cut = F.regexp_replace(cut, "(\\.{6})([^”’])", "$1\n$2")
    cut = F.regexp_replace(cut, "(…{2})([^”’])", "$1\n$2")
    cut = F.regexp_replace(cut, "([。！？?][”’])([^，。！？?])", "$1\n$2")
    return F.split(F.rtrim(cut), "\n")


def chunks(t: Column, width: int) -> Column:
    """The text in slices of ``width`` characters; one empty slice for an empty text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(t, i * width + 1, F.lit(width)))


def unaccented() -> dict[str, str]:
    """Characters whose decomposition has marks that take no place, or that are such marks, and what stays of them."""
    out = {}
    for c in map(chr, chain(range(0x80, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20))):
        if not 0xAC00 <= ord(c) <= 0xD7A3 and (unicodedata.category(c) == "Mn" or unicodedata.decomposition(c)[:1] not in ("", "<")):
            out[c] = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    return out


def nfkc_forms() -> dict[str, str]:
    """Characters of the full-width, small, squared and enclosed blocks in their compatibility form, numbers in circles and
    Roman numerals as digits between blanks, and one Han character."""
    # fixed values: the blocks
    forms = chain(range(0xFF00, 0xFFF0), range(0xFE50, 0xFE6C), range(0x3358, 0x3400), range(0x249C, 0x24EA), range(0x3200, 0x3300))
    numbers = chain(range(0x2460, 0x249C), range(0x24EA, 0x2500), range(0x2776, 0x2794), range(0x2160, 0x2180))
    out = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in forms}
    out |= {chr(c): f" {int(unicodedata.numeric(chr(c)))} " for c in numbers}
    out[chr(0xF979)] = "凉"
    return {a: b for a, b in out.items() if a != b}


def _mapped(text: Column, table: dict[str, str], syllables: bool = False) -> Column:
    """Characters replaced by the table, with ``syllables`` Hangul taken apart too. No ASCII character is in a table, so ASCII
    texts stay inside the JVM."""
    codes, hangul = str.maketrans(table), re.compile("[가-힣]")

    def mapped(t: str) -> str:
        t = t.translate(codes)
        return hangul.sub(lambda m: unicodedata.normalize("NFD", m[0]), t) if syllables else t

    wide = F.pandas_udf(lambda s: s.map(mapped, na_action="ignore"), "string")
    return F.coalesce(wide(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip_accents(t: Column) -> Column:
    """Text taken apart into letters and marks, without the marks that take no place."""
    return _mapped(t, unaccented(), syllables=True)


def nfkc_selected(t: Column) -> Column:
    """The text with the characters of ``nfkc_forms`` in their plain form, all others as they are."""
    return _mapped(t, nfkc_forms())


def clean(t: Column) -> Column:
    """Control characters go, blanks of any kind become spaces."""
    gone = F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]", "")
    return F.regexp_replace(gone, "[\\t\\n\\r]", " ")


def split_punctuation(t: Column) -> Column:
    """Each ASCII punctuation mark on its own, runs of the rest between them."""
    return F.regexp_extract_all(t, F.lit("[!-/:-@\\[-`{-~]|[^!-/:-@\\[-`{-~]+"), F.lit(0))


def space_han(t: Column) -> Column:
    return F.regexp_replace(t, "([一-鿿])", " $1 ")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest prefix both have."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def decoded_clean_up(t: Column) -> Column:
    for a, b in CLEAN_UP:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def with_period(t: Column) -> Column:
    """A final ' .' unless the line is empty, a section mark, or ends already."""
    return F.when((t == "") | t.startswith("@highlight") | t.rlike("[.!?…'`\")’”]\\z"), t).otherwise(F.concat(t, F.lit(" .")))


def option_prompt(t: Column) -> Column:
    """The options in a trailing [a,b] sorted, each once."""
    inside = F.regexp_extract(t, r"\[([^\[\]]*)\]\z", 1)
    return F.when(inside == "", t).otherwise(F.concat(F.regexp_replace(t, r"\[[^\[\]]*\]\z", "["), F.array_join(F.array_sort(F.array_distinct(F.split(inside, ","))), ","), F.lit("]")))


def call_bracket(t: Column) -> Column:
    """A call as '[ ...]': cut after the first bracket that closes, or closed."""
    return F.concat(F.lit("[ "), F.substring_index(t, "]", 1), F.lit("]"))
