"""Ordered folds over one text or token list that no expression can say: Arrow functions, a batch at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATIN = re.compile("[A-Za-z0-9]+")
STRINGS = T.ArrayType(T.StringType())


def per_row(f: Callable, kind: T.DataType):
    """A pandas UDF of a function of one row's values; a null argument gives null."""

    def run(*columns: pd.Series) -> pd.Series:
        out = [None if any(x is None for x in row) else f(*row) for row in zip(*columns, strict=True)]
        return pd.Series(out, dtype="object")

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(two if f.__code__.co_argcount == 2 else one, kind)


def longest_common_run(a: str, b: str) -> tuple[int, int]:
    """(end in ``a``, length) of the longest run both have, without case; the first of several."""
    a, b = a.lower(), b.lower()
    best, end, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                if new[j] > best:
                    best, end = new[j], i
        row = new
    return end, best


class Phrases:
    """A dictionary of phrases as a trie; ``find`` gives the longest match at each place that ends beyond the last one."""

    def __init__(self, phrases) -> None:
        self.root: dict = {}
        for p in phrases:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = True

    def find(self, text: str) -> list[tuple[int, int]]:
        out, last = [], -1
        for i in range(len(text)):
            node, end = self.root, None
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    end = j
            if end is not None and end > last:
                out.append((i, end))
                last = end
        return out


def found_spans(trie: Phrases):
    """A pandas UDF of a text: its spans as structs of ``first`` and ``last``."""
    kind = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))

    def find(t: str) -> list[dict]:
        return [{"first": a, "last": b} for a, b in trie.find(t)]

    return per_row(find, kind)


def overridden(length: Column, spans: Column, label: str) -> Column:
    """A tag a character: B-label and I-label within spans, of several that overlap the last one's, O elsewhere."""

    def tag(i: Column) -> Column:
        first = F.array_max(F.transform(F.filter(spans, lambda s: (s["first"] <= i) & (i <= s["last"])), lambda s: s["first"]))
        return F.when(first.isNull(), "O").when(first == i, f"B-{label}").otherwise(f"I-{label}")

    return F.transform(F.sequence(F.lit(0), length - 1), tag)


def tag_over(tags: list[str], spans: list[tuple[int, int]], label: str) -> list[str]:
    """Tags with the spans' characters set to B-label and I-label."""
    out = list(tags)
    for a, b in spans:
        out[a : b + 1] = [f"B-{label}"] + [f"I-{label}"] * (b - a)
    return out


def word_pieces(word: str, vocabulary: set[str], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """Greedy longest pieces, those after the first marked ##; one unknown mark where none fit."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def segmenter(words: set[str]) -> Callable[[str], list[str]]:
    """Runs of Latin letters and digits, and elsewhere the longest known word or one Han character; the rest is no word."""
    longest = max(map(len, words), default=1)

    def cut(text: str) -> list[str]:
        out, i = [], 0
        while i < len(text):
            run = _LATIN.match(text, i)
            n = run.end() - i if run else next((k for k in range(min(longest, len(text) - i), 1, -1) if text[i : i + k] in words), 1)
            if run or "一" <= text[i] <= "鿿":
                out.append(text[i : i + n])
            i += n
        return out

    return cut


def whole_word_marks(tokens: list[str], words: set[str], longest: int = 6) -> list[str]:
    """Han tokens that together form a known word: all but its first marked ##; the longest word wins."""
    out, i = [], 0
    while i < len(tokens):
        n = 1
        if "一" <= tokens[i] <= "鿿":
            for k in range(min(longest, len(tokens) - i), 1, -1):
                if "".join(tokens[i : i + k]) in words:
                    n = k
                    break
        out += [tokens[i], *("##" + t for t in tokens[i + 1 : i + n])]
        i += n
    return out


def restored_delimiters(text: Column) -> Column:
    """The words between single blanks; of two empty words in a row the second becomes a blank, a lone one goes. A word takes
    one blank with it, what is left of a run of blanks counts in pairs; a run at the end has an empty word more."""
    parts = F.regexp_extract_all(F.when(F.endswith(text, F.lit(" ")), F.concat(text, F.lit(" "))).otherwise(text), F.lit("[^ ]+ ?|  "), F.lit(0))
    return F.transform(parts, lambda x: F.when(x == "  ", F.lit(" ")).otherwise(F.rtrim(x)))


def whole_word_mask(pieces: list[str], order: list[int], share: float = 0.15) -> list[bool]:
    """Pieces to mask: words in the drawn order while they fit the budget, a word's pieces together."""
    words: list[list[int]] = []
    for i, p in enumerate(pieces):
        if p.startswith("##") and words:
            words[-1].append(i)
        else:
            words.append([i])
    budget, out, used = max(1, round(len(pieces) * share)), [False] * len(pieces), 0
    for w in order:
        if w < len(words) and used + len(words[w]) <= budget:
            used += len(words[w])
            for i in words[w]:
                out[i] = True
    return out
