"""One stored form for text that looks the same.

A rule table (widths, blanks, invisible characters, accents, look-alike letters, of all planes) is compiled once a
process into a longest-match transducer: a pattern that finds the grapheme clusters the rules touch and
a table from cluster to output, checked for conflicts as it is built. The table holds every character a rule touches and
every sequence that composes to one character; longer clusters (stacked accents, jamo) get the same rules and are
remembered. Text is rewritten in one left-to-right pass; what no rule touches is copied.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn alike, source letters over the Latin letters they look like.
_CYRILLIC = ("АВЕКМНОРСТУХЅІЈԚԜҺаеорсухѕіјһԛԝԁӏ", "ABEKMHOPCTYXSIJQWhaeopcyxsijhqwdl")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲρ", "ABEZHIKMNOPTYXCjovcp")
_ARMENIAN = ("ՕօՍհոց", "OoUhng")
_CHEROKEE = ("ᎪᎠᎬᎫᎻᏀᎢᏆᏒᏔᎥ", "ADEJHGTIRWi")
_MORE_CHEROKEE = ("ᏴᏟᎾᏞᎷᏢᏚᏙᏃᏦᏩ", "BCOLMPSVZKG")
# Latin ligatures that print as their letters.
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Letters and signs by their kind that are printed as a blank.
_BLANK = "\u3164\uffa0\u2800"
# Characters without any ink or advance; of the bidirectional controls the two overrides stay, as they turn what is shown.
_INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202D), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, 0xE0001)))
# Variation selectors, and the tags that spell a flag; without what they belong to they show nothing.
_SELECTORS = "".join(map(chr, (*range(0x180B, 0x180E), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))
_TAGS = "".join(map(chr, range(0xE0020, 0xE0080)))
_ZWJ, _KEYCAP, _FLAG = chr(0x200D), chr(0x20E3), chr(0x1F3F4)
_HAN = ((0x2E80, 0x2FDF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_PICT = ((0x2190, 0x2BFF), (0x1F000, 0x1FAFF))


def _width(c: str) -> str:
    """Full-width and half-width forms, the ligatures, letters that stand for numbers, unbreakable forms and one-character blanks."""
    if unicodedata.category(c) == "Zs" or c in _BLANK:
        return " "
    if c in _LIGATURES:
        return _LIGATURES[c]
    parts = unicodedata.decomposition(c)
    if parts.startswith(("<wide>", "<narrow>", "<noBreak>")) or "Ⅰ" <= c <= "ⅿ" and parts.startswith("<compat>"):
        return "".join(chr(int(x, 16)) for x in parts.split()[1:])  # one step, so that jamo don't join
    return c


def look_alikes() -> dict[str, str]:
    """Letter to the Latin letter it is drawn as."""
    return {a: b for src, dst in (_CYRILLIC, _GREEK, _ARMENIAN, _CHEROKEE, _MORE_CHEROKEE) for a, b in zip(src, dst, strict=True)}


class Transducer:
    """Compiled rules: ``apply`` maps a text to its one form; None stays None.

    Idempotent: every output is built of fixed points; a table with an output that isn't one is refused as it is compiled.
    Joiners and selectors inside an emoji sequence are kept, as they change what is drawn, so are selectors of Han
    characters and the tags of a flag; elsewhere they are dropped. Letter case, accents that show, digits, punctuation,
    tabs and line ends are never touched.
    """

    MEMO = 1 << 16

    def __init__(self) -> None:
        alike = look_alikes()
        self._alike = str.maketrans(alike)
        self._gone = str.maketrans(dict.fromkeys(_INVISIBLE))
        self._loose = str.maketrans(dict.fromkeys(_SELECTORS + _TAGS))
        self.table: dict[str, str] = dict.fromkeys(_INVISIBLE + _SELECTORS + _TAGS, "")
        marks, composed = set(), []
        for cp in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
            c = chr(cp)
            if unicodedata.combining(c):
                marks.add(c)
            parts = unicodedata.decomposition(c)
            if c in self.table or not (parts or c in alike or c in _BLANK or c.isspace() or c in marks):
                continue
            out = self._cluster(c)
            if out != c:
                self.table[c] = out
            if parts and parts[0] != "<":
                composed.append(c)
        drawn: dict[str, list[str]] = {}
        for a, b in alike.items():
            drawn.setdefault(b, []).append(a)
        for c in composed:  # what composes to one character, also from a letter that looks like its first
            whole = unicodedata.normalize("NFD", c)
            for seq in (whole, *(a + whole[1:] for a in drawn.get(whole[0], ()))):
                if len(seq) > 1 and (out := self._cluster(seq)) != seq:
                    self.table[seq] = out
        for c in list(map(chr, range(0x3046, 0x30FF))):  # voiced half-width kana are two characters
            half = unicodedata.normalize("NFD", c)
            if len(half) == 2:
                for h in map(chr, range(0xFF66, 0xFF9E)):
                    if unicodedata.normalize("NFKC", h) == half[0]:
                        self.table[h + ("ﾞ" if half[1] == "゙" else "ﾟ")] = c
        single = {c for c in self.table if len(c) == 1}
        joins = {*marks, *_INVISIBLE, *_SELECTORS, *_TAGS, _KEYCAP, "ﾞ", "ﾟ", *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}
        pict = _charclass(chr(c) for x, y in _PICT for c in range(x, y + 1))
        part = f"[{pict}]{chr(0xFE0F)}?[{chr(0x1F3FB)}-{chr(0x1F3FF)}]?"

        def patterns(single: str, joins: str) -> tuple[re.Pattern, re.Pattern]:
            return re.compile(f"[{joins}{single}]"), re.compile(f"{part}(?:{_ZWJ}{part})+|[^{joins}][{joins}]+|[{single}]|[{joins}]+", re.DOTALL)

        # classes within the basic plane are looked up at once, others range by range; few texts need those
        self._basic = patterns(*(_charclass(c for c in x if c <= "\uffff") for x in (single, joins)))
        self._full = patterns(_charclass(single), _charclass(joins))
        self._far = frozenset(c for c in single | joins if c > "\uffff")
        self._beyond = re.compile("[\U00010000-\U0010ffff]")
        self._pict = re.compile(f"[{pict}]")
        self._memo: dict[str, str] = dict(self.table)
        self._fixed = len(self._memo)
        if bad := self.conflicts():
            raise ValueError(f"rules whose output other rules would rewrite: {bad[:5]}")
        self._memo = dict(self.table)

    def _cluster(self, s: str) -> str:
        """The rules for one cluster: width, invisible, look-alike on the bare letters, accents put back."""
        first = ord(s[0]) if s else 0
        shown = any(x <= first <= y for x, y in (*_PICT, *_HAN)) or _KEYCAP in s
        kept = s if shown else s.translate(self._loose)
        if shown and s[0] != _FLAG:
            kept = "".join(c for c in kept if c not in _TAGS)
        wide = "".join(map(_width, kept)).translate(self._gone)
        bare = unicodedata.normalize("NFD", wide).translate(self._alike)
        return unicodedata.normalize("NFC", bare)

    def _replace(self, m: re.Match) -> str:
        s = m[0]
        try:
            return self._memo[s]
        except KeyError:
            pass
        out = s if _ZWJ in s[1:-1] and self._pict.match(s) and self._pict.match(s[-1]) else self._cluster(s)
        if s.startswith("\n") or s.startswith("\r"):
            out = s[0] + self._cluster(s[1:])
        if len(s) <= 8:
            if len(self._memo) - self._fixed >= self.MEMO:
                self._memo = dict(self.table)
            self._memo[s] = out
        return out

    def apply(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        far = self._beyond.search(text) and not self._far.isdisjoint(self._beyond.findall(text))
        touched, find = self._full if far else self._basic
        return find.sub(self._replace, text) if touched.search(text) else text

    def conflicts(self) -> list[str]:
        """Rules whose output would be rewritten again; empty for a sound table."""
        find = self._full[1]
        return [k for k, v in self.table.items() if v and find.sub(self._replace, v) != v]


def _charclass(chars) -> str:
    """The inside of a character class, ranges merged."""
    out, run = [], []
    for cp in sorted(map(ord, chars)):
        if run and cp == run[1] + 1:
            run[1] = cp
        else:
            if run:
                out.append(run)
            run = [cp, cp]
    out.append(run)
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_COMPILED: list[Transducer] = []


def transducer() -> Transducer:
    """The process's compiled table."""
    if not _COMPILED:
        _COMPILED.append(Transducer())
    return _COMPILED[0]


def _folded(text: pa.Array) -> pa.Array:
    one = transducer().apply
    return pa.array([one(x) for x in text.to_pylist()], pa.string())


#: Called nondeterministic so that a plan that uses its result twice, as a filter and a column, never runs it twice.
_fold = F.arrow_udf(_folded, T.StringType()).asNondeterministic()


def one_form(text: Column) -> Column:
    """``text`` in its one form; null stays null, empty stays empty. Pure ASCII never leaves the JVM."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_fold(F.when(foreign, text)), text)
