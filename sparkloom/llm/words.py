"""Words of a text: runs of letters, marks and digits after the one form, without case; each Han character is one."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import regex
import xxhash

from .glyphs import _charclass, look_alikes, transducer

#: Documents of fewer words than this are cases of no query but the encoding.
MIN_WORDS = 12

_ASCII = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))
_HAN = regex.compile(r"\p{Han}")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_IN_WORDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd"}
_ANY_RUN = regex.compile(r"\p{Han}|[\p{L}\p{M}\p{Nd}--\p{Han}]+", regex.V1)
_OTHER_SCRIPTS = re.compile("[\u0370-\u058f\u13a0-\u13ff\uab70-\uabbf]")
#: A capital that looks Latin makes its small letter equal to the small Latin one, where case is set aside.
_SMALL = str.maketrans({a.lower(): b.lower() for a, b in look_alikes().items() if a.lower() != b.lower()})
_PATTERNS: list[re.Pattern] = []


def _patterns() -> list[re.Pattern]:
    """Beyond ASCII: what parts words, and the Han characters."""
    if not _PATTERNS:
        gap, han = [], []
        for c in map(chr, range(0x80, 0x10000)):
            k = unicodedata.category(c)
            if k[0] not in "LM" and k != "Nd":
                gap.append(c)
            elif _HAN.match(c):
                han.append(c)
        _PATTERNS.extend((re.compile(f"[{_charclass(gap)}]"), re.compile(f"[{_charclass(han)}]")))
    return _PATTERNS


def words(text: str | None) -> list[bytes]:
    """The words in order, as UTF-8; none for a null or blank text."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    low = transducer().apply(text).lower()
    if _OTHER_SCRIPTS.search(low):
        low = low.translate(_SMALL)
    if _BEYOND.search(low):
        if any(unicodedata.category(c) in _IN_WORDS for c in set(_BEYOND.findall(low))):
            return " ".join(_ANY_RUN.findall(low)).encode().split()
        low = _BEYOND.sub(" ", low)  # emoji and the like
    gap, han = _patterns()
    low = gap.sub(" ", low)
    if han.search(low):
        low = han.sub(r" \g<0> ", low)
    return low.encode().translate(_ASCII).split()


class _Hashes(dict):
    """Word to its 64-bit hash, remembered up to a bound."""

    LIMIT = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xFF51AFD7ED558CCD) ^ (x >> np.uint64(31))


def shingles(docs: list[list[bytes]], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of each document (fewer than 65,536) the sorted distinct 48-bit hashes of its runs of ``k`` words: (hashes, offsets)."""
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(docs)), np.uint64, int(n.sum()))
    total = np.zeros(max(0, len(flat) - k + 1), np.uint64)
    for i in range(k):
        total = mix(total + flat[i : i + len(total)] * _ODD[i % 5])
    runs = np.maximum(n - k + 1, 0)
    ends = np.cumsum(n)
    at = np.arange(int(runs.sum())) + np.repeat(ends - n - np.cumsum(runs) + runs, runs)
    doc = np.repeat(np.arange(len(docs), dtype=np.uint64), runs)
    packed = doc << np.uint64(48) | total[at] >> np.uint64(16)
    packed.sort()
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    offsets = np.searchsorted(packed, np.arange(len(docs) + 1, dtype=np.uint64) << np.uint64(48))
    return packed & np.uint64((1 << 48) - 1), offsets
