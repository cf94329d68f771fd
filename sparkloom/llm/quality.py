"""Text statistics, and natural prose told from lists, tables and junk by robust Mahalanobis distance.

Statistics are taken of every line and of every document. A line's distance is that from the mean and covariance of
prose in the line's language, over all statistics; each statistic's contribution is its part of the squared distance.
A document's distance is the median of its lines', weighed by visible characters, and its contributions are those of the
line at the median: so it is over the threshold just if more than half of the visible characters lie in lines over it,
and then the document is no prose. Means, covariances and the threshold are fitted on a bounded sample of rated
documents (``SAMPLE``, ``SAMPLE_BYTES``); everything else runs over all documents.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .glyphs import transducer
from .shared import checkpointed
from .words import MIN_WORDS, words

STATS = ("line_words", "word_length", "symbol_share", "digit_share", "upper_share", "common_share", "ends_in_punctuation")
#: Rated documents used for the fit at most, and the share of prose lines that its trimmed estimates keep.
SAMPLE, KEEP = 20_000, 0.93
#: Bytes of their texts at most; whole texts are left out beyond it, those last in the order of the sample.
SAMPLE_BYTES = 64 << 20
#: Lines of a language it takes for estimates of its own, and the weight of a line's neighbours in its distance.
LEAST_LINES, NEIGHBOURS = 60, 0.5
#: Lines from which a language has a mean of its own.
FEW_LINES = 6
#: Common words of a second language from which a line is taken to speak it too; one alone is often chance.
SECOND_LANGUAGE = 2
#: Words from which a line counts as a full one in the first statistic, as sentences stay sentences however they are
#: wrapped and a line of a whole paragraph tells no more than one of two sentences. All words count everywhere else.
FULL_LINE = 30

_SPACE, _WORD, _DIGIT, _SYMBOL, _UPPER, _HAN, _STOP, _CLOSE = 1, 2, 4, 8, 16, 32, 64, 128
#: Where the scripts begin and end; Latin is what remains.
_SCRIPTS = ((0x370, 0x3FF), (0x400, 0x52F), (0x600, 0x77F), (0x900, 0x97F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3))
#: A script holds a line from this share of its letters; folding look-alikes leaves at least that of any script.
_HELD = 0.25
_BREAK = re.compile(r"[\r\n\v\f\x85]+")
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Bits of what each code point is."""
    if not _KINDS:
        out = np.full(0x110000, _SYMBOL, np.uint8)
        for cp in range(0x20000):
            c = chr(cp)
            k = unicodedata.category(c)
            bits = _SPACE if c.isspace() or k in ("Zs", "Cc") else _WORD if k[0] in "LM" or k == "Nd" else _SYMBOL
            if k == "Nd":
                bits |= _DIGIT
            if k in ("Lu", "Lt"):
                bits |= _UPPER
            if bits & _WORD and ("一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿"):
                bits |= _HAN
            out[cp] = bits
        out[0x20000:0x323B0] = _WORD | _HAN
        for c in ".!?…。！？।؟:;‽":
            out[ord(c)] |= _STOP
        for c in "\"'»”’)]}":
            out[ord(c)] |= _CLOSE
        _KINDS.append(out)
    return _KINDS[0]


def _scripts(points: np.ndarray, start: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line its script, and the share of its letters that the script it holds less of has."""
    share = np.stack([np.add.reduceat(((points >= a) & (points <= b)).astype(np.int64), start) for a, b in _SCRIPTS], 1) / np.maximum(letters, 1)[:, None]
    script = np.where(share.max(1) >= _HELD, share.argmax(1) + 1, 0)
    return script, np.minimum(share.sum(1), 1 - np.minimum(share.sum(1), 1))


class Common:
    """The languages' common words: ``hits`` counts them by line and language."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.langs = sorted({lang for lang, _ in rows})
        self.code: dict[bytes, int] = {}
        for _, w in rows:
            for part in words(w):
                self.code.setdefault(part, len(self.code) + 1)
        self.member = np.zeros((len(self.code) + 1, max(1, len(self.langs))), np.int32)
        for lang, w in rows:
            for part in words(w):
                self.member[self.code[part], self.langs.index(lang)] = 1
        spelled = ["".join(w for lang, w in rows if lang == own) or "a" for own in self.langs] or ["a"]
        size = np.array([len(w) for w in spelled])
        self.script = _scripts(np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size)[0]

    def hits(self, lines: list[list[bytes]], script: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common words by line and language, those of languages in the line's script; then the codes and lines of all."""
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        get = self.code.get
        codes = np.fromiter((get(w, 0) for w in chain.from_iterable(lines)), np.int64, int(n.sum()))
        line = np.repeat(np.arange(len(lines)), n)
        at = np.flatnonzero(codes)
        codes, line = codes[at], line[at]
        by = np.zeros((len(lines), self.member.shape[1]), np.int64)
        np.add.at(by, line, self.member[codes])
        return by * (self.script == script[:, None]), codes, line


class Lines:
    """The lines with visible characters of a batch of texts: their counts, words' language and statistics."""

    def __init__(self, texts: list[str | None], common: Common) -> None:
        fold = transducer().apply
        parts, owner = [], []
        for d, text in enumerate(texts):
            if text:
                for line in _BREAK.split(fold(text)):
                    if line and not line.isspace():
                        parts.append(line)
                        owner.append(d)
        self.doc = np.array(owner, np.int64)
        self.docs = len(texts)
        m = len(parts)
        size = np.fromiter(map(len, parts), np.int64, m)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[points]
        start = np.cumsum(size) - size

        def count(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask.astype(np.int64), start) if m else np.empty(0, np.int64)

        word = (kind & _WORD) > 0
        before = np.concatenate(([False], word[:-1]))
        before[start] = False
        han = (kind & _HAN) > 0
        after_han = np.concatenate(([False], han[:-1]))
        self.visible = count((kind & _SPACE) == 0)
        self.words = count(word & (~before | han | after_han))
        self.letters = count(word)
        self.symbols, self.digits, self.upper = (count((kind & k) > 0) for k in (_SYMBOL, _DIGIT, _UPPER))
        # the last visible character, or the one before a closing quote or bracket
        shown = np.flatnonzero((kind & _SPACE) == 0)
        last = np.searchsorted(shown, start + size) - 1
        tail = kind[shown[last]] if m else np.empty(0, np.uint8)
        inner = kind[shown[np.maximum(last - 1, 0)]] if m else tail
        self.stops = np.where((tail & _CLOSE) > 0, (tail | inner) & _STOP, tail & _STOP) > 0
        self.lang = self.common = self.mixed = np.empty(0, np.int64)
        if not m:
            return
        script, other = _scripts(points, start, self.letters)
        self.mixed = (other > 0.1).astype(np.int64)
        by, codes, line = common.hits([words(p) for p in parts], script)
        total = np.zeros((self.docs, by.shape[1]), np.int64)
        np.add.at(total, self.doc, by)
        # a line speaks the language of most of its common words, in a tie the document's
        rank = (by * (1 << 20) + total[self.doc]) * (common.script == script[:, None])
        self.lang = np.where(rank.max(1) > 0, rank.argmax(1), -1)
        # a second language in the line, of any script, is no outlier: its common words count too
        own = np.maximum(self.lang, 0)
        new = np.zeros_like(by)
        np.add.at(new, line, common.member[codes] * (1 - common.member[codes, own[line]])[:, None])
        second = new.argmax(1)
        extra = new[np.arange(m), second]
        self.common = np.where(self.lang >= 0, by[np.arange(m), own], 0) + np.where(extra >= SECOND_LANGUAGE, extra, 0)

    def stats(self) -> np.ndarray:
        w, v = np.maximum(self.words, 1), np.maximum(self.visible, 1)
        return np.stack([
            np.log1p(np.minimum(self.words, FULL_LINE)), np.log(np.maximum(self.letters / w, 0.5)), np.sqrt(self.symbols / v), np.sqrt(self.digits / v),
            np.sqrt(self.upper / v), np.sqrt(np.minimum(self.common / w, 1)), self.stops.astype(float),
        ], axis=1)


def trimmed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the lines nearest to them, repeated until they settle."""
    mean, ridge = np.median(x, 0), 1e-3 * np.eye(x.shape[1])
    cov = np.cov(x.T) + ridge
    for _ in range(10):
        d = distances(x, mean, np.linalg.inv(cov))[0]
        near = x[d <= np.quantile(d, KEEP)]
        mean, cov = near.mean(0), np.cov(near.T) + ridge
    return mean, cov


def distances(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Mahalanobis distances and the statistics' contributions, which add up to them."""
    z = x - mean
    parts = z * (z @ precision)
    return parts.sum(1), parts


class Model:
    """Prose by language (-1: all together), the threshold, and the typical outlying line of lists, tables and junk."""

    def __init__(self, facts: dict) -> None:
        self.prose = {int(k): (np.array(m), np.array(p)) for k, (m, p) in facts["prose"].items()}
        self.threshold = facts["threshold"]
        self.other = {k: (np.array(m), np.array(p), size) for k, (m, p, size) in facts["other"].items()}

    def score(self, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line its statistics, distance (its neighbours' weighed in) and contributions."""
        x = lines.stats()
        d, parts = np.zeros(len(x)), np.zeros_like(x)
        for lang in np.unique(lines.lang).tolist():
            own = lines.lang == lang
            mean, precision = self.prose.get(lang, self.prose[-1])
            d[own], parts[own] = distances(x[own], mean, precision)
        if len(x):
            # between two scripts the estimates of all languages may fit better
            e, other = distances(x, *self.prose[-1])
            better = (lines.mixed > 0) & (e < d)
            d, parts = np.where(better, e, d), np.where(better[:, None], other, parts)
            log, size = np.log1p(d), lines.visible
            moved = np.zeros(len(x))
            for shift in (1, -1):
                same = np.roll(lines.doc, shift) == lines.doc
                same[0 if shift == 1 else -1] = False
                # a neighbour weighs by its size, never more than the line itself
                weight = np.where(same, np.minimum(1, np.roll(size, shift) / np.maximum(size, 1)), 0)
                moved += NEIGHBOURS / 2 * weight * (np.roll(log, shift) - log)
            smooth = np.expm1(log + moved)
            # what the neighbours add or take is shared out in proportion, so that the contributions still add up
            parts = np.where((d > 0)[:, None], parts * (smooth / np.where(d > 0, d, 1))[:, None], (smooth / len(STATS))[:, None])
            d = smooth
        return x, d, parts


def median_lines(lines: Lines, d: np.ndarray) -> np.ndarray:
    """Of each document the line with its median distance, -1 for one without lines: of the lines with more than half of
    the visible characters at their distance or over it, the farthest."""
    at = np.full(lines.docs, -1)
    if not len(d):
        return at
    order = np.lexsort((np.arange(len(d)), -d, lines.doc))
    doc = lines.doc[order]
    sums = np.cumsum(lines.visible[order])
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    before = np.repeat(sums[first] - lines.visible[order][first], np.diff(np.append(first, len(doc))))
    total = np.bincount(lines.doc, lines.visible, lines.docs)[doc]
    over = np.flatnonzero(2 * (sums - before) > total)[::-1]
    at[doc[over]] = order[over]  # the first of each document is written last
    return at


def fit(texts: list[str], prose: np.ndarray, kinds: list[str], common: Common) -> dict | None:
    """A model's facts from rated texts: trimmed estimates over the lines of prose, by language, and the threshold
    at which documents agree best with the raters. None if too few lines of prose are rated."""
    lines = Lines(texts, common)
    x, good = lines.stats(), prose[lines.doc]
    if good.sum() < LEAST_LINES:
        return None
    groups = {-1: good} | {lang: good & (lines.lang == lang) for lang in np.unique(lines.lang).tolist() if lang >= 0}
    found = {k: trimmed(x[own]) for k, own in groups.items() if own.sum() >= LEAST_LINES}
    # a language's covariance is drawn halfway to that within all languages, as a few hundred lines may all end alike;
    # one of few lines has the median of them and the covariance within all
    count = {k: int(groups[k].sum()) for k in found if k >= 0}
    if count:
        within = sum(n * found[k][1] for k, n in count.items()) / sum(count.values())
        found |= {k: (found[k][0], (found[k][1] + within) / 2) for k in count}
        found |= {k: (np.median(x[own], 0), within) for k, own in groups.items() if k not in found and own.sum() >= FEW_LINES}
    facts = {"prose": {k: (m.tolist(), np.linalg.inv(c).tolist()) for k, (m, c) in found.items()}, "threshold": 0.0, "other": {}}
    _, d, _ = Model(facts).score(lines)
    best = (-1.0, 0.0)
    for t in np.geomspace(5, 300, 60):
        bad = _share(lines, d > t) > 0.5
        hit = (bad & ~prose).sum()
        best = max(best, (2 * hit / max(1, bad.sum() + (~prose).sum()), float(t)))
    facts["threshold"] = best[1]
    out = d > best[1]
    for k in ("list", "table", "junk"):
        own = x[out & (np.array(kinds)[lines.doc] == k)]
        if len(own) >= LEAST_LINES:
            mean, cov = trimmed(own)
            facts["other"][k] = (mean.tolist(), np.linalg.inv(cov).tolist(), float(np.linalg.slogdet(cov)[1]))
    return facts


def _share(lines: Lines, out: np.ndarray) -> np.ndarray:
    """Share of each document's visible characters in those lines."""
    total = np.bincount(lines.doc, lines.visible, lines.docs)
    return np.bincount(lines.doc, lines.visible * out, lines.docs) / np.maximum(total, 1)


def _fitter(common_rows: list[tuple[str, str]]):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("kind").to_pylist(), strict=True))
        kinds = [k for _, _, k in rows]
        facts = fit([t for _, t, _ in rows], np.array([k == "prose" for k in kinds]), kinds, Common(common_rows))
        return pa.table({"model": [json.dumps(facts)]})

    return run


#: Stands in where nothing is fitted; what it gives is not reported.
UNFITTED = {"prose": {-1: ([0.0] * len(STATS), np.eye(len(STATS)).tolist())}, "threshold": float("inf"), "other": {}}
SCORED = (
    "doc_id bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_share double, digit_share double, upper_share double, common_share double, "
    "punctuated_lines double, lang string, distance double, contributions map<string,double>, outlying_share double, kind string"
)


def _scorer(facts: dict | None, common_rows: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, model = Common(common_rows), Model(facts or UNFITTED)
        kinds = sorted(model.other)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lines = Lines(part.column(1).to_pylist(), common)
                x, d, parts = model.score(lines)
                n, doc = lines.docs, lines.doc

                def total(v: np.ndarray) -> np.ndarray:
                    return np.bincount(doc, v, n)

                def ratio(a: np.ndarray, b: np.ndarray) -> pa.Array:
                    with np.errstate(all="ignore"):
                        return pa.array(a / b, pa.float64(), mask=b == 0)

                w, v, m = total(lines.words), total(lines.visible), np.bincount(doc, minlength=n)
                out = d > model.threshold
                share = _share(lines, out)
                by_lang = np.zeros((n, max(1, len(common.langs))))
                ok = lines.lang >= 0
                np.add.at(by_lang, (doc[ok], lines.lang[ok]), lines.visible[ok])
                lang = [common.langs[i] if has else None for i, has in zip(by_lang.argmax(1).tolist(), (by_lang.max(1) > 0).tolist(), strict=True)]
                median = median_lines(lines, d)
                contribution = np.where((median >= 0)[:, None], parts[median], 0.0) if len(d) else np.zeros((n, len(STATS)))
                near = np.zeros((n, len(kinds)))
                for j, k in enumerate(kinds):
                    mean, precision, size = model.other[k]
                    near[:, j] = total(np.where(out, (distances(x, mean, precision)[0] + size) * lines.visible, 0))
                known = (v > 0) & (facts is not None)
                guess = [("prose" if s <= 0.5 else kinds[j] if kinds else "junk") if lit else None for s, j, lit in zip(share.tolist(), near.argmin(1).tolist() if kinds else [0] * n, known.tolist(), strict=True)]
                offsets = pa.array(np.arange(n + 1) * len(STATS), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(w.astype(np.int64)), pa.array(m.astype(np.int64)), ratio(total(lines.letters), w), ratio(total(lines.symbols), v), ratio(total(lines.digits), v),
                        ratio(total(lines.upper), v), ratio(total(lines.common), w), ratio(total(lines.stops), m), pa.array(lang, pa.string()), ratio(contribution.sum(1), known.astype(float)),
                        pa.MapArray.from_arrays(offsets, pa.array(list(STATS) * n, pa.string()), pa.array(contribution.ravel(), pa.float64())), ratio(share, known.astype(float)), pa.array(guess, pa.string()),
                    ],
                    names=[c.split()[0] for c in SCORED.split(", ")],
                )

    return run


def rated_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, bytes_: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``sample`` rated documents of ``bytes_`` in all, the same ones each time: ``doc_id, text, kind``; where raters
    differ the most frequent kind holds, of equally frequent ones the first by name. Null labels count for nothing."""
    votes = labels.where("kind is not null and doc_id is not null").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "kind")).alias("b")).select("doc_id", "b.kind")
    best = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select("doc_id", "text").where("text is not null")
    # no more than `sample` rows of two short values
    rated = checkpointed(docs.join(F.broadcast(best), "doc_id").dropDuplicates(["doc_id"]))
    # a window over the sample's sizes only, so over `sample` rows of two numbers
    sizes = rated.select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    kept = sizes.withColumn("sum", F.sum("n").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("sum") <= bytes_)
    return rated.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi")


def fitted(documents: DataFrame, labels: DataFrame, common: DataFrame, sample: int = SAMPLE) -> tuple[dict | None, list[tuple[str, str]]]:
    """The model's facts, None if no prose is rated to speak of, and the common words; both small, for ``text_quality``."""
    rows = [(r.lang, r.word) for r in common.where("lang is not null and word is not null").select("lang", "word").distinct().orderBy("lang", "word").toLocalIterator()]
    got = rated_sample(documents, labels, sample).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fitter(rows), "model string").collect()
    return (json.loads(got[0].model) if got else None), rows


def text_quality(documents: DataFrame, labels: DataFrame, common: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: its statistics, distance from prose with each statistic's contribution (of the line at the
    median, see above; they add up to the distance), the share of visible characters in outlying lines, and the kind
    (prose if that is half at most, that is if the distance is not over the threshold). Null and blank texts have no words and null shares, distance and kind; without rated prose
    (fewer than ``LEAST_LINES`` lines) the statistics come out with null distance, share and kind; repeated rows stay repeated. Other
    columns are ignored. One pass, no shuffle but that of the bounded sample."""
    facts, rows = fitted(documents, labels, common, sample)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return docs.mapInArrow(_scorer(facts, rows), SCORED)


def not_prose(documents: DataFrame, labels: DataFrame, common: DataFrame) -> DataFrame:
    """``doc_id`` of documents of ``MIN_WORDS`` words or more that are no prose."""
    return text_quality(documents, labels, common).where((F.col("n_words") >= MIN_WORDS) & (F.col("outlying_share") > 0.5)).select("doc_id").distinct()
