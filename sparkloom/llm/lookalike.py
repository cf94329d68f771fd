"""Documents that look the same but are stored in different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glyphs import one_form
from .shared import across, checkpointed
from .words import MIN_WORDS

_WORD = r"(?:\p{IsHan}|[\p{L}\p{M}\p{Nd}&&[^\p{IsHan}]]++)"
# anchored, so that a text of one endless word is read once
_LONG_ENOUGH = rf"^[^\p{{L}}\p{{M}}\p{{Nd}}]*+(?:{_WORD}[^\p{{L}}\p{{M}}\p{{Nd}}]*+){{{MIN_WORDS}}}"


def normalized(documents: DataFrame, text_col: str = "text", out: str = "one_form") -> DataFrame:
    """``documents`` with the one form of its text; a column of that name is replaced, null stays null."""
    return documents.withColumn(out, one_form(F.col(text_col)))


def look_alike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every two documents with one form and different stored characters: ``(doc_id_a, doc_id_b)``, the smaller id first.

    Documents under ``MIN_WORDS`` words, null and empty ones are left out; a repeated row counts once. Only digests are
    shuffled. Distinct stored texts are paired first, so copies cost nothing beyond the pairs they stand for; those of
    a text with very many copies meet in blocks.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    forms = docs.select("doc_id", F.md5("text").alias("stored"), one_form(F.col("text")).alias("form")).where(F.col("form").rlike(_LONG_ENOUGH))
    keyed = checkpointed(forms.select("doc_id", F.unhex("stored").alias("stored"), F.unhex(F.md5("form")).alias("form")))
    kinds = keyed.select("form", "stored").distinct()
    several = kinds.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    kinds = kinds.join(several, "form")
    pairs = checkpointed(kinds.join(kinds.select("form", F.col("stored").alias("other")), "form").where("stored < other").select(F.col("stored").alias("a"), F.col("other").alias("b")))
    told = keyed.join(kinds.select("stored"), "stored", "left_semi").select("stored", "doc_id")
    found = across(pairs, checkpointed(told), "stored", "doc_id").where("left <> right")
    return found.select(F.least("left", "right").alias("doc_id_a"), F.greatest("left", "right").alias("doc_id_b")).distinct()
