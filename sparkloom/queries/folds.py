"""Operators that fold over one row: phrases, pieces, marks, masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import folds as X
from ..functions.predicates import tokens
from ..operators.metrics import bleu, bleu_counts, lcs_length, rouge_l
from ..registry import query, table
from .metrics import _ROUGE, BLEU, LCS, _bleu, a09_rouge_l
from .selection import TOKENS


def questions(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", "question")


@query(f"WITH RECURSIVE {LCS} SELECT pred_id, n::INTEGER AS n FROM l WHERE k = 1")
def x10_common_subsequence(spark, sf):
    p = _bleu(spark, sf)
    return p.select("pred_id", lcs_length(F.col("cand"), F.coalesce(F.get("refs", F.lit(0)), F.array().cast("array<string>"))).alias("n"))


@query("""
    WITH RECURSIVE q AS (SELECT c.item_id, lower(c.question) AS a, [substr(lower(d.question), j, 1) for j in range(1, length(d.question) + 1)] AS b FROM eval_items c JOIN eval_items d ON d.item_id = c.item_id + 3),
    f AS (SELECT item_id, a, b, 0 AS i, [0 for x in b] AS row, 0 AS n, 0 AS stop FROM q
      UNION ALL SELECT item_id, a, b, i + 1, t, greatest(n, coalesce(list_max(t), 0)), CASE WHEN list_max(t) > n THEN i + 1 ELSE stop END FROM (
        SELECT *, [CASE WHEN b[j] = substr(a, i + 1, 1) THEN coalesce(CASE WHEN j > 1 THEN row[j - 1] END, 0) + 1 ELSE 0 END for j in range(1, len(b) + 1)] AS t FROM f WHERE i < length(a)))
    SELECT item_id, stop::INTEGER AS "end", n::INTEGER AS n FROM f WHERE i = length(a)""")
def x11_common_run(spark, sf):
    q = questions(spark, sf).where("question is not null").withColumn("other", F.col("item_id") + 3)
    both = q.join(q.select(F.col("item_id").alias("other"), F.col("question").alias("b")), "other")

    def runs(batches):
        for f in batches:
            got = [X.longest_common_run(a, b) for a, b in zip(f["question"], f["b"], strict=True)]
            yield f[["item_id"]].assign(end=[e for e, _ in got], n=[n for _, n in got])

    return both.select("item_id", "question", "b").mapInPandas(runs, "item_id bigint, end int, n int")


#: The spans (first, last) of the dictionary's words in ``{text}`` by ``{id}``: the longest word at each place, if it ends beyond all before.
_PHRASES = """
    w AS (SELECT DISTINCT word, length(word) AS n FROM common_words), s AS (SELECT {id} AS id, t.i, {text} AS text, n FROM {table}, unnest(range(1, length({text}) + 1)) t(i), (SELECT DISTINCT n FROM w) WHERE i + n - 1 <= length({text})),
    m AS (SELECT id, i - 1 AS first, max(i + s.n - 2) AS last FROM s JOIN w ON w.n = s.n AND w.word = substr(text, i, s.n) GROUP BY ALL),
    a AS (SELECT id, first::INTEGER AS first, last::INTEGER AS last FROM (SELECT *, max(last) OVER (PARTITION BY id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m) WHERE prev IS NULL OR last > prev)"""


def dictionary(spark, sf):
    """The common words of all languages as a trie; the table is of a fixed size."""
    return X.Phrases(r.word for r in table(spark, sf, "common_words").where("word is not null").select("word").distinct().toLocalIterator())


@query(f"WITH {_PHRASES.format(id='doc_id', text='text', table='documents')} SELECT id AS doc_id, first, last FROM a")
def x13_phrase_matches(spark, sf):
    trie = dictionary(spark, sf)

    def run(batches):
        for b in batches:
            found = [trie.find(t) for t in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
            at = np.array([p for x in found for p in x], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["doc_id", "first", "last"])

    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, first int, last int")


@query(f"""
    WITH {_PHRASES.format(id='item_id', text='question', table='eval_items')}, c AS (SELECT item_id, unnest(range(0, length(question))) AS i FROM eval_items), t AS (SELECT item_id, i, max(first) AS f FROM c LEFT JOIN a ON id = item_id AND i BETWEEN first AND last GROUP BY ALL)
    SELECT item_id, list(CASE WHEN f IS NULL THEN 'O' WHEN f = i THEN 'B-TERM' ELSE 'I-TERM' END ORDER BY i) AS tags FROM t GROUP BY item_id""")
def x55_tag_override(spark, sf):
    q = questions(spark, sf).where("length(question) > 0").select("item_id", F.length("question").alias("n"), X.found_spans(dictionary(spark, sf))(F.col("question")).alias("spans"))
    return q.select("item_id", X.overridden(F.col("n"), F.col("spans"), "TERM").alias("tags"))


@query(f"""
    WITH RECURSIVE v AS (SELECT list(DISTINCT p) AS vs FROM (SELECT word AS p FROM common_words UNION SELECT unnest(string_split(word, '')) FROM common_words UNION SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', '')))),
    q AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT item_id, {TOKENS.format('lower(question)')} AS t FROM eval_items)),
    f AS (SELECT DISTINCT w, CASE WHEN length(w) > 100 THEN '' ELSE w END AS rest, CASE WHEN length(w) > 100 THEN ['[UNK]'] ELSE [] END::VARCHAR[] AS ps FROM q
      UNION ALL SELECT w, CASE WHEN n IS NULL THEN '' ELSE substr(rest, n + 1) END, CASE WHEN n IS NULL THEN ['[UNK]'] ELSE list_append(ps, CASE WHEN len(ps) > 0 THEN '##' ELSE '' END || substr(rest, 1, n)) END
        FROM (SELECT *, list_max([length(p) for p in vs if starts_with(rest, p)]) AS n FROM f, v WHERE rest <> ''))
    SELECT item_id, flatten(list(ps ORDER BY k)) AS pieces FROM q JOIN f USING (w) WHERE rest = '' GROUP BY item_id""")
def x21_word_pieces(spark, sf):
    # the vocabulary is a table of a fixed size, and the letters
    known = {r.word for r in table(spark, sf, "common_words").select("word").distinct().toLocalIterator()}
    letters = {c for w in known for c in w} | set("abcdefghijklmnopqrstuvwxyz0123456789")
    vocabulary = known | letters | {"##" + x for x in known | letters}

    def pieces(words):
        return [p for w in words for p in X.word_pieces(w, vocabulary)]

    return questions(spark, sf).select("item_id", X.per_row(pieces, X.STRINGS)(tokens(F.lower("question"))).alias("pieces"))


@query("""
    WITH RECURSIVE v AS (SELECT list(DISTINCT word) AS vs FROM common_words WHERE lang = 'zh' AND length(word) BETWEEN 2 AND 6),
    f AS (SELECT doc_id, text AS rest, []::VARCHAR[] AS marks FROM documents WHERE regexp_matches(text, '[一-鿿]')
      UNION ALL SELECT doc_id, substr(rest, n + 1), list_concat(marks, [CASE WHEN i = 1 THEN '' ELSE '##' END || substr(rest, i, 1) for i in range(1, n + 1)])
        FROM (SELECT *, coalesce(list_max([length(x) for x in vs if starts_with(rest, x)]), 1) AS n FROM f, v WHERE rest <> ''))
    SELECT doc_id, marks FROM f WHERE rest = ''""")
def x25_whole_word_marks(spark, sf):
    # the words of one language of a table of a fixed size
    words = {r.word for r in table(spark, sf, "common_words").where("lang = 'zh'").select("word").distinct().toLocalIterator()}

    def marks(t):
        return X.whole_word_marks(list(t), words)

    d = table(spark, sf, "documents").where(F.col("text").rlike("[一-鿿]"))
    return d.select("doc_id", X.per_row(marks, X.STRINGS)("text").alias("marks"))


@query(r"""
    WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
    r AS (SELECT *, sum((w <> '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, w = '' ORDER BY i) AS k FROM r)
    SELECT doc_id, coalesce(list(CASE WHEN w = '' THEN ' ' ELSE w END ORDER BY i) FILTER (WHERE w <> '' OR k % 2 = 0), []) AS words FROM k GROUP BY doc_id""")
def x26_delimiters(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.restored_delimiters(F.col("text")).alias("words"))


@query(f"""
    WITH t AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i, greatest(1, round_even(len(t) * 0.15, 0)) AS most FROM (SELECT item_id, {TOKENS.format('question')} AS t FROM eval_items)),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(i::VARCHAR || '-' || w), i) AS k FROM t)
    SELECT item_id, list(k <= most ORDER BY i) AS masked FROM k GROUP BY item_id""")
def b08_whole_word_mask(spark, sf):
    """No word of the questions has pieces; those of several are tested apart."""

    def mask(words):
        import hashlib

        order = sorted(range(len(words)), key=lambda i: hashlib.md5(f"{i}-{words[i]}".encode()).hexdigest())
        return X.whole_word_mask(list(words), order)

    q = questions(spark, sf).select("item_id", tokens(F.col("question")).alias("t")).where("size(t) > 0")
    return q.select("item_id", X.per_row(mask, T.ArrayType(T.BooleanType()))("t").alias("masked"))


_BONUS = "SELECT pred_id, (n + b)::DOUBLE / nullif(c + b, 0) AS p, (n + b)::DOUBLE / nullif(r + b, 0) AS r FROM (SELECT *, CASE WHEN one IN ('yes', 'no') AND one = other THEN n ELSE 0 END AS b FROM l WHERE k = 1)"


@query(f"WITH RECURSIVE {LCS} SELECT round(avg({_ROUGE}), 9) AS rouge_l FROM ({_BONUS})")
def a10_rouge_l_bonus(spark, sf):
    """ROUGE-L whose numerator and denominators gain the subsequence's length where the answers agree on yes or no."""
    p = _bleu(spark, sf).withColumn("ref", F.coalesce(F.get("refs", F.lit(0)), F.array().cast("array<string>"))).withColumn("n", lcs_length(F.col("cand"), F.col("ref")))
    agree = F.lower(F.get("cand", F.lit(0))).isin("yes", "no") & (F.lower(F.get("cand", F.lit(0))) == F.lower(F.get("ref", F.lit(0))))
    bonus = F.when(agree, F.col("n")).otherwise(0)
    precision, recall = F.try_divide((F.col("n") + bonus).cast("double"), (F.size("cand") + bonus).cast("double")), F.try_divide((F.col("n") + bonus).cast("double"), (F.size("ref") + bonus).cast("double"))
    return p.agg(F.round(F.avg(rouge_l(precision, recall)), 9).alias("rouge_l"))


@query(f"""
    WITH RECURSIVE {LCS.replace("l AS (SELECT pred_id, k", "ll AS (SELECT pred_id, k")}, {BLEU.replace("p AS (SELECT pred_id, ", "bp AS (SELECT pred_id, ", 1).replace("FROM p, k", "FROM bp, k").replace("FROM p)", "FROM bp)")}
    SELECT 'bleu_4' AS metric, round((SELECT CASE WHEN c < r THEN exp(1 - r / c) ELSE 1.0 END FROM l) * exp(sum(ln(greatest(m / t, 2.2250738585072014e-308))) / 4), 2) AS value FROM s
    UNION ALL SELECT 'rouge_l', round(avg({_ROUGE}), 2) FROM (SELECT pred_id, coalesce(max(n) / nullif(max(c), 0), 0)::DOUBLE AS p, max(coalesce(n / nullif(r, 0), 0))::DOUBLE AS r FROM ll GROUP BY pred_id)""")
def a22_reading_metrics(spark, sf):
    b = bleu(bleu_counts(_bleu(spark, sf), "cand", "refs", 4), 4).select(F.lit("bleu_4").alias("metric"), F.round("bleu", 2).alias("value"))
    return b.unionByName(a09_rouge_l(spark, sf).select(F.lit("rouge_l").alias("metric"), F.round("rouge_l", 2).alias("value")))


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL")
def p09_unused_columns(spark, sf):
    wanted = {"doc_id", "lang", "not_there"}
    d = table(spark, sf, "documents").where("text is not null")
    return d.select([c for c in d.columns if c in wanted])


@query("SELECT string_split(l, chr(9))[2] AS source, string_split(l, chr(9))[1] AS id FROM (SELECT doc_id::VARCHAR || chr(9) || source AS l FROM documents WHERE source IS NOT NULL)")
def p10_positional_columns(spark, sf):
    line = table(spark, sf, "documents").where("source is not null").select(F.concat_ws("\t", F.col("doc_id").cast("string"), "source").alias("l"))
    return line.select(*[F.get(F.split("l", "\t"), F.lit(i)).alias(n) for n, i in (("source", 1), ("id", 0))])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1")
def p08_stream_shard(spark, sf):
    from ..operators.relational import numbered

    return numbered(table(spark, sf, "documents").select("doc_id"), ["doc_id"]).where("idx % 4 = 1").select("doc_id")


@query("SELECT 'kind' AS k, count(*) AS n FROM documents WHERE text IS NOT NULL")
def p02_batched_map(spark, sf):
    from collections.abc import Iterator

    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    n = table(spark, sf, "documents").where("text is not null").select("doc_id").mapInArrow(count, "n bigint")
    return n.agg(F.sum("n").alias("n")).select(F.lit("kind").alias("k"), "n")
