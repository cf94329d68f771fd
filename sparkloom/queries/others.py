"""The rest of the inventory: loaders, plug-ins and small operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from ..functions import folds
from ..functions import tokenizers as K
from ..functions.predicates import tokens
from ..operators import joins as J
from ..operators import ordered as O
from ..operators.relational import numbered, ordered_list
from ..plans import models
from ..registry import query, table
from ..scratch import scratch
from ..sources import readers, sinks, tokenfile
from .metrics import BLEU, _bleu
from .ordered import RECORDS, numbered_lines, records
from .selection import CALLS, TOKENS, calls
from .streams import items

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"


def token_files(spark, sf, legacy=False):
    """The records as token files, each with its id as the first token; their prefixes."""
    r = records(spark, sf).select("record_id", F.lit(0).alias("n"), F.concat(F.array((F.col("record_id") % 2**31).cast("int")), "input_ids").alias("t"))
    written = tokenfile.write(r, scratch(spark), "record_id", "n", "t", legacy)
    tokenfile.register(spark)
    return ",".join(sorted(x.prefix for x in written.select("prefix").toLocalIterator()))  # one a partition


@query(f"SELECT record_id, len(input_ids)::INTEGER AS n, input_ids[-1] AS last FROM {RECORDS}")
def s14_legacy_token_file(spark, sf):
    back = spark.read.format("tokenfile").load(token_files(spark, sf, legacy=True))
    return back.select(F.get("tokens", F.lit(0)).cast("bigint").alias("record_id"), (F.size("tokens") - 1).alias("n"), F.element_at("tokens", -1).alias("last"))


@query(f"SELECT record_id, len(input_ids)::INTEGER AS size, input_ids[3:7] AS part FROM {RECORDS}")
def s15_partial_read(spark, sf):
    """Eight tokens of each item are read, wherever it lies."""
    back = spark.read.format("tokenfile").option("offset", 0).option("length", 8).load(token_files(spark, sf))
    return back.select(F.get("tokens", F.lit(0)).cast("bigint").alias("record_id"), (F.col("size") - 1).alias("size"), F.slice("tokens", 4, 5).alias("part"))


@query(f"SELECT record_id, input_ids AS tokens FROM {RECORDS}")
def s13_token_file(spark, sf):
    """Written as token files to the shared folder and read back through the data source."""
    back = spark.read.format("tokenfile").load(token_files(spark, sf))
    return back.select(F.get("tokens", F.lit(0)).cast("bigint").alias("record_id"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("tokens"))


@query("SELECT question || ' ?' AS question, answers FROM eval_items WHERE bench = 'open_qa'")
def s16_reader_by_name(spark, sf):
    path = scratch(spark)
    items(spark, sf, "open_qa").select("question", F.col("answers").alias("answer")).write.json(path)
    return readers.load(spark, "open_questions", path)


@query("SELECT bench AS split, question || ' ?' AS question, answers FROM eval_items WHERE bench IS NOT NULL")
def s18_registry_splits(spark, sf):
    """Every benchmark is a split, a folder each, read by the reader's name."""
    base = scratch(spark)
    rows = table(spark, sf, "eval_items").where("bench is not null").select("bench", "question", F.col("answers").alias("answer"))
    names = tuple(sorted(r.bench for r in rows.select("bench").distinct().toLocalIterator()))  # a handful of names
    for name in names:
        rows.where(F.col("bench") == name).drop("bench").write.json(f"{base}/{name}")
    return readers.load(spark, "open_questions", base, splits=names).union("split")


@query("SELECT doc_id, list_position(['prose', 'list', 'table', 'junk'], kind) - 1 AS label, ['prose', 'list', 'table', 'junk'][list_position(['prose', 'list', 'table', 'junk'], kind)] AS name FROM doc_labels WHERE rater IS NOT NULL")
def s19_adapted_splits(spark, sf):
    """A data set by split (here by rater), its label numbers named by the column's metadata."""
    names = ["prose", "list", "table", "junk"]
    rows = table(spark, sf, "doc_labels").where("rater is not null").select("rater", "doc_id", F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("kind")) - 1, F.lit(-1)).cast("int").alias("label"))
    raters = sorted(r.rater for r in rows.select("rater").distinct().toLocalIterator())  # a handful of names
    got = readers.adapted({r: readers.with_labels(rows.where(F.col("rater") == r).drop("rater"), "label", names) for r in raters})
    known = readers.label_names(got[raters[0]])
    return got.union("rater").select("doc_id", "label", F.get(F.array(*map(F.lit, known)), F.col("label")).alias("name"))


@query("SELECT doc_id, CASE kind WHEN 'prose' THEN 0 WHEN 'list' THEN 1 WHEN 'table' THEN 2 WHEN 'junk' THEN 3 END AS label FROM doc_labels")
def s20_label_conversion(spark, sf):
    names = ("prose", "list", "table", "junk")
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return table(spark, sf, "doc_labels").select("doc_id", F.when(F.col("kind").isNotNull(), F.try_element_at(ids, F.col("kind"))).alias("label"))


@query("SELECT item_id, question, len(answers)::INTEGER AS n FROM eval_items")
def s21_function_reader(spark, sf):
    """Rows of a Python generator, a call a file, run by the workers."""
    files = table(spark, sf, "eval_items").select(F.input_file_name().alias("path")).distinct()

    def rows(path: str):
        import pyarrow.parquet as pq

        for batch in pq.ParquetFile(tokenfile.opened(path)).iter_batches(columns=["item_id", "question", "answers"]):
            for r in batch.to_pylist():
                yield r["item_id"], r["question"], -1 if r["answers"] is None else len(r["answers"])

    return readers.from_function(files, "path", rows, "item_id bigint, question string, n int").withColumn("n", F.nullif("n", F.lit(-1)))


@query("SELECT md5(string_agg(tool || ',' || max_length, ';' ORDER BY tool) || chr(10)) AS md5 FROM pack_limits")
def s23_checksum(spark, sf):
    path = scratch(spark)
    t = table(spark, sf, "pack_limits").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "tool", F.col("max_length").cast("string")))), ";").alias("value"))
    t.coalesce(1).write.text(path)
    return readers.checksums(spark, path).where("length > 0").select("md5")


@query("SELECT DISTINCT word, lang FROM common_words")
def s24_tab_separated(spark, sf):
    path = scratch(spark)
    table(spark, sf, "common_words").select("word", "lang").distinct().write.csv(path, sep="\t", quote="")
    return readers.delimited(spark, path, {"word": 0, "lang": 1})


@query(rf"""
    SELECT list(word ORDER BY freq_rank) AS tokens, list(freq_rank::VARCHAR ORDER BY freq_rank) AS tags FROM common_words GROUP BY lang""")
def s24_tagged_blocks(spark, sf):
    path = scratch(spark)
    by = table(spark, sf, "common_words").groupBy("lang").agg(ordered_list("freq_rank", "word").alias("r"))
    by.select(F.array_join(F.transform("r", lambda x: F.concat(x["word"], F.lit(" "), x["freq_rank"].cast("string"))), "\n").alias("v")).select(F.concat("v", F.lit("\n")).alias("value")).write.text(path)
    return readers.tagged_blocks(readers.text_lines(spark, path)).select("tokens", "tags")


@query("SELECT DISTINCT regexp_replace(question, '^[^ ]+ ', '') AS text FROM eval_items WHERE contains(question, ' ')")
def s26_line_augment(spark, sf):
    path = scratch(spark)
    q = table(spark, sf, "eval_items").where("contains(question, ' ')").select(F.regexp_replace("question", "^[^ ]+ ", "").alias("t")).distinct()
    sinks.text_lines(q, "t", path)
    return readers.text_lines(spark, path).select("text")


@query("SELECT doc_id FROM documents WHERE length(text) > 500 AND lang = 'en'")
def p03_filter(spark, sf):
    return table(spark, sf, "documents").where("length(text) > 500 and lang = 'en'").select("doc_id")


@query("SELECT doc_id, length(text) + 1 AS n FROM documents WHERE text IS NOT NULL")
def p04_map(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", (F.length("text").cast("bigint") + 1).alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(text, ' ') AND length(text) > 10")
def p05_stream_filter(spark, sf):
    return kept(table(spark, sf, "documents"), F.contains("text", F.lit(" ")), F.length("text") > 10).select("doc_id")


def kept(d, *predicates):
    for keep in predicates:
        d = d.where(keep)
    return d


@query(f"""
    WITH {BLEU}, y AS (SELECT count_if(lower(cand[1]) IN ('yes', 'no') AND len([x for x in refs if lower(x[1]) = lower(cand[1])]) > 0) AS y FROM p),
    z AS (SELECT CASE WHEN n = 1 THEN m + y ELSE m END AS m, CASE WHEN n = 1 THEN t + y ELSE t END AS t FROM s, y)
    SELECT round((SELECT CASE WHEN c < r THEN exp(1 - r / c) ELSE 1.0 END FROM l) * exp(sum(ln(greatest(m / t, 2.2250738585072014e-308))) / 4), 9) AS bleu FROM z""")
def a07_bleu_bonus(spark, sf):
    """BLEU whose unigram counts gain a match where candidate and reference agree on yes or no."""
    from ..operators.metrics import bleu, bleu_counts

    c = bleu_counts(_bleu(spark, sf), "cand", "refs", 4)
    first = F.lower(F.get("cand", F.lit(0)))
    agree = F.when(first.isin("yes", "no") & F.exists("refs", lambda r: F.lower(F.get(r, F.lit(0))) == first), 1).otherwise(0)
    return bleu(c.withColumn("match_1", F.col("match_1") + agree).withColumn("total_1", F.col("total_1") + agree), 4).select(F.round("bleu", 9).alias("bleu"))


@query("SELECT source, weight, max_repeats > 0 AS asked FROM mix_targets")
def w08_split_validation(spark, sf):
    """A source that is asked for and has no weight is an error when its row is read."""
    s = table(spark, sf, "mix_targets").select("source", "weight", (F.col("max_repeats") > 0).alias("asked"))
    return O.validated(s, "asked", "weight")


@query("""
    WITH r AS (SELECT DISTINCT pred_id, run_id, length(prediction) AS n FROM qa_predictions WHERE prediction IS NOT NULL AND run_id IS NOT NULL), c AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY pred_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM r)
    SELECT run_id, pred_id, total::BIGINT AS total FROM c WHERE total <= 100""")
def w12_turn_budget(spark, sf):
    r = table(spark, sf, "qa_predictions").where("prediction is not null and run_id is not null").select("run_id", "pred_id", F.length("prediction").alias("n")).distinct()
    return J.within_budget(r, "run_id", F.desc("pred_id"), "n", 100).select("run_id", "pred_id", "total")


@query(f"""
    WITH c AS (SELECT sample_id, cand_id, result_text, exp(-loss_result) AS p, pos FROM {CALLS} WHERE loss_result::VARCHAR <> 'nan' AND result_text IS NOT NULL), d AS (SELECT *, count(*) OVER (PARTITION BY sample_id, result_text) > 1 AS twice, avg(pos) OVER (PARTITION BY sample_id) AS m FROM c)
    SELECT sample_id, cand_id, row_number() OVER (PARTITION BY sample_id ORDER BY round(CASE WHEN twice THEN p - abs(pos - m) / 1000 ELSE p END, 9) DESC, cand_id)::INTEGER AS place FROM d""")
def t15_answer_order(spark, sf):
    """By probability; repeated answers lose by their distance from the others."""
    c = calls(spark, sf).where("not isnan(loss_result) and result_text is not null").withColumn("p", F.exp(-F.col("loss_result")))
    twice = F.count("*").over(W.partitionBy("sample_id", "result_text")) > 1
    far = F.abs(F.col("pos") - F.avg("pos").over(W.partitionBy("sample_id"))) / 1000
    c = c.withColumn("score", F.round(F.when(twice, F.col("p") - far).otherwise(F.col("p")), 9))
    return c.select("sample_id", "cand_id", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "cand_id")).alias("place"))


@query("SELECT item_id, question FROM eval_items")
def x22_byte_bpe(spark, sf):
    """Encoded and decoded: byte-level vocabularies lose nothing."""
    q = table(spark, sf, "eval_items").select("item_id", K.byte_bpe(BYTE_BPE)("question").alias("ids"))
    return q.select("item_id", K.byte_bpe_text(BYTE_BPE)("ids").alias("question"))


@query()
def x23_sentence_pieces(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", K.sentence_pieces(PIECES)("question").alias("ids"))


@query(r"""
    WITH RECURSIVE w AS (SELECT list(DISTINCT word) AS ws FROM common_words WHERE lang = 'zh'), f AS (SELECT item_id, question AS rest, []::VARCHAR[] AS words FROM eval_items WHERE question IS NOT NULL
      UNION ALL SELECT item_id, substr(rest, n + 1), CASE WHEN keep THEN list_append(words, substr(rest, 1, n)) ELSE words END FROM (
        SELECT item_id, rest, words, greatest(length(regexp_extract(rest, '^[A-Za-z0-9]+')), coalesce(list_max([length(x) for x in ws if starts_with(rest, x)]), 1)) AS n, regexp_matches(rest, '^[A-Za-z0-9一-鿿]') AS keep FROM f, w WHERE rest <> ''))
    SELECT item_id, words FROM f WHERE rest = ''""")
def x27_segmentation(spark, sf):
    """Latin runs, and Han text by the longest word of a dictionary at each place; any function of a text may stand here."""
    words = {r.word for r in table(spark, sf, "common_words").where("lang = 'zh'").select("word").distinct().toLocalIterator()}
    q = table(spark, sf, "eval_items").where("question is not null")
    return q.select("item_id", folds.per_row(folds.segmenter(words), folds.STRINGS)("question").alias("words"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT *, max(contains(line, '?')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS late FROM l)
    SELECT doc_id, coalesce(array_to_string(list(line ORDER BY n) FILTER (WHERE late = 0), ' '), '') AS article, coalesce(array_to_string(list(line ORDER BY n) FILTER (WHERE late = 1), ' '), '') AS abstract FROM f GROUP BY doc_id""")
def x29_highlight_split(spark, sf):
    """Lines before the first mark, and from it on; the mark here is a question."""
    w = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    f = numbered_lines(spark, sf).withColumn("late", F.max(F.contains("line", F.lit("?")).cast("int")).over(w))
    got = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "line", "late"))).alias("r"))

    def joined(late: int):
        return F.array_join(F.transform(F.filter("r", lambda x: x["late"] == late), lambda x: x["line"]), " ")

    return got.select("doc_id", joined(0).alias("article"), joined(1).alias("abstract"))


_WORDS = "(SELECT map(list(a), list(b)) AS m FROM (SELECT e.word AS a, min(d.word) AS b FROM common_words e JOIN common_words d USING (freq_rank) WHERE e.lang = '{0}' AND d.lang = '{1}' GROUP BY e.word))"
_BY_WORD = "array_to_string([coalesce(m[lower(w)], w) for w in string_split({0}, ' ')], ' ')"


def translator(spark, sf, source, target):
    """A client that puts words of one language by those of the same rank in another; the table is of a fixed size."""
    c = table(spark, sf, "common_words")
    rows = c.where(F.col("lang") == source).select("freq_rank", F.col("word").alias("a")).join(c.where(F.col("lang") == target).select("freq_rank", F.col("word").alias("b")), "freq_rank").groupBy("a").agg(F.min("b").alias("b"))
    return models.WordByWord({r.a: r.b for r in rows.toLocalIterator()})


@query(f"SELECT item_id, question, {_BY_WORD.format('question')} AS output FROM eval_items, {_WORDS.format('en', 'de')}")
def x35_client_call(spark, sf):
    return models.completed(table(spark, sf, "eval_items").select("item_id", "question"), "question", translator(spark, sf, "en", "de"))


@query(f"""
    WITH v AS (SELECT word, min(freq_rank) AS id FROM common_words WHERE lang = 'en' GROUP BY word)
    SELECT item_id, list(coalesce(id, 0) ORDER BY k)::INTEGER[] AS ids FROM (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT item_id, {TOKENS.format('lower(question)')} AS t FROM eval_items)) LEFT JOIN v ON v.word = w GROUP BY item_id""")
def x46_token_ids(spark, sf):
    v = table(spark, sf, "common_words").where("lang = 'en'").groupBy(F.col("word").alias("token")).agg(F.min("freq_rank").alias("id"))
    w = table(spark, sf, "eval_items").select("item_id", F.posexplode(tokens(F.lower("question"))).alias("k", "w"))
    found = J.lookup(w, "w", v, 0).groupBy("item_id").agg(ordered_list("k", "id").alias("r"))
    return found.select("item_id", F.transform("r", lambda x: x["id"]).alias("ids"))


@query("SELECT tool, CASE WHEN max(list_max(input_ids)) < 65535 THEN 'uint16' ELSE 'int32' END AS kind FROM pack_records WHERE len(input_ids) > 0 GROUP BY tool")
def b12_id_type(spark, sf):
    r = table(spark, sf, "pack_records").where("size(input_ids) > 0")
    return r.groupBy("tool").agg(F.when(F.max(F.array_max("input_ids")) < 65535, "uint16").otherwise("int32").alias("kind"))


@query("SELECT doc_id, upper(lang) AS lang, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def m04_ordered_map(spark, sf):
    n = numbered(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])
    return n.select("doc_id", F.upper("lang").alias("lang"), F.col("idx").cast("bigint").alias("place"))


@query(f"SELECT item_id, lower(question) AS question, 'de: ' || {_BY_WORD.format('lower(question)')} AS output FROM eval_items, {_WORDS.format('en', 'de')}")
def g07_task_pipeline(spark, sf):
    """Prepared, run through a model stage, finished: three transformations in a chain."""
    q = table(spark, sf, "eval_items").select("item_id", F.lower("question").alias("question"))
    return q.transform(lambda d: models.completed(d, "question", translator(spark, sf, "en", "de"))).select("item_id", "question", F.concat(F.lit("de: "), "output").alias("output"))


@query("""
    SELECT a.vec_id, arg_max(b.label, (round(list_dot_product(a.e, b.c), 4), -b.label)) AS label FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a,
      (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label) b GROUP BY a.vec_id""")
def g09_dual_encoder(spark, sf):
    """Each vector to the label whose mean vector it has the largest product with; the means are one row a label."""
    from ..functions.arrays import dot

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    means = e.select("label", F.posexplode("e").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("x")).groupBy("label").agg(ordered_list("i", "x").alias("r"))
    means = means.select("label", F.transform("r", lambda x: x["x"]).alias("c")).agg(F.collect_list(F.struct("label", "c")).alias("all"))
    best = F.array_max(F.transform("all", lambda m: F.struct(F.round(dot(F.col("e"), m["c"]), 4).alias("s"), (-m["label"]).alias("l"))))
    return e.join(F.broadcast(means), F.lit(True)).select("vec_id", (-best["l"]).alias("label"))


#: Kinds of subject and object, predicate, and how far the object may lie behind the subject, or before it.
RULES = (
    ("calculator", "calculator", "continues", 40), ("calculator", "calendar", "dates", 60), ("calendar", "calculator", "counts", -60), ("qa", "search", "looks_up", 80),
    ("search", "qa", "answers", -80), ("translator", "translator", "repeats", 25), ("translator", "search", "looks_up", 30), ("qa", "qa", "follows", -40),
)


@query(f"""
    WITH c AS (SELECT sample_id, cand_id, tool, call_text, pos FROM {CALLS} WHERE tool IS NOT NULL AND pos IS NOT NULL), r(ka, kb, predicate, most) AS (VALUES {", ".join(map(str, RULES))})
    SELECT a.sample_id, a.cand_id AS subject, b.cand_id AS object, predicate FROM c a JOIN r ON r.ka = a.tool JOIN c b ON a.sample_id = b.sample_id AND b.tool = r.kb
    WHERE a.call_text <> b.call_text AND CASE WHEN most > 0 THEN b.pos > a.pos AND b.pos <= a.pos + most ELSE b.pos < a.pos AND b.pos >= a.pos + most END""")
def g13_relation_rules(spark, sf):
    """Subject, predicate, object by rules over kinds and places of two different calls."""
    c = calls(spark, sf).where("tool is not null and pos is not null")
    return J.related(c, list(RULES), "sample_id", "cand_id", "tool", "pos", "call_text")


@query(f"SELECT item_id, question, {_BY_WORD.format('output')} AS output FROM (SELECT item_id, question, {_BY_WORD.format('question')} AS output FROM eval_items, {_WORDS.format('en', 'de')}), {_WORDS.format('de', 'en')}")
def d07_model_augment(spark, sf):
    """There and back through two clients."""
    there = models.completed(table(spark, sf, "eval_items").select("item_id", "question"), "question", translator(spark, sf, "en", "de"), "there")
    return models.completed(there, "there", translator(spark, sf, "de", "en")).select("item_id", "question", "output")
