"""Readers, sinks, streams and the function surfaces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import numbered
from ..registry import query, table
from ..scratch import scratch
from ..sources import readers, sinks
from ..streaming import events as S
from ..functions.predicates import tokens
from ..plans import language as L
from .selection import CALLS, LINES, TOKENS, calls, lines

TEXTS = "SELECT text FROM documents WHERE text IS NOT NULL"


def texts(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("text")


def items(spark, sf, bench):
    return table(spark, sf, "eval_items").where(F.col("bench") == bench)


@query(TEXTS)
def s01_json_scan(spark, sf):
    path = scratch(spark)
    sinks.rotating_json(texts(spark, sf), path, shard_rows=200)
    return readers.json_texts(spark, path)


@query(TEXTS)
def s02_streaming_scan(spark, sf):
    path = scratch(spark)
    texts(spark, sf).write.json(path)
    return S.drained(readers.stream_texts(spark, path), scratch(spark))


@query(f"SELECT ((row_number() OVER (ORDER BY doc_id, line) - 1) // 100 + 5)::BIGINT AS shard, line FROM {LINES} WHERE contains(line, ' -> ')")
def s04_converted_shards(spark, sf):
    hit = lines(spark, sf).where("contains(line, ' -> ')").select("doc_id", "line")
    return numbered(hit, ["doc_id", "line"]).select((F.floor(F.col("idx") / 100) + 5).alias("shard"), "line")


FILLED = "list_reduce(list_prepend(question, list_reverse(list_transform(range(len(string_split(numbers, ' '))), lambda i: i::VARCHAR))), lambda t, i: replace(t, 'number' || i, string_split(numbers, ' ')[i::INTEGER + 1]))"


@query(f"SELECT {FILLED} AS question, answers FROM eval_items WHERE bench = 'math_word'")
def s05_word_problems(spark, sf):
    path = scratch(spark)
    items(spark, sf, "math_word").select("question", "numbers", F.lit("x").alias("equation"), F.get("answers", F.lit(0)).alias("answer")).write.csv(path, header=True, escape='"')
    return readers.word_problems(spark, path)


@query(r"SELECT 'Complete: ' || trim(string_split(question, '[MASK]')[1]) AS question, answers[1:1] AS answers FROM eval_items WHERE bench = 'masked_fact' AND regexp_matches(question, '\[MASK\]\s*[.,!?]?$')")
def s06_masked_facts(spark, sf):
    path = scratch(spark)
    items(spark, sf, "masked_fact").select(F.array("question").alias("masked_sentences"), F.get("answers", F.lit(0)).alias("obj_label")).write.json(path)
    return readers.masked_facts(spark, path)


@query("SELECT question, answers FROM eval_items WHERE bench = 'alias_qa'")
def s07_web_questions(spark, sf):
    path = scratch(spark)
    target = F.concat(F.lit("(list "), F.array_join(F.transform("answers", lambda a: F.concat(F.lit('(description "'), a, F.lit('")'))), " "), F.lit(")"))
    items(spark, sf, "alias_qa").agg(F.collect_list(F.struct(F.col("question").alias("utterance"), target.alias("targetValue"))).alias("a")).select(F.to_json("a").alias("value")).write.text(path)
    return readers.web_questions(spark, path)


@query("SELECT question || ' ?' AS question, answers FROM eval_items WHERE bench = 'open_qa'")
def s08_open_questions(spark, sf):
    path = scratch(spark)
    items(spark, sf, "open_qa").select("question", F.col("answers").alias("answer")).write.json(path)
    return readers.open_questions(spark, path)


@query("SELECT question, answers FROM eval_items WHERE bench IN ('alias_qa', 'open_qa')")
def s09_alias_union(spark, sf):
    paths = [scratch(spark), scratch(spark)]
    for bench, path in zip(("alias_qa", "open_qa"), paths, strict=True):
        items(spark, sf, bench).agg(F.collect_list(F.struct(F.col("question").alias("Question"), F.struct(F.col("answers").alias("NormalizedAliases")).alias("Answer"))).alias("Data")).write.json(path)
    return readers.alias_questions(spark, *paths)


@query("SELECT context, question, answers[1:1] AS answers FROM eval_items WHERE context IS NOT NULL")
def s10_nested_qa(spark, sf):
    path = scratch(spark)
    qa = F.array(F.struct("question", F.transform("answers", lambda a: F.struct(a.alias("text"))).alias("answers")))
    it = table(spark, sf, "eval_items").where("context is not null").select(F.struct("context", qa.alias("qas")).alias("p"))
    it.agg(F.array(F.struct(F.collect_list("p").alias("paragraphs"))).alias("data")).write.json(path)
    return readers.nested_qa(spark, path)


@query("""
    SELECT n AS id, 'What day of the week is ' || strftime(d, '%Y-%m-%d') || '?' AS question, dayname(d) AS answer FROM (SELECT n, (DATE '2000-01-01' + (n * 37 % 9000)::INTEGER)::DATE AS d FROM range(0, 200) t(n))
    UNION ALL SELECT n + 200, 'How many days are left until ' || strftime(d, '%Y-%m-%d') || '?', date_diff('day', DATE '2000-01-01', d)::VARCHAR FROM (SELECT n, (DATE '2000-01-01' + (n * 37 % 9000)::INTEGER)::DATE AS d FROM range(0, 200) t(n))""")
def s11_date_questions(spark, sf):
    d = spark.range(200).select("id", F.date_add(F.to_date(F.lit("2000-01-01")), (F.col("id") * 37 % 9000).cast("int")).alias("d"))
    day = F.date_format("d", "yyyy-MM-dd")
    a = d.select("id", F.concat(F.lit("What day of the week is "), day, F.lit("?")).alias("question"), F.date_format("d", "EEEE").alias("answer"))
    return a.unionByName(d.select((F.col("id") + 200).alias("id"), F.concat(F.lit("How many days are left until "), day, F.lit("?")).alias("question"), F.datediff("d", F.to_date(F.lit("2000-01-01"))).cast("string").alias("answer")))


@query(TEXTS)
def s12_plain_documents(spark, sf):
    path = scratch(spark)
    texts(spark, sf).write.json(f"{path}/a")
    return readers.plain_documents(spark, path)


RECORDS = "(SELECT DISTINCT record_id, input_ids FROM pack_records WHERE len(input_ids) > 0)"


@query("""
    WITH a AS (SELECT tool, record_id, row_number() OVER (PARTITION BY tool ORDER BY record_id) - 1 AS i FROM (SELECT DISTINCT tool, record_id FROM pack_records WHERE tool IS NOT NULL)), n AS (SELECT tool, count(*) AS n FROM a GROUP BY tool),
    o AS (SELECT tool, coalesce(sum(n) OVER (ORDER BY tool ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n)
    SELECT record_id, (i + before)::BIGINT AS position FROM a JOIN o USING (tool)""")
def s17_merge_offsets(spark, sf):
    r = table(spark, sf, "pack_records").where("tool is not null").select("tool", "record_id").distinct()
    return numbered(r, ["tool", "record_id"]).select("record_id", F.col("idx").cast("bigint").alias("position"))


TOOLS = ("calculator", "qa", "translator", "calendar", "search")


@query("SELECT tool AS split, count(*) AS n FROM subset_rows WHERE tool IS NOT NULL GROUP BY tool")
def s22_split_container(spark, sf):
    """A frame a split, addressed by name or place."""
    splits = readers.Splits({s: table(spark, sf, "subset_rows").where(F.col("tool") == s) for s in TOOLS})
    assert splits[0] is splits["calculator"] and len(splits[1:3]) == 2
    return splits.union("split").groupBy("split").agg(F.count("*").alias("n"))


@query(r"SELECT regexp_replace(prediction, '[\r\n]+', ' ', 'g') AS text FROM (SELECT DISTINCT prediction FROM qa_predictions WHERE prediction IS NOT NULL)")
def s25_text_sink(spark, sf):
    path = scratch(spark)
    p = table(spark, sf, "qa_predictions").where("prediction is not null").select("prediction").distinct()
    sinks.text_lines(p, "prediction", path)
    return readers.text_lines(spark, path).select("text")


@query("SELECT word AS token, min(freq_rank)::BIGINT AS id FROM common_words GROUP BY word")
def s27_vocabulary_json(spark, sf):
    v = table(spark, sf, "common_words").groupBy(F.col("word").alias("token")).agg(F.min("freq_rank").cast("bigint").alias("id"))
    text = sinks.vocabulary_to_json(v)
    return text.select(F.explode(F.from_json("json", "map<string,bigint>")).alias("token", "id"))


@query("""
    WITH e AS (SELECT vec_id::VARCHAR AS token, embedding FROM embeddings), v AS (SELECT DISTINCT word AS token FROM common_words)
    SELECT coalesce(e.token, v.token) AS token, round(coalesce(list_sum(embedding::DOUBLE[]), 0), 4) AS total, 64 AS d FROM e FULL JOIN v ON e.token = v.token UNION ALL SELECT '[UNK]', 0, 64 UNION ALL SELECT '[PAD]', 0, 64""")
def s28_embedding_table(spark, sf):
    """Written as one npz file, read back with the words of another vocabulary."""
    path = f"{scratch(spark)}/vectors.npz"
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("token"), "embedding")
    sinks.embedding_file(e, "token", "embedding", path).collect()  # one row
    got = readers.embeddings(spark, path, extended=table(spark, sf, "common_words").select("word"))
    return got.select("token", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("embedding").alias("d"))


@query("SELECT question AS text, item_id::VARCHAR AS id, 0 AS start, 5 AS \"end\", lang AS label FROM eval_items")
def s29_annotations(spark, sf):
    path = scratch(spark)
    r = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("labels").alias("type"), F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.array("lang").alias("labels")).alias("value"))
    table(spark, sf, "eval_items").select(F.struct(F.col("question").alias("text")).alias("data"), F.array(F.struct(F.array(r).alias("result"))).alias("annotations")).write.json(path)
    return readers.annotations(spark.read.schema(readers.ANNOTATIONS).json(path))


# --- streams ---


def events(spark, sf):
    # a pattern, so that one file and a folder of files are both read
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE value > 10")
def m01_stream_map_filter(spark, sf):
    return S.drained(events(spark, sf).where("value > 10").select("event_id", (F.col("value") * 2).alias("doubled")), scratch(spark))


@query("""
    WITH RECURSIVE r AS (SELECT user_id % 8 AS shard, event_id AS item, (10 + event_id % 90) AS size, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS k FROM events),
    f AS (SELECT shard, item, size AS fill, 0 AS pack, k FROM r WHERE k = 1 UNION ALL SELECT r.shard, r.item, CASE WHEN f.fill + r.size <= 256 THEN f.fill + r.size ELSE r.size END, CASE WHEN f.fill + r.size <= 256 THEN f.pack ELSE f.pack + 1 END, r.k FROM f JOIN r ON r.shard = f.shard AND r.k = f.k + 1)
    SELECT shard, item, pack::BIGINT AS pack FROM f""")
def m02_streaming_packing(spark, sf):
    rows = events(spark, sf).select(F.pmod("user_id", F.lit(8)).alias("shard"), F.col("event_id").alias("item"), (10 + F.col("event_id") % 90).alias("size"))
    return S.drained(S.packed(rows, 256), scratch(spark))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def m06_tumbling(spark, sf):
    w = S.drained(S.tumbling(events(spark, sf), "1 hour", "10 minutes", ["event_type"]), scratch(spark), "complete")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    WITH s AS (SELECT user_id, ts, sum((prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))
    SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def m06_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.sessions(e, "30 minutes", "10 minutes", "user_id").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first"), "n")


# --- function surfaces ---


@query("SELECT doc_id, nfc_normalize(text) AS value FROM documents WHERE text IS NOT NULL")
def g01_scalar_function(spark, sf):
    """Any Python function over a column, a batch at a time; this one has no built-in counterpart."""
    import unicodedata

    composed = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFC", t)), T.StringType())
    return table(spark, sf, "documents").where("text is not null").select("doc_id", composed("text").alias("value"))


@query(f"SELECT tool, count(*) AS n, round(avg(loss_result), 6) AS mean FROM {CALLS} WHERE loss_result < 1000 AND loss_result::VARCHAR <> 'nan' AND tool IS NOT NULL GROUP BY tool")
def g02_metric_protocol(spark, sf):
    # partial sums by hash slice, then one row a tool: the form of any metric that accumulates
    c = calls(spark, sf).where("loss_result < 1000 and not isnan(loss_result) and tool is not null")
    part = c.groupBy("tool", F.pmod(F.xxhash64("cand_id"), F.lit(16))).agg(F.sum("loss_result").alias("s"), F.count("*").alias("k"))
    return part.groupBy("tool").agg(F.sum("k").alias("n"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean"))


@query(f"SELECT doc_id, line FROM {LINES} WHERE line <> ''")
def g03_table_function(spark, sf):
    cut = F.explode(F.filter(F.split("text", "\n"), lambda x: x != ""))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", cut.alias("line"))


@query("SELECT doc_id, replace(left(trim(text, ' '), 20), ' ', '_') AS head FROM documents WHERE text IS NOT NULL")
def g04_compose(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    steps = (lambda x: x.withColumn("text", F.trim("text")), lambda x: x.withColumn("text", F.left("text", F.lit(20))), lambda x: x.select("doc_id", F.replace("text", F.lit(" "), F.lit("_")).alias("head")))
    for s in steps:
        d = d.transform(s)
    return d


_PAIRS = f"""p AS (SELECT unnest(list_prepend('', t)) AS prev, unnest(list_append(t, '')) AS next FROM (SELECT {TOKENS.format('text')} AS t FROM documents WHERE text IS NOT NULL)), n AS (SELECT prev, next, count(*) AS n FROM p GROUP BY ALL)"""


def language(spark, sf):
    return L.trained(table(spark, sf, "documents").where("text is not null"), tokens(F.col("text")))


@query(f"""
    WITH {_PAIRS}, t AS (SELECT prev, sum(n) AS total FROM n GROUP BY prev), v AS (SELECT count(DISTINCT next) AS v FROM n),
    q AS (SELECT item_id, unnest(list_prepend('', t)) AS prev, unnest(list_append(t, '')) AS next FROM (SELECT item_id, {TOKENS.format('question')} AS t FROM eval_items WHERE question IS NOT NULL))
    SELECT item_id, round(avg(ln((coalesce(n, 0) + 1) / (coalesce(total, 0) + v))), 9) AS score FROM q LEFT JOIN n USING (prev, next) LEFT JOIN t USING (prev), v GROUP BY item_id""")
def g05_model_stage(spark, sf):
    q = table(spark, sf, "eval_items").where("question is not null")
    return L.scores(q, "item_id", tokens(F.col("question")), language(spark, sf)).select("item_id", F.round("score", 9).alias("score"))


def first_words(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", F.get(tokens(F.col("question")), F.lit(0)).alias("w")).where("w is not null")


@query(f"""
    WITH RECURSIVE {_PAIRS}, s AS (SELECT prev, next FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS k FROM n) WHERE k = 1),
    f AS (SELECT item_id, {TOKENS.format('question')}[1] AS last, []::VARCHAR[] AS words, 0 AS i FROM eval_items WHERE len({TOKENS.format('question')}) > 0
      UNION ALL SELECT item_id, next, CASE WHEN next = '' THEN words ELSE list_append(words, next) END, i + 1 FROM f JOIN s ON prev = last WHERE i < 6 AND (i = 0 OR last <> ''))
    SELECT item_id, arg_max(words, i) AS words FROM f GROUP BY item_id""")
def g06_greedy_decode(spark, sf):
    return L.decoded(first_words(spark, sf), "item_id", "w", language(spark, sf), 6).select("item_id", "words")


@query()
def g06_beam_decode(spark, sf):
    """Three best continuations of five words; tested against all continuations of a small model."""
    return L.decoded(first_words(spark, sf), "item_id", "w", language(spark, sf), 5, beams=3).select("item_id", "beam", "words", F.round("score", 6).alias("score"))


@query()
def g06_group_beam_decode(spark, sf):
    """Two groups of two beams, three words, the second group kept from the first's words; tested against a plain search."""
    return L.decoded_in_groups(first_words(spark, sf), "item_id", "w", language(spark, sf), 3, 2, 2, 1.5).select("item_id", "group", "beam", "words", F.round("score", 6).alias("score"))


@query()
def g06_sampled_decode(spark, sf):
    """Drawn by the model's probabilities; tested by how often words are drawn."""
    return L.decoded(first_words(spark, sf), "item_id", "w", language(spark, sf), 5, temperature=0.8).select("item_id", "words", F.round("score", 6).alias("score"))


@query("SELECT a.vec_id, round(list_dot_product(a.e, b.e), 4)::DOUBLE AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS e FROM embeddings) b USING (vec_id)")
def g08_pair_similarity(spark, sf):
    from ..functions.arrays import dot

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return e.join(b, "vec_id").select("vec_id", F.round(dot(F.col("e"), F.col("f")), 4).alias("score"))


@query("SELECT vec_id, list_filter(range(len(embedding)), lambda i: 1 / (1 + exp(-embedding[i + 1]::DOUBLE)) > 0.55)::INTEGER[] AS labels FROM embeddings")
def g10_zero_shot(spark, sf):
    from ..functions.arrays import indices_over

    p = F.transform("embedding", lambda v: 1 / (1 + F.exp(-v.cast("double"))))
    return table(spark, sf, "embeddings").select("vec_id", indices_over(p, F.lit(0.55)).alias("labels"))


@query("SELECT vec_id, round(ln(list_avg(list_transform(embedding[1:4], lambda x: exp(x::DOUBLE)))), 9) AS mean_word, round(list_max(embedding[5:8])::DOUBLE, 6) AS max_word FROM embeddings")
def g11_verbalizer(spark, sf):
    first, second = F.slice("embedding", 1, 4), F.slice("embedding", 5, 4)
    mean = F.ln(F.aggregate(F.transform(first, lambda x: F.exp(x.cast("double"))), F.lit(0.0), lambda a, b: a + b) / 4)
    return table(spark, sf, "embeddings").select("vec_id", F.round(mean, 9).alias("mean_word"), F.round(F.array_max(second).cast("double"), 6).alias("max_word"))


@query("SELECT item_id, 'Q: ' || question || ' A:' || ' [MASK]' AS prompt FROM eval_items")
def g12_prompt_template(spark, sf):
    from ..plans.templates import render

    return table(spark, sf, "eval_items").select("item_id", render('Q: {"text": "question"} A: {"mask": true}').alias("prompt"))


