"""Scalar functions: strings, tool calls, dates, arrays, maps, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tools
from ..functions.predicates import tokens
from ..registry import query, table
from .selection import CALLS, TOKENS, calls

Q = "'"
DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def docs(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text")


def texts(name: str, f, sql: str | None, columns: str = "value") -> None:
    """A query of one expression over the documents' texts."""

    def run(spark, sf):
        return docs(spark, sf).select("doc_id", f(F.col("text")).alias(columns))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS {columns} FROM {DOCS}" if sql else None)(run)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""
    WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM {DOCS}), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c, run) AS n, row_number() OVER (PARTITION BY doc_id, c, run ORDER BY i) AS k FROM r)
    SELECT doc_id, coalesce((SELECT string_agg(c, '' ORDER BY i) FROM n WHERE n.doc_id = d.doc_id AND (n <= 100 OR k = 1 OR c = chr(10))), '') AS value FROM {DOCS} d""")
def x01_collapse_runs(spark, sf):
    return docs(spark, sf).select("doc_id", X.collapse_runs(F.col("text")).alias("value"))


texts("x02_newline_sentences", lambda t: F.split(t, "\n"), "string_split(text, chr(10))")
texts("x03_chinese_sentences", X.chinese_sentences, r"""string_split(rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([。！？?])([^”’])', '\1' || chr(10) || '\2', 'g'),
      '(\.{6})([^”’])', '\1' || chr(10) || '\2', 'g'), '(…{2})([^”’])', '\1' || chr(10) || '\2', 'g'), '([。！？?][”’])([^，。！？?])', '\1' || chr(10) || '\2', 'g'), ' '), chr(10))""")
texts("x04_chunks", lambda t: X.chunks(t, 100), "[substr(text, i * 100 + 1, 100) for i in range(greatest((length(text) + 99) // 100, 1))]")
texts("x05_half_width", X.half_width, f"translate(text, {quoted(X.FULL)}, {quoted(X.HALF)})")
texts("x06_model_output", X.model_output, "replace(replace(string_split(text, '<unk>')[1], chr(10), ' '), '</s>', ' ')")
ANSWER = r"array_to_string(list_filter(regexp_split_to_array(translate(lower({0}), " + quoted(X.ASCII_PUNCTUATION + X.CJK_PUNCTUATION) + r", ''), '[ \t\n\r\f]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def answer_sql(col: str) -> str:
    return ANSWER.replace("{0}", col)


texts("x07_answer_form", X.answer_form, answer_sql("text"))
texts("x08_char_form", X.char_form, r"translate(regexp_replace(text, '[ \t\n\r\f]+', '', 'g'), '，。！？：；（）', ',.!?:;()')")
_FORMS = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in X.nfkc_forms().items())


@query(f"""
    WITH f(a, b) AS (VALUES {_FORMS}), c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM {DOCS}), n AS (SELECT doc_id, string_agg(coalesce(b, c), '' ORDER BY i) AS value FROM c LEFT JOIN f ON a = c GROUP BY doc_id)
    SELECT doc_id, coalesce(value, '') AS value FROM {DOCS} LEFT JOIN n USING (doc_id)""")
def x14_nfkc_forms(spark, sf):
    return docs(spark, sf).select("doc_id", X.nfkc_selected(F.col("text")).alias("value"))


_MARKS = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in X.unaccented().items())


@query(f"""
    WITH f(a, b) AS (VALUES {_MARKS}), c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM {DOCS}), u AS (SELECT *, unicode(c) - 44032 AS u FROM c),
    j AS (SELECT doc_id, i, CASE WHEN u BETWEEN 0 AND 11171 THEN chr((4352 + u // 588)::INTEGER) || chr((4449 + u % 588 // 28)::INTEGER) || CASE WHEN u % 28 > 0 THEN chr((4519 + u % 28)::INTEGER) ELSE '' END ELSE c END AS c FROM u), n AS (SELECT doc_id, string_agg(coalesce(b, c), '' ORDER BY i) AS value FROM j LEFT JOIN f ON a = c GROUP BY doc_id)
    SELECT doc_id, coalesce(value, '') AS value FROM {DOCS} LEFT JOIN n USING (doc_id)""")
def x15_strip_accents(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_accents(F.col("text")).alias("value"))


texts("x16_clean", X.clean, r"regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]', '', 'g'), '[\t\n\r]', ' ', 'g')")
texts("x17_split_punctuation", X.split_punctuation, r"regexp_extract_all(text, '[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~]+')")
texts("x18_space_han", X.space_han, r"regexp_replace(text, '([一-鿿])', ' \1 ', 'g')")
texts("x19_space_special", lambda t: F.regexp_replace(t, "([Ͱ-ϿЀ-ӿぁ-ヿ])", " $1 "), r"regexp_replace(text, '([Ͱ-ϿЀ-ӿぁ-ヿ])', ' \1 ', 'g')")
texts("x20_whitespace_tokens", tokens, TOKENS.format("text"))
texts("x24_no_split_tokens", lambda t: F.regexp_extract_all(t, F.lit(r"\[ [A-Za-z]+\(|->|\]|[^\[\]>-]+|."), F.lit(0)), r"regexp_extract_all(text, '\[ [A-Za-z]+\(|->|\]|[^\[\]>-]+|.')")
texts("x28_missing_period", X.with_period, r"""CASE WHEN text = '' OR starts_with(text, '@highlight') OR regexp_matches(text, '[.!?…''`")’”]$') THEN text ELSE text || ' .' END""")
texts("x30_label_clean_up", lambda t: F.replace(t, F.lit("contradictory"), F.lit("contradiction")), "replace(text, 'contradictory', 'contradiction')")
texts("x32_decoded_clean_up", X.decoded_clean_up, "replace(" * len(X.CLEAN_UP) + "text" + "".join(f", {quoted(a)}, {quoted(b)})" for a, b in X.CLEAN_UP))
texts("x36_search_stub", lambda t: t, "text")
texts("x37_prompt", lambda t: F.concat(F.lit("Insert tool calls.\nInput: "), t, F.lit("\nOutput: ")), "'Insert tool calls.' || chr(10) || 'Input: ' || text || chr(10) || 'Output: '")
texts("x48_hashes", lambda t: F.concat(F.sha1(t), F.md5(t)), "sha1(text) || md5(text)")
texts("x49_utf8_length", lambda t: F.octet_length(t).cast("bigint"), "strlen(text)")


@query()
def x09_edit_distance(spark, sf):
    """In characters of any script, which DuckDB counts in bytes; tested against the plain table of distances."""
    it = table(spark, sf, "eval_items").select("item_id", "question")
    return it.withColumn("other", F.col("item_id") + 3).join(it.toDF("other", "q2"), "other").select("item_id", F.levenshtein(F.lower("question"), F.lower("q2")).alias("distance"), "other")


@query("""
    SELECT c.item_id, (SELECT coalesce(max(i), 0) FROM unnest(range(1, least(length(c.question), length(d.question)) + 1)) t(i) WHERE substr(c.question, 1, i) = substr(d.question, 1, i))::INTEGER AS n
    FROM eval_items c JOIN eval_items d ON d.item_id = c.item_id + 3""")
def x12_common_prefix(spark, sf):
    it = table(spark, sf, "eval_items").select("item_id", "question")
    return it.withColumn("other", F.col("item_id") + 3).join(it.toDF("other", "q2"), "other").select("item_id", X.common_prefix(F.col("question"), F.col("q2")).alias("n"))


@query("SELECT item_id, 'pick [' || array_to_string(list_sort(list_distinct([bench, lang, 'en'])), ',') || ']' AS prompt FROM eval_items")
def x31_option_prompt(spark, sf):
    raw = F.concat(F.lit("pick ["), "bench", F.lit(","), "lang", F.lit(",en]"))
    return table(spark, sf, "eval_items").select("item_id", X.option_prompt(raw).alias("prompt"))


# the calls in the tables are of two whole numbers; what other expressions give is tested apart
@query(r"""
    WITH r AS (SELECT DISTINCT row_id, text FROM subset_rows WHERE contains(text, '[ Calculator(')), c AS (SELECT row_id, text, regexp_extract(text, 'Calculator\((.*)\)', 1) AS e FROM r),
    p AS (SELECT row_id, text, regexp_extract(e, '^\s*([0-9]+)\s*([-+*/])\s*([0-9]+)\s*$', ['a', 'op', 'b']) AS m FROM c),
    v AS (SELECT row_id, text, CASE m.op WHEN '+' THEN (TRY_CAST(m.a AS BIGINT) + TRY_CAST(m.b AS BIGINT))::VARCHAR WHEN '-' THEN (TRY_CAST(m.a AS BIGINT) - TRY_CAST(m.b AS BIGINT))::VARCHAR
          WHEN '*' THEN (TRY_CAST(m.a AS BIGINT) * TRY_CAST(m.b AS BIGINT))::VARCHAR WHEN '/' THEN (TRY_CAST(m.a AS DOUBLE) / nullif(TRY_CAST(m.b AS DOUBLE), 0))::VARCHAR END AS v FROM p)
    SELECT row_id, CASE WHEN v IS NULL THEN text ELSE left(text, instr(text, ']') - 1) || ' -> ' || v || ' ]' || substr(text, instr(text, ']') + 1) END AS answered FROM v""")
def x33_calculator(spark, sf):
    rows = table(spark, sf, "subset_rows").select("row_id", "text").distinct().where("contains(text, '[ Calculator(')")
    return rows.select("row_id", tools.calculator(F.col("text")).alias("answered"))


_HOLIDAY = """CASE WHEN month(d) = 1 AND day(d) = 1 THEN 'New Year''s Day' WHEN month(d) = 1 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day' WHEN month(d) = 2 AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21 THEN 'Washington''s Birthday'
      WHEN month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25 THEN 'Memorial Day' WHEN month(d) = 6 AND day(d) = 19 THEN 'Juneteenth National Independence Day' WHEN month(d) = 7 AND day(d) = 4 THEN 'Independence Day' WHEN month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7 THEN 'Labor Day'
      WHEN month(d) = 10 AND isodow(d) = 1 AND day(d) BETWEEN 8 AND 14 THEN 'Columbus Day' WHEN month(d) = 11 AND day(d) = 11 THEN 'Veterans Day' WHEN month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving' WHEN month(d) = 12 AND day(d) = 25 THEN 'Christmas Day' END"""


@query(f"""
    WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, strftime(o_orderdate, '%Y-%-m-%-d') AS s, o_orderkey % 3 AS k FROM orders), h AS (SELECT *, s || ' is ' || dayname(d) || coalesce(', ' || {_HOLIDAY} || ' of ' || year(d), '') AS one FROM o),
    e AS (SELECT *, CASE WHEN k = 1 THEN DATE '2024-06-01' WHEN k = 2 THEN make_date(year(d), 12, 25) END AS e, CASE WHEN k = 1 THEN 'today' WHEN k = 2 THEN 'christmas' END AS t FROM h)
    SELECT o_orderkey, '[ Calendar(' || s || coalesce(',' || t, '') || ') ' || '-> ' || one || CASE WHEN t IS NULL THEN ' ]' ELSE '. ' || t || ' is ' || strftime(e, '%Y-%m-%d') || ', ' || dayname(e) || '. ' ||
      CASE WHEN e > d THEN 'The days from ' || s || ' until ' || t || ' is ' || date_diff('day', d, e) || ' days. ' WHEN e < d THEN 'The days from ' || t || ' until ' || s || ' is ' || date_diff('day', e, d) || ' days. ' ELSE s || ' is ' || t || '. ' END || ' ]' END AS answered FROM e""")
def x34_calendar(spark, sf):
    """Calls of one date, of a date and today, of a date and a holiday of its year."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-M-d").alias("s"))
    second = F.when(F.col("o_orderkey") % 3 == 1, ",today").when(F.col("o_orderkey") % 3 == 2, ",christmas").otherwise("")
    call = F.concat(F.lit("[ Calendar("), "s", second, F.lit(") ]"))
    return o.select("o_orderkey", tools.calendar(call, F.to_date(F.lit("2024-06-01"))).alias("answered"))


@query(f"SELECT DISTINCT cand_id, '[ ' || string_split(call_text, ']')[1] || ']' AS call FROM {CALLS} WHERE call_text IS NOT NULL")
def x38_call_bracket(spark, sf):
    return calls(spark, sf).where("call_text is not null").select("cand_id", X.call_bracket(F.col("call_text")).alias("call")).distinct()


@query("SELECT o_orderkey, dayname(o_orderdate) AS weekday, monthname(o_orderdate) AS month, day(o_orderdate)::INTEGER AS day, year(o_orderdate)::INTEGER AS year FROM orders")
def x39_date_names(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(d, "EEEE").alias("weekday"), F.date_format(d, "MMMM").alias("month"), F.day(d).alias("day"), F.year(d).alias("year"))


@query("SELECT o_orderkey, (o_orderdate::DATE + 45)::DATE AS later, abs(date_diff('day', DATE '1995-06-17', o_orderdate::DATE))::INTEGER AS apart FROM orders")
def x40_date_arithmetic(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.date_add(d, 45).alias("later"), F.abs(F.datediff(d, F.to_date(F.lit("1995-06-17")))).alias("apart"))


@query("""
    WITH y AS (SELECT unnest(range(1990, 2031))::INTEGER AS y),
    r(name, m, dom, wd, nth) AS (VALUES ('New Year''s Day',1,1,NULL,NULL),('Martin Luther King Jr. Day',1,NULL,1,3),('Washington''s Birthday',2,NULL,1,3),('Memorial Day',5,NULL,1,-1),('Juneteenth National Independence Day',6,19,NULL,NULL),
      ('Independence Day',7,4,NULL,NULL),('Labor Day',9,NULL,1,1),('Columbus Day',10,NULL,1,2),('Veterans Day',11,11,NULL,NULL),('Thanksgiving',11,NULL,4,4),('Christmas Day',12,25,NULL,NULL)),
    d AS (SELECT name, nth, dom, unnest(range(make_date(y, m, 1)::TIMESTAMP, make_date(y, m, 1) + INTERVAL 1 MONTH, INTERVAL 1 DAY))::DATE AS day, wd, y FROM y, r),
    k AS (SELECT name, y, day, row_number() OVER (PARTITION BY name, y ORDER BY day) AS f, row_number() OVER (PARTITION BY name, y ORDER BY day DESC) AS b, nth FROM d WHERE (dom IS NOT NULL AND day(day) = dom) OR (dom IS NULL AND isodow(day) = wd))
    SELECT name, day FROM k WHERE nth IS NULL OR f = nth OR (nth = -1 AND b = 1)""")
def x41_holidays(spark, sf):
    return tools.holidays(spark, 1990, 2030)


@query("""
    SELECT vec_id, round(list_dot_product(e, e), 4)::DOUBLE AS dot, round(list_cosine_similarity(e, list_reverse(e)), 6)::DOUBLE AS cosine, round(list_distance(e, list_reverse(e)), 4)::DOUBLE AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def x43_vectors(spark, sf):
    from ..functions.arrays import cosine, dot, euclidean

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = F.col("e"), F.reverse("e")
    return e.select("vec_id", F.round(dot(a, a), 4).alias("dot"), F.round(cosine(a, b), 6).alias("cosine"), F.round(euclidean(a, b), 4).alias("distance"))


@query("""
    WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, max(x) AS m FROM t GROUP BY vec_id)
    SELECT vec_id, round(1 / sum(exp(x - m)), 9) AS largest FROM t JOIN m USING (vec_id) GROUP BY vec_id""")
def x42_softmax(spark, sf):
    from ..functions.arrays import softmax

    return table(spark, sf, "embeddings").select("vec_id", F.round(F.array_max(softmax(F.col("embedding").cast("array<double>"))), 9).alias("largest"))


@query("SELECT vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.1)::INTEGER[] AS at FROM embeddings")
def x44_threshold_indices(spark, sf):
    from ..functions.arrays import indices_over

    return table(spark, sf, "embeddings").select("vec_id", indices_over(F.col("embedding"), F.lit(0.1).cast("float")).alias("at"))


@query("SELECT vec_id, round(list_sum([CASE WHEN x < 0 THEN x * 1.2 ELSE x / 1.2 END / 0.7 for x in embedding::DOUBLE[]]), 4) AS total FROM embeddings")
def x45_penalty_temperature(spark, sf):
    from ..functions.arrays import penalised

    x = penalised(F.col("embedding").cast("array<double>"), 1.2, 0.7)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("""
    SELECT record_id, g[1]::INTEGER AS token, list_sort(list_distinct(list(g[2])))::INTEGER[] AS banned FROM (SELECT record_id, unnest([[input_ids[i], input_ids[i + 1]] for i in range(1, len(input_ids))]) AS g FROM (SELECT DISTINCT record_id, input_ids FROM pack_records WHERE len(input_ids) >= 2)) GROUP BY ALL""")
def x45_ngram_ban(spark, sf):
    return banned_next(table(spark, sf, "pack_records").where("size(input_ids) >= 2"))


def banned_next(recs):
    g = recs.select("record_id", "input_ids").distinct().select("record_id", F.explode(F.arrays_zip(F.expr("slice(input_ids, 1, size(input_ids) - 1)").alias("token"), F.expr("slice(input_ids, 2, size(input_ids) - 1)").alias("next"))).alias("g"))
    return g.groupBy("record_id", F.col("g.token").alias("token")).agg(F.array_sort(F.collect_set("g.next")).alias("banned"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INTEGER AS n FROM events WHERE props IS NOT NULL AND len(json_keys(props)) > 0")
def x47_json(spark, sf):
    keys = F.json_object_keys("props")
    e = table(spark, sf, "events").where("props is not null").withColumn("m", F.from_json("props", "map<string,string>")).where("size(m) > 0")
    return e.select("event_id", F.element_at("m", F.get(keys, 0)).alias("first_value"), F.size("m").alias("n"))


@query("SELECT doc_id, string_split(text, ',') AS parts FROM (SELECT doc_id, text FROM documents WHERE contains(text, ','))")
def x50_nested_split(spark, sf):
    return docs(spark, sf).where("contains(text, ',')").select("doc_id", F.split("text", ",").alias("parts"))


@query("""
    SELECT item_id, [CASE WHEN i = s THEN CASE WHEN n = 1 THEN 'S' ELSE 'B' END WHEN i > s AND i < s + n - 1 THEN 'I' WHEN i = s + n - 1 AND n > 1 THEN 'E' ELSE 'O' END for i in range(length(ctx))] AS tags
    FROM (SELECT item_id, context AS ctx, instr(context, answers[1]) - 1 AS s, length(answers[1]) AS n FROM eval_items WHERE context IS NOT NULL AND contains(context, answers[1]))""")
def x51_span_tags(spark, sf):
    from ..functions.arrays import span_tags

    it = table(spark, sf, "eval_items").where("context is not null and contains(context, answers[0])")
    return it.select("item_id", span_tags(F.length("context"), F.instr("context", F.col("answers")[0]) - 1, F.length(F.col("answers")[0])).alias("tags"))


@query("SELECT item_id, obj_label AS object, instr(replace(question, '[MASK]', obj_label), obj_label)::INTEGER - 1 AS start FROM eval_items WHERE obj_label IS NOT NULL")
def x52_triple_flatten(spark, sf):
    filled = F.replace("question", F.lit("[MASK]"), F.col("obj_label"))
    return table(spark, sf, "eval_items").where("obj_label is not null").select("item_id", F.col("obj_label").alias("object"), (F.instr(filled, F.col("obj_label")) - 1).alias("start"))


@query("""
    SELECT vec_id, CASE WHEN step < 3 THEN -1e9 ELSE round(v, 4) END AS eos_score FROM (SELECT vec_id, (vec_id % 6) AS step, embedding[1]::DOUBLE AS v FROM embeddings)""")
def x53_min_length(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 6 < 3, F.lit(-1e9)).otherwise(F.round(F.col("embedding")[0].cast("double"), 4)).alias("eos_score"))


@query(f"""
    SELECT sample_id, cand_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_id) AS rn FROM (
      SELECT sample_id, cand_id, round(-loss_call / pow((length(call_text) + 5) / 6.0, 0.6), 9) AS score FROM {CALLS} WHERE loss_call::VARCHAR <> 'nan' AND call_text IS NOT NULL)) WHERE rn <= 2""")
def x54_beam_score(spark, sf):
    from ..operators.relational import top_k

    c = calls(spark, sf).where("not isnan(loss_call) and call_text is not null")
    c = c.select("sample_id", "cand_id", F.round(-F.col("loss_call") / F.pow((F.length("call_text") + 5) / F.lit(6.0), F.lit(0.6)), 9).alias("score"))
    return top_k(c, ["sample_id"], [F.desc("score"), "cand_id"], 2)


@query(f"""
    SELECT cand_id, pos - length(call_text) AS offset, round(exp(-loss_call) * exp(-loss_result), 9) AS prob FROM {CALLS} WHERE loss_call::VARCHAR <> 'nan' AND loss_result::VARCHAR <> 'nan' AND call_text IS NOT NULL""")
def x56_prompt_offset(spark, sf):
    c = calls(spark, sf).where("not isnan(loss_call) and not isnan(loss_result) and call_text is not null")
    return c.select("cand_id", (F.col("pos").cast("bigint") - F.length("call_text")).alias("offset"), F.round(F.exp(-F.col("loss_call")) * F.exp(-F.col("loss_result")), 9).alias("prob"))


@query("""
    SELECT split_part(run_id, '_', 1) AS prefix, list_sort(list_distinct(list(string_split(run_id, '_')[-1]))) AS suffixes FROM qa_predictions WHERE run_id IS NOT NULL GROUP BY ALL""")
def x57_prefix_groups(spark, sf):
    r = table(spark, sf, "qa_predictions").where("run_id is not null").select("run_id").distinct()
    return r.groupBy(F.substring_index("run_id", "_", 1).alias("prefix")).agg(F.array_sort(F.collect_set(F.substring_index("run_id", "_", -1))).alias("suffixes"))
