"""Picking text and calls: predicates, insertion points, losses, splices, sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import relational as R
from ..registry import query, table

# SQL pieces of the twins, written from the rules and not from the engine's own patterns
SCRIPT = (
    "[\\x{0600}-\\x{06FF}\\x{0900}-\\x{097F}\\x{4E00}-\\x{9FFF}]|[äöüß]|[ÄÖÜ]|[ñáéíóúü]|[ÁÉÍÓÚÜ]|"
    "[ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ]|[àáâãèéêìíòóôõùúăđĩũơư]"
)
LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
CALLS = "(SELECT DISTINCT * FROM call_candidates)"
TOKENS = r"list_filter(regexp_split_to_array({0}, '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda t: t <> '')"
_DIGITS = "'٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९０１２３４５６７８９', '" + "0123456789" * 4 + "'"
_EDGES = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"
_MONTHS = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[\p{L}\p{N}_]*"
_WHITE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"
_PATTERNS = (
    _EDGES % r"\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}",
    _EDGES % r"\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4}",
    _EDGES % (r"\p{Nd}{1,2} ?" + _MONTHS + r" ?\p{Nd}{2,4}"),
    _EDGES % (_MONTHS + r" \p{Nd}{1,2},? \p{Nd}{4}"),
    rf"\p{{Nd}}{_WHITE}days{_WHITE}ago",
    rf"in{_WHITE}\p{{Nd}}+{_WHITE}days",
)
_NAMES = (
    "tomorrow", "today", "yesterday", "new year''s day", "martin luther king jr. day", "washington''s birthday", "memorial day", "juneteenth national independence day",
    "independence day", "labor day", "columbus day", "veterans day", "thanksgiving", "christmas day",
)
_DATES = "(" + " OR ".join([f"regexp_matches({{0}}, '{d}')" for d in _PATTERNS] + [f"contains(lower({{0}}), '{w}')" for w in _NAMES]) + ")"


def date_hit(col: str) -> str:
    return _DATES.replace("{0}", col)


def lines(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def calls(spark, sf):
    return table(spark, sf, "call_candidates").distinct()


@query(f"""
    SELECT lang, source, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars
    FROM {LINES} WHERE regexp_matches(line, '{SCRIPT}') GROUP BY ALL""")
def subset_translator(spark, sf):
    hit = lines(spark, sf).where(P.other_script(F.col("line")))
    return hit.groupBy("lang", "source").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"SELECT doc_id, count(*) AS n_lines FROM {LINES} GROUP BY doc_id")
def p11_newline_explode(spark, sf):
    return lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INTEGER AS n FROM documents WHERE len({TOKENS.format('text')}) BETWEEN 1 AND 60")
def p12_length_gate(spark, sf):
    n = F.size(P.tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", n.alias("n")).where("n between 1 and 60")


@query(r"""
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^ ]')))::INTEGER AS n_sentences FROM documents
    WHERE len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^ ]'))) > 0""")
def p13_empty_drop(spark, sf):
    kept = F.filter(F.split("text", "\n"), lambda s: s.rlike("[^ ]"))
    return table(spark, sf, "documents").select("doc_id", F.size(kept).alias("n_sentences")).where("n_sentences > 0")


@query(rf"""
    WITH l AS (SELECT doc_id, t.line_no, t.line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d,
               unnest(list_zip(range(len(ls)), ls)) AS u(t0), (SELECT t0[1] AS line_no, t0[2] AS line) AS t),
    n AS (SELECT doc_id, line_no, u.x[1] AS i, u.x[2] AS tok FROM (SELECT *, {TOKENS.format('line')} AS ts FROM l) q, unnest(list_zip(range(len(ts)), ts)) AS u(x)),
    v AS (SELECT doc_id, line_no, i, CASE WHEN right(tok, 1) = '%' THEN rtrim(tok, '%')::DOUBLE / 100 ELSE tok::DOUBLE END AS a
          FROM (SELECT doc_id, line_no, i, translate(tok, {_DIGITS}) AS tok FROM n WHERE regexp_full_match(tok, '[-+]?\p{{Nd}}+(\.\p{{Nd}}+)?%?'))),
    w AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(i, 2) OVER o - i AS span FROM v WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i))
    SELECT DISTINCT doc_id, line_no::INTEGER AS line_no FROM w WHERE span < 100 AND NOT (a < 100 AND b < 100 AND c < 100) AND (
      {" OR ".join(f"{x}+{y}={z} OR {x}-{y}={z} OR {x}*{y}={z} OR (CASE WHEN {y}=0 THEN false ELSE {x}/{y}={z} END)" for x, y, z in ("abc", "acb", "bac", "bca", "cab", "cba"))})""")
def f01_arithmetic(spark, sf):
    return lines(spark, sf).where(P.arithmetic_text(F.col("line"))).select("doc_id", "line_no")


@query(rf"""
    SELECT doc_id FROM documents WHERE len({TOKENS.format('text')}) > 5 AND ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INTEGER < 3276""")
def f02_random_keep(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where((F.size(P.tokens(F.col("text"))) > 5) & P.hash_keep(F.col("doc_id"), 0.05)).select("doc_id")


@query(f"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '{SCRIPT}') GROUP BY lang")
def f03_other_script(spark, sf):
    return table(spark, sf, "documents").where(P.other_script(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) AS n FROM {LINES} WHERE {date_hit('line')} GROUP BY source")
def f04_date_text(spark, sf):
    return lines(spark, sf).where(P.date_text(F.col("line"))).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""
    SELECT tool, count(*) AS n FROM (SELECT CASE WHEN {date_hit('line')} THEN 'calendar' WHEN regexp_matches(line, '{SCRIPT}') THEN 'translator' ELSE 'other' END AS tool FROM {LINES}) GROUP BY tool""")
def f05_tool_router(spark, sf):
    line = F.col("line")
    tool = F.when(P.date_text(line), "calendar").when(P.other_script(line), "translator").otherwise("other")
    return lines(spark, sf).groupBy(tool.alias("tool")).agg(F.count("*").alias("n"))


@query(f"""
    SELECT sample_id, pos, p FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, pos) AS rn FROM (
      SELECT sample_id, pos, max(exp(-loss_orig)) AS p FROM {CALLS} WHERE loss_orig::VARCHAR <> 'nan' AND pos IS NOT NULL GROUP BY ALL)) WHERE rn <= 3 AND p > 0.2""")
def f06_insertion_points(spark, sf):
    at = calls(spark, sf).where("not isnan(loss_orig) and pos is not null").groupBy("sample_id", "pos").agg(F.max(F.exp(-F.col("loss_orig"))).alias("p"))
    return R.top_k(at, ["sample_id"], [F.desc("p"), "pos"], 3).where("p > 0.2")


@query("""
    WITH t AS (SELECT record_id, unnest(list_zip(range(len(input_ids)), input_ids)) AS z FROM (SELECT DISTINCT record_id, input_ids FROM pack_records WHERE len(input_ids) > 0))
    SELECT record_id, CASE WHEN sum(w) > 0 THEN round(-sum(w * ln(1.0 / (1 + z[2]))) / sum(w), 9) ELSE 1000.0 END AS loss
    FROM (SELECT record_id, z, greatest(0, 1 - 0.2 * z[1]) AS w FROM t) GROUP BY record_id""")
def f07_weighted_loss(spark, sf):
    recs = table(spark, sf, "pack_records").where("size(input_ids) > 0").select("record_id", "input_ids").distinct()
    loss = R.weighted_loss(F.transform("input_ids", lambda x: F.lit(1.0) / (1 + x)))
    return recs.select("record_id", F.round(loss, 9).alias("loss"))


@query(f"""
    SELECT sample_id, cand_id, gain FROM (SELECT sample_id, cand_id, round(gain, 9) AS gain, row_number() OVER (PARTITION BY sample_id ORDER BY gain DESC, cand_id) AS rn
      FROM (SELECT *, least(loss_orig, loss_call) - loss_result AS gain FROM {CALLS}
            WHERE loss_orig::VARCHAR <> 'nan' AND loss_call::VARCHAR <> 'nan' AND loss_result::VARCHAR <> 'nan' AND length(result_text) BETWEEN 1 AND 9999) WHERE gain > 0.1) WHERE rn = 1""")
def f08_best_candidate(spark, sf):
    good = calls(spark, sf).where("not isnan(loss_orig) and not isnan(loss_call) and not isnan(loss_result) and length(result_text) between 1 and 9999")
    good = good.withColumn("gain", F.least("loss_orig", "loss_call") - F.col("loss_result")).where("gain > 0.1")
    return R.top_k(good, ["sample_id"], [F.desc("gain"), "cand_id"], 1).select("sample_id", "cand_id", F.round("gain", 9).alias("gain"))


@query(f"""
    WITH s AS (SELECT DISTINCT row_id, text FROM subset_rows WHERE text IS NOT NULL)
    SELECT cand_id, substr(text, 1, pos) || call_text || substr(text, pos + 1) AS spliced FROM {CALLS} c JOIN s ON row_id = sample_id WHERE pos BETWEEN 0 AND length(text)""")
def f09_call_splice(spark, sf):
    rows = table(spark, sf, "subset_rows").where("text is not null").select(F.col("row_id").alias("sample_id"), "text").distinct()
    both = calls(spark, sf).join(rows, "sample_id").where("pos between 0 and length(text)")
    return both.select("cand_id", F.concat(F.substring("text", F.lit(1), F.col("pos")), "call_text", F.substring("text", F.col("pos") + 1, F.length("text"))).alias("spliced"))


@query("""
    SELECT shard, count(*) AS n FROM (SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 100000)::BIGINT AS shard FROM documents WHERE text IS NOT NULL) WHERE shard < 10 GROUP BY shard""")
def s03_rotating_shards(spark, sf):
    return shard_sizes(table(spark, sf, "documents"), 100_000)


def shard_sizes(docs, size):
    return R.numbered(docs.where("text is not null"), ["doc_id"]).withColumn("shard", F.floor(F.col("idx") / size)).where("shard < 10").groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(text, 1, 40) AS head FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[A-Z]')")
def p01_map_filter(spark, sf):
    return table(spark, sf, "documents").where("text is not null").where(F.col("text").rlike("^[A-Z]")).select("doc_id", F.substring("text", 1, 40).alias("head"))


@query("SELECT doc_id FROM documents ORDER BY doc_id OFFSET 7")
def p06_skip(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").offset(7)


@query("""
    WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents)
    SELECT doc_id, (i % 3)::BIGINT AS modulo_shard, (CASE WHEN i < (c % 4) * (c // 4 + 1) THEN i // (c // 4 + 1) ELSE (c % 4) + (i - (c % 4) * (c // 4 + 1)) // greatest(c // 4, 1) END)::BIGINT AS contiguous_shard FROM n""")
def p07_shard(spark, sf):
    return R.sharded(table(spark, sf, "documents"), ["doc_id"], 3, 4).select("doc_id", "modulo_shard", "contiguous_shard")


@query("SELECT doc_id, kind, (list_position(['prose','list','table','junk'], kind) - 1)::BIGINT AS label FROM doc_labels")
def p16_label_ids(spark, sf):
    return table(spark, sf, "doc_labels").select("doc_id", "kind", (F.array_position(F.array(*map(F.lit, ("prose", "list", "table", "junk"))), F.col("kind")) - 1).alias("label"))


@query("""
    WITH f AS (SELECT kind, min(doc_id) AS first FROM doc_labels WHERE kind IS NOT NULL GROUP BY kind)
    SELECT doc_id, kind, label FROM (SELECT DISTINCT doc_id, kind FROM doc_labels WHERE kind IS NOT NULL) JOIN (SELECT kind, row_number() OVER (ORDER BY first, kind) - 1 AS label FROM f) USING (kind)""")
def p20_label_inference(spark, sf):
    rows = table(spark, sf, "doc_labels").where("kind is not null").select("doc_id", "kind").distinct()
    return R.with_inferred_labels(rows, "kind", "doc_id", "label").select("doc_id", "kind", "label")


@query("SELECT item_id, answers[1] AS answer FROM eval_items WHERE len(answers) = 1")
def p15_single_answer(spark, sf):
    return table(spark, sf, "eval_items").where(F.size("answers") == 1).select("item_id", F.get("answers", 0).alias("answer"))


@query("""
    SELECT item_id, CASE WHEN contains(question, obj_label) THEN length(obj_label) ELSE 0 END::INTEGER AS n_tagged FROM eval_items WHERE answers IS NOT NULL AND contains(coalesce(context, question), answers[1])""")
def p14_dirty_rows(spark, sf):
    it = table(spark, sf, "eval_items").where(F.expr("answers is not null and contains(coalesce(context, question), answers[0])"))
    return it.select("item_id", F.expr("case when contains(question, obj_label) then length(obj_label) else 0 end").alias("n_tagged"))


@query("SELECT item_id, (list_position(list_sort(['a','b',bench,lang]), lang) - 1)::VARCHAR AS choice FROM eval_items")
def p17_choice_index(spark, sf):
    choices = F.array_sort(F.array(F.lit("a"), F.lit("b"), "bench", "lang"))
    return table(spark, sf, "eval_items").select("item_id", (F.array_position(choices, F.col("lang")) - 1).cast("string").alias("choice"))


@query(f"""
    WITH p AS (SELECT sample_id, min_by(call_text, cand_id) AS a, max_by(call_text, cand_id) AS b, min_by(loss_result, cand_id) AS x, max_by(loss_result, cand_id) AS y, count(*) AS n
               FROM {CALLS} WHERE loss_result::VARCHAR <> 'nan' AND call_text IS NOT NULL GROUP BY sample_id)
    SELECT sample_id, CASE WHEN x < y THEN a ELSE b END AS chosen, CASE WHEN x < y THEN b ELSE a END AS rejected FROM p WHERE n >= 2 AND x <> y""")
def p18_preference_split(spark, sf):
    good = calls(spark, sf).where("not isnan(loss_result) and call_text is not null").groupBy("sample_id").agg(
        F.min_by("call_text", "cand_id").alias("a"), F.max_by("call_text", "cand_id").alias("b"), F.min_by("loss_result", "cand_id").alias("x"), F.max_by("loss_result", "cand_id").alias("y"), F.count("*").alias("n")
    )
    first = F.col("x") < F.col("y")
    return good.where("n >= 2 and x <> y").select("sample_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"))


@query(f"""
    WITH p AS (SELECT sample_id, list(loss_result ORDER BY cand_id) AS sort, list(call_text ORDER BY cand_id) AS response FROM {CALLS} WHERE cand_id IS NOT NULL GROUP BY sample_id)
    SELECT sample_id, len(response) = 2 AND len(list_filter(response, lambda r: r IS NOT NULL AND r <> '')) = 2 AND len(list_distinct(sort)) = 2 AS valid FROM p""")
def p19_preference_check(spark, sf):
    rows = calls(spark, sf).where("cand_id is not null").groupBy("sample_id").agg(R.ordered_list("cand_id", "loss_result", "call_text").alias("r"))
    good = (F.size("r") == 2) & (F.size(F.filter("r", lambda x: x["call_text"].isNotNull() & (x["call_text"] != ""))) == 2) & (F.size(F.array_distinct("r.loss_result")) == 2)
    return rows.select("sample_id", good.alias("valid"))
