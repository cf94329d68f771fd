"""Windows, folds, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import ngrams
from ..functions.predicates import tokens
from ..operators import ordered as O
from ..operators import relational as R
from ..registry import query, table
from .selection import CALLS, TOKENS, calls

RECORDS = "(SELECT DISTINCT record_id, tool, input_ids, labels FROM pack_records WHERE len(input_ids) > 0)"


def records(spark, sf):
    return table(spark, sf, "pack_records").where("size(input_ids) > 0").select("record_id", "tool", "input_ids", "labels").distinct()


@query(f"SELECT record_id, (coalesce(sum(len(input_ids)) OVER (ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4)::BIGINT AS pointer FROM {RECORDS}")
def w01_prefix_pointers(spark, sf):
    r = records(spark, sf).select("record_id", F.size("input_ids").alias("n"))
    return R.running(r, ["record_id"], "n", "before").select("record_id", (F.col("before") * 4).cast("bigint").alias("pointer"))


@query(f"""
    WITH t AS (SELECT tok, row_number() OVER (ORDER BY record_id, i) - 1 AS p FROM (SELECT record_id, unnest(input_ids) AS tok, generate_subscripts(input_ids, 1) AS i FROM {RECORDS})), n AS (SELECT count(*) AS n FROM t)
    SELECT s AS sample, list(tok ORDER BY p) AS tokens FROM (SELECT p // 64 AS s, tok, p FROM t UNION ALL SELECT p // 64 - 1, tok, p FROM t WHERE p % 64 = 0 AND p > 0) WHERE s < ((SELECT n FROM n) - 1) // 64 GROUP BY s""")
def w02_fixed_samples(spark, sf):
    return O.fixed_samples(records(spark, sf), ["record_id"], "input_ids", 64)


@query(f"SELECT tool, ceil((1000 * 128 + 1) / sum(len(input_ids)))::BIGINT AS epochs FROM {RECORDS} GROUP BY tool")
def w03_epochs(spark, sf):
    return records(spark, sf).groupBy("tool").agg(F.ceil(F.lit(1000 * 128 + 1) / F.sum(F.size("input_ids"))).alias("epochs"))


@query(f"""
    SELECT tool, (n - (e - 1) * per) < 0.8 * per AS separate FROM (SELECT tool, 1000 AS n, ceil((1000 * 128 + 1) / sum(len(input_ids)))::BIGINT AS e, (sum(len(input_ids)) - 1)::BIGINT // 128 AS per FROM {RECORDS} GROUP BY tool)""")
def w04_last_epoch(spark, sf):
    t = F.sum(F.size("input_ids"))
    r = records(spark, sf).groupBy("tool").agg(F.ceil(F.lit(1000 * 128 + 1) / t).alias("e"), F.floor((t - 1) / 128).alias("per"))
    return r.select("tool", ((1000 - (F.col("e") - 1) * F.col("per")) < 0.8 * F.col("per")).alias("separate"))


@query(f"SELECT record_id, epoch::INTEGER AS epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(epoch::VARCHAR || '-' || record_id::VARCHAR)) - 1 AS at FROM {RECORDS}, range(0, 2) e(epoch)")
def w05_document_index(spark, sf):
    r = records(spark, sf).select("record_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("epoch"))
    r = r.withColumn("mark", F.md5(F.concat_ws("-", F.col("epoch").cast("string"), F.col("record_id").cast("string"))))
    n = R.numbered(r, ["epoch", "mark"])
    first = n.groupBy("epoch").agg(F.min("idx").alias("first"))  # a row an epoch
    return n.join(F.broadcast(first), "epoch").select("record_id", "epoch", (F.col("idx") - F.col("first")).cast("bigint").alias("at"))


@query("SELECT doc_id, CASE WHEN i < 100 THEN 0 ELSE 100 END + row_number() OVER (PARTITION BY i >= 100 ORDER BY md5(doc_id::VARCHAR)) - 1 AS at FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def w06_shuffle_index(spark, sf):
    n = R.numbered(table(spark, sf, "documents").select("doc_id"), ["doc_id"]).withColumn("late", F.col("idx") >= 100).withColumn("mark", F.md5(F.col("doc_id").cast("string")))
    return R.numbered(n.drop("idx"), ["late", "mark"]).select("doc_id", F.col("idx").cast("bigint").alias("at"))


@query("""
    WITH n AS (SELECT count(*) AS n FROM documents), c AS (SELECT round_even(n * 949.0 / 1000, 0) AS a, round_even(n * 949.0 / 1000, 0) + round_even(n * 50.0 / 1000, 0) AS b, round_even(n * 949.0 / 1000, 0) + round_even(n * 50.0 / 1000, 0) + round_even(n * 1.0 / 1000, 0) AS e, n FROM n),
    i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT doc_id, CASE WHEN i < a - (e - n) THEN 'train' WHEN i < b - (e - n) THEN 'valid' ELSE 'test' END AS split FROM i, c""")
def w07_split_by_position(spark, sf):
    return O.split_by_position(table(spark, sf, "documents").select("doc_id"), ["doc_id"], "949,50,1").select("doc_id", "split")


@query("SELECT source, ceil(10000 * weight / sum(weight) OVER () * 1.005)::BIGINT AS n FROM mix_targets")
def w09_blend_sizes(spark, sf):
    return table(spark, sf, "mix_targets").select("source", F.ceil(10000 * F.col("weight") / F.sum("weight").over(W.partitionBy()) * 1.005).alias("n"))


@query("""
    SELECT doc_id, source, round((k + 0.5) / weight, 9)::DOUBLE AS blend_order FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) JOIN mix_targets USING (source)""")
def w10_blend(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").where("source is not null")
    return O.blend(d, "source", ["doc_id"], table(spark, sf, "mix_targets").select("source", "weight")).select("doc_id", "source", F.round("blend_order", 9).alias("blend_order"))


@query(f"SELECT item_id, [array_to_string(t[i:i + 2], ' ') for i in range(1, len(t) - 1)] AS grams FROM (SELECT item_id, {TOKENS.format('question')} AS t FROM eval_items)")
def w11_ngrams(spark, sf):
    return table(spark, sf, "eval_items").select("item_id", F.transform(ngrams(tokens(F.col("question")), 3), lambda g: F.array_join(g, " ")).alias("grams"))


@query(f"SELECT cand_id, rank() OVER (PARTITION BY tool ORDER BY loss_result DESC) AS rank FROM {CALLS} WHERE loss_result::VARCHAR <> 'nan'")
def w13_rank(spark, sf):
    c = calls(spark, sf).where("not isnan(loss_result)").select("cand_id", "tool", "loss_result")
    return R.ranked(c, "tool", "loss_result", "rank", down=True).select("cand_id", F.col("rank").cast("bigint").alias("rank"))


LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)"


def numbered_lines(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(f"""
    SELECT doc_id, block::BIGINT AS block, list(line ORDER BY n) AS lines FROM (SELECT *, sum((line = '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM {LINES}) WHERE line <> '' GROUP BY ALL""")
def w14_blocks(spark, sf):
    b = O.blocks(numbered_lines(spark, sf), ["doc_id"], "n", F.col("line") == "", "block").where("line <> ''")
    return b.groupBy("doc_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))


TAGS = f"(SELECT record_id, unnest([x % 3 for x in input_ids]) AS tag, generate_subscripts(input_ids, 1) - 1 AS pos FROM {RECORDS})"


def tags(spark, sf):
    return records(spark, sf).select("record_id", F.posexplode(F.transform("input_ids", lambda x: x % 3)).alias("pos", "tag"))


@query(f"""
    WITH b AS (SELECT *, sum((tag = 2 OR (tag = 1 AND coalesce(prev, 0) = 0))::INTEGER) OVER (PARTITION BY record_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM (SELECT *, lag(tag) OVER (PARTITION BY record_id ORDER BY pos) AS prev FROM {TAGS}))
    SELECT record_id, min(pos)::INTEGER AS first, max(pos)::INTEGER AS last FROM b WHERE tag > 0 GROUP BY record_id, span""")
def w15_tags_to_spans(spark, sf):
    return spans(tags(spark, sf))


def spans(t):
    t = t.withColumn("prev", F.lag("tag").over(W.partitionBy("record_id").orderBy("pos")))
    t = O.blocks(t, ["record_id"], "pos", (F.col("tag") == 2) | ((F.col("tag") == 1) & (F.coalesce("prev", F.lit(0)) == 0)), "span").where("tag > 0")
    return t.groupBy("record_id", "span").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("span")


@query(f"""
    WITH s AS (SELECT record_id, pos FROM {TAGS} WHERE tag = 2), e AS (SELECT record_id, pos FROM {TAGS} WHERE tag = 1), m AS (SELECT s.record_id, s.pos AS s, e.pos AS e FROM s ASOF JOIN e ON s.record_id = e.record_id AND s.pos <= e.pos)
    SELECT record_id, max(s)::INTEGER AS start, e::INTEGER AS stop FROM m GROUP BY record_id, e""")
def w16_pointer_match(spark, sf):
    t = tags(spark, sf)
    return O.pointer_spans(t, ["record_id"], "pos", F.col("tag") == 2, F.col("tag") == 1)


@query()
def w17_viterbi(spark, sf):
    scores = F.transform("input_ids", lambda x: F.array((x % 5).cast("double"), (x % 7).cast("double"), (x % 3).cast("double")))
    return records(spark, sf).select("record_id", O.viterbi(scores).alias("tags"))


@query(f"SELECT sample_id, pos, arg_max(cand_id, (length(call_text), -cand_id)) AS cand_id FROM {CALLS} WHERE call_text IS NOT NULL GROUP BY ALL")
def w18_max_context(spark, sf):
    c = calls(spark, sf).where("call_text is not null")
    return c.groupBy("sample_id", "pos").agg(F.max_by("cand_id", F.struct(F.length("call_text"), -F.col("cand_id"))).alias("cand_id"))


@query(f"""
    SELECT doc_id, grp::BIGINT AS grp, count(*) AS n, max(n)::INTEGER AS last FROM (SELECT *, sum((NOT coalesce(starts_with(left(line, 2), left(prev, 2)), false))::INTEGER) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS grp
      FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM {LINES})) GROUP BY doc_id, grp""")
def w19_partial_transcripts(spark, sf):
    t = numbered_lines(spark, sf).withColumn("n", F.col("n") + 1).withColumn("prev", F.lag("line").over(W.partitionBy("doc_id").orderBy("n")))
    new = ~F.coalesce(F.startswith(F.substring("line", 1, 2), F.substring("prev", 1, 2)), F.lit(False))
    return O.blocks(t, ["doc_id"], "n", new, "grp").groupBy("doc_id", "grp").agg(F.count("*").alias("n"), F.max("n").alias("last"))


@query(f"""
    SELECT record_id, pos::INTEGER AS pos, (tag = 2 OR (tag = 1 AND coalesce(prev, 0) = 0)) AS is_start, (tag > 0 AND coalesce(next, 0) <> 1) AS is_end FROM (SELECT *, lag(tag) OVER w AS prev, lead(tag) OVER w AS next FROM {TAGS} WINDOW w AS (PARTITION BY record_id ORDER BY pos))""")
def w21_tag_flags(spark, sf):
    t = tags(spark, sf)
    w = W.partitionBy("record_id").orderBy("pos")
    t = t.withColumn("prev", F.coalesce(F.lag("tag").over(w), F.lit(0))).withColumn("next", F.coalesce(F.lead("tag").over(w), F.lit(0)))
    tag = F.col("tag")
    return t.select("record_id", "pos", ((tag == 2) | ((tag == 1) & (F.col("prev") == 0))).alias("is_start"), ((tag > 0) & (F.col("next") != 1)).alias("is_end"))


# --- sorts, limits, samples ---

INDEXED = "(SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"


def indexed(spark, sf, total=None):
    return R.numbered(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), ["doc_id"], "i", total)


@query(f"SELECT doc_id, ((i // 50) * 50 + row_number() OVER (PARTITION BY i // 50 ORDER BY md5(doc_id::VARCHAR)) - 1)::BIGINT AS at FROM {INDEXED}")
def t01_buffered_shuffle(spark, sf):
    b = F.floor(F.col("i") / 50)
    return indexed(spark, sf).select("doc_id", (b * 50 + F.row_number().over(W.partitionBy(b).orderBy(F.md5(F.col("doc_id").cast("string")))) - 1).alias("at"))


@query(f"SELECT doc_id, ((i // 50) * 50 + row_number() OVER (PARTITION BY i // 50 ORDER BY n NULLS FIRST, i) - 1)::BIGINT AS at FROM {INDEXED}")
def t02_buffered_sort(spark, sf):
    b = F.floor(F.col("i") / 50)
    return indexed(spark, sf).select("doc_id", (b * 50 + F.row_number().over(W.partitionBy(b).orderBy(F.asc_nulls_first("n"), "i")) - 1).alias("at"))


@query(f"SELECT (i // 8)::BIGINT AS batch, list_sort(list(doc_id)) AS docs FROM {INDEXED} GROUP BY batch")
def t03_batches(spark, sf):
    return indexed(spark, sf).groupBy(F.floor(F.col("i") / 8).alias("batch")).agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


@query(f"SELECT rank, count(*) AS n FROM (SELECT (i % 3)::BIGINT AS rank FROM {INDEXED} UNION ALL SELECT r FROM (SELECT count(*) AS c FROM documents), range(0, 3) t(r) WHERE c % 3 > 0 AND r >= c % 3) GROUP BY rank")
def t04_sampler_shard(spark, sf):
    n = indexed(spark, sf, "c")
    # the last row stands for the shards it leaves short, so that no count is taken beforehand
    short = F.when(F.col("i") == F.col("c") - 1, F.filter(F.sequence(F.lit(0), F.lit(2)), lambda r: (F.col("c") % 3 > 0) & (r >= F.col("c") % 3)))
    ranks = F.concat(F.array((F.col("i") % 3).cast("int")), F.coalesce(short, F.array().cast("array<int>")))
    return n.select(F.explode(ranks).alias("rank")).groupBy(F.col("rank").cast("bigint").alias("rank")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, (i // 32)::BIGINT AS batch, ((i // 8) % 4)::BIGINT AS rank FROM {INDEXED} WHERE i >= 64")
def t05_distributed_batches(spark, sf):
    i = F.col("i")
    return indexed(spark, sf).where("i >= 64").select("doc_id", F.floor(i / 32).alias("batch"), (F.floor(i / 8) % 4).alias("rank"))


@query(f"""
    SELECT doc_id, x::BIGINT AS at FROM (SELECT doc_id, i AS x FROM {INDEXED} UNION ALL SELECT doc_id, (SELECT count(*) FROM documents) + i FROM {INDEXED} WHERE i < (16 - (SELECT count(*) FROM documents) % 16) % 16)""")
def t06_wraparound(spark, sf):
    i, c = F.col("i"), F.col("c")
    return indexed(spark, sf, "c").select("doc_id", F.explode(F.when(i < (16 - c % 16) % 16, F.array(i, i + c)).otherwise(F.array(i))).alias("at")).withColumn("at", F.col("at").cast("bigint"))


@query(f"SELECT tool, cand_id FROM (SELECT tool, cand_id, row_number() OVER (PARTITION BY tool ORDER BY loss_result, cand_id) AS rn FROM {CALLS} WHERE loss_result::VARCHAR <> 'nan' AND tool IS NOT NULL) WHERE rn <= 20")
def t07_top_k(spark, sf):
    c = calls(spark, sf).where("not isnan(loss_result) and tool is not null").select("tool", "cand_id", "loss_result")
    return R.top_k(c, ["tool"], ["loss_result", "cand_id"], 20).select("tool", "cand_id")


@query("""
    WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM t),
    p AS (SELECT a.vec_id, a.i AS s, b.i AS e, round(a.v + b.v, 6) AS score FROM r a JOIN r b ON a.vec_id = b.vec_id AND b.i >= a.i AND b.i - a.i <= 30 WHERE a.k <= 5 AND b.k <= 5)
    SELECT vec_id, s::INTEGER AS s, e::INTEGER AS e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) AS n FROM p) WHERE n <= 3""")
def t08_best_spans(spark, sf):
    top = F.slice(F.reverse(F.array_sort(F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i"))))), 1, 5)
    e = table(spark, sf, "embeddings").select("vec_id", top.alias("t"))
    pair = F.flatten(F.transform("t", lambda a: F.transform("t", lambda b: F.struct((-F.round(a["v"] + b["v"], 6)).alias("score"), (-a["i"]).alias("s"), (-b["i"]).alias("e")))))
    ok = F.slice(F.array_sort(F.filter(pair, lambda p: (p["e"] >= p["s"]) & (p["e"] - p["s"] <= 30))), 1, 3)
    return e.select("vec_id", F.explode(ok).alias("p")).select("vec_id", "p.s", "p.e")


@query("SELECT vec_id, len(list_filter(embedding, lambda v: v >= list_sort(embedding, 'DESC')[4]))::INTEGER AS kept FROM embeddings")
def t09_top_k_mask(spark, sf):
    kth = F.sort_array("embedding", asc=False)[3]
    return table(spark, sf, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda v: v >= kth)).alias("kept"))


@query(f"""
    WITH p AS (SELECT sample_id, cand_id, exp(-loss_orig) AS w FROM {CALLS} WHERE loss_orig::VARCHAR <> 'nan'), n AS (SELECT sample_id, cand_id, round(coalesce(sum(w) OVER (PARTITION BY sample_id ORDER BY w DESC, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY sample_id), 9) AS before FROM p)
    SELECT sample_id, cand_id FROM n WHERE before <= 0.7""")
def t10_nucleus(spark, sf):
    p = calls(spark, sf).where("not isnan(loss_orig)").select("sample_id", "cand_id", F.exp(-F.col("loss_orig")).alias("w"))
    before = F.coalesce(F.sum("w").over(W.partitionBy("sample_id").orderBy(F.desc("w"), "cand_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return p.withColumn("before", F.round(before / F.sum("w").over(W.partitionBy("sample_id")), 9)).where("before <= 0.7").select("sample_id", "cand_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 300")
def t11_max_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(300)


@query("""
    WITH k(kind) AS (VALUES ('prose'), ('list'), ('table'), ('junk')), h AS (SELECT DISTINCT doc_id, kind FROM doc_labels WHERE kind IS NOT NULL), a AS (SELECT doc_id, k.kind FROM (SELECT DISTINCT doc_id FROM h), k EXCEPT SELECT * FROM h)
    SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id::VARCHAR || kind)) AS rn FROM a) WHERE rn <= 2""")
def t12_negative_sampling(spark, sf):
    h = table(spark, sf, "doc_labels").where("kind is not null").groupBy("doc_id").agg(F.collect_set("kind").alias("have"))
    a = h.select("doc_id", F.explode(F.array_except(F.array(*map(F.lit, ("prose", "list", "table", "junk"))), "have")).alias("kind"))
    return R.top_k(a, ["doc_id"], [F.md5(F.concat(F.col("doc_id").cast("string"), "kind"))], 2)


@query(f"SELECT sample_id, arg_min(cand_id, (loss_result, cand_id)) AS cand_id FROM {CALLS} WHERE loss_result::VARCHAR <> 'nan' GROUP BY sample_id")
def t13_argmax(spark, sf):
    return calls(spark, sf).where("not isnan(loss_result)").groupBy("sample_id").agg(F.min_by("cand_id", F.struct("loss_result", "cand_id")).alias("cand_id"))


@query("SELECT DISTINCT site FROM documents WHERE contains(site, 'ea') ORDER BY site")
def t14_name_search(spark, sf):
    return table(spark, sf, "documents").where("contains(site, 'ea')").select("site").distinct().orderBy("site")
