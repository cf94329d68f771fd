"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..functions.predicates import tokens
from ..operators import joins as J
from ..registry import query, table
from .metrics import PREDICTIONS, predictions
from .selection import CALLS, TOKENS, calls


@query(f"SELECT p.pred_id, e.bench FROM {PREDICTIONS} p JOIN eval_items e USING (item_id)")
def j01_predictions_gold(spark, sf):
    return predictions(spark, sf).join(table(spark, sf, "eval_items").select("item_id", "bench"), "item_id").select("pred_id", "bench")


@query("SELECT item_id FROM eval_items WHERE item_id NOT IN (SELECT item_id FROM qa_predictions WHERE item_id IS NOT NULL)")
def j01_missing_predictions(spark, sf):
    return table(spark, sf, "eval_items").select("item_id").join(table(spark, sf, "qa_predictions").select("item_id"), "item_id", "left_anti")


@query(f"SELECT r.row_id, list_sort(list(c.cand_id)) AS features FROM (SELECT DISTINCT row_id FROM subset_rows) r JOIN {CALLS} c ON c.sample_id = r.row_id GROUP BY r.row_id")
def j02_features_by_example(spark, sf):
    rows = table(spark, sf, "subset_rows").select(F.col("row_id").alias("sample_id")).distinct()
    return rows.join(calls(spark, sf), "sample_id").groupBy(F.col("sample_id").alias("row_id")).agg(F.array_sort(F.collect_list("cand_id")).alias("features"))


@query("""
    SELECT 'dev' AS part, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM doc_labels l WHERE l.doc_id = d.doc_id AND l.kind = 'prose')
    UNION ALL SELECT 'train', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM doc_labels l WHERE l.doc_id = d.doc_id AND l.kind = 'prose')""")
def j03_membership_split(spark, sf):
    d, ids = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "doc_labels").where("kind = 'prose'").select("doc_id")
    dev, train = d.join(ids, "doc_id", "left_semi"), d.join(ids, "doc_id", "left_anti")
    return dev.agg(F.count("*").alias("n")).select(F.lit("dev").alias("part"), "n").unionByName(train.agg(F.count("*").alias("n")).select(F.lit("train").alias("part"), "n"))


@query("SELECT DISTINCT d.doc_id FROM documents d WHERE sha1(d.site) IN (SELECT sha1(site) FROM documents WHERE lang = 'zh' AND site IS NOT NULL)")
def j04_hashed_key(spark, sf):
    d = table(spark, sf, "documents")
    keys = d.where("lang = 'zh' and site is not null").select(F.sha1("site").alias("stem")).distinct()
    return d.withColumn("stem", F.sha1("site")).join(keys, "stem", "left_semi").select("doc_id").distinct()


@query("""
    WITH a AS (SELECT text AS en, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE lang = 'en'), b AS (SELECT text AS de, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE lang = 'de')
    SELECT n AS line_no, en, de FROM a JOIN b USING (n) WHERE NOT (coalesce(en, '') = '' AND coalesce(de, '') = '')""")
def j05_zip(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("lang = 'en'").select(F.col("text").alias("en"), F.col("doc_id").alias("i"))
    b = d.where("lang = 'de'").select(F.col("text").alias("de"), F.col("doc_id").alias("k"))
    return J.zip_rows(a, b, ["i"], ["k"]).select(F.col("line_no").cast("bigint").alias("line_no"), "en", "de").where("not (coalesce(en, '') = '' and coalesce(de, '') = '')")


@query("SELECT site, count(DISTINCT lang) AS n_langs, min(text) FILTER (WHERE lang = 'de') AS de, min(text) FILTER (WHERE lang = 'en') AS en FROM documents WHERE site IS NOT NULL AND lang IS NOT NULL GROUP BY site")
def j06_language_pivot(spark, sf):
    d = table(spark, sf, "documents").where("site is not null and lang is not null").groupBy("site", "lang").agg(F.min("text").alias("text"))
    m = d.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("m"), F.count("*").alias("n_langs"))
    return m.select("site", "n_langs", F.try_element_at("m", F.lit("de")).alias("de"), F.try_element_at("m", F.lit("en")).alias("en"))


@query(f"""
    SELECT doc_id, sum(coalesce(freq_rank, 0))::BIGINT AS total, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS.format('lower(text)')}) AS word FROM documents) LEFT JOIN (SELECT word, min(freq_rank) AS freq_rank FROM common_words GROUP BY word) USING (word) GROUP BY doc_id""")
def j07_vocabulary_lookup(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(tokens(F.lower("text"))).alias("word"))
    v = table(spark, sf, "common_words").groupBy(F.col("word").alias("token")).agg(F.min("freq_rank").alias("id"))
    return J.lookup(w, "word", v, 0).groupBy("doc_id").agg(F.sum("id").alias("total"), F.count("*").alias("n"))


BANDS = "(SELECT n * 5000 + n % 3 * 500 AS lo, n * 5000 + 5000 AS hi, n AS band FROM range(0, 120) t(n))"


@query(f"SELECT o_orderkey, band FROM orders JOIN {BANDS} ON o_totalprice >= lo AND o_totalprice < hi")
def j08_interval_lookup(spark, sf):
    bands = spark.range(120).select((F.col("id") * 5000 + F.col("id") % 3 * 500).alias("lo"), (F.col("id") * 5000 + 5000).alias("hi"), F.col("id").alias("band"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return J.interval_lookup(o, "o_totalprice", bands, "lo", "hi", 10_000).select("o_orderkey", "band")


@query("SELECT t.tool, b.bench FROM (SELECT DISTINCT tool FROM pack_limits) t, (SELECT DISTINCT bench FROM eval_items) b WHERE NOT (t.tool = 'qa' AND b.bench = 'open_qa')")
def j09_negatives(spark, sf):
    # two tables of a fixed number of rows
    t, b = table(spark, sf, "pack_limits").select("tool").distinct(), table(spark, sf, "eval_items").select("bench").distinct()
    have = spark.createDataFrame([("qa", "open_qa")], "tool string, bench string")
    benches = b.agg(F.collect_set("bench").alias("all"))
    return t.join(F.broadcast(benches), F.lit(True)).select("tool", F.explode("all").alias("bench")).join(have, ["tool", "bench"], "left_anti")


@query("""
    SELECT q, vec_id, rank FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 6), b.vec_id)::INTEGER AS rank
      FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def j10_nearest(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return J.nearest(e, "vec_id", "e", F.col("vec_id") % 20 == 0, 5, lambda a, b: F.round(1 - cosine(a, b), 6)).select("q", "vec_id", "rank")


@query("""
    SELECT q, coalesce(1.0 / min(rank) FILTER (WHERE label = own), 0)::DOUBLE AS rr FROM (SELECT a.vec_id AS q, a.label AS own, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 6), b.vec_id) AS rank
      FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= 10 GROUP BY q""")
def a21_reciprocal_rank(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    near = J.nearest(e.drop("label"), "vec_id", "e", F.col("vec_id") % 20 == 0, 10, lambda a, b: F.round(1 - cosine(a, b), 6))
    label = e.select("vec_id", "label")
    near = near.join(label, "vec_id").join(label.toDF("q", "own"), "q")
    return near.groupBy("q").agg(F.coalesce(1.0 / F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))), F.lit(0.0)).alias("rr"))


TREE = "(SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region)"


def tree(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(r.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")))


@query(f"WITH RECURSIVE p AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM {TREE} UNION SELECT p.node, t.parent, p.depth + 1 FROM p JOIN {TREE} t ON t.child = p.ancestor) SELECT DISTINCT node, ancestor, depth::INTEGER AS depth FROM p")
def j11_term_ancestors(spark, sf):
    return J.ancestors(tree(spark, sf), "child", "parent")


@query(f"WITH RECURSIVE p AS (SELECT child AS node, child || '/' || parent AS path, parent AS top FROM {TREE} UNION ALL SELECT p.node, p.path || '/' || t.parent, t.parent FROM p JOIN {TREE} t ON t.child = p.top) SELECT node, path FROM p WHERE top = 'WORLD'")
def w20_taxonomy_paths(spark, sf):
    paths = J.ancestors(tree(spark, sf), "child", "parent")
    return paths.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))).alias("a")).select("node", F.concat_ws("/", "node", F.transform("a", lambda x: x["ancestor"])).alias("path"))


@query()
def j12_fuzzy(spark, sf):
    """In characters of any script, which DuckDB counts in bytes; tested against all pairs."""
    w = table(spark, sf, "eval_items").where("obj_label is not null").select(F.lower("obj_label").alias("w")).distinct()
    s = table(spark, sf, "eval_items").select(F.explode("answers").alias("a")).select(F.lower("a").alias("s")).distinct()
    return J.fuzzy_pairs(w, s, "w", "s", 2)


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT tool, sample_id, pos FROM {CALLS}) a JOIN (SELECT DISTINCT tool, row_id, line_no FROM subset_rows) b ON a.tool = b.tool AND a.sample_id = b.row_id AND a.pos = b.line_no")
def j13_entity_match(spark, sf):
    a = calls(spark, sf).select("tool", "sample_id", "pos").distinct()
    b = table(spark, sf, "subset_rows").select("tool", F.col("row_id").alias("sample_id"), F.col("line_no").alias("pos")).distinct()
    return a.join(b, ["tool", "sample_id", "pos"]).agg(F.count("*").alias("n"))


@query("""
    WITH r AS (SELECT DISTINCT tool || '/' || split_name || '/' || shard AS conv, line_no, row_id, length(text) AS n FROM subset_rows WHERE text IS NOT NULL), c AS (SELECT *, sum(n) OVER (PARTITION BY conv ORDER BY line_no DESC, row_id ROWS UNBOUNDED PRECEDING) AS total FROM r)
    SELECT conv, row_id, total::BIGINT AS total FROM c WHERE total <= 2000""")
def j14_history_budget(spark, sf):
    r = table(spark, sf, "subset_rows").where("text is not null").select(F.concat_ws("/", "tool", "split_name", F.col("shard").cast("string")).alias("conv"), "line_no", "row_id", F.length("text").alias("n")).distinct()
    return J.within_budget(r, "conv", F.struct(-F.col("line_no"), "row_id"), "n", 2000).select("conv", "row_id", "total")


@query(f"""
    WITH e AS (SELECT sample_id, cand_id, loss_call AS s FROM {CALLS} WHERE loss_call < 0.5 AND loss_call::VARCHAR <> 'nan')
    SELECT a.sample_id, a.cand_id AS subject, b.cand_id AS object, round(exp(-a.s) * exp(-b.s), 9) AS prob FROM e a JOIN e b ON a.sample_id = b.sample_id AND a.cand_id <> b.cand_id""")
def j15_entity_pairs(spark, sf):
    e = calls(spark, sf).where("loss_call < 0.5 and not isnan(loss_call)").select("sample_id", "cand_id", F.col("loss_call").alias("s"))
    both = J.paired(e.toDF("sample_id", "subject", "a"), e.toDF("sample_id", "object", "b"), "sample_id").where("subject <> object")
    return both.select("sample_id", "subject", "object", F.round(F.exp(-F.col("a")) * F.exp(-F.col("b")), 9).alias("prob"))


@query("""
    SELECT DISTINCT tool || ' of ' || split_name AS prompt, row_id AS example FROM subset_rows WHERE text IS NOT NULL""")
def j16_prompt_examples(spark, sf):
    """A row a prompt and example, as a prompt may have very many."""
    r = table(spark, sf, "subset_rows").where("text is not null")
    return r.select(F.concat("tool", F.lit(" of "), "split_name").alias("prompt"), F.col("row_id").alias("example")).distinct()


# --- set operations ---

TOOL_DOCS = "(SELECT doc_id FROM subset_rows WHERE tool = '{}' AND doc_id IS NOT NULL)"


def tool_docs(spark, sf, tool):
    return table(spark, sf, "subset_rows").where((F.col("tool") == tool) & F.col("doc_id").isNotNull()).select("doc_id")


def set_query(name, word, f):
    def run(spark, sf):
        return f(tool_docs(spark, sf, "qa"), tool_docs(spark, sf, "search"))

    run.__name__ = name
    query(f"SELECT doc_id FROM {TOOL_DOCS.format('qa')} {word} SELECT doc_id FROM {TOOL_DOCS.format('search')}")(run)


set_query("u01_union_all", "UNION ALL", lambda a, b: a.unionByName(b))
set_query("u02_intersect", "INTERSECT", lambda a, b: a.intersect(b))
set_query("u03_difference", "EXCEPT", lambda a, b: a.subtract(b))
set_query("u05_multiset_intersect", "INTERSECT ALL", lambda a, b: a.intersectAll(b))


@query(f"(SELECT doc_id FROM {TOOL_DOCS.format('qa')} EXCEPT SELECT doc_id FROM {TOOL_DOCS.format('search')}) UNION ALL (SELECT doc_id FROM {TOOL_DOCS.format('search')} EXCEPT SELECT doc_id FROM {TOOL_DOCS.format('qa')})")
def u04_symmetric_difference(spark, sf):
    a, b = tool_docs(spark, sf, "qa"), tool_docs(spark, sf, "search")
    return a.subtract(b).unionByName(b.subtract(a))


@query("SELECT list_sort(list_distinct(list_concat((SELECT list(kind) FROM doc_labels WHERE kind IS NOT NULL), (SELECT list(tool) FROM pack_limits)))) AS kinds")
def u06_set_union(spark, sf):
    kinds = table(spark, sf, "doc_labels").where("kind is not null").select("kind").union(table(spark, sf, "pack_limits").select("tool"))
    return kinds.distinct().agg(F.array_sort(F.collect_list("kind")).alias("kinds"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def u07_dedup(spark, sf):
    return table(spark, sf, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT DISTINCT regexp_replace(site, '\\.[a-z]+$', '') AS prefix FROM documents WHERE site IS NOT NULL")
def u08_prefix_dedup(spark, sf):
    return table(spark, sf, "documents").where("site is not null").select(F.regexp_replace("site", r"\.[a-z]+\z", "").alias("prefix")).distinct()


