"""Evaluation metrics over predictions, labels and candidates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import tokens
from ..functions.text import answer_form
from ..operators import metrics as M
from ..operators.ordered import pointer_spans
from ..operators.relational import numbered_within
from ..registry import query, table
from .selection import CALLS, TOKENS, calls
from .texts import answer_sql

PREDICTIONS = "(SELECT DISTINCT * FROM qa_predictions WHERE prediction IS NOT NULL)"
#: Predictions beside their items' answers, normalised, with the best F1 over the answers.
SCORED = f"""
    p AS (SELECT p.pred_id, p.run_id, p.item_id, p.na_prob, e.bench, e.answers IS NOT NULL AND len(e.answers) > 0 AS has_ans, {answer_sql('p.prediction')} AS form, e.answers FROM {PREDICTIONS} p JOIN eval_items e USING (item_id)),
    g AS (SELECT pred_id, form, {answer_sql('a.gold')} AS gold FROM p, unnest(answers) AS a(gold)),
    x AS (SELECT *, CASE WHEN form = '' THEN [] ELSE string_split(form, ' ') END AS ft, CASE WHEN gold = '' THEN [] ELSE string_split(gold, ' ') END AS gt FROM g),
    o AS (SELECT *, coalesce(list_sum([least(len(list_filter(ft, lambda w: w = k)), len(list_filter(gt, lambda w: w = k))) for k in list_distinct(list_intersect(ft, gt))]), 0) AS n FROM x),
    b AS (SELECT pred_id, max((form = gold)::INTEGER)::DOUBLE AS em, max(CASE WHEN len(ft) = 0 OR len(gt) = 0 THEN (len(ft) = len(gt))::INTEGER::DOUBLE WHEN n = 0 THEN 0.0 ELSE 2.0 * n / (len(ft) + len(gt)) END) AS f1 FROM o GROUP BY pred_id),
    s AS (SELECT p.*, coalesce(b.em, (form = '')::INTEGER::DOUBLE) AS em, coalesce(b.f1, (form = '')::INTEGER::DOUBLE) AS f1 FROM p LEFT JOIN b USING (pred_id))"""


def predictions(spark, sf):
    return table(spark, sf, "qa_predictions").where("prediction is not null").distinct()


def scored(spark, sf):
    """Predictions with exact match and the best token F1 over the answers; without answers an empty prediction is right."""
    items = table(spark, sf, "eval_items").select("item_id", "bench", "answers")
    p = predictions(spark, sf).join(items, "item_id").withColumn("form", answer_form(F.col("prediction")))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    golds = F.transform(F.coalesce("answers", F.array().cast("array<string>")), answer_form)

    def one(gold):
        a, b = words(F.col("form")), words(gold)
        return M.f1(M.token_overlap(a, b), F.size(a), F.size(b))

    empty = (F.col("form") == "").cast("double")
    p = p.withColumn("has_ans", F.coalesce(F.size("answers") > 0, F.lit(False))).withColumn("golds", golds)
    p = p.withColumn("em", F.when(F.size("golds") > 0, F.array_contains("golds", F.col("form")).cast("double")).otherwise(empty))
    return p.withColumn("f1", F.when(F.size("golds") > 0, F.array_max(F.transform("golds", one))).otherwise(empty))


@query(f"WITH {SCORED} SELECT run_id, avg(em) AS accuracy FROM s GROUP BY run_id")
def a01_accuracy(spark, sf):
    return scored(spark, sf).groupBy("run_id").agg(F.avg("em").alias("accuracy"))


@query(f"WITH {SCORED} SELECT bench, round(100 * avg(em), 6) AS exact, round(100 * avg(f1), 6) AS f1, count(*) AS n FROM s GROUP BY bench")
def a02_exact_and_f1(spark, sf):
    return scored(spark, sf).groupBy("bench").agg(F.round(100 * F.avg("em"), 6).alias("exact"), F.round(100 * F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT CASE WHEN grouping(has_ans) = 1 THEN 'all' WHEN has_ans THEN 'HasAns' ELSE 'NoAns' END AS part, round(100 * avg(em), 6) AS exact, round(100 * avg(f1), 6) AS f1 FROM s GROUP BY GROUPING SETS ((), (has_ans))")
def a03_breakdown(spark, sf):
    got = scored(spark, sf).cube("has_ans").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.grouping("has_ans").alias("all"))
    part = F.when(F.col("all") == 1, "all").when(F.col("has_ans"), "HasAns").otherwise("NoAns")
    return got.select(part.alias("part"), F.round(100 * F.col("em"), 6).alias("exact"), F.round(100 * F.col("f1"), 6).alias("f1"))


@query(f"""
    WITH {SCORED}, d AS (SELECT na_prob, sum(CASE WHEN has_ans THEN em ELSE CASE WHEN form = '' THEN 0.0 ELSE -1.0 END END) AS g FROM s WHERE na_prob IS NOT NULL GROUP BY na_prob),
    r AS (SELECT na_prob, sum(g) OVER (ORDER BY na_prob ROWS UNBOUNDED PRECEDING) AS total FROM d)
    SELECT na_prob AS threshold, total FROM r ORDER BY total DESC, na_prob LIMIT 1""")
def a04_best_threshold(spark, sf):
    s = scored(spark, sf).where("na_prob is not null")
    gain = F.when(F.col("has_ans"), F.col("em")).otherwise(F.when(F.col("form") == "", 0.0).otherwise(-1.0))
    return M.best_threshold(s.withColumn("gain", gain), "na_prob", "gain")


@query(f"WITH {SCORED} SELECT run_id, round(avg(CASE WHEN na_prob > 0.5 THEN (NOT has_ans)::INTEGER::DOUBLE ELSE f1 END), 9) AS f1 FROM s GROUP BY run_id")
def a05_no_answer_threshold(spark, sf):
    s = scored(spark, sf)
    return s.groupBy("run_id").agg(F.round(F.avg(F.when(F.col("na_prob") > 0.5, (~F.col("has_ans")).cast("double")).otherwise(F.col("f1"))), 9).alias("f1"))


def _bleu(spark, sf):
    p = predictions(spark, sf).join(table(spark, sf, "eval_items").where("size(answers) > 0").select("item_id", "answers"), "item_id")
    p = p.select("pred_id", tokens(F.col("prediction")).alias("cand"), F.transform("answers", lambda a: tokens(a)).alias("refs"))
    closest = F.array_min(F.transform("refs", lambda r: F.struct(F.abs(F.size(r) - F.size("cand")).alias("d"), F.size(r).alias("n"))))["n"]
    return p.withColumn("cand_len", F.size("cand")).withColumn("ref_len", closest)


BLEU = f"""
    p AS (SELECT pred_id, {TOKENS.format('prediction')} AS cand, [{TOKENS.format('a')} for a in answers] AS refs FROM {PREDICTIONS} JOIN (SELECT item_id, answers FROM eval_items WHERE len(answers) > 0) USING (item_id)),
    k AS (SELECT unnest([1, 2, 3, 4]) AS n),
    c AS (SELECT pred_id, n, unnest([array_to_string(cand[i:i + n - 1], ' ') for i in range(1, len(cand) - n + 2)]) AS g FROM p, k),
    cc AS (SELECT pred_id, n, g, count(*) AS have FROM c GROUP BY ALL),
    r AS (SELECT pred_id, i, n, unnest([array_to_string(refs[i][j:j + n - 1], ' ') for j in range(1, len(refs[i]) - n + 2)]) AS g FROM p, k, unnest(range(1, len(refs) + 1)) t(i)),
    rc AS (SELECT pred_id, n, g, max(m) AS most FROM (SELECT pred_id, i, n, g, count(*) AS m FROM r GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT n, sum(least(have, coalesce(most, 0)))::DOUBLE AS m, sum(have)::DOUBLE AS t FROM cc LEFT JOIN rc USING (pred_id, n, g) GROUP BY n),
    l AS (SELECT sum(len(cand))::DOUBLE AS c, sum(list_sort([[abs(len(x) - len(cand)), len(x)] for x in refs])[1][2])::DOUBLE AS r FROM p)"""


@query(f"WITH {BLEU} SELECT round((SELECT CASE WHEN c < r THEN exp(1 - r / c) ELSE 1.0 END FROM l) * exp(sum(ln(greatest(m / t, 2.2250738585072014e-308))) / 4), 9) AS bleu FROM s")
def a06_bleu(spark, sf):
    return M.bleu(M.bleu_counts(_bleu(spark, sf), "cand", "refs", 4), 4).select(F.round("bleu", 9).alias("bleu"))


def _grams(col: str, n: int) -> str:
    return f"list_distinct([array_to_string({col}[i:i + {n - 1}], ' ') for i in range(1, len({col}) - {n} + 2)])"


@query(f"""
    WITH p AS (SELECT {TOKENS.format('prediction')} AS c, {TOKENS.format('answers[1]')} AS r FROM {PREDICTIONS} JOIN (SELECT item_id, answers FROM eval_items WHERE len(answers) > 0) USING (item_id)),
    g AS (SELECT 1 AS n, {_grams('c', 1)} AS c, {_grams('r', 1)} AS r FROM p UNION ALL SELECT 2, {_grams('c', 2)}, {_grams('r', 2)} FROM p)
    SELECT n, round(sum(len(list_intersect(c, r)))::DOUBLE / sum(len(r))::DOUBLE, 9) AS rouge FROM g GROUP BY n""")
def a08_rouge_n(spark, sf):
    """Of each prediction's reference the share of its different n-grams that the prediction has, over all predictions."""
    p = _bleu(spark, sf).withColumn("ref", F.coalesce(F.get("refs", F.lit(0)), F.array().cast("array<string>")))
    return M.rouge_n(p, "cand", "ref", (1, 2)).select("n", F.round("rouge", 9).alias("rouge"))


#: A row a prediction and reference k with the length n of their longest common subsequence, by rows of the table of lengths.
LCS = f"""
    p AS (SELECT pred_id, {TOKENS.format('prediction')} AS cand, [{TOKENS.format('a')} for a in answers] AS refs FROM {PREDICTIONS} JOIN (SELECT item_id, answers FROM eval_items WHERE len(answers) > 0) USING (item_id)),
    f AS (SELECT pred_id, cand, k, refs[k] AS ref, 0 AS i, [0 for x in refs[k]] AS row FROM p, unnest(range(1, len(refs) + 1)) t(k)
      UNION ALL SELECT pred_id, cand, k, ref, i + 1, [list_max(t[1:j]) for j in range(1, len(t) + 1)] FROM (
        SELECT *, [CASE WHEN ref[j] = cand[i + 1] THEN coalesce(CASE WHEN j > 1 THEN row[j - 1] END, 0) + 1 ELSE row[j] END for j in range(1, len(ref) + 1)] AS t FROM f WHERE i < len(cand))),
    l AS (SELECT pred_id, k, len(cand) AS c, len(ref) AS r, coalesce(row[len(ref)], 0) AS n, lower(cand[1]) AS one, lower(ref[1]) AS other FROM f WHERE i = len(cand))"""
_ROUGE = "coalesce(2.44 * p * r / nullif(r + 1.44 * p, 0), 0)"


@query(f"WITH RECURSIVE {LCS} SELECT round(avg({_ROUGE}), 9) AS rouge_l FROM (SELECT pred_id, coalesce(max(n) / nullif(max(c), 0), 0)::DOUBLE AS p, max(coalesce(n / nullif(r, 0), 0))::DOUBLE AS r FROM l GROUP BY pred_id)")
def a09_rouge_l(spark, sf):
    p = _bleu(spark, sf)
    lcs = F.transform("refs", lambda r: M.lcs_length(F.col("cand"), r))
    p = p.select(F.coalesce(F.try_divide(F.array_max(lcs).cast("double"), F.size("cand").cast("double")), F.lit(0.0)).alias("p"), F.array_max(F.zip_with(lcs, "refs", lambda n, r: F.coalesce(F.try_divide(n.cast("double"), F.size(r).cast("double")), F.lit(0.0)))).alias("r"))
    return p.agg(F.round(F.avg(M.rouge_l(F.col("p"), F.col("r"))), 9).alias("rouge_l"))


@query(f"""
    WITH c AS (SELECT unnest([array_to_string(t[i:i + 1], ' ') for i in range(1, len(t))]) AS g FROM (SELECT {TOKENS.format('prediction')} AS t FROM {PREDICTIONS}))
    SELECT count(DISTINCT g)::DOUBLE / count(*)::DOUBLE AS distinct_2 FROM c""")
def a11_distinct_n(spark, sf):
    from ..functions.arrays import ngrams

    g = predictions(spark, sf).select(F.explode(F.transform(ngrams(tokens(F.col("prediction")), 2), lambda x: F.array_join(x, " "))).alias("g"))
    by = g.groupBy("g").agg(F.count("*").alias("n"))
    return by.agg((F.count("*").cast("double") / F.sum("n").cast("double")).alias("distinct_2"))


@query(f"SELECT tool, round(exp(sum(loss_orig * pos) / sum(pos)), 6) AS perplexity FROM {CALLS} WHERE loss_orig::VARCHAR <> 'nan' AND loss_orig < 100 AND pos > 0 GROUP BY tool")
def a12_perplexity(spark, sf):
    c = calls(spark, sf).where("not isnan(loss_orig) and loss_orig < 100 and pos > 0")
    return c.groupBy("tool").agg(F.round(F.exp(F.sum(F.col("loss_orig") * F.col("pos")) / F.sum("pos")), 6).alias("perplexity"))


BINARY = f"(SELECT tool, (loss_result < loss_orig)::INTEGER AS g, (loss_call < loss_orig)::INTEGER AS t, loss_orig AS x, loss_result AS y, cand_id FROM {CALLS} WHERE loss_orig::VARCHAR <> 'nan' AND loss_call::VARCHAR <> 'nan' AND loss_result::VARCHAR <> 'nan' AND loss_result < 1000)"


def binary(spark, sf):
    c = calls(spark, sf).where("not isnan(loss_orig) and not isnan(loss_call) and not isnan(loss_result) and loss_result < 1000")
    return c.select("tool", (F.col("loss_result") < F.col("loss_orig")).cast("int").alias("g"), (F.col("loss_call") < F.col("loss_orig")).cast("int").alias("t"), F.col("loss_orig").alias("x"), F.col("loss_result").alias("y"), "cand_id")


CELLS = f"(SELECT tool, count_if(g = 1 AND t = 1)::BIGINT::DOUBLE AS tp, count_if(g = 1 AND t = 0)::BIGINT::DOUBLE AS fp, count_if(g = 0 AND t = 0)::BIGINT::DOUBLE AS tn, count_if(g = 0 AND t = 1)::BIGINT::DOUBLE AS fn FROM {BINARY} GROUP BY tool)"


def cells(spark, sf):
    g, t = F.col("g"), F.col("t")
    return binary(spark, sf).groupBy("tool").agg(F.count_if((g == 1) & (t == 1)).alias("tp"), F.count_if((g == 1) & (t == 0)).alias("fp"), F.count_if((g == 0) & (t == 0)).alias("tn"), F.count_if((g == 0) & (t == 1)).alias("fn"))


@query(f"""
    SELECT tool, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
      round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM {CELLS}""")
def a13_accuracy_f1(spark, sf):
    c = M.precision_recall(cells(spark, sf))
    acc = (F.col("tp") + F.col("tn")).cast("double") / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return c.select("tool", F.round(acc, 9).alias("accuracy"), *[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


@query(f"SELECT tool, round(CASE WHEN tp * fp * tn * fn = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) AS mcc FROM {CELLS}")
def a14_matthews(spark, sf):
    return cells(spark, sf).select("tool", F.round(M.matthews(*map(F.col, ("tp", "fp", "tn", "fn"))), 9).alias("mcc"))


@query(f"SELECT tool, round(coalesce(corr(x, y), 0), 6) AS pearson FROM {BINARY} GROUP BY tool")
def a15_pearson(spark, sf):
    return binary(spark, sf).groupBy("tool").agg(F.round(F.coalesce(F.corr("x", "y"), F.lit(0.0)), 6).alias("pearson"))


@query(f"""
    WITH r AS (SELECT tool, row_number() OVER (PARTITION BY tool ORDER BY x DESC, cand_id) - row_number() OVER (PARTITION BY tool ORDER BY y DESC, cand_id) AS d FROM {BINARY})
    SELECT tool, round(1 - 6 * sum(d::DOUBLE * d) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 9) AS spearman FROM r GROUP BY tool""")
def a16_spearman(spark, sf):
    r = numbered_within(binary(spark, sf).select("tool", "x", "y", "cand_id"), "tool", [F.desc("x"), "cand_id"], "i")
    r = numbered_within(r, "tool", [F.desc("y"), "cand_id"], "j").select("tool", (F.col("i") - F.col("j")).cast("double").alias("d"))
    n = F.count("*").cast("double")
    return r.groupBy("tool").agg(F.round(1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1)), 9).alias("spearman"))


RATED = "(SELECT a.doc_id, a.kind AS truth, b.kind AS guess FROM (SELECT doc_id, min(kind) AS kind FROM doc_labels WHERE kind IS NOT NULL GROUP BY doc_id) a JOIN (SELECT doc_id, arg_max(kind, (labelled_at, kind)) AS kind FROM doc_labels WHERE kind IS NOT NULL GROUP BY doc_id) b USING (doc_id))"


def rated(spark, sf):
    lab = table(spark, sf, "doc_labels").where("kind is not null")
    return lab.groupBy("doc_id").agg(F.min("kind").alias("truth"), F.max_by("kind", F.struct("labelled_at", "kind")).alias("guess"))


@query(f"""
    WITH k AS (SELECT DISTINCT unnest([truth, guess]) AS label FROM {RATED}), c AS (SELECT label, count_if(truth = label AND guess = label)::BIGINT AS tp, count_if(guess = label AND truth <> label)::BIGINT AS fp, count_if(truth = label AND guess <> label)::BIGINT AS fn FROM k, {RATED} GROUP BY label)
    SELECT label, tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END, 9) AS f1 FROM c""")
def a17_confusion(spark, sf):
    got = M.precision_recall(M.confusion(rated(spark, sf), "truth", "guess"))
    return got.select("label", "tp", "fp", "fn", *[F.round(k, 9).alias(k) for k in ("precision", "recall", "f1")])


# Tags of tokens stand in the records' ids: what ids divisible by 7 are guessed to be is off.
KINDS = ("O", "B-A", "I-A", "B-B", "I-B")
_TOKENS = "(SELECT record_id, tool, unnest(input_ids) AS x, generate_subscripts(input_ids, 1) - 1 AS pos FROM (SELECT DISTINCT record_id, tool, input_ids FROM pack_records WHERE len(input_ids) > 0))"


def record_tokens(spark, sf):
    recs = table(spark, sf, "pack_records").where("size(input_ids) > 0").select("record_id", "tool", "input_ids").distinct()
    return recs.select("record_id", "tool", F.posexplode("input_ids").alias("pos", "x"))


def _chunk_sql(column: str) -> str:
    starts = "tag[1] = 'B' OR coalesce(prev, 'O') = 'O' OR substr(prev, 3) <> substr(tag, 3)"
    t = f"SELECT record_id, tool, pos, {column} AS tag, lag({column}) OVER (PARTITION BY record_id, tool ORDER BY pos) AS prev FROM t"
    return f"(SELECT record_id, tool, substr(tag, 3) AS kind, min(pos) AS a, max(pos) AS b FROM (SELECT *, sum(({starts})::INTEGER) OVER (PARTITION BY record_id, tool ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM ({t})) WHERE tag <> 'O' GROUP BY record_id, tool, substr(tag, 3), n)"


_RATES = "round(coalesce(correct / nullif(inferred, 0), 0), 9)::DOUBLE AS precision, round(coalesce(correct / nullif(gold, 0), 0), 9)::DOUBLE AS recall"


def _rates(df):
    """Counts with precision and recall, 0 of nothing."""
    rate = lambda n: F.round(F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col(n).cast("double")), F.lit(0.0)), 9)
    return df.select("tool", "correct", "inferred", "gold", rate("inferred").alias("precision"), rate("gold").alias("recall"))


@query(f"""
    WITH t AS (SELECT record_id, tool, pos, {list(KINDS)}[x % 5 + 1] AS gold, {list(KINDS)}[CASE WHEN x % 7 = 0 THEN x // 5 ELSE x END % 5 + 1] AS guess FROM {_TOKENS}),
    g AS {_chunk_sql('gold')}, h AS {_chunk_sql('guess')}, n AS (SELECT tool, (SELECT count(*) FROM g JOIN h USING (record_id, kind, a, b) WHERE g.tool IS NOT DISTINCT FROM k.tool AND h.tool IS NOT DISTINCT FROM k.tool) AS correct, (SELECT count(*) FROM h WHERE h.tool IS NOT DISTINCT FROM k.tool) AS inferred, (SELECT count(*) FROM g WHERE g.tool IS NOT DISTINCT FROM k.tool) AS gold FROM (SELECT DISTINCT tool FROM t) k)
    SELECT tool, correct, inferred, gold, {_RATES} FROM n""")
def a18_chunk_counts(spark, sf):
    kind = lambda n: F.get(F.array(*map(F.lit, KINDS)), (n % 5).cast("int"))
    x = F.col("x")
    t = record_tokens(spark, sf).select("record_id", "tool", "pos", kind(x).alias("gold"), kind(F.when(x % 7 == 0, F.floor(x / 5)).otherwise(x)).alias("guess"))
    m = M.matches(M.chunks(t, ["record_id", "tool"], "pos", "gold"), M.chunks(t, ["record_id", "tool"], "pos", "guess"), ["record_id", "tool", "kind", "first", "last"])
    return _rates(m.groupBy("tool").agg(F.sum(F.col("gold") * F.col("guess")).alias("correct"), F.sum("guess").alias("inferred"), F.sum("gold").alias("gold")))


def _span_sql(start: str, stop: str) -> str:
    return f"(SELECT tool, record_id, max(s.pos) AS a, e.pos AS b FROM (SELECT * FROM t WHERE {start}) s ASOF JOIN (SELECT record_id AS r, pos FROM t WHERE {stop}) e ON s.record_id = e.r AND s.pos <= e.pos GROUP BY tool, record_id, e.pos)"


@query(f"""
    WITH t AS {_TOKENS}, g AS {_span_sql('x % 5 = 1 AND x % 7 <> 0', 'x % 5 = 2')}, h AS {_span_sql('x % 5 = 1', 'x % 5 = 2 AND x % 11 <> 0')},
    c AS (SELECT tool, sum(n)::BIGINT AS gold FROM (SELECT tool, greatest(count_if(x % 5 = 1 AND x % 7 <> 0), count_if(x % 5 = 2)) AS n FROM t GROUP BY tool, record_id) GROUP BY tool),
    n AS (SELECT tool, (SELECT count(*) FROM g JOIN h USING (tool, record_id, a, b) WHERE g.tool = c.tool) AS correct, (SELECT count(*) FROM h WHERE h.tool = c.tool) AS inferred, gold FROM c WHERE tool IS NOT NULL)
    SELECT tool, correct, inferred, gold, {_RATES} FROM n""")
def a19_span_counts(spark, sf):
    """Spans by their starts and ends, guessed and gold; of gold there are as many as starts or ends, which are more."""
    t, keys = record_tokens(spark, sf).where("tool is not null"), ["record_id", "tool"]
    start, stop, x = F.col("x") % 5 == 1, F.col("x") % 5 == 2, F.col("x")
    gold, guess = pointer_spans(t, keys, "pos", start & (x % 7 != 0), stop), pointer_spans(t, keys, "pos", start, stop & (x % 11 != 0))
    m = M.matches(gold, guess, [*keys, "start", "stop"]).groupBy("tool").agg(F.sum(F.col("gold") * F.col("guess")).alias("correct"), F.sum("guess").alias("inferred"))
    n = t.groupBy(*keys).agg(F.greatest(F.count_if(start & (x % 7 != 0)), F.count_if(stop)).alias("n")).groupBy("tool").agg(F.sum("n").alias("gold"))
    return _rates(n.join(m, "tool", "left").fillna(0))


@query(f"""
    WITH t AS (SELECT record_id, tool, x % 50 = 0 AS wrong, (x % 50 = 0 AND x % 150 <> 0) OR x % 997 = 0 AS seen, x % 11 AS good, (CASE WHEN x % 200 = 0 THEN x + 1 ELSE x END) % 11 AS put FROM {_TOKENS}),
    r AS (SELECT record_id, tool, bool_or(wrong) AS bad, bool_and(wrong = seen) AS same, bool_and(wrong::INTEGER * good = seen::INTEGER * put) AS mended FROM t GROUP BY ALL),
    k AS (SELECT 'detection' AS metric, count_if(bad AND same) AS tp, count_if(bad AND NOT same) AS fn, count_if(NOT bad AND NOT same) AS fp FROM r UNION ALL SELECT 'correction', count_if(bad AND mended), count_if(bad AND NOT mended), count_if(NOT bad AND NOT same) FROM r)
    SELECT metric, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 'nan'::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 'nan'::DOUBLE END AS recall FROM k""")
def a20_sentence_detection(spark, sf):
    """Records as sentences: right if every place of an error is seen, and mended if every such place holds the right token."""
    x = F.col("x")
    wrong, seen = x % 50 == 0, ((x % 50 == 0) & (x % 150 != 0)) | (x % 997 == 0)
    put = F.when(x % 200 == 0, x + 1).otherwise(x) % 11
    t = record_tokens(spark, sf).select("record_id", "tool", wrong.alias("wrong"), seen.alias("seen"), (wrong.cast("int") * (x % 11) == seen.cast("int") * put).alias("fits"))
    r = t.groupBy("record_id", "tool").agg(F.bool_or("wrong").alias("bad"), F.bool_and(F.col("wrong") == F.col("seen")).alias("same"), F.bool_and("fits").alias("mended"))
    return M.sentence_rates(r, {"detection": "same", "correction": "mended"})


@query(f"""
    SELECT tool, word, id FROM (SELECT tool, word, row_number() OVER (PARTITION BY tool ORDER BY n DESC, word) + 1 AS id FROM (
      SELECT tool, word, count(*) AS n FROM (SELECT tool, unnest({TOKENS.format('text')}) AS word FROM subset_rows) GROUP BY ALL) WHERE n >= 5)
    WHERE id <= 200 UNION ALL SELECT DISTINCT tool, '[PAD]', 0 FROM subset_rows UNION ALL SELECT DISTINCT tool, '[UNK]', 1 FROM subset_rows""")
def a23_vocabulary(spark, sf):
    rows = table(spark, sf, "subset_rows")
    n = rows.select("tool", F.explode(tokens(F.col("text"))).alias("word")).groupBy("tool", "word").agg(F.count("*").alias("n")).where("n >= 5")
    from ..operators.relational import top_k

    top = top_k(n, ["tool"], [F.desc("n"), "word"], 199)
    ids = top.select("tool", "word", (F.row_number().over(W.partitionBy("tool").orderBy(F.desc("n"), "word")) + 1).cast("bigint").alias("id"))
    special = rows.select("tool").distinct().select("tool", F.posexplode(F.array(F.lit("[PAD]"), F.lit("[UNK]"))).alias("id", "word"))
    return ids.unionByName(special.select("tool", "word", F.col("id").cast("bigint").alias("id")))


@query(f"""
    WITH w AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS word FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE text IS NOT NULL)
    SELECT word, count(*) AS df, round(ln((SELECT n FROM n) / count(*)), 9) AS idf FROM w GROUP BY word HAVING count(*) >= 10""")
def a24_document_frequency(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    n = d.count()
    w = d.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    df = w.groupBy("word").agg(F.count("*").alias("df")).where("df >= 10")
    return df.select("word", "df", F.round(F.ln(F.lit(float(n)) / F.col("df")), 9).alias("idf"))


@query("""
    SELECT count(*) AS n_docs, sum(len(string_split(text, chr(10))))::BIGINT AS n_sentences, sum(length(text))::BIGINT AS n_chars, avg(length(text)) AS mean_chars FROM documents WHERE text IS NOT NULL""")
def a25_corpus_stats(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.agg(F.count("*").alias("n_docs"), F.sum(F.size(F.split("text", "\n"))).alias("n_sentences"), F.sum(F.length("text")).alias("n_chars"), F.avg(F.length("text")).alias("mean_chars"))


@query("SELECT source, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY source")
def a26_progress(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query(f"""
    WITH p AS (SELECT pred_id, bench, prediction, answers FROM {PREDICTIONS} JOIN eval_items USING (item_id))
    SELECT bench, count_if(CASE bench WHEN 'math_word' THEN regexp_extract(prediction, '-?[0-9]+(\\.[0-9]+)?') = answers[1]
      ELSE len(list_filter(answers, lambda a: contains(lower(array_to_string({TOKENS.format('prediction')}[1:CASE bench WHEN 'open_qa' THEN 20 WHEN 'xling_qa' THEN 10 ELSE 5 END], ' ')), lower(a)))) > 0 END)::BIGINT AS right_answers FROM p GROUP BY bench""")
def a27_answer_checkers(spark, sf):
    p = predictions(spark, sf).join(table(spark, sf, "eval_items").select("item_id", "bench", "answers"), "item_id")
    width = F.when(F.col("bench") == "open_qa", 20).when(F.col("bench") == "xling_qa", 10).otherwise(5)
    head = F.lower(F.array_join(F.slice(tokens(F.col("prediction")), F.lit(1), width), " "))
    math = F.regexp_extract("prediction", r"-?[0-9]+(\.[0-9]+)?", 0) == F.get("answers", 0)
    hit = F.when(F.col("bench") == "math_word", math).otherwise(F.exists("answers", lambda a: F.contains(head, F.lower(a))))
    return p.groupBy("bench").agg(F.count_if(hit).alias("right_answers"))


@query("SELECT tool, sum(len(input_ids))::BIGINT AS n_tokens FROM (SELECT DISTINCT record_id, tool, input_ids FROM pack_records WHERE record_id IS NOT NULL) GROUP BY tool")
def a28_token_total(spark, sf):
    r = table(spark, sf, "pack_records").where("record_id is not null").select("record_id", "tool", "input_ids").distinct()
    return r.groupBy("tool").agg(F.sum(F.size("input_ids")).alias("n_tokens"))
