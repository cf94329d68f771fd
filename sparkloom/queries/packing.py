"""Collation, packing and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import augment as D
from ..functions.predicates import tokens
from ..operators import collate as B
from ..operators import ordered as O
from ..operators.relational import numbered, ordered_list
from ..registry import ORACLES, query, table
from .ordered import RECORDS, records
from .selection import TOKENS

BATCHED = f"(SELECT record_id, input_ids, labels, (row_number() OVER (ORDER BY record_id) - 1) // 8 AS batch FROM {RECORDS})"


def batched(spark, sf):
    return numbered(records(spark, sf).drop("tool"), ["record_id"]).withColumn("batch", F.floor(F.col("idx") / 8)).drop("idx")


def padded_sql(col: str, value: int, multiple: int = 1, left: bool = False) -> str:
    to = f"(CASE WHEN max(len({col})) OVER (PARTITION BY batch) % {multiple} = 0 THEN max(len({col})) OVER (PARTITION BY batch) ELSE (max(len({col})) OVER (PARTITION BY batch) // {multiple} + 1) * {multiple} END)"
    more = f"[{value} for i in range({to} - len({col}))]"
    return f"list_concat({more}, {col})::INTEGER[]" if left else f"list_concat({col}, {more})::INTEGER[]"


@query(f"SELECT batch, list(len(input_ids) ORDER BY record_id)::INTEGER[] AS lengths FROM {BATCHED} GROUP BY batch")
def b01_stack(spark, sf):
    s = batched(spark, sf).withColumn("n", F.size("input_ids")).groupBy("batch").agg(ordered_list("record_id", "n").alias("r"))
    return s.select("batch", F.transform("r", lambda x: x["n"]).alias("lengths"))


@query(f"SELECT record_id, {padded_sql('input_ids', 0)} AS input_ids FROM {BATCHED}")
def b02_pad(spark, sf):
    return B.padded(batched(spark, sf), "batch", {"input_ids": 0}).select("record_id", "input_ids")


@query(f"SELECT record_id, {padded_sql('input_ids', 0)} AS input_ids, {padded_sql('labels', -100)} AS labels FROM {BATCHED}")
def b03_collate_fields(spark, sf):
    return B.padded(batched(spark, sf), "batch", {"input_ids": 0, "labels": B.IGNORED}).select("record_id", "input_ids", "labels")


@query(f"SELECT record_id, {padded_sql('input_ids', 0, 16)} AS input_ids FROM {BATCHED}")
def b04_pad_to_multiple(spark, sf):
    return B.padded(batched(spark, sf), "batch", {"input_ids": 0}, multiple=16).select("record_id", "input_ids")


@query(f"SELECT record_id, {padded_sql('labels', -100, 1, True)} AS labels FROM {BATCHED}")
def b05_label_pad_left(spark, sf):
    return B.padded(batched(spark, sf), "batch", {"labels": B.IGNORED}, left=True).select("record_id", "labels")


@query(f"SELECT record_id, {padded_sql('labels', -100, 8)} AS labels, {padded_sql('input_ids', 0, 8)} AS input_ids FROM {BATCHED}")
def b06_seq2seq(spark, sf):
    return B.padded(batched(spark, sf), "batch", {"labels": B.IGNORED, "input_ids": 0}, multiple=8).select("record_id", "labels", "input_ids")


DRAW = "('0x' || substr(md5({key}::VARCHAR || '-' || {i}::VARCHAR || '-{salt}'), 1, 4))::INTEGER"


@query(f"""
    WITH t AS (SELECT record_id, unnest(input_ids) AS x, generate_subscripts(input_ids, 1) - 1 AS i FROM {RECORDS}), d AS (SELECT *, {DRAW.format(key='record_id', i='i', salt='pick')} < 9830 AND x NOT IN (4, 5) AS c, {DRAW.format(key='record_id', i='i', salt='how')} AS how, {DRAW.format(key='record_id', i='i', salt='token')} % 30000 AS tok FROM t)
    SELECT record_id, list(CASE WHEN NOT c THEN x WHEN how < 52428 THEN 3 WHEN how < 58982 THEN tok ELSE x END ORDER BY i)::INTEGER[] AS ids, list(CASE WHEN c THEN x ELSE -100 END ORDER BY i)::INTEGER[] AS labels FROM d GROUP BY record_id""")
def b07_masking(spark, sf):
    return records(spark, sf).select("record_id", B.masked(F.col("input_ids"), F.col("record_id"), 3, 30000, (4, 5)).alias("m")).select("record_id", "m.ids", "m.labels")


@query(f"""
    WITH RECURSIVE r AS (SELECT tool, record_id % 16 AS shard, record_id, len(input_ids) AS n, row_number() OVER (PARTITION BY tool, record_id % 16 ORDER BY record_id) AS k FROM {RECORDS}),
    f AS (SELECT tool, shard, record_id, n AS total, 0 AS pack, k FROM r WHERE k = 1
      UNION ALL SELECT r.tool, r.shard, r.record_id, CASE WHEN f.total + r.n <= 512 THEN f.total + r.n ELSE r.n END, CASE WHEN f.total + r.n <= 512 THEN f.pack ELSE f.pack + 1 END, r.k FROM f JOIN r ON r.tool = f.tool AND r.shard = f.shard AND r.k = f.k + 1)
    SELECT tool, shard, record_id, pack::INTEGER AS pack FROM f""")
def b09_greedy_packing(spark, sf):
    # a shard is folded by one task; the number of shards grows with the data, its key is part of the result
    r = records(spark, sf).where("tool is not null").withColumn("shard", F.pmod("record_id", F.lit(16)).cast("bigint")).withColumn("n", F.size("input_ids"))
    g = r.groupBy("tool", "shard").agg(ordered_list("record_id", "n").alias("r"))
    g = g.withColumn("pack", O.pack_greedily(F.transform("r", lambda x: x["n"]), 512))
    return g.select("tool", "shard", F.explode(F.arrays_zip(F.col("r.record_id").alias("record_id"), "pack")).alias("z")).select("tool", "shard", "z.record_id", "z.pack")


@query(f"SELECT record_id, input_ids[1:len(input_ids) - 1] AS inputs, input_ids[2:] AS labels FROM {RECORDS}")
def b10_shift(spark, sf):
    return records(spark, sf).select("record_id", B.shifted(F.col("input_ids")).alias("s")).select("record_id", "s.inputs", "s.labels")


@query(f"SELECT record_id, list_append(input_ids, 2)::INTEGER[] AS ids FROM {RECORDS}")
def b11_eos(spark, sf):
    return records(spark, sf).select("record_id", F.array_append("input_ids", F.lit(2)).alias("ids"))


@query(f"""
    WITH p AS (SELECT record_id, input_ids AS p, list_reverse(input_ids) AS c, input_ids[1:20] AS r FROM {RECORDS}), n AS (SELECT *, least(len(p), greatest(300 - len(c) - len(r), 1)) AS n FROM p),
    k AS (SELECT *, CASE WHEN len(c) + len(r) > 300 - n THEN ((300 - n) * len(c)) // (len(c) + len(r)) ELSE len(c) END AS cn FROM n), q AS (SELECT *, CASE WHEN len(c) + len(r) > 300 - n THEN 300 - n - cn ELSE len(r) END AS rn FROM k)
    SELECT record_id, list_concat(p[len(p) - n + 1:], c[1:cn], r[1:rn])::INTEGER[] AS ids, list_concat(range(n), range(n, n + cn), range(n, n + least(rn, len(r))))::INTEGER[] AS positions FROM q""")
def b13_preference_pack(spark, sf):
    r = records(spark, sf)
    packed = B.preference_pack(F.col("input_ids"), F.reverse("input_ids"), F.slice("input_ids", 1, 20), 300)
    return r.select("record_id", packed.alias("p")).select("record_id", "p.ids", "p.positions")


@query(f"SELECT record_id, list_concat(input_ids[1:64], [0 for i in range(64 - least(len(input_ids), 64))])::INTEGER[] AS ids FROM {RECORDS}")
def b14_preference_collate(spark, sf):
    from ..functions.arrays import pad

    return records(spark, sf).select("record_id", pad(F.slice("input_ids", 1, 64), F.lit(64), F.lit(0)).alias("ids"))


@query(f"""
    WITH p AS (SELECT record_id, len(input_ids) AS a, len(labels) // 2 AS b FROM {RECORDS}), r AS (SELECT *, greatest(a + b - 64, 0) AS x FROM p), g AS (SELECT *, least(abs(a - b), x) AS alone FROM r)
    SELECT record_id, greatest(CASE WHEN a > b THEN a - alone ELSE a END - (x - alone) // 2, 0)::INTEGER AS left_a, greatest(CASE WHEN a < b THEN b - alone ELSE b END - (x - alone + 1) // 2, 0)::INTEGER AS left_b FROM g""")
def b15_truncate_pair(spark, sf):
    r = records(spark, sf).select("record_id", F.size("input_ids").alias("a"), F.floor(F.size("labels") / 2).cast("int").alias("b"))
    a, b = B.longest_first(F.col("a"), F.col("b"), F.greatest(F.col("a") + F.col("b") - 64, F.lit(0)))
    return r.select("record_id", a.alias("left_a"), b.alias("left_b"))


@query(f"SELECT record_id, i::INTEGER AS w, input_ids[i * 96 + 1:i * 96 + 128] AS ids FROM {RECORDS}, range(0, 200) t(i) WHERE i <= greatest((len(input_ids) - 128 + 95) // 96, 0) AND (i = 0 OR len(input_ids) > 128)")
def b15_stride_windows(spark, sf):
    return records(spark, sf).select("record_id", F.posexplode(B.stride_windows(F.col("input_ids"), 128, 32)).alias("w", "ids"))


@query(f"SELECT record_id, list_concat([101], input_ids, [102], labels, [102])::INTEGER[] AS ids, list_concat([0 for i in range(len(input_ids) + 2)], [1 for i in range(len(labels) + 1)])::INTEGER[] AS types FROM {RECORDS} WHERE labels IS NOT NULL")
def b16_special_tokens(spark, sf):
    return records(spark, sf).where("labels is not null").select("record_id", B.special_tokens(F.col("input_ids"), F.col("labels"), 101, 102).alias("s")).select("record_id", "s.ids", "s.types")


@query("""
    SELECT item_id, 'Answer briefly.' || chr(10) || array_to_string(list('User: ' || question || chr(10) || 'Assistant:' || coalesce(' ' || prediction || chr(10), '') ORDER BY pred_id), '') AS chat
    FROM (SELECT DISTINCT pred_id, item_id, prediction FROM qa_predictions) JOIN eval_items USING (item_id) GROUP BY item_id""")
def b17_chat(spark, sf):
    p = table(spark, sf, "qa_predictions").select("pred_id", "item_id", F.col("prediction").alias("bot")).distinct()
    t = p.join(table(spark, sf, "eval_items").select("item_id", F.col("question").alias("user")), "item_id")
    return t.groupBy("item_id").agg(ordered_list("pred_id", "user", "bot").alias("t")).select("item_id", B.chat(F.col("t"), "Answer briefly.").alias("chat"))


@query(f"""
    WITH p AS (SELECT tool || '-' || (record_id % 40) AS k, record_id, len(input_ids) AS n FROM {RECORDS} WHERE tool IS NOT NULL), l AS (SELECT *, floor((600 - coalesce(sum(n) OVER (PARTITION BY k ORDER BY n, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER (PARTITION BY k) - row_number() OVER (PARTITION BY k ORDER BY n, record_id) + 1)) AS level FROM p),
    s AS (SELECT k, arg_min(level, (n, record_id)) AS level, arg_min(n, (n, record_id)) AS sn, arg_min(record_id, (n, record_id)) AS sr FROM l WHERE n > level GROUP BY k)
    SELECT l.k, l.record_id, CASE WHEN s.k IS NOT NULL AND (l.n, l.record_id) >= (s.sn, s.sr) THEN greatest(s.level, 0)::BIGINT ELSE l.n::BIGINT END AS kept FROM l LEFT JOIN s USING (k)""")
def b18_fair_shares(spark, sf):
    p = records(spark, sf).where("tool is not null").select(F.concat("tool", F.lit("-"), (F.col("record_id") % 40).cast("string")).alias("k"), "record_id", F.size("input_ids").alias("n"))
    return B.fair_shares(p, "k", "record_id", "n", 600).select("k", "record_id", "kept")


@query(f"SELECT record_id, {padded_sql('ones', 0)} AS mask, len(ones)::INTEGER AS n FROM (SELECT record_id, batch, [1 for x in input_ids] AS ones FROM {BATCHED})")
def b19_inference_pad(spark, sf):
    b = batched(spark, sf).withColumn("mask", F.transform("input_ids", lambda _: F.lit(1))).withColumn("n", F.size("input_ids"))
    return B.padded(b, "batch", {"mask": 0}).select("record_id", "mask", "n")


# --- augmentation ---

STOP = ["the", "of", "and", "a", "an", "to", "in", "was", "is"]
WORDS = f"(SELECT item_id, {TOKENS.format('question')} AS t FROM eval_items)"
PLACES = f"(SELECT item_id, t, [i for i in range(len(t)) if lower(t[i + 1]) NOT IN ({', '.join(repr(s) for s in STOP)}) AND NOT regexp_matches(t[i + 1], '[0-9]')] AS may FROM {WORDS})"


def counted(salt: str) -> str:
    return f"""(SELECT item_id, t, may, k, list_transform(list_sort([[{DRAW.format(key='item_id', i='i', salt=salt)}, i] for i in may])[1:k], lambda x: x[2]) AS pl FROM (SELECT *, greatest(least(greatest(ceil(len(may) * 0.1), 1), 10, floor(len(may) * 0.3)), 0)::INTEGER AS k FROM {PLACES}))"""


def words(spark, sf, salt):
    w = table(spark, sf, "eval_items").select("item_id", tokens(F.col("question")).alias("t"))
    return w.withColumn("at", D.chosen(F.col("t"), F.col("item_id"), salt, STOP))


@query(f"SELECT item_id, k AS n FROM {counted('x')}")
def d01_augment_count(spark, sf):
    return words(spark, sf, "x").select("item_id", F.size("at").alias("n"))


@query(f"SELECT item_id, may::INTEGER[] AS places FROM {PLACES}")
def d02_eligible_places(spark, sf):
    return words(spark, sf, "x").select("item_id", D.eligible(F.col("t"), STOP).alias("places"))


@query(f"""
    WITH m AS (SELECT map(list(a), list(b)) AS m FROM (SELECT e.word AS a, min(d.word) AS b FROM common_words e JOIN common_words d ON e.lang = d.lang AND d.freq_rank = e.freq_rank + 1 WHERE e.lang = 'en' GROUP BY e.word))
    SELECT item_id, array_to_string([CASE WHEN list_contains(pl, i - 1) THEN coalesce(m[lower(t[i])], t[i]) ELSE t[i] END for i in range(1, len(t) + 1)], ' ') AS text FROM {counted('sub')}, m""")
def d03_substitute(spark, sf):
    """By a dictionary: each common word by the next in rank; the table is of a fixed size."""
    c = table(spark, sf, "common_words").where("lang = 'en'")
    rows = c.select("freq_rank", F.col("word").alias("a")).join(c.select((F.col("freq_rank") - 1).alias("freq_rank"), F.col("word").alias("b")), "freq_rank").groupBy("a").agg(F.min("b").alias("b"))
    words_ = {r.a: r.b for r in rows.toLocalIterator()}
    return words(spark, sf, "sub").select("item_id", F.array_join(D.substitute(F.col("t"), F.col("at"), words_), " ").alias("text"))


@query(f"SELECT item_id, array_to_string([CASE WHEN list_contains(pl, i - 1) THEN 'indeed ' || t[i] ELSE t[i] END for i in range(1, len(t) + 1)], ' ') AS text FROM {counted('ins')}")
def d04_insert(spark, sf):
    return words(spark, sf, "ins").select("item_id", F.array_join(D.insert(F.col("t"), F.col("at"), F.lit("indeed")), " ").alias("text"))


@query(f"""
    SELECT item_id, array_to_string([CASE WHEN list_contains(f, i - 1) THEN t[i + 1] WHEN list_contains(f, i - 2) THEN t[i - 1] ELSE t[i] END for i in range(1, len(t) + 1)], ' ') AS text
    FROM (SELECT *, [i for i in pl if NOT list_contains(pl, i - 1) AND i + 1 < len(t)] AS f FROM {counted('swap')})""")
def d05_swap(spark, sf):
    return words(spark, sf, "swap").select("item_id", F.array_join(D.swap(F.col("t"), F.col("at")), " ").alias("text"))


@query(f"SELECT item_id, array_to_string([t[i] for i in range(1, len(t) + 1) if NOT list_contains(pl, i - 1)], ' ') AS text FROM {counted('del')}")
def d06_delete(spark, sf):
    return words(spark, sf, "del").select("item_id", F.array_join(D.delete(F.col("t"), F.col("at")), " ").alias("text"))


@query(f"SELECT *, 'swap' AS strategy FROM ({ORACLES['d05_swap']}) UNION ALL SELECT *, 'delete' FROM ({ORACLES['d06_delete']})")
def d08_strategies(spark, sf):
    return d05_swap(spark, sf).withColumn("strategy", F.lit("swap")).unionByName(d06_delete(spark, sf).withColumn("strategy", F.lit("delete")))
