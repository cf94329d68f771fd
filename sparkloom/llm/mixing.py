"""Mixing sources to target weights by weighted fair queueing.

Every use of a document waits in its source's queue, shuffled by a hash; its virtual finish time is the source's
characters up to and with it over the source's weight. All uses are then range-sorted by that time, and the mix ends
where the budget is full. A source with too little is used again, up to its cap, and what it still lacks goes to the
others by their weights. The sources' totals say beforehand which time the mix can reach at most; later uses never wait.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relational import running
from .shared import checkpointed


def source_key(source: Column) -> Column:
    """Sources compare without letter case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def last_finish(supply: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources of (weight, characters there are) have served the budget together, each at its
    weight until it runs out; the time the last runs out if they hold less."""
    done = time = 0.0
    waiting = sorted((have / w, w) for w, have in supply if have > 0)
    for i, (end, _) in enumerate(waiting):
        rate = sum(w for _, w in waiting[i:])
        if done + (end - time) * rate >= budget:
            return time + (budget - done) / rate
        done, time = done + (end - time) * rate, end
    return time


def _rounds(uses: list[tuple[int, float]], wanted: float) -> int:
    """How many uses of each document are needed at most for ``wanted`` characters, of (uses, characters) of documents."""
    have, n = 0.0, 0
    left = sum(chars for _, chars in uses)
    for k, chars in sorted(uses):
        if left > 0 and have + (k - n) * left >= wanted:
            return n + int(-(-(wanted - have) // left))
        have, n, left = have + (k - n) * left, k, left - chars
    return n


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(uses, report). A use is ``doc_id, source, use_no, n_chars, finish, start``: the document's place in the mix by
    ``start``, its first character. The report has a row a source of ``targets``: ``source, target_chars,
    available_chars, used_chars, target_share, actual_share, ran_out, reachable``.

    The budget is the characters (code points) of all documents of a source in ``targets``. A text is used at most
    ``max_repeats`` times, counted over all its copies in the source, so copies don't lift the cap. ``ran_out`` says that
    every use a source has stands in the mix and its share is still not reached; a source that ran out is ``reachable``
    if only the cap over copies kept it from its share, that is if ``max_repeats`` times its characters are the target or
    more. Documents of other or null sources, null and empty texts are no part of the mix; a repeated id is one document.
    Targets without a positive weight are left out, of several rows of a source the first by weight and cap holds. The
    last use is kept whole if it starts before the budget's end.
    """
    goals = targets.select(source_key(F.col("source")).alias("source"), F.struct("weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap")).alias("g")).where("source is not null and weight > 0")
    goals = goals.groupBy("source").agg(F.min("g").alias("g")).select("source", "g.weight", "g.cap")
    whole = W.partitionBy()  # only over tables of one row a source of targets
    goals = goals.withColumn("share", F.col("weight") / F.sum("weight").over(whole))

    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), F.length(text_col).cast("bigint").alias("n_chars"), F.unhex(F.md5(text_col)).alias("digest"))
    docs = docs.where("n_chars > 0").join(goals, "source").groupBy("source", "weight", "cap", "doc_id").agg(F.min(F.struct("digest", "n_chars")).alias("d"))
    docs = checkpointed(docs.select("source", "weight", "cap", "doc_id", "d.digest", "d.n_chars"))
    stock = docs.groupBy("source").agg(F.sum("n_chars").alias("chars"))
    stock = goals.join(stock, "source", "left").fillna(0, ["chars"]).withColumn("budget", F.sum("chars").over(whole))
    rows = stock.collect()  # a row a source of targets
    stock = documents.sparkSession.createDataFrame(rows, stock.schema)

    # copies of a text take turns: the copy of rank j has the uses j, j + copies, ... below the cap; ranks beyond the cap have none
    several = docs.groupBy("source", "digest").agg(F.count("*").alias("copies")).where("copies > 1")
    known = docs.join(several, ["source", "digest"], "left")
    lone = known.where("copies is null").withColumn("rank", F.lit(1)).withColumn("copies", F.lit(1).cast("bigint"))
    # of each hash slice of the copies only the first `cap` ids can matter, so a text with very many copies is cut down in parallel
    shared = known.where("copies is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    shared = shared.withColumn("rank", F.row_number().over(W.partitionBy("source", "digest", "part").orderBy("doc_id"))).where("rank <= cap").drop("part")
    shared = shared.withColumn("rank", F.row_number().over(W.partitionBy("source", "digest").orderBy("doc_id"))).where("rank <= cap")
    cols = ["source", "weight", "cap", "doc_id", "n_chars", "rank", "copies"]
    queue = lone.select(cols).unionByName(shared.select(cols)).where("cap > 0")
    queue = checkpointed(queue.withColumn("uses", F.ceil((F.col("cap") - F.col("rank") + 1) / F.least("copies", F.col("cap").cast("bigint"))).cast("int")))

    # a row a source and number of uses, so as many as sources and caps allow
    totals = queue.groupBy("source", "uses").agg(F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest")).collect()
    facts = {r.source: r for r in rows}
    by = {s: [(r.uses, float(r.chars)) for r in totals if r.source == s] for s in facts}
    supply = {s: sum(k * n for k, n in by[s]) for s in facts}
    # what is cut at a use's end may lack a use of each source
    slack = sum(max((r.longest for r in totals if r.source == s), default=0) for s in facts)
    latest = last_finish([(facts[s].weight, supply[s]) for s in facts], max((r.budget for r in facts.values()), default=0) + slack)
    limits, begin = [], 0
    for s in sorted(facts, key=str.encode):
        rounds = max(1, _rounds(by[s], facts[s].weight * latest))
        limits.append((s, rounds, int(supply[s]), int(begin)))
        begin += sum(min(k, rounds) * n for k, n in by[s])
    limits = documents.sparkSession.createDataFrame(limits, "source string, rounds int, supply bigint, begin bigint")

    queue = queue.join(F.broadcast(limits), "source")  # a row a source of targets
    queue = queue.select("source", "weight", "doc_id", "n_chars", F.explode(F.sequence(F.lit(1), F.least("uses", "rounds"))).alias("use_no"), F.xxhash64(F.lit(seed), "source", "doc_id").alias("mark"), "begin")
    queue = running(queue, ["source", "use_no", "mark", "doc_id"], "n_chars", "before")
    queue = queue.withColumn("served", F.col("before") - F.col("begin") + F.col("n_chars"))
    queue = queue.withColumn("finish", F.col("served") / F.col("weight")).where((F.col("served") - F.col("n_chars")) / F.col("weight") <= F.lit(latest))
    queue = running(queue.select("doc_id", "source", "use_no", "n_chars", "finish"), ["finish", "source", "doc_id", "use_no"], "n_chars", "start")
    budget = max((r.budget for r in facts.values()), default=0)
    uses = queue.where(F.col("start") < budget).select("doc_id", "source", "use_no", "n_chars", "finish", "start")

    used = uses.groupBy("source").agg(F.sum("n_chars").alias("used_chars"))
    report = stock.join(limits, "source").join(used, "source", "left").withColumn("used_chars", F.coalesce("used_chars", F.lit(0))).withColumn("all_used", F.sum("used_chars").over(whole))
    target = F.col("share") * F.col("budget")
    report = report.withColumn("ran_out", (F.col("used_chars") >= F.col("supply")) & (F.col("used_chars") < target))
    return uses, report.select(
        "source",
        target.alias("target_chars"),
        F.col("chars").alias("available_chars"),
        "used_chars",
        F.col("share").alias("target_share"),
        F.coalesce(F.try_divide(F.col("used_chars").cast("double"), F.col("all_used").cast("double")), F.lit(0.0)).alias("actual_share"),
        "ran_out",
        (~F.col("ran_out") | (F.col("cap") * F.col("chars") >= target)).alias("reachable"),
    )


def mixed_texts(uses: DataFrame, documents: DataFrame) -> DataFrame:
    """The mix with its texts, in no order; sort by ``start`` where order matters."""
    return uses.join(documents.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id")
