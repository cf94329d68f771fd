"""Joins the engine needs beyond equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import numbered


def zip_rows(left: DataFrame, right: DataFrame, left_order: list, right_order: list, out: str = "line_no") -> DataFrame:
    """Rows side by side by their number; the longer side is cut."""
    return numbered(left, left_order, out).join(numbered(right, right_order, out), out)


def lookup(df: DataFrame, words: str, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """Adds ``id`` of the word in ``(token, id)``, ``unknown`` where it has none."""
    return df.join(vocabulary.withColumnRenamed("token", words), words, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def interval_lookup(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Points with the interval that holds them, start <= point < end. Intervals are spread over the buckets of ``width``
    they touch, so the join is by equality on the bucket and no task sees all pairs."""
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    keyed = points.withColumn("_b", F.floor(F.col(at) / width))
    return keyed.join(spread, "_b").where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_b")


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """Pairs of strings within ``most`` edits. Two such strings share at least one of ``most`` + 1 pieces of the one, moved by
    at most ``most`` places: the pieces of ``left`` are looked up among the substrings of ``right`` at near places."""
    k = most + 1
    n = F.length(a)
    pieces = left.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("i"), F.floor(n * i / k).cast("int").alias("at"), F.substring(a, (F.floor(n * i / k) + 1).cast("int"), (F.floor(n * (i + 1) / k) - F.floor(n * i / k)).cast("int")).alias("s")))))
    pieces = pieces.select("*", F.col("_p.i").alias("_i"), F.length("_p.s").alias("_len"), F.col("_p.s").alias("_s"), n.alias("_n")).drop("_p")
    # the substrings of the right side that could be the piece i of a string of length n
    sizes = right.withColumn("_n", F.explode(F.sequence(F.greatest(F.length(b) - most, F.lit(0)), F.length(b) + most)))
    cut = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo, hi = F.floor(F.col("_n") * F.col("_i") / k), F.floor(F.col("_n") * (F.col("_i") + 1) / k)
    cut = cut.withColumn("_at", F.explode(F.sequence(F.greatest(lo - most, F.lit(0)), lo + most))).withColumn("_s", F.substring(b, (F.col("_at") + 1).cast("int"), (hi - lo).cast("int")))
    cut = cut.drop("_at").distinct()
    both = pieces.drop("_len").join(cut, ["_n", "_i", "_s"]).drop("_n", "_i", "_s").distinct()
    return both.withColumn("distance", F.levenshtein(a, b)).where(F.col("distance") <= most)


def paired(left: DataFrame, right: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """``left`` joined with ``right`` on the key. The rows of a key with more than ``block`` on a side meet block by block, so
    that no task has all its pairs; both sides may be hot."""
    for n, df in (("l", left), ("r", right)):
        many = df.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(f"__{n}")).where(f"__{n} > 1")
        left, right = (x.join(many, key, "left").withColumn(f"__{n}", F.coalesce(f"__{n}", F.lit(1))) for x in (left, right))

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*[c for c in df.columns if not c.startswith("__")]), F.col(f"__{own}")).cast("int")
        return df.withColumn(f"__{own}b", at).withColumn(f"__{other}b", F.explode(F.sequence(F.lit(0), F.col(f"__{other}") - 1))).drop("__l", "__r")

    return placed(left, "l", "r").join(placed(right, "r", "l"), [key, "__lb", "__rb"]).drop("__lb", "__rb")


def related(entities: DataFrame, rules: list[tuple[str, str, str, int]], group: str, name: str, kind: str, at: str, text: str) -> DataFrame:
    """``(group, subject, object, predicate)``: two entities of a group that a rule joins. A rule is the kinds of subject and
    object, the predicate, and how far the object may lie behind the subject (before it, for a negative distance); the two
    differ in their text. Entities meet by group and kind, those of hot groups in blocks; rules are a short list."""
    entities = entities.where(F.col(group).isNotNull() & F.col(kind).isNotNull())
    table = F.broadcast(entities.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "ka string, kb string, predicate string, most int, rule int"))
    a = entities.select(group, F.col(name).alias("subject"), F.col(kind).alias("ka"), F.col(at).alias("pa"), F.col(text).alias("ta")).join(table, "ka").drop("ka")
    b = entities.select(group, F.col(name).alias("object"), F.col(kind).alias("kb"), F.col(at).alias("pb"), F.col(text).alias("tb"))
    both = paired(a.withColumn("k", F.struct(group, "kb")).drop("kb"), b.withColumn("k", F.struct(group, "kb")).drop(group, "kb"), "k")
    far = (F.col("pb") - F.col("pa")) * F.signum(F.col("most")).cast("int")
    return both.where((far > 0) & (far <= F.abs("most")) & (F.col("ta") != F.col("tb"))).select(group, "subject", "object", "predicate")


def nearest(points: DataFrame, key: str, vector: str, queries: Column, k: int, distance, block: int = 20_000) -> DataFrame:
    """The ``k`` nearest other points of each query point, exactly: the queries go against blocks of points, each block keeps
    its own best ``k``, and only those meet. ``queries`` says which points ask; they are a stated set. There are as many
    blocks as the session has shuffle partitions, more where a block would have over ``block`` points."""
    asked = points.where(queries).select(F.col(key).alias("q"), F.col(vector).alias("_qv"))
    blocks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // block))
    asked = asked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = points.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    pairs = asked.join(held, "_b").where(F.col("q") != F.col(key)).withColumn("distance", distance(F.col("_qv"), F.col(vector)))
    near = pairs.select("q", "_b", key, "distance").withColumn("_rn", F.row_number().over(W.partitionBy("q", "_b").orderBy("distance", key))).where(F.col("_rn") <= k)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", key))).where(F.col("rank") <= k).drop("_b", "_rn")


def within_budget(df: DataFrame, key: str, order: Column, size: str, budget: int) -> DataFrame:
    """Of each key the rows in that order while their sizes fit the budget, up to the first that doesn't. Sizes aren't
    negative, so what doesn't fit within a hash part of the key's rows fits nowhere: hot keys are cut before their rows meet."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(32))

    def fits(rows: DataFrame, *keys: str) -> DataFrame:
        total = F.sum(size).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
        return rows.withColumn("total", total).where(F.col("total") <= budget)

    return fits(fits(df.withColumn("_salt", salt), key, "_salt").drop("_salt", "total"), key)


def ancestors(edges: DataFrame, child: str, parent: str, rounds: int = 20) -> DataFrame:
    """``(node, ancestor, depth)`` of a tree of parent edges: paths double each round, so ``rounds`` bounds depth at 2^rounds."""
    paths = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).where("ancestor is not null").distinct()
    n = -1
    for _ in range(rounds):
        further = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths = paths.unionByName(further).distinct()
        m = paths.count()
        if m == n:
            break
        n = m
    return paths
